"""Queries of problem 1: nested payloads as flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators.shred import entities, shred
from paperloom.session import table


def p1_found(spark, sf_dir):
    return entities(table(spark, sf_dir, "papers"), "ord", "raw").select("ord", "kind", "pos", "sub_pos", "item_text")


def p1_nodes(spark, sf_dir):
    return shred(table(spark, sf_dir, "papers"), "ord", "raw")


def p1_entities(spark, sf_dir):
    """All entities with all their scalars, as text of a JSON object with sorted names."""
    rows = entities(table(spark, sf_dir, "papers"), "ord", "raw", scalars=True)
    return rows.withColumn("scalars", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("scalars")))))


QUERIES = {"p1_found": p1_found, "p1_nodes": p1_nodes, "p1_entities": p1_entities}
ORACLE: dict[str, str] = {}
