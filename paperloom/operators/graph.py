"""Citation graphs among each question's selected papers.

All steps are equi-joins keyed by (qid, id): aliases of the selected papers, provider replies
resolved through them, edges kept inside the selection. Only one hop is needed, so there is no
iteration. Ties go to the earlier selection rank, never to arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.identity import alias_forms, aliases
from paperloom.operators.shred import PAPER_ENTITIES, entities

#: Order in which the sources of edges are asked; the first to name an edge is its `via`.
STAGES = {"local": 0, "openalex": 1, "crossref": 2, "s2": 3}


def alias_index(selected: DataFrame) -> DataFrame:
    """qid, alias, canon: each alias of a selected paper (qid, paper_id, sel_rank, j), the first paper winning."""
    forms = selected.where("paper_id is not null").select("qid", "paper_id", "sel_rank", F.explode(aliases(F.col("paper_id"), F.col("j"))).alias("alias"))
    return forms.groupBy("qid", "alias").agg(F.min_by("paper_id", "sel_rank").alias("canon"))


def resolve(rows: DataFrame, key: str, index: DataFrame, by: list[str]) -> DataFrame:
    """rows (with qid) plus canon: the paper that `key` names through any of its forms, the plain form first. Rows without one are left out."""
    forms = rows.select(*by, F.posexplode(alias_forms(F.array(F.col(key)))).alias("priority", "alias"))
    hits = forms.join(index, ["qid", "alias"])
    return hits.groupBy(*by).agg(F.min_by("canon", "priority").alias("canon"))


def replies(selected: DataFrame, edges: DataFrame, seed_k: int = 8, ref_limit: int = 100, cit_limit: int = 50) -> DataFrame:
    """qid, seed, direction, via, target_key, ok, stage: distinct provider replies about the selected papers.

    Local replies count for all of them, the providers' for the first seed_k; one provider's
    lists are limited, in order of the target's key.
    """
    stage = F.lit(None).cast("int")
    for via, n in STAGES.items():
        stage = F.when(F.col("via") == via, n).otherwise(stage)
    asked = selected.where("paper_id is not null").select("qid", F.col("paper_id").alias("seed"), "sel_rank")
    # edges of papers nobody selected go no further than the scan's join
    rows = edges.where("seed_id is not null").select(F.col("seed_id").alias("seed"), "direction", "via", "target_key", F.coalesce("ok", F.lit(False)).alias("ok"), stage.alias("stage")).where("stage is not null")
    rows = rows.join(asked.select("seed").distinct(), "seed", "left_semi").groupBy("seed", "direction", "via", "target_key", "stage").agg(F.max("ok").alias("ok"))
    place = F.row_number().over(Window.partitionBy("seed", "direction").orderBy("target_key"))
    limited = rows.where("via = 's2'").withColumn("place", place).where(F.col("place") <= max(ref_limit, cit_limit))  # a bound that prunes before the shuffle
    limited = limited.where(F.col("place") <= F.when(F.col("direction") == "ref", ref_limit).otherwise(cit_limit)).drop("place")
    rows = rows.where("via <> 's2'").unionByName(limited)
    return asked.join(rows, "seed").where((F.col("via") == "local") | (F.col("sel_rank") <= seed_k)).drop("sel_rank")


def build(selected: DataFrame, edges: DataFrame, crossref_always: bool = False, **limits: int) -> DataFrame:
    """qid, source, target, via: the edges among each question's selected papers.

    References point from the seed, citations to it. Self loops, targets outside and repeats
    are dropped; of repeats the earliest stage stays. Crossref is only asked where the stages
    before gave nothing, unless crossref_always.
    """
    answered = replies(selected, edges, **limits).where("ok and target_key is not null")
    by = ["qid", "seed", "direction", "via", "target_key", "stage"]
    found = resolve(answered, "target_key", alias_index(selected), by)
    out = F.col("direction") == "ref"
    linked = found.select("qid", F.when(out, F.col("seed")).otherwise(F.col("canon")).alias("source"), F.when(out, F.col("canon")).otherwise(F.col("seed")).alias("target"), "via", "stage").where("source <> target")
    if not crossref_always:
        early = linked.where("stage < 2").select("qid").distinct().withColumn("early", F.lit(True))
        linked = linked.join(early, "qid", "left").where("stage <> 2 or early is null").drop("early")
    return linked.groupBy("qid", "source", "target").agg(F.min_by("via", "stage").alias("via"))


def local_edges(selected: DataFrame) -> DataFrame:
    """qid, source, target: references in the selected papers' own payloads (raw) to other selected papers."""
    kinds = [e for e in PAPER_ENTITIES if e.kind == "reference"]
    papers = selected.where("paper_id is not null").select("paper_id", "raw").distinct()
    cited = entities(papers, "paper_id", "raw", kinds).where("item_text <> ''").select("paper_id", F.col("item_text").alias("key")).distinct()
    rows = selected.select("qid", "paper_id").join(cited, "paper_id")
    found = resolve(rows, "key", alias_index(selected), ["qid", "paper_id", "key"])
    return found.where("paper_id <> canon").select("qid", F.col("paper_id").alias("source"), F.col("canon").alias("target")).distinct()


def statistics(selected: DataFrame, edges: DataFrame, built: DataFrame, **limits: int) -> DataFrame:
    """qid, n_nodes, n_edges, n_calls, n_errors, sources_used, reason for every question with a selection."""
    nodes = selected.where("paper_id is not null").groupBy("qid").agg(F.count_distinct("paper_id").alias("n_nodes"))
    asked = replies(selected, edges, **limits).groupBy("qid").agg(F.count("*").alias("n_calls"), F.count_if(~F.col("ok")).alias("n_errors"))
    made = built.groupBy("qid").agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("via")), ",").alias("sources_used"))
    out = nodes.join(asked, "qid", "left").join(made, "qid", "left").fillna(0, ["n_calls", "n_errors", "n_edges"]).fillna("", ["sources_used"])
    return out.withColumn("reason", F.when(F.col("n_edges") > 0, "").when(F.col("n_errors") > 0, "all_sources_failed_or_empty").otherwise("no_in_set_edges"))


def dense_enough(n_edges: Column, n_nodes: Column, min_edges: int = 1, min_density: float = 0.0) -> Column:
    """Whether a graph is worth showing."""
    thin = F.lit(min_density > 0) & (n_nodes > 0) & (n_edges / n_nodes < min_density)
    return (n_edges > 0) & (n_edges >= min_edges) & ~thin


def view(n_edges: Column, n_nodes: Column, wanted: str = "auto", **bars: float) -> Column:
    """list or graph, as wanted; auto asks dense_enough."""
    if wanted.strip().lower() in ("list", "graph"):
        return F.lit(wanted.strip().lower())
    return F.when(dense_enough(n_edges, n_nodes, **bars), "graph").otherwise("list")


def neighbours(edges: DataFrame, direction: str, via: str = "s2", most: int = 100) -> DataFrame:
    """seed_id, target_key, place: distinct targets of each seed from one provider, `most` at most, in order of the key."""
    rows = edges.where((F.col("direction") == direction) & (F.col("via") == via) & F.coalesce("ok", F.lit(False))).where("seed_id is not null and target_key is not null").select("seed_id", "target_key").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("seed_id").orderBy("target_key"))).where(F.col("place") <= most)


def expand(seeds: DataFrame, edges: DataFrame, pool: DataFrame, ref_limit: int = 5, cit_limit: int = 5, most: int = 30) -> DataFrame:
    """qid, place, key: papers the seeds (qid, seed, k_rank) cite or are cited by that aren't in the pool (qid, key).

    Calls are made in order of the seeds, references before citations; a call returns no more
    than is left of `most` when it is made, known papers included, and stops counting there.
    """
    rows = edges.where("coalesce(ok, false) and seed_id is not null and target_key is not null and direction in ('ref', 'cit')").select(F.col("seed_id").alias("seed"), "direction", "target_key").join(seeds.select("seed").distinct(), "seed", "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("seed", "direction").orderBy("target_key"))
    first = rows.withColumn("place", place).where(F.col("place") <= max(ref_limit, cit_limit))
    lists = first.groupBy("seed", "direction").agg(F.array_sort(F.collect_list("target_key")).alias("keys"))
    calls = seeds.join(lists, "seed")
    limit = F.when(F.col("direction") == "ref", ref_limit).otherwise(cit_limit)
    calls = calls.select("qid", "k_rank", F.when(F.col("direction") == "ref", 0).otherwise(1).alias("second"), F.slice("keys", 1, limit).alias("keys"))
    known = calls.select("qid", F.explode("keys").alias("key")).distinct().join(pool.select("qid", "key").distinct(), ["qid", "key"]).groupBy("qid").agg(F.collect_set("key").alias("known"))
    lined = calls.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k_rank", "second", "keys"))).alias("calls")).join(known, "qid", "left")
    seen = F.coalesce("known", F.array().cast("array<string>"))

    def call(acc: Column, c: Column) -> Column:
        taken = F.slice(c["keys"], 1, F.greatest(F.lit(most) - F.size(acc), F.lit(0)))
        return F.concat(acc, F.array_except(F.array_except(taken, seen), acc))

    return lined.select("qid", F.posexplode(F.aggregate("calls", F.array().cast("array<string>"), call)).alias("place", "key"))
