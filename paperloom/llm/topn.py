"""Top N items within every group (problem 5).

Secondary sort: rows are hash-partitioned by group, each partition is sorted by group, score
and identifier, and Arrow batches stream through a counter that emits the first N rows of
each group and holds nothing but the current group's name and count.

The same sort-and-stream step runs once before the shuffle, on each input partition, so a
group's rows shrink to N a partition before they travel: a group with a third of all rows
sends no more than N rows a partition to its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_n(n: int, ranked: bool):
    """Batches sorted by their first column in, the first n rows of each of its runs out; ranked: with rnk as second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            group = batch.column(0)
            new = np.ones(rows, bool)
            if rows > 1:
                new[1:] = pc.not_equal(group.slice(1), group.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            goes_on = group[0].as_py() == current and current is not None
            if goes_on:
                new[0] = False
            at = np.arange(rows)
            start = np.maximum.accumulate(np.where(new, at, -seen if goes_on else 0))
            rank = at - start + 1
            keep = rank <= n
            last = group[rows - 1].as_py()
            current, seen = last, int(rank[-1])
            out = batch.filter(pa.array(keep))
            if ranked:
                columns = [out.column(0), pa.array(rank[keep].astype(np.int32)), *out.columns[1:]]
                out = pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "rnk", *batch.schema.names[1:]])
            yield out

    return run


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int = 10) -> DataFrame:
    """group, rnk int, ident of the n highest scores of each group; of equal scores the lower ident comes first.

    Rows with a null group, or a null or NaN score, take no part. Groups with fewer rows give
    them all; -0.0 equals 0.0. Repeated rows are items of their own. n <= 0 and empty tables
    give no rows. Other columns are not read, whatever their names.
    """
    rows = df.select(F.col(group).alias("g"), (F.col(score) + F.lit(0.0)).alias("s"), F.col(ident).alias("i")).where("g is not null and s is not null and not isnan(s)")
    kinds = dict(rows.dtypes)
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    head = rows.sortWithinPartitions(*order).mapInArrow(_first_n(n, False), f"g {kinds['g']}, s {kinds['s']}, i {kinds['i']}")
    best = head.repartition(F.col("g")).sortWithinPartitions(*order).select("g", "i").mapInArrow(_first_n(n, True), f"g {kinds['g']}, rnk int, i {kinds['i']}")
    return best.select(F.col("g").alias(group), "rnk", F.col("i").alias(ident))
