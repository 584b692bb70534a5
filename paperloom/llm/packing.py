"""Filling fixed-capacity containers with items of varying length (problem 7).

Mixture-controlled packing. Each source is a queue; a window is a run of containers. Deficit
round-robin gives source s a quantum of share_s x window tokens in every window: the source
serves items while what it has served lies below the sum of its quanta, and what it serves
too much or too little is carried to the next window as its deficit. In closed form, an item
belongs to the window floor(served before it / quantum), so the windows of all partitions
follow from one prefix sum per source: sums per bucket of the queue first, then within
buckets. No queue is ever gathered in one task, and a deficit is carried across partitions
as it is across windows.

Inside a window, whose tokens are bounded, items go into containers by best fit, the largest
first. An item above the capacity alone is divided into full containers and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import materialize

#: Rows a bucket of a queue has on average.
BUCKET_ROWS = 20_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and offset of each item (each at most capacity); largest first, into the fullest container that has room."""
    order = np.argsort(-sizes, kind="stable")
    container, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    opened = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, opened
            opened += 1
        container[i], offset[i] = k, capacity - left
        insort(room, (left - size, k))
    return container, offset


def queue_items(sizes: DataFrame, key: str, source: str, size: str, capacity: int, window_containers: int, targets: dict[str, float] | None = None) -> DataFrame:
    """key, source, piece, start, n, win: the items and the window each is served in.

    sizes must be cheap to read more than once. targets: wanted share of tokens by source;
    sources it doesn't name keep their own share, and all are scaled to a sum of 1. A queue
    that ends leaves later windows to the others. Null sources are the queue ''. Items of
    size 0 or null cost one token in their queue, so that they too are spread over windows.
    """
    rows = sizes.select(F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    # rows that are alike, however many, are numbered, so that no bucket gets all of them
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))).alias("copy")
    rows = materialize(rows.groupBy("k", "src", "n").agg(F.count("*").alias("c")).select("k", "src", "n", copy).withColumn("h", F.xxhash64("k", "n", "copy")), "queues")
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("b", F.pmod("h", F.lit(buckets)).cast("int")).withColumn("cost", F.greatest("n", F.lit(1)))
    sums = rows.groupBy("src", "b").agg(F.sum("cost").alias("cost"))
    totals = sums.groupBy("src").agg(F.sum("cost").alias("total"))
    grand = F.sum("total").over(Window.partitionBy())
    weight = F.col("total") / grand
    if targets:
        named = F.create_map(*[x for s, w in targets.items() for x in (F.lit(s), F.lit(float(w)))])
        weight = F.coalesce(F.try_element_at(named, F.col("src")), weight)
    shares = totals.select("src", weight.alias("weight")).withColumn("quantum", F.greatest(F.col("weight") / F.sum("weight").over(Window.partitionBy()) * F.lit(float(capacity * window_containers)), F.lit(1.0))).select("src", "quantum")
    before = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("src", "b", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("base")).join(shares, "src")
    within = Window.partitionBy("src", "b").orderBy("h", "k", "n", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("src", "b", "k", "n", F.coalesce(F.sum("cost").over(within), F.lit(0)).alias("off")).join(base, ["src", "b"])
    pieces = placed.select("k", "src", "n", "quantum", (F.col("base") + F.col("off")).alias("served"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / F.lit(capacity)) - 1, F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return pieces.select(
        "k", "src", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("n"), F.floor((F.col("served") + start) / F.col("quantum")).cast("bigint").alias("win"), "quantum"
    )


def pack(sizes: DataFrame, key: str, source: str, size: str, capacity: int = 8192, window_containers: int = 128, targets: dict[str, float] | None = None) -> DataFrame:
    """container bigint, offset int, key, piece int, start int, n_tokens int, source: where every item lies.

    Every row of sizes comes out, repeated and null keys included; only items above the
    capacity have more than one piece, each but the last a full container. Items of size 0
    take no room. An empty table gives no rows. Other columns are not read.
    """
    items = queue_items(sizes, key, source, size, capacity, window_containers, targets)
    kind = dict(items.dtypes)["k"]

    def fill(group: pa.Table) -> pa.Table:
        # ties are ordered by the items themselves, never by arrival
        group = group.sort_by([("n", "descending"), ("k", "ascending"), ("piece", "ascending"), ("src", "ascending")])
        sizes = group["n"].to_numpy()
        container, offset = best_fit(sizes, capacity)
        win = group["win"].to_numpy()
        return pa.table(
            {
                "container": pa.array(win * (1 << 20) + container, pa.int64()),
                "offset": pa.array(offset.astype(np.int32)),
                "k": group["k"],
                "piece": group["piece"],
                "start": group["start"].cast(pa.int32()),
                "n_tokens": pa.array(sizes.astype(np.int32)),
                "src": group["src"],
            }
        )

    out = items.drop("quantum").groupBy("win").applyInArrow(fill, f"container bigint, offset int, k {kind}, piece int, start int, n_tokens int, src string")
    return out.withColumnRenamed("k", key).withColumnRenamed("src", source)


def window_mixture(sizes: DataFrame, key: str, source: str, size: str, capacity: int = 8192, window_containers: int = 128, targets: dict[str, float] | None = None) -> DataFrame:
    """win, source, served, quantum, deficit: what each window took from each queue, and what is carried on after it."""
    items = queue_items(sizes, key, source, size, capacity, window_containers, targets)
    served = items.groupBy("win", "src", "quantum").agg(F.sum(F.greatest("n", F.lit(1))).alias("served"))
    run = F.sum("served").over(Window.partitionBy("src").orderBy("win"))
    return served.select("win", F.col("src").alias(source), "served", "quantum", ((F.col("win") + 1) * F.col("quantum") - run).alias("deficit"))


def pack_documents(docs: DataFrame, key: str, source: str, text: str, capacity: int = 8192, window_containers: int = 128, targets: dict[str, float] | None = None, **vocabulary: str) -> DataFrame:
    """pack() of texts measured in tokens; null and empty texts measure 0. The sizes are written to the shared folder once."""
    from paperloom.llm.tokenizer import token_counts

    return pack(materialize(token_counts(docs, [key, source], text, **vocabulary), "sizes"), key, source, "n_tokens", capacity, window_containers, targets)
