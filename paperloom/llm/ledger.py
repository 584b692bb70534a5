"""Duplicates hidden by formatting differences (problem 2).

An incremental ledger holds, per canonical key, the number of rows seen and the earliest
representative, in tables bucketed by the key. A batch is reduced to one row per key before any
shuffle (partial aggregation) and becomes a table of its own with the same buckets. Tables meet
in full outer joins of matching buckets (no side is shuffled), counts are added and the earliest
representative is retained. They are joined for good as soon as the newer one has at least
1 / RATIO of the older one's keys, else when the ledger is read: so a small batch costs what it
holds, not what the ledger holds, each key is rewritten a logarithmic number of times, and
there are never more than a logarithmic number of tables.

A key's hot rows never meet in one task: counts are combined before the shuffle, and where
rows are joined back to the ledger (`copies`), keys with more than 1/HOT of all rows (at
most HOT of them, so their broadcast is bounded) are joined by broadcast, the rest by bucket.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import shared_path

#: Keys with more than this share of all rows are hot: 1 / HOT.
HOT = 200
#: A table is joined with the next newer one once that has this part of its keys: 1 / RATIO.
RATIO = 4

#: Unicode white space, the separators U+001C to U+001F, and the categories P*.
_FORMATTING = r"[\p{IsWhite_Space}\x{1C}-\x{1F}\p{P}]+"


def canonical(text: Column) -> Column:
    """Text without letter case, white space and punctuation; '' for null.

    Symbols and accents stay. Upper case before lower case makes one of such forms as ß and
    SS; formatting goes in between, since lower-casing looks at neighbours (and since the
    optimizer drops an upper() directly inside a lower()).
    """
    return F.lower(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), _FORMATTING, ""))


def canonical_key(*fields: str) -> Column:
    """128-bit key of the fields' canonical forms, null where a field has nothing left."""
    forms = [canonical(F.col(f)) for f in fields]
    whole = forms[0] != ""
    for form in forms[1:]:
        whole &= form != ""
    return F.when(whole, F.unhex(F.md5(F.concat_ws("\x00", *forms))))


class Ledger:
    """Bucketed counts of canonical keys: key binary, n bigint, keep_ord bigint.

    buckets: fixed for the ledger's life; by default the session's shuffle partitions, so that
    a batch's exchange and the ledger's buckets agree. Tables lie in the folder the session
    shares; those joined into another are dropped once that is written, so a failed update
    leaves the ledger as it was.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str, int]] = []  # name, path and keys of each table, the oldest first

    def table(self) -> DataFrame:
        """All keys; the full outer joins of the tables are formed when it is read."""
        if not self.runs:
            return self.spark.createDataFrame([], "key binary, n bigint, keep_ord bigint")
        return reduce(_joined, [self.spark.table(name) for name, _, _ in self.runs])

    def update(self, batch: DataFrame, fields: tuple[str, ...], order: str) -> None:
        """Add a batch. Rows whose fields have nothing left take no part; an empty batch changes nothing."""
        fresh = batch.select(canonical_key(*fields).alias("key"), F.col(order).alias("o")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("o").alias("keep_ord"))
        written = self._write(fresh)
        if not written[2]:
            self._drop([written])
            return
        runs = [*self.runs, written]
        done: list[tuple[str, str, int]] = []
        while len(runs) > 1 and runs[-1][2] * RATIO >= runs[-2][2]:
            old, new = runs[-2:]
            runs[-2:] = [self._write(_joined(self.spark.table(old[0]), self.spark.table(new[0])))]
            done += [old, new]
        self.runs = runs
        self._drop(done)

    def drop(self) -> None:
        """Drop the ledger's tables."""
        self._drop(self.runs)
        self.runs = []

    def _write(self, rows: DataFrame) -> tuple[str, str, int]:
        name, path = f"ledger_{uuid.uuid4().hex}", shared_path(self.spark, "ledger")
        rows.write.option("path", path).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name, path, self.spark.table(name).count()

    def _drop(self, runs: list[tuple[str, str, int]]) -> None:
        for name, path, _ in runs:
            self.spark.sql(f"drop table {name}")
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _joined(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' keys with the sums of their counts and the earlier representative."""
    old = old.select("key", F.col("n").alias("n0"), F.col("keep_ord").alias("k0"))
    return old.join(new, "key", "full_outer").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"), F.least("keep_ord", "k0").alias("keep_ord"))


def in_batches(ledger: Ledger, df: DataFrame, fields: tuple[str, ...], order: str, batches: int) -> Ledger:
    """Feed df to the ledger in so many batches of arrival (equal ranges of `order`)."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return ledger
    width = (high - low) // batches + 1
    for b in range(batches):
        start = low + b * width
        ledger.update(df.where(F.col(order).between(start, start + width - 1)), fields, order)
    return ledger


def copies(df: DataFrame, ledger: Ledger, fields: tuple[str, ...], order: str) -> DataFrame:
    """keep_ord, copy_ord: each further row of a record beside its representative.

    `order` is unique and not null; rows with the same key are copies however often a row is
    repeated under another `order`. Null, blank and punctuation-only fields give no copies.
    """
    known = ledger.table().where("n > 1")
    total = ledger.table().agg(F.sum("n")).first()[0] or 0
    keyed = df.select(canonical_key(*fields).alias("key"), F.col(order).alias("copy_ord")).where("key is not null")
    limit = max(total // HOT, 10_000)
    hot = known.where(F.col("n") > limit)
    cold = keyed
    parts = []
    if hot.limit(1).count():
        parts.append(keyed.join(F.broadcast(hot), "key"))
        cold = keyed.join(F.broadcast(hot), "key", "left_anti")
    parts.append(cold.join(known.where(F.col("n") <= limit), "key"))
    out = parts[0] if len(parts) == 1 else parts[0].select("keep_ord", "copy_ord").unionByName(parts[1].select("keep_ord", "copy_ord"))
    return out.where("copy_ord > keep_ord").select("keep_ord", "copy_ord")
