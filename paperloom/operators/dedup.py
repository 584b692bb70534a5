"""First-wins and last-wins by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The row with the lowest (or highest, if last) `order` of each key, all columns.

    An aggregate, so a key with many copies is combined before the shuffle. Null keys are a
    key of their own; rows with a null order lose to all others; rows of a table without rows
    give none. `order` should be unique: of equal rows any may stay.
    """
    others = [c for c in df.columns if c not in keys]
    best = (F.max_by if last else F.min_by)(F.struct(*others), F.coalesce(F.col(order), F.lit(-(2**62) if last else 2**62)))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col("_best")[c].alias(c) for c in others]).select(*df.columns)
