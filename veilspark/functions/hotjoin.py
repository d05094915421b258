"""Equi-joins whose hot keys are cut into cells, so no task meets a whole hot group of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.materialize import cut, semi_by_size

BLOCK = 2_000


def _hot(df: DataFrame, keys: list[str], block: int, name: str) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    return n.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias(name))


def blocked_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], block: int = BLOCK, counted: DataFrame | None = None, spread_right: list[str] | None = None, counted_right: DataFrame | None = None) -> DataFrame:
    """Inner join on ``keys``; a key with more than ``block`` rows on a side is cut on that side by a hash of its
    ``spread`` columns.

    A left row is copied to the right blocks of its key and a right row to the left ones, so every pair meets in one
    cell of about block x block pairs and the join stays whole. Without ``spread_right`` the right side holds few
    rows a key and isn't cut. Counts are aggregated before the shuffle; without a hot key this is a plain join.
    ``counted`` and ``counted_right`` are the rows whose keys may be hot, where the caller knows them.
    """
    hot = _hot(left if counted is None else counted, keys, block, "_lefts")
    if spread_right:
        hot = hot.join(_hot(right if counted_right is None else counted_right, keys, block, "_rights"), keys, "full")
    else:
        hot = hot.withColumn("_rights", F.lit(1))
    hot = cut(hot)
    n = hot.count()
    if not n:
        return left.join(right, keys)
    lefts, rights = F.coalesce("_lefts", F.lit(1)), F.coalesce("_rights", F.lit(1))

    def cells(df: DataFrame, own: str, other: str, mine, theirs, by: list[str]) -> DataFrame:
        df = semi_by_size(df, hot, keys, n, "left").withColumn(own, F.pmod(F.xxhash64(*by), mine).cast("int") if by else F.lit(0))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), theirs - 1))).drop("_lefts", "_rights")

    a = cells(left, "_block_a", "_block_b", lefts, rights, spread)
    b = cells(right, "_block_b", "_block_a", rights, lefts, spread_right or [])
    return a.join(b, [*keys, "_block_a", "_block_b"]).drop("_block_a", "_block_b")
