"""Exact medians without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks that the values of a group are cut into, at approximate quantiles.
BLOCKS = 256


def block_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, median) of the values that are no nulls; groups without one are absent.

    Equal values are counted first.  Approximate quantiles cut a group's distinct values into
    blocks; block totals tell where the middle ranks lie, and only those blocks are sorted, each
    in a task of its own.  Groups are few (dimensions, columns): their cuts are broadcast.
    """
    at = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    cuts = at.groupBy(*by).agg(F.percentile_approx("v", F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)]), F.lit(10_000)).alias("cuts"), F.sum("k").alias("n"))
    placed = at.join(F.broadcast(cuts), by).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    blocks = placed.groupBy(*by, "b", "n").agg(F.sum("k").alias("k"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    reach = blocks.withColumn("before", F.coalesce(F.sum("k").over(before(*by).orderBy("b")), F.lit(0)))
    middles = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("k"))
    wanted = reach.where(F.exists(middles, holds)).select(*by, "b", "before")
    inside = placed.join(F.broadcast(wanted), [*by, "b"])
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("k").over(before(*by, "b").orderBy("v")), F.lit(0)))
    hit = inside.select(*by, "n", "v", F.size(F.filter(middles, holds)).alias("times")).where("times > 0")
    return hit.groupBy(*by, "n").agg((F.sum(F.col("v") * F.col("times")) / 2).alias("median"))
