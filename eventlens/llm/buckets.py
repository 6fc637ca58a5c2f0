"""Links inside buckets of signatures, verified in waves of pivots.

Each wave compares the first members of every bucket with its others, then forgets these
members and the buckets that lie in one component, until no bucket is left.  A pair that
shares a bucket is thus compared, or already linked by way of others; no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import Scratch
from eventlens.llm.graph import components
from eventlens.llm.shingles import mix

#: 64-bit words of a parity sketch.
SKETCH = 8

#: One member of so many is sampled to find hot buckets, those of HOT_LEAST sampled members or
#: more; the largest HOT_MOST of them are set apart (a longer list would be no hotter).
HOT_SAMPLE, HOT_LEAST, HOT_MOST = 64, 16, 4000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def enough(common: int, a: int, b: int, percent: int) -> bool:
    """Whether common / union is at least percent / 100."""
    return 100 * common >= percent * (a + b - common)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Whether each of 64 * SKETCH ranges of scrambled hashes holds an odd number of elements.

    An element that only one of two sets has flips one bit, so the bits in which two sketches
    differ are a lower bound of the sets' Hamming distance.
    """
    at = mix(s ^ _BASE) >> np.uint64(64 - 9)
    bits = (np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def fine_sketch(s: np.ndarray) -> bytes:
    """A parity sketch of at least twice as many ranges as the set has elements, for sets that fill one of 64 * SKETCH."""
    width = max(9, int(2 * len(s)).bit_length())
    at = mix(s ^ _BASE) >> np.uint64(64 - width)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=1 << width) & 1).astype(np.uint8)).tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the Hamming distance of two sets from their fine sketches.

    The wider one is folded: the parity of two neighbouring ranges is that of both bits together.
    """
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (a, b))
    least = min(len(x), len(y))
    x, y = (v if len(v) == least else np.bitwise_xor.reduce(v.reshape(least, -1), axis=1) for v in (x, y))
    return int(np.count_nonzero(x != y))


def hot_buckets(sampled: DataFrame) -> list[int]:
    """The ``sig`` of the largest buckets, from one of HOT_SAMPLE members (see ``in_sample``): at most HOT_MOST."""
    counted = sampled.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST)
    return [r[0] for r in counted.orderBy(F.desc("n"), "sig").limit(HOT_MOST).collect()]


def in_sample(member: Column | str) -> Column:
    """Whether a member is sampled; by its hash alone."""
    return F.pmod(F.xxhash64(member), F.lit(HOT_SAMPLE)) == 0


def shared(each: DataFrame, hot: list[int]) -> DataFrame:
    """The rows of ``each(sig, id)`` whose bucket has two members or more.

    A hot bucket has many, so its rows pass without being brought together; the list only routes
    rows, the result is the same without it.  ``each`` is read twice, so it had better be a table.
    """
    bucket = Window.partitionBy("sig")
    met = each.where(~F.col("sig").isin(hot)) if hot else each
    met = met.withColumn("low", F.min("id").over(bucket)).withColumn("high", F.max("id").over(bucket)).where("low < high").select("sig", "id").distinct()
    return met.union(each.where(F.col("sig").isin(hot)).select("sig", "id")) if hot else met


def least_holders(each: DataFrame, keys: list[str], on: str) -> DataFrame:
    """The rows of ``each(id, keys...)`` whose keys another id has too, with ``lo``, the smallest such id.

    Rows are brought together by their keys, but for hot values of the key ``on``: their few groups
    are added up before they are shuffled, and broadcast (at most HOT_MOST values, as each ``on``
    has one group).  The list only routes rows.
    """
    hot = hot_buckets(each.where(in_sample("id")).select(F.col(on).alias("sig")))
    low, high = F.min("id").alias("lo"), F.max("id").alias("hi")
    group = Window.partitionBy(*keys)
    met = each.where(~F.col(on).isin(hot)) if hot else each
    met = met.withColumns({"lo": F.min("id").over(group), "hi": F.max("id").over(group)})
    if hot:
        warm = each.where(F.col(on).isin(hot))
        met = met.unionByName(warm.join(F.broadcast(warm.groupBy(*keys).agg(low, high)), keys))
    return met.where("lo < hi").drop("hi")


def link_in_waves(live: DataFrame, sets: DataFrame, links: DataFrame | None, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) from the buckets ``live(sig, id)`` of ``sets(id, n, sketch, s)`` and links known before.

    Two members link when their sets' Jaccard similarity is at least ``percent``; the sizes and
    sketches of a pair bound its distance from below, so most others end inside the join, and larger ones
    most of the rest before their sets are brought together.
    ``live`` and ``sets`` are tables of ``scratch``; both are dropped here.
    """

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for a, b in zip(left, right):
                both = np.sort(np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))), kind="stable")
                out.append(enough(int(np.count_nonzero(both[1:] == both[:-1])), len(a) // 8, len(b) // 8, percent))
            yield pd.Series(out, dtype=bool)

    @F.pandas_udf("binary")
    def finely(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sets in batches:
            yield pd.Series([fine_sketch(np.frombuffer(s, np.uint64)) for s in sets], dtype=object)

    @F.pandas_udf("boolean")
    def close(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for left, right, sizes in batches:
            yield pd.Series([(100 + percent) * apart_at_least(a, b) <= (100 - percent) * n for a, b, n in zip(left, right, sizes)], dtype=bool)

    parity = [f"k{i}" for i in range(SKETCH)]
    outer = sets.select("id", "n", *[F.get("sketch", F.lit(i)).alias(k) for i, k in enumerate(parity)])
    other = outer.select(*[F.col(x).alias(f"a{x}") for x in ("id", "n", *parity)])
    apart = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"a{k}"))) for k in parity), F.lit(0))
    may_link = (100 * F.least("n", "an") >= percent * F.greatest("n", "an")) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("an")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link.  Sets are large, so pairs meet as fine sketches first; sets in none of the rest don't move."""
        some = lambda x: fine.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("f").alias(f"f{x}"))
        near = pairs.join(some("b"), "b").join(some("a"), "a").select("a", "b", close("fa", "fb", F.col("na") + F.col("nb")).alias("ok"))
        near = scratch.keep(near.where("ok").select("a", "b"))
        scratch.forget_shuffles()
        side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")).join(near.select(x).distinct(), x, "left_semi")
        compared = near.join(side("b"), "b").join(side("a"), "a")
        return compared.select("a", "b", linked("sa", "sb").alias("ok")).where("ok").select("a", "b")

    def opened(comps: DataFrame, pivots: int) -> DataFrame:
        """The rows of ``live`` beyond the first members of their buckets, with their components: of buckets with several."""
        top = F.max(F.when(F.col("r") == pivots, F.col("id")))
        heads = live.select("sig", "id", F.row_number().over(Window.partitionBy("sig").orderBy("id")).alias("r")).where(F.col("r") <= pivots)
        top = heads.groupBy("sig").agg(top.alias("top")).where("top IS NOT NULL") if pivots > 1 else live.groupBy("sig").agg(F.min("id").alias("top"))
        rest = live.select("sig", "id").join(top, "sig").where(F.col("id") > F.col("top")).drop("top")
        rest = scratch.keep(rest.join(comps.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("c")))
        open_ = scratch.keep(rest.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig"))
        out = scratch.keep(rest.join(open_, "sig"))
        for df in (live, rest, open_):
            scratch.drop(df)
        scratch.forget_shuffles()
        return out

    if not live.limit(1).count():
        scratch.drop(sets)
        return components(links, scratch) if links is not None else live.select(F.col("id").alias("node"), F.col("id").alias("component"))

    fine = scratch.keep(sets.select("id", "n", finely("s").alias("f")))

    # the first wave: each member meets its bucket's smallest.  A pair that links shares most of its buckets,
    # so pairs are made distinct first, and only then get their sketches
    least = live.groupBy("sig").agg(F.min("id").alias("aid"))
    met = live.join(least, "sig").where(F.col("aid") < F.col("id")).select("aid", "id").distinct()
    done = scratch.keep(met.join(outer, "id").join(other, "aid").where(may_link).select(F.col("aid").alias("a"), F.col("id").alias("b")))
    scratch.forget_shuffles()
    found = verified(done)
    links = scratch.keep(found if links is None else links.union(found))
    comps = scratch.keep(components(links, scratch))
    scratch.forget_shuffles()
    live, pivots = opened(comps, 1), 64
    while live.limit(1).count():
        # the smallest members of each bucket: only so many of each leave a task that reads a part of it,
        # without their sketches, which join later; a table, with which joins split large buckets
        rank = F.row_number().over(Window.partitionBy("sig").orderBy("id"))
        first = live.withColumn("r", rank).where(F.col("r") <= pivots).join(outer, "id")
        heads = scratch.keep(first.select("sig", *[F.col(x).alias(f"a{x}") for x in ("id", "c", "n", *parity)]))
        near = live.join(outer, "id").join(heads, "sig").where((F.col("aid") < F.col("id")) & (F.col("ac") != F.col("c")) & may_link)
        pairs = scratch.keep(near.select(F.col("aid").alias("a"), F.col("id").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
        scratch.drop(heads)
        scratch.forget_shuffles()
        # only what is new is written; the tables before it stay
        fresh = scratch.keep(verified(pairs))
        links, done = links.union(fresh), done.union(pairs)
        if fresh.limit(1).count():
            before, comps = comps, scratch.keep(components(links, scratch))
            scratch.drop(before)
        scratch.forget_shuffles()
        live, pivots = opened(comps, pivots), pivots * 64
    scratch.drop(sets)
    scratch.drop(fine)
    return comps
