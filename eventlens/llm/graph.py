"""Connected components over a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import Scratch

#: Most links (counted) of which a table of one row for each node is broadcast.
BROADCAST_LINKS = 50_000


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of ``links(a, b)``: (node, component).

    Alternates the large-star and small-star steps: each node hands the smallest
    neighbour to the larger (then the smaller) neighbours, until every link points
    at its component's smallest node.  Rounds grow with the logarithm of the longest
    chain.  Each round is written to the shared folder, so lineage stays short.
    Nulls and self links are ignored; an empty table gives an empty result.
    """
    edges = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    digest = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
    before = digest(edges)
    for _ in range(most_rounds):
        small = before[0] <= BROADCAST_LINKS
        made: list[DataFrame] = []

        def held(df: DataFrame) -> DataFrame:
            """Broadcast, or a table of its own, so that joins with it split the rows of a hub."""
            if small:
                return F.broadcast(df)
            made.append(scratch.keep(df))
            return made[-1]

        # large-star: every larger neighbour (and v itself) moves to v's smallest neighbour
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select("v", "u"))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.join(held(low), "n").where("m > n").select(F.col("m").alias("v"), F.col("low").alias("u"))
        large = large if small else held(large)
        # small-star: v's smaller neighbours move to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        pair = lambda v: F.struct(F.col(v).alias("v"), F.col("low").alias("u"))
        moved = large.join(held(least), "v").select(F.explode(F.array(pair("v"), pair("u"))).alias("e")).select("e.v", "e.u")
        after = scratch.keep(moved.where("v <> u").distinct())
        for df in (edges, *made):
            scratch.drop(df)
        edges, now = after, digest(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # each node but the smallest of its component now has one link, to that smallest one
    out = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return out.union(out.select("component", "component").distinct())
