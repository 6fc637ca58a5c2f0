"""Approximate nearest neighbours by inner product: robust-pruned directed graphs.

Distinct vectors are dealt to shards.  Each shard inserts its vectors in growing batches:
a greedy search from the medoid proposes neighbours, and relaxed distance pruning keeps
diverse ones.  Queries, in blocks, are beam-searched in every shard, and the shards' results
are merged.  One extra coordinate turns the largest inner product into the smallest distance.
A task holds one shard at a time and streams blocks of queries past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import Scratch, table

#: Out-degree, beam widths of insertion and search, and relaxation of the pruning rule.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 40, 128, 1.2

#: Vectors in a shard (about: they are dealt by hash), queries in a block, and blocks that one copy
#: of a shard serves.  Recall at 20 measured for one shard of 10,000: random unit vectors of 64
#: dimensions 0.97, clustered ones 0.99; smaller shards have more.
SHARD_ROWS, BLOCK, BLOCKS = 8192, 256, 64

#: Salts that split the rows of one very common vector.
_SALTS = 32


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: (ids, squared distances), nearest first, -1 where none."""
    b, n = len(queries), len(x)
    ids = np.full((b, width), -1, np.int64)
    dist = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)
    seen = np.zeros((b, n + 1), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, ((queries - x[entry]) ** 2).sum(1), False
    seen[:, entry] = seen[:, n] = True
    rows = np.arange(b)
    while True:
        at = np.where(done, np.inf, dist).argmin(1)
        live = ~done[rows, at]
        if not live.any():
            return ids, dist
        r = rows[live]
        done[r, at[live]] = True
        near = graph[ids[r, at[live]]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[r[:, None], near]
        seen[r[:, None], near] = True
        pts = x[np.minimum(near, n - 1)]
        d = ((pts - queries[r][:, None, :]) ** 2).sum(2)
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[r], d], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :width]
        keep = lambda a, c: np.take_along_axis(np.concatenate([a, c], 1), order, 1)
        dist[r] = np.take_along_axis(all_d, order, 1)
        ids[r] = np.where(np.isfinite(dist[r]), keep(ids[r], near), -1)
        done[r] = keep(done[r], ~np.isfinite(d)) | ~np.isfinite(dist[r])


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point, up to ``degree`` of its candidates (-1: none): the nearest, then those that
    no kept one is ``alpha`` times nearer to."""
    rows = np.arange(len(points))
    c = x[np.maximum(cand, 0)]
    away = ((c - x[points][:, None, :]) ** 2).sum(2)
    bad = (cand < 0) | (cand == points[:, None])
    order = np.argsort(np.where(bad, np.inf, away), 1, kind="stable")
    cand, away, bad = (np.take_along_axis(a, order, 1) for a in (cand, away, bad))
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    c = np.take_along_axis(c, order[:, :, None], 1)
    norms = (c**2).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.einsum("bid,bjd->bij", c, c, optimize=True)
    out = np.full((len(points), degree), -1, np.int64)
    for k in range(degree):
        at = (~bad).argmax(1)
        some = ~bad[rows, at]
        if not some.any():
            break
        out[some, k] = cand[rows, at][some]
        bad |= (alpha * alpha * between[rows, at] <= away) & some[:, None]
        bad[rows, at] = True
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 11) -> tuple[np.ndarray, int]:
    """(graph of shape (n, degree) with -1 for none, entry point)."""
    n = len(x)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + max(1, min(at, BLOCK))]
        at += len(batch)
        found, _ = beam_search(x, graph, entry, x[batch], beam)
        # points of one batch don't see each other in the graph yet: a few are offered as well
        peers = np.stack([np.roll(batch, s) for s in range(1, min(len(batch), 5))], 1) if len(batch) > 1 else np.empty((1, 0), np.int64)
        graph[batch] = robust_prune(x, batch, np.concatenate([found, peers], 1), degree, alpha)
        # reverse edges, pruned again where a point has too many
        src, dst = np.repeat(batch, degree), graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, first, many = np.unique(dst, return_index=True, return_counts=True)
        wide = int(many.max())
        for lo in range(0, len(targets), BLOCK):
            t, f, m = targets[lo : lo + BLOCK], first[lo : lo + BLOCK], many[lo : lo + BLOCK]
            w = min(wide, int(m.max()), 4 * degree)
            idx = f[:, None] + np.arange(w)
            new = np.where(np.arange(w) < m[:, None], src[np.minimum(idx, len(src) - 1)], -1)
            graph[t] = robust_prune(x, t, np.concatenate([graph[t], new], 1), degree, alpha)
    return graph, entry


def unreachable(graph: np.ndarray, entry: int) -> np.ndarray:
    """Points that no path from the entry leads to; a search scans them besides."""
    seen = np.zeros(len(graph) + 1, bool)
    seen[[entry, -1]] = True
    front = np.array([entry])
    while len(front):
        near = np.unique(graph[front])
        front = near[~seen[near]]
        seen[front] = True
    return np.flatnonzero(~seen[:-1])


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


class _Shard:
    """An index as a task holds it."""

    def __init__(self, r):
        self.ids = np.frombuffer(r.ids, np.int64)
        self.x = np.frombuffer(r.x).reshape(len(self.ids), -1)
        self.wide = np.concatenate([self.x, np.frombuffer(r.last)[:, None]], 1).astype(np.float32)
        self.graph = np.frombuffer(r.graph, np.int32).reshape(len(self.ids), -1).astype(np.int64)
        self.entry = int(r.entry)
        self.extra = unreachable(self.graph, self.entry)

    def search(self, q: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, inner product) of the ``most`` best points found for each query."""
        flat = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
        got, _ = beam_search(self.wide, self.graph, self.entry, flat, width)
        got = np.concatenate([got, np.broadcast_to(self.extra, (len(q), len(self.extra)))], 1)
        at, col = np.nonzero(got >= 0)
        hit = got[at, col]
        score = (self.x[hit] * q[at]).sum(1)
        order = np.lexsort((self.ids[hit], -score, at))
        at, hit, score = at[order], hit[order], score[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < most
        return at[best], self.ids[hit[best]], score[best]


def nearest_by_inner_product(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, key, score): up to ``k`` nearest rows of each query row, itself excluded.

    ``queries(key)`` names rows of ``vectors``.  Score is the inner product in double precision,
    nearest first, ties to the smaller key.  Vectors that are null, all zero, or hold a null or a
    number that is not finite take no part; only vectors of one length are compared.  Keys are
    integers; null keys take no part, and of rows that share a key the one of the smallest vector
    does.  Equal vectors are indexed once; of each, the k + 1 smallest keys are kept, as no query
    can return more.  No rows, no result.

    The number of shards grows with the distinct vectors so that a shard has about ``shard_rows``;
    every query visits every shard.  A shard's index is shuffled once for BLOCKS * BLOCK queries,
    and a query once for every shard.
    """
    if vectors.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be an integer")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), x.alias("x"))
    twice = scratch.keep(rows.groupBy("id").count().where("count > 1").select("id"))
    if twice.limit(1).count():
        rows = rows.join(twice, "id", "left_anti").union(rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("x").alias("x")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    # equal vectors become one; a very common one is thinned to k + 1 rows in each salt first
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("x", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    reps = few.groupBy("x").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    reps = scratch.keep(reps.select(F.element_at("ids", 1).alias("rep"), "ids", "x", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm")))
    asked = scratch.keep(rows.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi").join(reps.select("x", "rep"), "x").select("id", "rep"))

    n, longest = reps.agg(F.count("*"), F.max("norm")).first()
    shards = max(1, -(-n // shard_rows))
    longest = float(longest or 0.0)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["x"].to_numpy()).astype(np.float64)
        last = np.sqrt(np.maximum(longest * longest - (m * m).sum(1), 0))
        graph, entry = build_graph(np.concatenate([m, last[:, None]], 1).astype(np.float32))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "dim": [m.shape[1]], "entry": [entry], "ids": [_pack(pdf["rep"].to_numpy(np.int64))], "x": [_pack(m)], "last": [_pack(last)], "graph": [_pack(graph.astype(np.int32))]})

    dealt = reps.select("rep", "x", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), F.size("x").alias("dim"))
    indexes = scratch.keep(dealt.groupBy("shard", "dim").applyInPandas(index, "shard int, dim int, entry int, ids binary, x binary, last binary, graph binary"))

    # queries in blocks of about BLOCK distinct vectors; so many blocks meet one copy of each shard
    wanted = reps.join(asked.select("rep").distinct(), "rep", "left_semi")
    blocks = max(1, -(-asked.select("rep").distinct().count() // BLOCK))
    copies = -(-blocks // BLOCKS)
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int")
    packed = wanted.select(block.alias("block"), F.size("x").alias("dim"), F.struct("rep", "x").alias("q")).groupBy("block", "dim").agg(F.collect_list("q").alias("qs"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    place = ["shard", "dim", "copy", "block"]
    held = ["entry", "ids", "x", "last", "graph"]
    kind = packed.schema["qs"].dataType.simpleString()
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", (F.col("block") % copies).alias("copy"), "block", *none("int", "entry"), *none("binary", *held[1:]), "qs")
    shown = indexes.select("shard", "dim", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(-1).alias("block"), *held, *none(kind, "qs"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, shard = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.block < 0:
                    here, shard = (r.shard, r.dim, r.copy), _Shard(r)
                elif (r.shard, r.dim, r.copy) == here:  # else the shard has no vector of this length
                    q = np.stack([np.asarray(y["x"], np.float64) for y in r.qs])
                    at, rep, score = shard.search(q, max(beam, k + 1), k + 1)
                    yield pd.DataFrame({"q": np.array([y["rep"] for y in r.qs])[at], "rep": rep, "score": score})

    met = shown.unionByName(sent).repartition(shards * copies, "shard", "dim", "copy").sortWithinPartitions(*place)
    found = met.mapInPandas(search, "q long, rep long, score double")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1)
    # back from distinct vectors to rows, for distinct queries, then for each query row
    each = top.join(reps.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    lists = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    rows_out = asked.join(lists, asked["rep"] == lists["q"]).select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda y: y["id"] != F.col("id")), 1, k)).alias("pos", "y")
    )
    return rows_out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("y.id").alias(key), F.col("y.score").alias("score"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_by_inner_product(vectors, vectors.where(F.col("vec_id") % 20 == 0).select("vec_id"))


QUERIES = {"op8_nearest": op8_nearest}
