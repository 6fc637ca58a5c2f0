"""Centroid clustering in exact integers, with Ptolemaic pivots.

Components become integers floor(scale * x), so that distances, sums and centroids are exact and
runs repeat bit by bit.  The starting centroids serve as pivots: each vector's distances to them
are computed once and kept beside it.  For a pair of pivots p, s Ptolemy's inequality gives

    d(v, c) >= |d(v, p) * d(c, s) - d(v, s) * d(c, p)| / d(p, s)

so most centroids are ruled out without looking at the vector.  The bound is lowered by more than
its rounding error; centroids that survive are compared by their exact squared distance.
Only sums of clusters (k x dimensions numbers) come back to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import Scratch, table

#: Integers of this magnitude or more would not leave room for sums of squares in 64 bits.
LIMIT = 1 << 27

#: Relative slack of a lower bound: far more than the few roundings behind it.
SLACK = 1e-13


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of integer vectors to the pivots, as doubles."""
    out = np.empty((len(x), len(pivots)))
    for i, p in enumerate(pivots):
        out[:, i] = np.sqrt(((x - p) ** 2).sum(1).astype(np.float64))
    return out


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """Each pivot with the next one that differs from it, and their distance."""
    apart = pivot_distances(pivots, pivots)
    pairs = []
    for i in range(len(pivots)):
        for j in (*range(i + 1, len(pivots)), *range(i)):
            if apart[i, j] > 0:
                pairs.append((i, j, float(apart[i, j])))
                break
    return pairs


def lower_bounds(near: np.ndarray, far: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Ptolemaic lower bounds of distances: vectors' pivot distances against centroids' pivot distances."""
    low = np.zeros((len(near), len(far)))
    for i, j, apart in pairs:
        a, b = near[:, i, None] * far[None, :, j], near[:, j, None] * far[None, :, i]
        np.maximum(low, (np.abs(a - b) - SLACK * (a + b)) / apart, out=low)
    return low


def nearest_centroid(x: np.ndarray, low: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance, exact comparisons made); ties go to the smaller number."""
    first = low.argmin(1)
    best = ((x - centroids[first]) ** 2).sum(1)
    found, made = first.astype(np.int64), len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= np.sqrt(best.astype(np.float64)) * (1 + SLACK)) & (first != c))
        d = ((x[rows] - centroids[c]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (c < found[rows]))
        best[rows[better]], found[rows[better]] = d[better], c
        made += len(rows)
    return found, best, made


def integer_vectors(vectors: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(key, x array<long>): vectors of ``dim`` components, none null or non-finite, in integers."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float(LIMIT)))
    kept = vectors.where((F.size(vector) == dim) & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col(key), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, key: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64, seed: str = "1:"
) -> tuple[DataFrame, np.ndarray]:
    """(frame of key, cluster, distance; final centroids): ``rounds`` of exact integer k-means.

    Vectors that are null, have another number of components, or hold a null or a number that
    isn't finite are left out, as are those whose integers reach LIMIT (their squares would not
    fit).  Centroids start as the k vectors with the smallest sha256 of seed and key, in that
    order (null keys last, repeated keys by their vectors); fewer vectors, fewer centroids.  An
    empty cluster keeps its centroid.  Each row has a result, repeated rows too; other columns
    are left out, whatever their names.  Without any vector the frame is empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    rows = integer_vectors(vectors, key, vector, dim, scale)
    name = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    starts = rows.select(F.coalesce(name, F.lit("~")).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    pivots = np.array([r["x"] for r in starts], np.int64).reshape(-1, dim)
    pairs = pivot_pairs(pivots)
    kind = vectors.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
                held = pivot_distances(x, pivots)
                yield pd.DataFrame({key: pdf[key], "v": [r.tobytes() for r in x.astype(np.int32)], "near": [r.tobytes() for r in held]})

    packed = scratch.keep(rows.mapInPandas(pack, f"`{key}` {kind}, v binary, near binary"))

    def unpacked(pdf: pd.DataFrame, centroids: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(pdf["v"]), np.int32).reshape(len(pdf), dim).astype(np.int64)
        near = np.frombuffer(b"".join(pdf["near"]), np.float64).reshape(len(pdf), len(pivots))
        return x, *nearest_centroid(x, lower_bounds(near, far, pairs), centroids)[:2]

    centroids = pivots.copy()
    for _ in range(rounds if len(centroids) else 0):
        far = pivot_distances(centroids, pivots)

        def add_up(batches: Iterator[pd.DataFrame], centroids: np.ndarray = centroids, far: np.ndarray = far) -> Iterator[pd.DataFrame]:
            sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for pdf in batches:
                if len(pdf):
                    x, found, _ = unpacked(pdf, centroids, far)
                    for c in np.unique(found):
                        sums[c] += x[found == c].sum(0)
                    counts += np.bincount(found, minlength=len(centroids))
            met = np.flatnonzero(counts)
            at = np.repeat(met, dim)
            yield pd.DataFrame({"c": at, "i": np.tile(np.arange(dim), len(met)), "total": sums[met].ravel(), "n": counts[at]})

        parts = packed.select("v", "near").mapInPandas(add_up, "c int, i int, total long, n long")
        for r in parts.groupBy("c", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            centroids[r["c"], r["i"]] = r["total"] // r["n"]

    far = pivot_distances(centroids, pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, found, d = unpacked(pdf, centroids, far)
                yield pd.DataFrame({key: pdf[key], "cluster": found, "distance": d})

    out = scratch.keep(packed.mapInPandas(assign, f"`{key}` {kind}, cluster int, distance long"))
    scratch.drop(packed)
    return out, centroids


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    said = [(c, sums.get(c, 0), sum(sums.values()), ",".join(map(str, v.tolist()))) for c, v in enumerate(centroids)]
    about = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, _joined string")
    # one row for each centroid
    told = found.join(F.broadcast(about), "cluster")
    return told.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("_joined", 256).alias("centroid_sha256"))


QUERIES = {"op11_clustering": op11_clustering}


def _sql() -> str:
    """The rounds, written out one after the other over (vector, place, integer) rows."""
    steps = [
        """WITH ok AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
flat AS MATERIALIZED (SELECT vec_id, unnest(x) AS v, unnest(range(64)) AS i FROM ok),
start AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM ok QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS v, unnest(range(64)) AS i FROM start)"""
    ]
    for r in range(4):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, CAST(arg_min(c, (d, c)) AS INTEGER) AS cluster, min(d) AS distance
  FROM (
    SELECT vec_id, c, CAST(sum((f.v - k.v) * (f.v - k.v)) AS BIGINT) AS d
    FROM flat f JOIN c{r} k USING (i) GROUP BY vec_id, c)
  GROUP BY vec_id)"""
        )
        if r < 3:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, k.v) AS v
  FROM c{r} k LEFT JOIN (
    SELECT cluster AS c, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
    FROM flat JOIN a{r} USING (vec_id) GROUP BY cluster, i) m USING (c, i))"""
            )
    steps.append("named AS (SELECT c AS cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)")
    return ",\n".join(steps) + (
        "\nSELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,"
        "\n       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256\nFROM a3 JOIN named USING (cluster)"
    )


ORACLES = {"op11_clustering": _sql()}
