"""Clustering, importance resampling and fingerprints against brute force; nulls, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventlens.llm import clustering, fingerprints, importance
from eventlens.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 11 ----------------------------------------------------------------------------------------------
def naive_clusters(rows, k, rounds, dim, scale, seed="1:"):
    """rows: (id, list or None); Python integers throughout."""
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: ("~" if r[0] is None else sha(f"{seed}{r[0]}"), r[1]))[:k]]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n])) if groups[n] else c for n, c in enumerate(cents)]
    return sorted((repr(i), near(v)[1], near(v)[0]) for i, v in kept), cents


@pytest.mark.parametrize("k", [1, 4, 50])
def test_clusters_against_brute_force(spark, k):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(scale=0.3, size=6)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # a hot vector
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]  # repeated and null keys
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [None] + [1.0] * 5), (204, [float("nan")] * 6), (205, [float("inf")] + [0.0] * 5), (206, [0.0] * 6), (207, [-0.01] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, b"x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, c int, v binary")
    found, cents = clustering.cluster(df, k=k, rounds=3, dim=6, scale=64)
    want, want_cents = naive_clusters(rows, k, 3, 6, 64)
    assert [tuple(c) for c in cents.tolist()] == want_cents
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == want
    assert found.columns == ["vec_id", "cluster", "distance"]


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    for df in (none, none.limit(0)):
        found, cents = clustering.cluster(df)
        assert found.count() == 0 and cents.shape == (0, 64)
    huge = spark.createDataFrame([(1, [1e30] * 64), (2, [1.0] * 64)], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in clustering.cluster(huge)[0].collect()] == [2]


def test_pivots_rule_out_but_never_the_nearest():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, size=(16, 8))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-25, 25, size=(3000, 8))
    pivots = x[:16].copy()
    cents = centres + rng.integers(-3, 3, size=centres.shape)
    low = clustering.lower_bounds(clustering.pivot_distances(x, pivots), clustering.pivot_distances(cents, pivots), clustering.pivot_pairs(pivots))
    exact = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (low <= np.sqrt(exact)).all()
    found, d, made = clustering.nearest_centroid(x, low, cents)
    assert (found == exact.argmin(1)).all() and (d == exact.min(1)).all()
    assert made < 0.5 * exact.size  # most comparisons are saved
    # equal pivots give no pair, and no pair no bound
    assert clustering.pivot_pairs(np.ones((3, 8), np.int64)) == []


# 12 ----------------------------------------------------------------------------------------------
def naive_features(t, n):
    ws = WORD.findall((t or "").translate(LOW))
    return [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)], len(ws)


def naive_resample(rows, target, n, buckets, least, percent):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(b(f) for x in xs for f in naive_features(x, n)[0]) for xs in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float((t[i] + 1) * (big_s + buckets)) / float((s[i] + 1) * (big_t + buckets)))) for i in range(buckets)]
    out = []
    for key, text in rows:
        fs, words = naive_features(text, n)
        weight = sum(gain[b(f)] for f in fs) // len(fs) if fs else 0
        h = int(sha(f"2024:{'null' if key is None else key}")[:8], 16)
        out.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    pool = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(pool[: percent * len(pool) // 100]):
        r.append(i + 1)
    return sorted(tuple(map(repr, [*r[:4], r[5] if len(r) > 5 else None])) for r in out)


TEXTS = [None, "", "\n\n", "a b\nc", "The cat\nsat on the mat\n", "THE cat\r\nsat", "É é\nñ 安", "one line only " * 40, "line\n" * 500, "mat " * 3000, "\x00 x\x1cy"]


@pytest.mark.parametrize("n,percent", [(1, 50), (3, 34), (1, 0)])
def test_resampling_against_brute_force(spark, n, percent):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "a b c"), (None, "a b c"), (3, "another text"), (3, "another text")]
    df = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, score int, rank int, _row string")
    target = ["the cat sat", None, "", "mat\nmat c"]
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, least_words=3, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    plain = sorted(tuple(map(repr, r)) for r in got.collect())
    want = naive_resample(rows, target, n, 97, 3, percent)
    # rows that tie in everything may hold each other's rank
    assert sorted(r[:4] for r in plain) == sorted(r[:4] for r in want) and sorted(r[4] for r in plain) == sorted(r[4] for r in want)
    whole = {r for r in plain if r[0] not in ("None", "3")}
    assert whole == {r for r in want if r[0] not in ("None", "3")}


def test_segments_count_as_whole_texts_do(spark):
    df = table(spark, SF, "documents").select("text")
    texts = [r["text"] for r in df.collect()]
    for n in (1, 2):
        want = collections.Counter(zlib.crc32(f.encode()) % 1000 for t in texts for f in naive_features(t, n)[0])
        assert {r["bucket"]: r["n"] for r in importance.feature_counts(df, n=n, buckets=1000).collect()} == dict(want)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert [r["rank"] for r in importance.resample(some, none, percent=100).collect()] == [1]


def test_ranks_over_ranges_of_ties(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("score"), "id")
    got = importance.ranked(rows, [F.desc("score"), F.asc("id")], Scratch(spark, "t"), 3000).collect()
    want = sorted(((i % 3, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))[:3000]
    assert [(r["score"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 3001))


# 13 ----------------------------------------------------------------------------------------------
def naive_lanes(text):
    total = np.zeros(fingerprints.LANES, np.int64)
    for p in re.split(r"(?<=\n)|(?<=[.!?] )", text or ""):
        h = sha(p)
        words = [int(h[15 * k : 15 * k + 15], 16) for k in range(fingerprints.WORDS)]
        bits = [(w >> (i + up)) & 1 for up in (0, 20, 40) for w in words for i in range(20)]
        total += 2 * np.array(bits) - 1
    return total % (1 << 24)


def naive_likeness(a, b):
    a, b = (np.where(x >= 1 << 23, x - (1 << 24), x).astype(object) for x in (a, b))
    if (a == b).all():
        return 1.0
    return max(0.0, min(1.0, round(float((a * b).sum()) / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())), 6)))


def hexed(v):
    return "".join(f"{x:06x}" for x in v)


def naive_next(rows):
    """Keys in descending order; the order of rows that share a key is free."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return {order[i][0]: order[(i + 1) % len(order)][1] for i in range(len(order))}


def test_fingerprints_against_brute_force(spark, tmp_path):
    texts = ["One. Two! Three?\nFour\n\nFive", None, "", "no end", "One. Two! Three?\nFive\n\nFour", "é安🙂. ñ\n" * 7, "x" * 100_000, "word. " * 3000, "a\n" * 2000, "tab\t. end.\r\n", ""]
    rows = list(enumerate(texts * 2))
    spark.createDataFrame([(i, t, "y", 3) for i, t in rows], "doc_id long, text string, own string, r int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.op13_fingerprints(spark, str(tmp_path)).collect()}
    after = naive_next(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        t, nxt = t or "", after[i] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        own, changed, other = naive_lanes(t), naive_lanes(edited), naive_lanes(nxt)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert r["fingerprint"] == hexed(own) and r["edited_fingerprint"] == hexed(changed)
        assert r["near_edited"] == pytest.approx(naive_likeness(own, changed), abs=2e-6)
        assert r["near_next"] == pytest.approx(naive_likeness(own, other), abs=2e-6)
    assert got[1]["fingerprint"] == got[2]["fingerprint"]  # null reads as empty


def vectors(spark, texts):
    """One row with a column of lanes for each named text."""
    df = spark.createDataFrame(list(texts.items()), "name string, t string")
    got = fingerprints.lanes(df, ["name"], "t")
    return got.agg(*[F.max(F.when(F.col("name") == n, F.col("lanes"))).alias(n) for n in texts])


def test_order_insertion_and_deletion(spark):
    a, b, c = "A b.\n", "C d. ", "E f\n"
    df = vectors(spark, {"a": a, "bc": b + c, "abc": a + b + c, "cab": c + a + b, "abbc": a + b + b + c, "none": ""})
    got = df.select(
        (F.col("abc") == F.col("cab")).alias("order"),
        (fingerprints.written(fingerprints.removed(fingerprints.added(F.col("a"), F.col("bc")), F.col("none"))) == fingerprints.written(F.col("abc"))).alias("sum"),
        fingerprints.likeness(F.col("abc"), fingerprints.read_lanes(fingerprints.written(F.col("abc")))).alias("same"),
        (F.col("abc") == F.col("abbc")).alias("twice"),
    ).first()
    assert got["order"] and got["sum"] and got["same"] == 1.0 and not got["twice"]


def test_chunks_of_a_long_text_add_up(spark, monkeypatch):
    df = spark.createDataFrame([("x", "p. q. r\n" * 50 + "end"), ("y", "")], "name string, t string")
    whole = sorted(map(tuple, fingerprints.lanes(df, ["name"], "t").select("name", fingerprints.written(F.col("lanes"))).collect()))
    monkeypatch.setattr(fingerprints, "CHUNK", 7)
    assert fingerprints.lane_sums(df, ["name"], "t").count() > 20
    assert whole == sorted(map(tuple, fingerprints.lanes(df, ["name"], "t").select("name", fingerprints.written(F.col("lanes"))).collect()))
    assert whole[0][1] == hexed(naive_lanes("p. q. r\n" * 50 + "end"))


def test_likeness_follows_the_shared_share(spark):
    rows = [(i, k, side, "".join(f"{'p' if side == 'a' or j < k else 'q'}{i}-{j}\n" for j in range(60))) for i in range(12) for k in (0, 15, 30, 45, 60) for side in "ab"]
    df = fingerprints.lanes(spark.createDataFrame(rows, "i int, k int, side string, t string"), ["i", "k", "side"], "t")
    of = lambda x: F.max(F.when(F.col("side") == x, F.col("lanes")))
    near = df.groupBy("i", "k").agg(of("a").alias("a"), of("b").alias("b")).select("k", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).toPandas()
    assert ((near["near"] - near["k"] / 60).abs() < 0.35).all()
    assert all(abs(mean - k / 60) < 0.1 for k, mean in near.groupby("k")["near"].mean().items())


def test_next_texts_with_null_and_repeated_keys(spark):
    rows = [(i, f"t{i}") for i in range(-300, 300, 7)] + [(2**63 - 1, "top"), (-(2**63), "least"), (None, "none"), (5, "same"), (5, "same"), (5, "same"), (5, "other")]
    got = fingerprints.with_next(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, guest int")).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    plain = {r["doc_id"]: r["next_text"] for r in got if r["doc_id"] != 5}
    keys = sorted({i for i, _ in rows if i is not None}, reverse=True)
    text = {i: t for i, t in rows if i != 5}
    for a, b in zip(keys, keys[1:]):
        if a != 5:
            assert plain[a] in ({"same", "other"} if b == 5 else {text[b]})
    assert plain[-(2**63)] == "none" and plain[None] == "top"
    fives = collections.Counter((r["text"], r["next_text"]) for r in got if r["doc_id"] == 5)
    below = text[max(k for k in keys if k < 5)]
    assert fives in (collections.Counter({("same", "same"): 2, ("same", "other"): 1, ("other", below): 1}), collections.Counter({("other", "same"): 1, ("same", "same"): 2, ("same", below): 1}))


def test_next_of_one_and_of_none(spark):
    one = spark.createDataFrame([(3, "abcd")], "doc_id int, text string")
    assert [tuple(r) for r in fingerprints.with_next(one).collect()] == [(3, "abcd", "abcd")]
    assert fingerprints.with_next(one.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_next_over_any_number_of_ranges(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(400).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("d"), F.col("id")).alias("text"))
        got = {r["text"]: r["next_text"] for r in fingerprints.with_next(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {f"d{i}": f"d{(i - 1) % 400}" for i in range(400)}


def test_contract_columns(spark):
    kinds = lambda df: dict(df.dtypes)
    assert kinds(clustering.op11_clustering(spark, SF)) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert kinds(importance.op12_resampling(spark, SF)) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert kinds(fingerprints.op13_fingerprints(spark, SF)) == {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}


def test_queries_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    bench = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    got = sorted(tuple(map(repr, r)) for r in importance.op12_resampling(spark, SF).collect())
    assert got == naive_resample(list(docs.itertuples(index=False, name=None)), bench, 1, 10_000, 20, 10)
    vectors = table(spark, SF, "embeddings").select("vec_id", "embedding").toPandas()
    want, cents = naive_clusters([(r.vec_id, list(r.embedding)) for r in vectors.itertuples()], 16, 3, 64, 64)
    rows = clustering.op11_clustering(spark, SF).toPandas()
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in rows.itertuples()) == want
    assert set(rows["inertia"]) == {sum(d for _, _, d in want)}
    assert all(r.centroid_sha256 == sha(",".join(map(str, cents[r.cluster]))) for r in rows.itertuples())
    assert (pd.Series(rows.groupby("cluster")["distance"].sum()) == rows.groupby("cluster")["cluster_inertia"].first()).all()


def test_fine_sketches_bound_the_distance_of_large_sets():
    """Of sets that fill the small sketch, unlike ones are told apart by the fine one, and no bound exceeds the distance."""
    import numpy as np

    from eventlens.llm.buckets import apart_at_least, fine_sketch, parity_sketch

    rng = np.random.default_rng(3)
    for n, other in ((1, 1), (300, 2000), (2000, 2000), (2000, 2500), (5000, 5000)):
        pool = np.unique(rng.integers(0, 1 << 63, n + other, np.uint64))
        for share in (0.0, 0.6, 0.95, 1.0):
            both = int(min(n, other) * share)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n : n + other - both])))
            distance = len(np.setxor1d(a, b))
            bound = apart_at_least(fine_sketch(a), fine_sketch(b))
            assert bound == apart_at_least(fine_sketch(b), fine_sketch(a)) <= distance
            assert (bound == 0) == (distance == 0) or n < 300
            if n == other == 2000 and share == 0.6:
                small = int(np.bitwise_count(parity_sketch(a) ^ parity_sketch(b)).sum())
                assert 180 * small <= 20 * (n + other) < 180 * bound  # at 80 % only the fine one rules the pair out
