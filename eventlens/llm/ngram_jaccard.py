"""N-gram Jaccard join by PartEnum signatures.

The domain of shingle hashes is cut into partitions, and these into parts; subsets of two of a
partition's three parts are enumerated.  Of two sets at a Hamming distance of at most k, some
partition holds at most one difference, so they agree on a subset and share the signature made of
its elements.  Sizes are banded, since a Jaccard threshold bounds both the sizes and the distance
of a pair.  Very small sets enumerate the subsets that lack one element.  Candidates are verified
exactly, in waves of pivots, and links become components.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.buckets import enough, hot_buckets, in_sample, link_in_waves, parity_sketch, shared
from eventlens.llm.common import Scratch, table
from eventlens.llm.shingles import mix, shingle_sets

#: Texts whose sets a worker holds at once.
SLICE = 256


def least_banded(percent: int) -> int:
    """Smallest size of which two sets that differ in two elements can link.

    Below it, a linked pair is equal or a set and a superset of one more element.
    """
    return -(-2 * percent // (100 - percent))


#: Largest distance of a size band at which first-level partitions are cut again and pairs of
#: their THREE parts are enumerated; beyond, a first-level partition is one part.
ENUMERATED, THREE = 32, 3


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """Size bands (low, high, first-level partitions, parts of each, spare) that reach ``upto``.

    A pair of sizes s <= r belongs to s's band; its distance is at most k.  With one part to a
    partition, the pair agrees on all but k of them.  With three, partitions that hold at most one
    difference, of which all but k // 2 are, agree on two parts of the three.  Either way
    1 + spare partitions or more have an agreeing subset.
    """
    out, low = [], least_banded(percent)
    while low <= upto:
        high = max(low, low * 100 // percent * 100 // percent)
        most = high * 100 // percent
        k = (100 - percent) * (high + most) // (100 + percent)
        parts = THREE if k <= ENUMERATED else 1
        apart = k // 2 if parts == THREE else k
        spare = 1
        for _ in range(4):  # about the number of partitions with an empty subset in a set of size low
            n = apart + 1 + spare
            empty = 3 * n * np.exp(-2 * low / (3 * n)) if parts == THREE else n * np.exp(-low / n)
            spare = int(np.ceil(empty + 3 * np.sqrt(empty)))
        spare = max(1, min(spare, apart + 1))
        out.append((low, high, apart + 1 + spare, parts, spare))
        low = high + 1
    return tuple(out)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a sorted set: any two sets that link, and differ, share one.

    An empty subset of parts gives no signature.  As long as a set has at most ``spare``
    partitions with empty subsets, some agreeing subset is not empty; sets with more add the
    signatures of their prefix tokens, one of which two linked sets share.
    """
    n = len(s)
    if n == 0:
        return np.empty(0, np.int64)
    out: list[np.ndarray] = []
    scrambled = mix(s)
    small = least_banded(percent)
    total = scrambled.sum(dtype=np.uint64) if n <= small else np.uint64(0)
    # smaller sets link to supersets of one more element at most
    if n < small and enough(n, n, n + 1, percent):
        out.append(np.array([total + np.uint64(n)]))
    if 1 < n <= small and enough(n - 1, n - 1, n, percent):
        out.append(total - scrambled + np.uint64(n - 1))
    if n >= small:
        levels = bands(percent, 1 << int(n).bit_length())
        at = bisect_right(levels, (n, 1 << 62)) - 1
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled)))
        for i in (at - 1, at):
            if i < 0 or not enough(levels[i][1], levels[i][1], max(n, levels[i][1]), percent):
                continue
            low, _, parts, each, spare = levels[i]
            # equal ranges of the hash domain; the elements are sorted, so each range is a slice
            cuts = np.empty(parts * each + 1, np.int64)
            cuts[0], cuts[-1] = 0, n
            cuts[1:-1] = s.searchsorted(_edges(parts * each))
            held, sums = np.diff(cuts).reshape(parts, each), (upto[cuts[1:]] - upto[cuts[:-1]]).reshape(parts, each)
            if each == THREE:  # subsets of two of the three parts
                held, sums = held + np.roll(held, 1, 1), sums + np.roll(sums, 1, 1)
            salt = np.uint64(low << 32)
            number = salt + np.arange(parts * each, dtype=np.uint64)
            full = held.ravel() > 0
            out.append(sums.ravel()[full] * _BASE + number[full])
            if np.count_nonzero((held == 0).any(1)) > spare:
                must = n - -(-n * percent // 100) + 1
                out.append(scrambled[:must] ^ (salt + np.uint64(1 << 31)))
    return mix(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


_BASE = np.uint64(0x9E3779B97F4A7C15)

@lru_cache(maxsize=256)
def _edges(parts: int) -> np.ndarray:
    return (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)


def jaccard_components(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, words: str = "blank") -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``documents``.

    Two rows link when 100 * intersection >= percent * union of their sets of ``width``-word
    shingles (a text of fewer words is one shingle); component_id is the smallest key reachable.
    ``words``: "blank" cuts at ASCII white space, "ascii" at every ASCII byte that is no letter
    or digit; A-Z are lower-cased in both.  ``percent`` is 80 to 99.

    Null and blank texts have the empty set and link with nothing.  Rows that share a key are
    one node, which links whatever any of their texts links.  A null key stays outside: its
    component is null.  Exact copies are grouped first and only one of each group goes on.
    """
    if not 80 <= percent <= 99:
        raise ValueError("percent must be 80 to 99")
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def sets_of(texts: pd.Series) -> Iterator[np.ndarray]:
        for lo in range(0, len(texts), SLICE):
            yield from shingle_sets(texts.iloc[lo : lo + SLICE].tolist(), words, width)

    @F.pandas_udf("n long, fp binary")
    def outline(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()) for s in sets_of(texts)]
            yield pd.DataFrame(rows, columns=["n", "fp"])

    @F.pandas_udf("array<long>")
    def signed_by(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signatures(s, percent) for s in sets_of(texts)], dtype=object)

    @F.pandas_udf("n long, sketch array<long>, s binary")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = shingle_sets(texts.tolist(), words, width)
            yield pd.DataFrame({"n": [len(x) for x in sets], "sketch": [parity_sketch(x) for x in sets], "s": [x.tobytes() for x in sets]})

    # 1. size and fingerprint of each set; equal sets are one class, named by the smallest key
    seen = scratch.keep(docs.select("id", outline("text").alias("o")).select("id", "o.*"))
    classes = scratch.keep(seen.where("n > 0 AND id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")))
    member = scratch.keep(seen.join(classes, "fp", "left").select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("rep")).alias("rep")))
    scratch.drop(seen)

    # 2. buckets of the signatures of one member of each class, which are made for these alone; those with one member are done
    reps = classes.select(F.col("rep").alias("id")).distinct()
    once = scratch.keep(docs.join(reps.hint("shuffle_hash"), "id", "left_semi").select("id", signed_by("text").alias("sigs")))
    scratch.forget_shuffles()
    signed = lambda some: once.where(some).select("id", F.explode("sigs").alias("sig"))
    live = scratch.keep(shared(signed(F.lit(True)), hot_buckets(signed(in_sample("id")))))
    scratch.drop(once)
    scratch.forget_shuffles()
    wanted = live.select("id").distinct().hint("shuffle_hash")
    sets = scratch.keep(docs.join(wanted, "id", "left_semi").select("id", whole("text").alias("w")).select("id", "w.*"))
    scratch.forget_shuffles()

    # 3. candidates are verified in waves; rows of one key with different sets are one node
    links = scratch.keep(member.where("rep IS NOT NULL").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b"))
    comps = link_in_waves(live, sets, links, percent, scratch)
    got = member.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return got.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard}

ORACLES = {
    "op7_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.b FROM reach r JOIN edges l ON r.y = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON x = d.doc_id GROUP BY d.doc_id
"""
}
