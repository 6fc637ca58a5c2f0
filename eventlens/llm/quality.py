"""Quality classifier: supervised subword embeddings.

Hashed vectors of words, word pairs and character trigrams are averaged over a document and fed
to a softmax over two classes, trained by numpy stochastic gradient descent.  The model is linear
in the averaged vectors, so after training each bucket has one number: scoring a text is hashing
its features, all at once in numpy, and a mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import Scratch, table
from eventlens.llm.shingles import mix

#: Most labelled rows that are fitted (those of smallest hash), buckets, vector size, and training.
SAMPLE, BUCKETS, DIM, EPOCHS, RATE, SEED = 2000, 1 << 17, 8, 10, 0.5, 7

#: Most distinct features of all fitted rows together, 8 bytes each: what the driver holds of the sample.
SAMPLE_FEATURES = 1 << 24

#: Code points that are hashed together: bounds the arrays, at about 80 bytes for each.
CHUNK = 1 << 19

_PRIME, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 17)
_KIND = {k: np.uint64(i << 60) for i, k in enumerate(("word", "pair", "trigram"), 1)}


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of (numbers of texts, parts of them) of about CHUNK code points.

    A longer text is cut at the last blank of each CHUNK code points (without a blank, after them).
    """
    at, run, size = [], [], 0
    for k, t in enumerate(texts):
        t, lo = t or "", 0
        while lo < len(t) or lo == 0:
            hi = len(t)
            if hi - lo > CHUNK:
                hi = max(t.rfind(" ", lo + 1, lo + CHUNK), t.rfind("\n", lo + 1, lo + CHUNK))
                hi = hi if hi > 0 else lo + CHUNK
            if run and size + hi - lo > CHUNK:
                yield at, run
                at, run, size = [], [], 0
            at.append(k)
            run.append(t[lo:hi])
            size += hi - lo + 1
            lo = max(hi, 1)
    if run:
        yield at, run


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of a text, bucket) of every feature of the texts, in runs.

    Words stand between ASCII white space.  A word gives itself, its character trigrams with both
    ends marked, and a pair with the word before it, hashed from both words in their order.  Pairs
    across a cut of a long text are no features.
    """
    for at, run in _pieces(texts):
        size = np.fromiter(map(len, run), np.int64, len(run)) + 1
        owner = np.repeat(np.asarray(at), size)
        c = np.frombuffer(("\n" + "\n".join(run) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        c[((c >= 9) & (c <= 13)) | (c == 32)] = 0
        inner = np.flatnonzero(c[1:]) + 1  # each letter is the middle of a trigram
        if not len(inner):
            continue
        three = (c[inner - 1] * _PRIME + c[inner]) * _PRIME + c[inner + 1]
        first = np.flatnonzero(c[inner - 1] == 0)
        place = np.arange(len(inner)) - np.repeat(first, np.diff(first, append=len(inner)))
        word = mix(np.add.reduceat(mix(c[inner] + (place.astype(np.uint64) << np.uint64(32))), first))
        of = owner[inner - 1]
        of_word = of[first]
        piece = np.repeat(np.arange(len(run)), size)[inner - 1][first]
        same = np.flatnonzero(piece[1:] == piece[:-1])
        pair = mix(word[same]) * _PRIME + word[same + 1]
        codes = np.concatenate((word ^ _KIND["word"], pair ^ _KIND["pair"], three ^ _KIND["trigram"]))
        yield np.concatenate((of_word, of_word[same], of)), (mix(codes) >> _SHIFT).astype(np.int64)


@dataclass
class QualityModel:
    """One number for each feature bucket, and the bias."""

    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each text; a text without words has the bias alone."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for of, bucket in features(texts):
            total += np.bincount(of, self.weight[bucket], len(texts))
            n += np.bincount(of, minlength=len(texts))
        z = self.bias + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, and how often each occurs."""
    many = [bucket for _, bucket in features([text])]
    at, n = np.unique(np.concatenate(many) if many else np.empty(0, np.int64), return_counts=True)
    return at.astype(np.int32), n.astype(np.int32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> QualityModel:
    """Trains vectors and softmax by stochastic gradient descent on counted texts; the same rows give the same model.

    Both classes weigh the same, however rare one is.
    """
    rng = np.random.default_rng(SEED)
    rows = [(at, n / max(n.sum(), 1)) for at, n in rows]
    y = np.asarray(labels, int)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    weigh = 0.5 / np.array([1 - share, share])
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, step = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, n = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = n @ vectors[at] if len(at) else np.zeros(DIM)
            p = np.exp((z := mean @ out + bias) - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weigh[y[i]]
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias = bias - 0.1 * rate * p
            if len(at):
                # a feature's step is scaled by its share of the document, as in averaging
                vectors[at] -= rate * np.outer(np.minimum(n * 50, 1), back)
    return QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = SAMPLE, most_features: int = SAMPLE_FEATURES
) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Counted whole texts and labels of up to ``most`` labelled documents, those whose key has the smallest hash.

    Texts are counted in the workers; the driver gets features, and of the chosen rows only as many,
    in the same order, as have ``most_features`` distinct ones together.  The chosen keys are bounded by
    ``most``, so they are broadcast and no text is shuffled; of the joined rows, too, ``most`` are
    kept, however often a key is repeated in either table.
    """

    @F.pandas_udf("struct<at: binary, n: binary>")
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = [counted(t) for t in texts]
        return pd.DataFrame({"at": [a.tobytes() for a, _ in rows], "n": [n.tobytes() for _, n in rows]})

    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, label).orderBy(F.xxhash64(key), key, label).limit(most)
    order = [F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(label).alias("y")]
    got = documents.select(key, text).join(F.broadcast(chosen), key)
    table_ = Scratch(documents.sparkSession, "sample").keep(got.select(*order, count(text).alias("f")))
    # at most ``most`` rows, without their features
    first = table_.select("h", "k", "t", "y", (F.octet_length("f.at") / 4).cast("long").alias("size")).orderBy("h", "k", "t", "y").limit(most)
    kept, total = [], 0
    for r in first.collect():
        total += r["size"]
        if total > most_features:
            break
        kept.append(r)
    if not kept:
        return [], []
    upto = table_.where(F.col("h") <= kept[-1]["h"]).orderBy("h", "k", "t", "y").limit(len(kept)).collect()
    return [(np.frombuffer(r["f"]["at"], np.int32), np.frombuffer(r["f"]["n"], np.int32)) for r in upto], [int(r["y"]) for r in upto]


def score_quality(text: Column | str, model: QualityModel) -> Column:
    """Probability of label 1 for each whole text; null and empty texts get the bias alone."""
    weight, bias = model.weight.astype(np.float32), model.bias

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = QualityModel(weight.astype(np.float64), bias)
        for texts in batches:
            yield pd.Series(held.score(texts.tolist()), dtype="float64")

    return run(text)


def held_out(key: Column | str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; null keys are not."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_quality(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QualityModel:
    """Fits on labels outside the held-out fold only."""
    return fit(*labelled_sample(documents, labels.where(~held_out()), most=most))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_quality(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_quality("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op10_quality": op10_quality}
