"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

One aggregation reduces any number of documents to one row per distinct length; totals,
quantiles and truncated totals of every context limit then come from suffix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm import bpe
from eventlens.llm.common import table

#: Lengths per block: suffix sums run inside blocks, then over the few block totals.
BLOCK = 512


def encoded_length(text: Column | str, path: str | None = None) -> Column:
    """Tokens of each whole text; null and empty texts have none."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = bpe.encoder(path or bpe.default_path())
        for texts in batches:
            rows = texts.tolist()
            yield pd.Series([len(x) // 4 for lo in range(0, len(rows), bpe.SLICE) for x in e.encode_many(rows[lo : lo + bpe.SLICE])], dtype="int64")

    return run(text)


def length_histogram(lengths: DataFrame, length: str = "n_tokens", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_tokens, n_docs): one row per distinct length; null lengths count as 0."""
    return lengths.groupBy(*by, F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Answers for every context limit L that equals a length present.

    Adds n_longer and tokens_longer (documents longer than L), docs_total, tokens_total,
    truncated_total (the sum of min(length, L)) and rank_share (the share of documents of
    at most L tokens: the smallest L with rank_share >= q is the q-quantile).  An empty
    histogram gives no rows.
    """
    h = histogram.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    # block totals are at most longest / BLOCK rows in each group
    blocks = h.groupBy(*by, "_block").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    later = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    blocks = blocks.select(
        *by, "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_later_d"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_later_t"),
        F.sum("_d").over(whole).alias("docs_total"),
        F.sum("_t").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy(*by, "_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    on = [h[c].eqNullSafe(blocks[c]) for c in (*by, "_block")]
    joined = h.join(blocks, on, "inner").select(h["*"], *[blocks[c] for c in ("_later_d", "_later_t", "docs_total", "tokens_total")])
    return (
        joined.withColumn("n_longer", F.col("_later_d") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
        .withColumn("tokens_longer", F.col("_later_t") + F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
        .withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("n_longer"))
        .withColumn("rank_share", 1 - F.col("n_longer") / F.col("docs_total"))
        .drop("_block", "_later_d", "_later_t")
    )


def at_limits(histogram: DataFrame, limits: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Totals at any context limits: (by..., context_limit, n_docs, n_longer, truncated_total).

    A limit's answers come from the suffix sums of the least length that isn't below it (all
    documents are shorter beyond the longest): one pass over the sums, which holds one row for
    each limit, whatever the number of lengths.
    """
    sums = suffix_sums(histogram, by)
    n, length = F.col("n_docs"), F.col("n_tokens")
    # documents of this length or more, and their tokens
    from_here = F.struct(length, (F.col("n_longer") + n).alias("d"), (F.col("tokens_longer") + length * n).alias("t"))
    at = [F.min(F.when(length > limit, from_here)).alias(f"at{i}") for i, limit in enumerate(limits)]
    met = sums.groupBy(*by).agg(F.max("docs_total").alias("n_docs"), F.max("tokens_total").alias("tokens"), *at)
    d, t = (lambda i: F.coalesce(F.col(f"at{i}.d"), F.lit(0))), (lambda i: F.coalesce(F.col(f"at{i}.t"), F.lit(0)))
    answer = lambda i, limit: F.struct(F.lit(int(limit)).alias("context_limit"), d(i).alias("n_longer"), (F.col("tokens") - t(i) + d(i) * int(limit)).alias("truncated_total"))
    each = met.where("n_docs > 0").select(*by, "n_docs", F.explode(F.array(*[answer(i, limit) for i, limit in enumerate(limits)])).alias("x"))
    return each.select(*by, "x.context_limit", "n_docs", "x.n_longer", "x.truncated_total")


def quantiles(histogram: DataFrame, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., share, n_tokens): the smallest length that at least this share of the documents doesn't exceed."""
    sums = suffix_sums(histogram, by)
    least = [F.min(F.when(F.col("rank_share") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    met = sums.groupBy(*by).agg(F.count("*").alias("_n"), *least).where("_n > 0")
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)])
    return met.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(encoded_length("text").alias("n_tokens"))
    return suffix_sums(length_histogram(docs))


QUERIES = {"op2_token_counts": op2_token_counts}
