"""Target-distribution importance resampling over hashed word n-grams.

Corpus counts come from distinct segments: newlines part words, so a text is cut into lines, the
features of each distinct line are counted once and multiplied by the line's occurrences, and
n-grams that cross lines are counted by themselves.  A bucket's gain is the scaled log ratio of
its shares in the target and in the corpus; a document's weight is the floored mean gain of its
features.  Gumbel noise from a hash turns the highest scores into a draw in proportion to the
weights.  Everything is DataFrame expressions; only the gains (one number a bucket) pass the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import Scratch, table
from eventlens.llm.decontaminate import word_array

#: Buckets of features, longest run of words that is a feature, and the scale of gains and noise.
BUCKETS, RUNS, SCALE = 10_000, 1, 1000

#: Fewest words of a document that may be drawn, and percent of such documents that are.
LEAST_WORDS, PERCENT = 20, 10


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def grams(words: Column, n: int) -> list[Column]:
    """For each length 1 to n, the array of runs of that many consecutive words, joined by a space."""
    out = [words]
    for k in range(2, n + 1):
        later = F.slice(words, k, F.greatest(F.size(words), F.lit(1)))
        both = F.zip_with(out[-1], later, lambda g, w: F.concat(g, F.lit(" "), w))  # null where either ends
        out.append(F.filter(both, lambda g: g.isNotNull()))
    return out


def across_lines(text: str, n: int) -> Column:
    """Runs of 2 to n words that begin in one line and end in a later one."""
    in_line = lambda line, i: F.transform(word_array(line), lambda w: F.struct(w.alias("g"), i.alias("first"), i.alias("last")))
    words = F.flatten(F.transform(F.split(text, "\n"), in_line))
    runs, out = words, F.array().cast("array<string>")
    for k in range(2, n + 1):
        later = F.slice(words, k, F.greatest(F.size(words), F.lit(1)))
        longer = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.concat(a["g"], F.lit(" "), b["g"]).alias("g"), a["first"].alias("first"), b["last"].alias("last")))
        runs = F.filter(F.zip_with(runs, later, longer), lambda r: r.isNotNull())
        out = F.concat(out, F.transform(F.filter(runs, lambda r: r["first"] != r["last"]), lambda r: r["g"]))
    return out


def feature_counts(docs: DataFrame, text: str = "text", n: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often features of each bucket occur in all texts; buckets without any are left out.

    Each distinct line is taken apart once.  A null or empty text has no feature.
    """
    lines = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(text, "\n")).alias("line"))
    often = lines.where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))
    counted = often.select("n", F.explode(F.concat(*grams(word_array("line"), n))).alias("feature"))
    if n > 1:
        crossing = docs.where(F.col(text).isNotNull()).select(F.lit(1).cast("long").alias("n"), F.explode(across_lines(text, n)).alias("feature"))
        counted = counted.unionByName(crossing)
    return counted.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", n: int = RUNS, buckets: int = BUCKETS, scale: int = SCALE) -> list[int]:
    """Per bucket floor(scale * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))); s, S of docs, t, T of target."""
    s, t = ({r["bucket"]: r["n"] for r in feature_counts(df, text, n, buckets).collect()} for df in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda b: float((t.get(b, 0) + 1) * (all_s + buckets)) / float((s.get(b, 0) + 1) * (all_t + buckets))
    return [math.floor(scale * math.log(ratio(b))) for b in range(buckets)]


def mean_gain(text: str, gain: list[int], n: int = RUNS) -> tuple[Column, Column]:
    """(number of features, floored mean of their gains; 0 without any)."""
    table_ = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    features = F.concat(*grams(word_array(text), n))
    total = F.aggregate(features, F.lit(0).cast("long"), lambda a, f: a + F.get(table_, bucket(f, len(gain))))
    count = F.size(features).cast("long")
    return count, F.when(count > 0, F.floor((total - F.pmod(total, count)) / F.greatest(count, F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(key: str, seed: str = "2024:", scale: int = SCALE) -> Column:
    """floor(-scale * ln(-ln(u))) for u from the first 32 bits of sha256 of seed and key (a null key reads "null")."""
    name = F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, most: int) -> DataFrame:
    """``rank`` (from 1) of the first ``most`` rows in this order, the rest left out.

    Rows are dealt by ranges of the order, so only the sizes of ranges meet in one place.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.keep(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    before, offsets = 0, []
    for part, count in sizes:
        if before < most:
            offsets.append((part, before))
        before += count
    at = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(at, "_part").withColumn("rank", F.col("_before") + inside).where(F.col("rank") <= most).drop("_part", "_before")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", n: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """Every row's (key, n_features, weight, score, rank), all long but the key; rank is null where it isn't drawn.

    Of the rows with at least ``least_words`` words, floor(percent * N / 100) highest scores are drawn,
    ties to the smaller key (null keys first), equal rows in any fixed order.  Null and empty texts have
    no feature, weight 0, and are never drawn while least_words > 0.  Repeated rows count as often as they
    occur.  An empty target leaves the corpus' own shares; no documents, no rows.  Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    gain = gains(texts, target.select(F.col(text).alias("_text")), "_text", n, buckets)
    count, weight = mean_gain("_text", gain, n)
    words = F.size(word_array("_text")).cast("long")
    rows = texts.select("_key", words.alias("_words"), count.alias("n_features"), weight.alias("weight"), F.monotonically_increasing_id().alias("_row"))
    rows = scratch.keep(rows.withColumn("score", F.col("weight") + noise("_key")))
    pool = rows.where(F.col("_words") >= least_words)
    most = percent * pool.count() // 100
    cols = [F.col("_key").alias(key), "n_features", "weight", "score"]
    if not most:
        return rows.select(*cols, F.lit(None).cast("long").alias("rank"))
    drawn = scratch.keep(ranked(pool, [F.desc("score"), F.asc("_key"), F.asc("_row")], scratch, most).select("_row", "rank"))
    return rows.join(drawn, "_row", "left").select(*cols, F.col("rank").cast("long").alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_resampling": op12_resampling}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_NOISE = "-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))"

ORACLES = {
    "op12_resampling": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS w FROM benchmark),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
hashed AS MATERIALIZED (
  SELECT w, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS b
  FROM vocabulary, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS MATERIALIZED (
  SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (totals.s + 10000) AS DOUBLE)
                               / CAST((coalesce(s.n, 0) + 1) * (totals.t + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), totals),
mean AS (
  SELECT doc_id, CAST(sum(g) AS BIGINT) AS g, count(*) AS n
  FROM dw JOIN hashed USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
         coalesce((g - ((g % n) + n) % n) // n, 0) + CAST(floor({_NOISE}) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS most
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, rank
FROM scored s LEFT JOIN (SELECT doc_id, rank FROM drawn WHERE rank <= most) USING (doc_id)
"""
}
