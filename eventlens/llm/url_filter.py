"""URL filters: a sort-merge range join between page urls and host/path rules.

A host becomes a canonical key by reversing it and closing it with a dot, so a rule's
host covers one interval of keys: itself and its subdomains.  Intervals nest, hence a
sweep over sorted keys needs only a stack of the rules that are open at that point.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import table

#: The rules that the contract fixes: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Most rules that are shipped to every task; beyond, rules and urls are dealt by key range.
LOCAL_RULES = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Canonical key: the reversed host and a dot, so that a rule's subdomains share its prefix."""
    return F.concat(F.reverse(host), F.lit("."))


def sweep(keys: list[str], paths: list[str], rules: list[tuple[str, str, str, str]]) -> list[tuple[str | None, str | None]]:
    """Best rule of each url: both lists sorted by key.

    ``rules``: (key, path, rule, verdict).  A rule opens when the sweep reaches its key
    and closes at the first key that doesn't start with it.  Of the open rules whose path
    starts the url's, the longest rule wins, then the longer host.
    """
    out, stack, at = [], [], 0
    for key, path in zip(keys, paths):
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        fit = [r for r in stack if path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[2]), len(r[0]))) if fit else None
        out.append((best[2], best[3]) if best else (None, None))
    return out


_OUT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", local_rules: int = LOCAL_RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules(verdict, host, path)``: fits its host and all subdomains if the url's path starts
    with the rule's; the longest ``host + path`` wins.  Without a fitting rule, rule is null and
    verdict is ``default``.  Null urls and urls without ``://`` have an empty host and path.
    Repeated rules count once (block before allow); a rule with a null is ignored.  Columns
    of ``pages`` named host, path, rule or verdict are replaced.

    Up to ``local_rules`` rules (counted first) go to every task, and no page is shuffled.
    More rules are cut into key ranges, and pages are dealt to their range and a salt (a hash of the
    row), so that no task holds more than about ``local_rules`` rules and what encloses them.
    """
    spark = pages.sparkSession
    rules = (
        rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    )
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if (found := rules.limit(local_rules + 1).collect()).__len__() <= local_rules:
        ordered = sorted(tuple(r) for r in found)

        @F.pandas_udf(_OUT)
        def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for keys, paths in batches:
                order = keys.argsort(kind="stable")
                rows = sweep(keys.iloc[order].tolist(), paths.iloc[order].tolist(), ordered)
                yield pd.DataFrame(rows, columns=["rule", "verdict"], index=order, dtype=object).sort_index()

        got = pages.withColumn("_got", judge(host_key(F.col("host")), F.col("path")))
        return got.withColumns({"rule": F.col("_got.rule"), "verdict": F.coalesce("_got.verdict", F.lit(default))}).drop("_got")

    # Many rules: cut the key space where the range exchange cuts the sorted rules.
    ranged = rules.repartitionByRange(2 + rules.count() // local_rules, "key").withColumn("_part", F.spark_partition_id())
    cuts = sorted(r[0] for r in ranged.groupBy("_part").agg(F.min("key").alias("k")).select("k").collect())[1:]
    segment = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))).cast("int")
    # a rule goes to each segment that its interval touches: its own, and those up to the key's last successor
    last = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")))).cast("int")
    tasks = 4 * spark.sparkContext.defaultParallelism
    salts = max(1, tasks // (len(cuts) + 1))
    # pages go through the sweep themselves, so a very common host is split by salts and nothing is joined back
    row = F.struct(*pages.columns)
    salt = F.pmod(F.xxhash64(*[c for c, t in pages.dtypes if "map<" not in t]), F.lit(salts)).cast("int")
    urls = pages.select(host_key(F.col("host")).alias("key"), row.alias("row"), "path", salt.alias("salt"))
    urls = urls.select(segment.alias("seg"), "salt", "key", F.lit(1).alias("kind"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "row")
    none = F.lit(None).cast(pages.select(row.alias("row")).schema["row"].dataType)
    held = rules.withColumn("seg", F.explode(F.sequence(segment, last))).select("seg", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("kind"), "path", "rule", "verdict", none.alias("row"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, here = [], None
        for b in batches:
            at, got = [], []
            for i, (seg, salt, key, kind, path, rule, verdict) in enumerate(zip(*(b[c].to_pylist() for c in ("seg", "salt", "key", "kind", "path", "rule", "verdict")))):
                if (seg, salt) != here:
                    stack, here = [], (seg, salt)
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, path, rule, verdict))
                    continue
                fit = [r for r in stack if path.startswith(r[1])]
                at.append(i)
                got.append(max(fit, key=lambda r: (len(r[2]), len(r[0])))[2:] if fit else (None, None))
            rule, verdict = (pa.array([g[k] for g in got], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b["row"].take(pa.array(at, pa.int64())), rule, verdict], ["row", "rule", "verdict"])

    kind = pages.select(row.alias("row")).schema.add("rule", "string").add("verdict", "string")
    judged = urls.union(held).repartition(tasks, "seg", "salt").sortWithinPartitions("seg", "salt", "key", "kind").mapInArrow(merge, kind)
    return judged.select("row.*", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return filter_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filter": op1_url_filter}

ORACLES = {
    "op1_url_filter": r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m USING (page_id)
"""
}
