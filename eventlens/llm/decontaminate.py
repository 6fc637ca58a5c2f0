"""Benchmark decontamination: a prefix-filtered join of documents and item-sized windows.

Containment of a window means that all its words match in order, so one word of each window
is a necessary prefix: its rarest in the documents.  Places of prefix words are joined to the
windows, positional and length bounds cut places where a window can't fit, and the words around
the place are compared exactly.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import NON_WORD, Scratch, table

#: Words in a window.
WINDOW = 10

#: Most distinct prefix words that are filtered for in place, and most windows that are broadcast.
PREFIX_WORDS, BROADCAST_WINDOWS = 50_000, 200_000

#: Most bytes of all windows that are broadcast, and keys that documents without a place are dealt by.
BROADCAST_BYTES, SPREAD = 64 << 20, 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column | str) -> Column:
    """Words of a text: A-Z lower-cased, cut at ASCII bytes that are no letter or digit."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, NON_WORD), lambda w: w != "")


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id string, window array): ``width`` consecutive words of an item, or all of fewer.

    Items without words have no window; equal windows of an item count once.
    """
    ws = benchmark.select(F.col(item).cast("string").alias("item_id"), word_array(text).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (width - 1), F.lit(1)))
    return ws.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, width))).alias("window")).distinct()


def rarest_prefix(each: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """``each`` window with its rarest word: (item_id, window, prefix, at), at from 0.

    Counts cover all documents, for the words of the benchmark only; ties go to the
    lesser word.  A word that no document has is rarest of all: its window can't occur.
    """
    words = each.select(F.explode("window").alias("w")).distinct()
    bounded = [r[0] for r in words.limit(PREFIX_WORDS + 1).collect()]
    ws = word_array(text)
    if len(bounded) <= PREFIX_WORDS:
        ws = F.filter(ws, lambda w: w.isin(bounded))
    counted = documents.select(F.explode(ws).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    known = words.join(counted, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    placed = each.select("item_id", "window", F.posexplode("window").alias("at", "w")).join(known, "w")
    best = F.min(F.struct("n", "w", "at"))
    return placed.groupBy("item_id", "window").agg(best.alias("b")).select("item_id", "window", F.col("b.w").alias("prefix"), F.col("b.at").alias("at"), F.col("b.n").alias("n"))


def contaminated_words(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", width: int = WINDOW) -> DataFrame:
    """Per document: key, n_words, n_hit, items (sorted array of item ids as strings).

    A document word inside any occurrence of a window is hit.  Each input row gives one output
    row; rows that share key and text count once each.  Null texts and items have no words,
    a null item id names no item but its windows hit.  Other columns are left out.
    Windows are broadcast only up to a bound of their number and bytes, which are counted; beyond it
    the join shuffles on the prefix word (each document's own row on one of SPREAD other keys).
    """
    rare = rarest_prefix(windows(benchmark, item, text, width), documents, text).where("n > 0")
    rare = Scratch(documents.sparkSession, "windows").keep(rare.select("prefix", "at", F.size("window").alias("len"), "window", "item_id"))
    many, size = rare.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("window", " "))), F.lit(0))).first()
    side = F.broadcast(rare) if many <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES else rare
    prefixes = [r[0] for r in rare.select("prefix").distinct().limit(PREFIX_WORDS + 1).collect()]

    place = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("w"), F.lit(None).cast("array<string>").alias("around"))
    docs = documents.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), word_array(text).alias("ws"))
    every = F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("w")))
    if len(prefixes) <= PREFIX_WORDS:
        every = F.filter(every, lambda p: p["w"].isin(prefixes))
    # the words before and after a place that a window through it may have
    first = lambda p: F.greatest(p["pos"] - (width - 1), F.lit(0))
    near = F.transform(every, lambda p: F.struct(p["pos"].alias("pos"), p["w"].alias("w"), F.slice("ws", first(p) + 1, 2 * width - 1).alias("around")))
    places = docs.select("_key", "_text", F.size("ws").alias("n_words"), F.explode(F.concat(F.array(place), near)).alias("p")).select("_key", "_text", "n_words", "p.*")
    start = F.col("pos") - F.col("at")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    here = F.slice("around", start - F.greatest(F.col("pos") - (width - 1), F.lit(0)) + 1, F.col("len"))
    # a key with a blank is no word: rows of documents meet no window there
    meet = F.coalesce("w", F.concat(F.lit(" "), F.pmod(F.xxhash64("_key", "_text"), F.lit(SPREAD)).cast("string")))
    joined = places.join(side, meet == F.col("prefix"), "left").withColumn("hit", F.coalesce(F.when(inside, F.when(inside, here) == F.col("window")), F.lit(False)))
    hits = joined.where((F.col("pos") < 0) | F.col("hit")).select(
        "_key", "_text", "n_words",
        F.when(F.col("hit"), F.struct(start.alias("s"), (start + F.col("len")).alias("e"))).alias("span"),
        F.when(F.col("hit"), F.col("item_id")).alias("item"),
        (F.col("pos") < 0).cast("int").alias("rows"),
    )
    per = hits.groupBy("_key", "_text").agg(
        F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"), F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    # union of the spans, in order of their starts: what each adds beyond the furthest end so far
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    grow = lambda a, s: F.struct(F.greatest(a["end"], s["e"]).alias("end"), (a["n"] + F.greatest(s["e"] - F.greatest(a["end"], s["s"]), F.lit(0))).alias("n"))
    return per.select(
        F.col("_key").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", zero, grow, lambda a: a["n"]).alias("n_hit"),
        "items",
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy"),
    ).drop("_copy")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op6_decontamination": op6_decontamination}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLES = {
    "op6_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, i, n FROM pos JOIN win USING (n, w)),
hitwords AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hitwords USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
