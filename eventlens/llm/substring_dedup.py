"""Substring deduplication of passages that documents share.

Texts are cut into paragraphs at sentence ends and line breaks that only nearby words decide, so
that a passage is cut alike wherever it stands.  Equal paragraphs are one class; classes get
MinHash bands tuned for high recall, colliding ones are joined and verified by exact Jaccard in
waves of pivots until each bucket is exhausted, and links become components.  So that a passage
which doesn't begin and end at cuts isn't lost, every window of WINDOW words that two documents
hold is found as well, wherever it begins: windows whose least hash of ANCHOR words is shared are
grouped by it and their own hash.  Runs of paragraphs and windows that other documents hold too
are the passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.buckets import hot_buckets, in_sample, least_holders, link_in_waves, parity_sketch, shared
from eventlens.llm.common import Scratch, table
from eventlens.llm.shingles import mix, word_runs

#: Words in a shingle, similarity of near paragraphs in percent, and their MinHash bands and rows:
#: two paragraphs at the threshold share a band with a probability of 0.997.
SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 8, 3

#: Words between two cuts, at least, so that a paragraph with one changed word inside is still near
#: enough; fewest words of a paragraph (texts have shorter ends) and of a passage; most words that
#: may stand between two repeated stretches of a passage.
REACH, LEAST, LEAST_PASSAGE, GAP = 48, 5, 30, 12

#: Words of a window that is found wherever it begins, and of the runs whose least hash stands for it.
WINDOW, ANCHOR = 50, 20

#: The same words in a text that is not lower-cased yet.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ODD = np.random.default_rng(9).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_MAX = np.uint64(2**64 - 1)


@dataclass
class Outline:
    """Paragraphs of one text: first words, numbers of words, two content hashes, MinHash bands, and
    the hash of the shingle that begins at each word of the text."""

    start: np.ndarray
    words: np.ndarray
    h: np.ndarray
    g: np.ndarray
    bands: np.ndarray
    shingles: np.ndarray

    def set_of(self, i: int) -> np.ndarray:
        """Sorted shingle hashes of a paragraph of SHINGLE words or more."""
        return np.unique(self.shingles[self.start[i] : self.start[i] + self.words[i] - SHINGLE + 1])


def paragraph_starts(h: np.ndarray, bounds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First words of the paragraphs of a run of texts (see word_runs).

    Sentence ends and line breaks are places for a cut if four words or more stand since the one
    before; in stretches of more than 40 words without one, words whose hash is divisible by 16 are.
    A place is a cut if the hash of its next two words is the least of all places within REACH
    words (of equal ones, the first), so whatever stands further away has no influence on it.
    Texts begin with a cut, which is no place: it hides no other.
    """
    n = len(h)
    marks = np.unique(np.concatenate((bounds, ends)))
    kept = np.ones(len(marks), bool)
    kept[1:] = np.diff(marks) >= 4
    places = np.union1d(marks[kept], bounds)
    soft = np.flatnonzero(h % np.uint64(16) == 0)
    at = np.searchsorted(places, soft, "right")
    inner = (at > 0) & (at < len(places))
    soft, at = soft[inner], at[inner]
    places = np.union1d(places, soft[places[at] - places[at - 1] > 40]) if len(soft) else places
    first = bounds[:-1][np.diff(bounds) > 0]
    places = np.setdiff1d(places[places < n], bounds)
    if not len(places):
        return first
    # texts are moved apart, so that their places don't meet
    of = np.searchsorted(bounds, places, "right") - 1
    spot = places + of * REACH
    value = mix(h[places] * _ODD[60] + h[np.minimum(places + 1, n - 1)] * np.where(places + 1 < bounds[of + 1], _ODD[61], np.uint64(0)))
    low = np.full(int(spot[-1]) + 2 * REACH + 1, _MAX)
    low[spot + REACH] = value
    left, width = low, 1  # at each spot, the least of the REACH values from it on
    while 2 * width <= REACH:
        left = np.minimum(left[:-width], left[width:])
        width *= 2
    left = np.minimum(left[: len(left) - (REACH - width)], left[REACH - width :])
    return np.union1d(first, places[(value < left[spot]) & (value <= left[spot + REACH + 1])])


def outlines(texts: list[str | None], banded: bool = True) -> Iterator[Outline]:
    """Paragraphs of each text."""
    for h, bounds, ends in word_runs(texts, "ascii", True):
        n = len(h)
        first = paragraph_starts(h, bounds, ends)
        size = np.diff(first, append=n)
        if n:
            place = (np.arange(n) - np.repeat(first, size)).astype(np.uint64)
            code, other = (mix(np.add.reduceat(mix(h + place * odd), first) + size.astype(np.uint64)).view(np.int64) for odd in _ODD[62:])
        else:
            code = other = np.empty(0, np.int64)
        s = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE):
            s += h[i : i + len(s)] * _ODD[i]
        s = np.concatenate((mix(s), np.full(n - len(s), _MAX)))
        bands = np.empty((len(first), 0), np.int64)
        if banded and n:
            own = np.repeat(first + size, size) - np.arange(n) >= SHINGLE  # shingles inside their paragraph
            low = [np.minimum.reduceat(np.where(own, s * _ODD[8 + j], _MAX), first) for j in range(BANDS * ROWS)]
            bands = np.stack([_together(low[j * ROWS : (j + 1) * ROWS], j) for j in range(BANDS)], 1)
        unit = np.searchsorted(first, bounds)
        for k in range(len(bounds) - 1):
            a, z = unit[k], unit[k + 1]
            yield Outline(first[a:z] - bounds[k], size[a:z], code[a:z], other[a:z], bands[a:z], s[bounds[k] : bounds[k + 1]])


def _together(low: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(low[0]), np.uint64(salt))
    for x in low:
        out = mix(out * _ODD[62] + x)
    return out.view(np.int64)


def windows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, of each of its windows in order: the least hash of ANCHOR words inside, and the hash of all WINDOW words.

    Both depend on the window's words alone, so equal windows agree, in long runs of one word too.
    """
    for h, bounds in word_runs(texts, "ascii"):
        n = len(h)
        count = max(0, n - WINDOW + 1)
        up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b)))) for b in _BASES)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:n])))
        of = lambda width: mix((total[width:] - total[: max(0, n - width + 1)]) * down[: max(0, n - width + 1)])  # noqa: E731, B023
        low, width, most = of(ANCHOR), 1, WINDOW - ANCHOR + 1
        while 2 * width <= most:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:count], low[most - width : most - width + count]).view(np.int64)
        own = of(WINDOW).view(np.int64)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            z = max(a, z - WINDOW + 1)
            yield low[a:z], own[a:z]


_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Rows of windows that a worker hands over at once.
_ROWS_OUT = 100_000


def _repeated(rows: Iterator[tuple[pa.Scalar, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Record batches of (id, low): each key is repeated for its array's values."""
    keys, parts, size = [], [], 0
    for key, values in rows:
        keys.append(key)
        parts.append(values)
        size += len(values)
        if size >= _ROWS_OUT:
            yield _spread(keys, parts, ["low"])
            keys, parts, size = [], [], 0
    if keys:
        yield _spread(keys, parts, ["low"])


def _spread(keys: list[pa.Scalar], parts: list, names: list[str]) -> pa.RecordBatch:
    parts = [p if isinstance(p, tuple) else (p,) for p in parts]
    ids = pa.array(keys, keys[0].type).take(pa.array(np.repeat(np.arange(len(keys)), [len(p[0]) for p in parts])))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(x)) for x in zip(*parts))], ["id", *names])


def least_hashes(docs: DataFrame) -> DataFrame:
    """(id, low): the distinct least hashes of the windows of ``docs(id, text)``."""

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b["id"], windows(b["text"].to_pylist()))
            yield from _repeated((i, np.unique(low)) for i, (low, _) in rows if len(low))

    return docs.select("id", "text").mapInArrow(lows, f"id {docs.schema['id'].dataType.simpleString()}, low long")


def copied(units: list[dict]) -> Iterator[tuple[int, int]]:
    """Stretches of a document that stand alike in one document of smaller key: paragraphs (start,
    words, first, at) that follow each other in both documents, merged."""
    run = None
    for u in sorted(units, key=lambda u: u["start"]):
        lo, hi, at = u["start"], u["start"] + u["words"], u["at"]
        if run and (run[1], run[2], run[3]) == (lo, u["first"], at):
            run = [run[0], hi, run[2], at + u["words"]]
        else:
            if run:
                yield run[0], run[1]
            run = [lo, hi, u["first"], at + u["words"]]
    if run:
        yield run[0], run[1]


def shared_windows(low: np.ndarray, own: np.ndarray, lows: np.ndarray, units: list[dict]) -> tuple[np.ndarray, ...] | None:
    """(start, end, low, own hash) of a text's windows (see ``windows``) whose least hash is among ``lows``.

    Equal windows that stand one word apart, as in a run of one word, are one row.  Windows inside
    a stretch that is copied from a document of smaller key are left out: all words there are of
    repeated paragraphs already, and that document has the same windows.
    """
    want = np.isin(low, lows)
    for a, z in copied(units):
        want[a : max(a, z - WINDOW + 1)] = False
    at = np.flatnonzero(want)
    if not len(at):
        return None
    first = np.flatnonzero(np.concatenate(([True], (at[1:] > at[:-1] + 1) | (own[at[1:]] != own[at[:-1]]))))
    at, to = at[first], at[np.append(first[1:], len(at)) - 1]
    return at.astype(np.int32), (to + WINDOW).astype(np.int32), low[at], own[at]


def passages_of(start: np.ndarray, end: np.ndarray, lo: np.ndarray, own: np.ndarray, least: int) -> Iterator[tuple]:
    """(start, end, repeated words, least key, keep) of the runs of one document's repeated stretches.

    A stretch joins the run if at most GAP words stand between; own: whether lo is the document.
    Runs are split where keep changes: a word stays if all stretches over it are the document's own.
    """
    order = np.argsort(start, kind="stable")
    start, end, lo, own = start[order], end[order], lo[order], own[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate(([True], start[1:] - reach[:-1] > GAP)))
    last = np.append(first[1:], len(start)) - 1
    base, size = start[0], reach[-1] - start[0] + 1
    cover = lambda s, e: np.cumsum(np.bincount(s - base, minlength=size) - np.bincount(e - base, minlength=size)) > 0
    held = cover(start, end)
    kept = ~cover(start[~own], end[~own])
    for a, z in zip(first.tolist(), last.tolist()):
        at = np.flatnonzero(held[start[a] - base : reach[z] - base]) + start[a]
        if len(at) >= least:
            low, keep = min(lo[a : z + 1]), kept[at - base]
            piece = np.flatnonzero(np.concatenate(([True], keep[1:] != keep[:-1])))
            for i, k in zip(piece.tolist(), np.append(piece[1:], len(at)).tolist()):
                yield int(at[i]), int(at[k - 1]) + 1, k - i, low, bool(keep[i])


_UNITS = "array<struct<start:int,words:int,h:long,g:long,bands:array<long>>>"


def outlined(docs: DataFrame) -> DataFrame:
    """(id, start, words, h, g, bands) of the paragraphs of ``docs(id, text)``."""

    @F.pandas_udf(_UNITS)
    def units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for o in outlines(texts.tolist()):
                rows = zip(o.start.tolist(), o.words.tolist(), o.h.tolist(), o.g.tolist(), o.bands.tolist())
                out.append([{"start": s, "words": n, "h": x, "g": y, "bands": b} for s, n, x, y, b in rows if n >= LEAST])
            yield pd.Series(out)

    return docs.select("id", F.explode(units("text")).alias("u")).select("id", "u.*")


def sets_and_windows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """What is asked of each text, which is read once: (node, n, sketch, s) of paragraphs, and (id, start, end, low, own) of windows.

    ``asked(id, paragraphs, lows, units)``: paragraphs (node, start) whose sets are wanted, least
    hashes of windows, and paragraphs of smaller documents (see ``copied``).
    """
    kind = docs.schema["id"].dataType.simpleString()
    names = ["start", "end", "low", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b["text"].to_pylist(), b["id"]
            at = [k for k, x in enumerate(b["paragraphs"]) if len(x)]
            for k, o in zip(at, outlines([texts[k] for k in at], False)):
                of = dict(zip(o.start.tolist(), range(len(o.start))))
                yield _sets([(x["node"], o.set_of(of[x["start"]])) for x in b["paragraphs"][k].as_py()], ids.type)
            at = [k for k, x in enumerate(b["lows"]) if len(x)]
            keys, parts, size = [], [], 0
            for k, (low, own) in zip(at, windows([texts[k] for k in at])):
                if found := shared_windows(low, own, b["lows"][k].values.to_numpy(), b["units"][k].as_py()):
                    keys.append(ids[k])
                    parts.append(found)
                    size += len(found[0])
                if size >= _ROWS_OUT:
                    yield _filled(_spread(keys, parts, names))
                    keys, parts, size = [], [], 0
            if keys:
                yield _filled(_spread(keys, parts, names))

    return docs.join(asked.hint("shuffle_hash"), "id").select("id", "text", "paragraphs", "lows", "units").mapInArrow(run, f"id {kind}, {_BOTH}")


_BOTH = "start int, end int, low long, own long, node long, n int, sketch array<long>, s binary"
_SET_TYPES = {"node": pa.int64(), "n": pa.int32(), "sketch": pa.list_(pa.int64()), "s": pa.binary()}


def _filled(found: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of windows, with the columns of sets empty."""
    none = [pa.nulls(found.num_rows, t) for t in _SET_TYPES.values()]
    return pa.RecordBatch.from_arrays([*found.columns, *none], [*found.schema.names, *_SET_TYPES])


def _sets(sets: list[tuple[int, np.ndarray]], key: pa.DataType) -> pa.RecordBatch:
    """Rows of sets, with the columns of windows empty."""
    none = [pa.nulls(len(sets), t) for t in (key, pa.int32(), pa.int32(), pa.int64(), pa.int64())]
    values = [x for x, _ in sets], [len(s) for _, s in sets], [parity_sketch(s) for _, s in sets], [s.tobytes() for _, s in sets]
    return pa.RecordBatch.from_arrays([*none, *(pa.array(v, t) for v, t in zip(values, _SET_TYPES.values()))], ["id", "start", "end", "low", "own", *_SET_TYPES])


def repeated_stretches(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, start, end, lo) of the paragraphs and windows of ``docs(id, text)`` that two ids hold; lo is the least of these.

    A near paragraph counts as the same.  Of the windows, those inside a copied stretch are left out.
    """
    each = scratch.keep(outlined(docs))
    # one row for each distinct paragraph, by 128 bits: where it first stands, and whether another document has it
    classes = each.groupBy("h", "g").agg(F.min(F.struct("id", "start")).alias("first"), F.max("id").alias("last"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))
    first = classes.select("h", "g", "node", "first.*")
    once = scratch.keep(each.join(first, ["h", "g", "id", "start"]).groupBy("node").agg(F.any_value("bands").alias("bands")))
    banded, each = each, scratch.keep(each.drop("bands"))
    scratch.drop(banded)

    # near paragraphs: classes that share a MinHash band
    signed = lambda some: once.where(some).select(F.col("node").alias("id"), F.explode("bands").alias("sig"))
    live = scratch.keep(shared(signed(F.lit(True)), hot_buckets(signed(in_sample("node")))))
    scratch.drop(once)

    lows = scratch.keep(least_hashes(docs))
    met = least_holders(lows, ["low"], "low")
    wanted = first.join(live.select(F.col("id").alias("node")).distinct(), "node")
    copied_ = scratch.keep(classes.where("first.id < last").select("h", "g", "first"))  # a table: the join with it splits large classes
    later = each.join(copied_, ["h", "g"]).where("id > first.id")

    paragraph, unit = F.struct("node", "start"), F.struct("start", "words", F.col("first.id").cast("string").alias("first"), F.col("first.start").alias("at"))
    kinds = {"paragraph": "struct<node:bigint,start:int>", "low": "bigint", "unit": "struct<start:int,words:int,first:string,at:int>"}
    rows = lambda df, **have: df.select("id", *[have.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
    every = rows(wanted, paragraph=paragraph).union(rows(met, low=F.col("low"))).union(rows(later, unit=unit))
    asked = every.groupBy("id").agg(F.collect_list("paragraph").alias("paragraphs"), F.collect_set("low").alias("lows"), F.collect_list("unit").alias("units"))
    both = scratch.keep(sets_and_windows(docs, asked.where("size(paragraphs) > 0 OR size(lows) > 0")))
    scratch.drop(lows)
    scratch.forget_shuffles()

    sets = scratch.keep(both.where("node IS NOT NULL").select(F.col("node").alias("id"), "n", "sketch", "s").dropDuplicates(["id"]))
    near = link_in_waves(live, sets, None, PERCENT, scratch)
    # the class of a paragraph: itself or its component; kept if two documents hold it
    known = classes.join(near, "node", "left").select("h", "g", F.coalesce("component", "node").alias("c"), F.col("first.id").alias("lo"), F.col("last").alias("hi"))
    by_class = known.groupBy("c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    repeated = scratch.keep(known.select("h", "g", "c").join(by_class.select("c", "lo"), "c").select("h", "g", "lo"))
    paragraphs = each.join(repeated, ["h", "g"]).select("id", "start", (F.col("start") + F.col("words")).alias("end"), "lo")

    found = both.where("node IS NULL").select("id", "start", "end", "low", "own")
    out = scratch.keep(paragraphs.union(least_holders(found, ["low", "own"], "own").select("id", "start", "end", "lo")))
    for df in (each, both):
        scratch.drop(df)
    return out


def repeated_passages(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_PASSAGE) -> DataFrame:
    """(key, passage, start_word, end_word, n_words, component, keep): every passage that another document holds too.

    A passage is a run of repeated paragraphs and windows, with at most GAP other words between
    two, and at least ``least`` repeated words.  start_word and end_word count the words of the
    text from 0, end exclusive; n_words counts the repeated ones.  component is the smallest key
    of any document that holds one of its paragraphs, or one linked to it, or one of its windows
    (of those inside a stretch copied from a smaller document, that document counts alone).

    keep is decided for each word: false where a paragraph or window over it also stands (or
    nearly) in a document of smaller key.  What is removed thus always stands in a document of
    smaller key, so the first of all copies stays.  A passage is split where keep changes; pieces
    may have fewer than ``least`` words.

    Null, empty and short texts have no passage.  Rows with a null key take no part, nor do rows of
    a key that has different texts, as their places couldn't be told apart; rows that repeat key
    and text count as one document.
    """
    scratch = Scratch(documents.sparkSession, "passages")
    docs = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    hashed = docs.groupBy("id").agg(*[f(F.xxhash64("text")).alias(f.__name__) for f in (F.min, F.max)])
    torn = scratch.keep(hashed.where("min <> max").select("id"))
    if torn.limit(1).count():
        docs = docs.join(torn, "id", "left_anti")

    per = repeated_stretches(docs, scratch).groupBy("id").agg(F.collect_list(F.struct("start", "end", "lo", (F.col("lo") == F.col("id")).alias("own"))).alias("us"))
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "passage", "start_word", "end_word", "n_words", "component", "keep"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, us in zip(b["id"], b["us"]):
                of = us.values.flatten()
                found = passages_of(*(x.to_numpy(zero_copy_only=False) for x in of), least)
                rows += [(i.as_py(), k, *r) for k, r in enumerate(found)]
            kinds = [b["id"].type, *[pa.int32()] * 4, b["id"].type, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    found = per.mapInArrow(runs, f"id {kind}, passage int, start_word int, end_word int, n_words int, component {kind}, keep boolean")
    return found.withColumnRenamed("id", key)


def remove_passages(documents: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without the passages whose ``keep`` is false; other columns stay, null texts too."""
    gone = passages.where(~F.col("keep")).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("_cut"))

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, cuts in batches:
            out = []
            for t, spans in zip(texts, cuts):
                if t and spans is not None and len(spans):
                    places = [m.span() for m in _WORD.finditer(t)]
                    for s in reversed(spans):
                        t = t[: places[s["start_word"]][0]] + t[places[s["end_word"] - 1][1] :]
                out.append(t)
            yield pd.Series(out, dtype=object)

    return documents.join(gone, key, "left").withColumn(text, cut(text, "_cut")).drop("_cut")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("component", "first_doc_id")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
