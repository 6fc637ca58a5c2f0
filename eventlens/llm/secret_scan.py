"""Secret scans by grammar inference.

Credentials found by the fixed patterns are labelled examples of their kinds.  For each
kind, a prefix tree of examples is folded into a probabilistic automaton by merging
statistically compatible states (ALERGIA, with Hoeffding bounds); the same is done for
ordinary long tokens.  Every other candidate token is then scored by how much likelier a
credential format is than ordinary text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import table

#: Fixed by the contract, in this order: kind -> pattern.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # AKIA[A-Z0-9]+ of 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")  # [0-9a-f]+ of 32 characters or more
ASSIGN_LEAST = 8

#: Kind of the spans that the automata add.  A candidate is any token of as many characters as a value
#: must have, with a letter and a digit among them; every candidate is scored.
INFERRED = "inferred"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")

#: Most labelled examples of each kind that are fitted; merge confidence; score needed.
EXAMPLES, ALPHA, THRESHOLD = 300, 0.05, 0.9

_GROUPS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS = {c: i for i, g in enumerate(_GROUPS) for c in g}
#: A token's form: one letter for each class.  Automata see only this.
_FORM = str.maketrans({c: chr(97 + i) for c, i in _CLASS.items()})

#: Forms whose scores a worker remembers before it starts afresh.
MEMO_FORMS = 100_000
_SPREAD = [math.log(len(g)) for g in _GROUPS]


@dataclass
class Automaton:
    """Deterministic probabilistic automaton over character classes."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    count: list[dict[int, int]] = field(default_factory=lambda: [{}])
    end: list[int] = field(default_factory=lambda: [0])
    seen: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def infer(cls, examples: list[str], alpha: float = ALPHA) -> Automaton:
        """Prefix tree of the examples, folded by red-blue state merging."""
        a = cls()
        for x in examples:
            v = 0
            a.seen[0] += 1
            for c in map(_CLASS.__getitem__, x):
                if c not in a.step[v]:
                    a.step[v][c] = len(a.step)
                    a.step.append({}), a.count.append({}), a.end.append(0), a.seen.append(0)
                a.count[v][c] = a.count[v].get(c, 0) + 1
                v = a.step[v][c]
                a.seen[v] += 1
            a.end[v] += 1
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
            return n1 > 0 < n2 and abs(f1 / n1 - f2 / n2) >= bound * (n1**-0.5 + n2**-0.5)

        def compatible(u: int, v: int) -> bool:
            todo = [(u, v)]
            while todo:
                u, v = todo.pop()
                if differ(a.end[u], a.seen[u], a.end[v], a.seen[v]):
                    return False
                for c in {**a.step[u], **a.step[v]}:
                    if differ(a.count[u].get(c, 0), a.seen[u], a.count[v].get(c, 0), a.seen[v]):
                        return False
                    if c in a.step[u] and c in a.step[v]:
                        todo.append((a.step[u][c], a.step[v][c]))
            return True

        def fold(u: int, v: int) -> None:
            todo = [(u, v)]
            while todo:
                u, v = todo.pop()
                a.end[u] += a.end[v]
                a.seen[u] += a.seen[v]
                for c, w in a.step[v].items():
                    a.count[u][c] = a.count[u].get(c, 0) + a.count[v][c]
                    if c in a.step[u]:
                        todo.append((a.step[u][c], w))
                    else:
                        a.step[u][c] = w

        red = [0]
        while blue := sorted(((p, c) for p in red for c, w in a.step[p].items() if w not in red), key=lambda e: (-a.seen[a.step[e[0]][e[1]]], e)):
            p, c = blue[0]
            q = a.step[p][c]
            for r in red:
                if compatible(r, q):
                    a.step[p][c] = r
                    fold(r, q)
                    break
            else:
                red.append(q)
        return a

    def mean_log(self, text: str) -> float:
        """Mean log likelihood of a character, smoothed; the end of the text counts as one."""
        v, total, wide = 0, 0.0, len(_GROUPS) + 1
        for c in map(_CLASS.__getitem__, text):
            if v < 0:
                total += -math.log(wide) - 2.0 - _SPREAD[c]
                continue
            total += math.log((self.count[v].get(c, 0) + 0.1) / (self.seen[v] + 0.1 * wide)) - _SPREAD[c]
            v = self.step[v].get(c, -1)
        if v >= 0:
            total += math.log((self.end[v] + 0.1) / (self.seen[v] + 0.1 * wide))
        return total / (len(text) + 1)


@dataclass
class Grammar:
    """One automaton for each kind of credential, and one for ordinary tokens."""

    kinds: list[Automaton]
    ordinary: Automaton
    memo: dict[str, float] = field(default_factory=dict)

    def score(self, token: str) -> float:
        """0 to 1: how much a credential format explains the token better than ordinary text."""
        if not self.kinds:
            return 0.0
        form = token.translate(_FORM)
        if (known := self.memo.get(form)) is None:
            if len(self.memo) >= MEMO_FORMS:
                self.memo.clear()
            known = self.memo[form] = self._score(token)
        return known

    def _score(self, token: str) -> float:
        gain = (max(k.mean_log(token) for k in self.kinds) - self.ordinary.mean_log(token)) * min(len(token), 40)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, gain - 4.0))))


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the fixed patterns, in code points, in text order by kind."""
    out = [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text)]
    return out + [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]


class _Taken:
    """Stretches that spans take, merged, so that asking for one costs a binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s), self.ends.append(e)

    def meets(self, lo: int, hi: int) -> bool:
        at = bisect_right(self.ends, lo)
        return at < len(self.starts) and self.starts[at] < hi


def _candidates(text: str, taken: _Taken) -> Iterator[tuple[int, int, str]]:
    if not _DIGIT.search(text):
        return
    for m in CANDIDATE.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]) and not taken.meets(*m.span()):
            yield *m.span(), m[0]


def examples(documents: DataFrame, text: str = "text", most: int = EXAMPLES) -> DataFrame:
    """(kind, value): up to ``most`` distinct labelled tokens of each kind and of ordinary ones.

    All documents are read; the values of smallest hash are taken, whatever the partitions.
    A hex match counts as one unless an assignment holds it.
    Ordinary tokens are those of 8 characters or more outside all matches, by smallest crc32; of
    these only the ``most`` smallest of each partition leave the scan, which bounds what is shuffled.
    """

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        least: list[tuple[int, str]] = []  # of the ordinary tokens so far
        for texts in batches:
            rows, fresh = [], set()
            for t in texts:
                found = base_spans(t) if t else []
                assigned = _Taken([(s, e) for s, k, e, _ in found if k == "assign"])
                got = {(k, v) for s, k, e, v in found if k != "hex" or not assigned.meets(s, e)}
                taken = _Taken([(s, e) for s, _, e, _ in found])
                for m in ORDINARY.finditer(t or ""):
                    x = crc32(m[0].encode()), m[0]
                    if (len(least) < most or x < least[-1]) and not taken.meets(*m.span()):
                        fresh.add(x)
                rows.append([{"kind": k, "value": v} for k, v in sorted(got)])
                if fresh and (len(fresh) > most or len(rows) == len(texts)):
                    known, least = set(least), sorted(fresh.union(least))[:most]
                    rows[-1] += [{"kind": "ordinary", "value": v} for x, v in least if (x, v) not in known]
                    fresh = set()
            yield pd.Series(rows)

    each = documents.select(F.explode(label(text)).alias("x")).select("x.kind", "x.value").distinct()
    # dealt by hash first, so that no task ranks all values of a kind
    h = F.when(F.col("kind") == "ordinary", F.crc32("value")).otherwise(F.xxhash64("kind", "value"))
    part = each.withColumn("h", h).withColumn("part", F.pmod("h", F.lit(64)))
    # of each part, its smallest; then those of all parts: at most 64 * most rows of a kind meet
    near = part.withColumn("r", F.row_number().over(Window.partitionBy("kind", "part").orderBy("h", "value"))).where(F.col("r") <= most)
    return near.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))).where(F.col("r") <= most).select("kind", "value")


def fit_grammar(labelled: DataFrame) -> Grammar:
    """Infers the automata from a bounded table of (kind, value); values with foreign characters are left out."""
    by: dict[str, list[str]] = {}
    for kind, value in sorted((r[0], r[1]) for r in labelled.collect()):
        if value and all(c in _CLASS for c in value):
            by.setdefault(kind, []).append(value)
    plain = by.pop("ordinary", [])
    ordinary = Automaton.infer(plain)
    if not plain:  # nothing to compare a token with: no spans are inferred
        return Grammar([], ordinary)
    return Grammar([Automaton.infer(v) for _, v in sorted(by.items())], ordinary)


_SPANS = "array<struct<start:int,kind:string,end:int,score:double>>"


def find(text: str, grammar: Grammar, threshold: float = THRESHOLD) -> list[tuple[int, str, int, float]]:
    """Base spans (score 1) and the spans that the automata add, which overlap no base span."""
    found = [(s, k, e, 1.0) for s, k, e, _ in base_spans(text)]
    for lo, hi, token in _candidates(text, _Taken([(s, e) for s, _, e, _ in found])):
        if (score := grammar.score(token)) >= threshold:
            found.append((lo, INFERRED, hi, score))
    order = {k: i for i, k in enumerate((*KINDS, INFERRED))}
    return sorted(found, key=lambda x: (x[0], order[x[1]]))


def scan_secrets(text: Column | str, grammar: Grammar, threshold: float = THRESHOLD) -> Column:
    """Array of (start, kind, end, score) of every secret in each whole text, in text order.

    Positions are code points, ends exclusive.  Null and empty texts give an empty array.
    """

    @F.pandas_udf(_SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start", "kind", "end", "score")
        for texts in batches:
            yield pd.Series([[dict(zip(names, x)) for x in find(t, grammar, threshold)] if t else [] for t in texts])

    return run(text)


def redact_secrets(text: Column | str, grammar: Grammar, mask: str = "[REDACTED]", threshold: float = THRESHOLD) -> Column:
    """The texts with every secret replaced by ``mask``; overlapping spans become one; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_masked(t, find(t, grammar, threshold), mask) if t else t for t in texts], dtype=object)

    return run(text)


def _masked(text: str, spans: list[tuple[int, str, int, float]], mask: str) -> str:
    out, at = [], 0
    for s, _, e, _ in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit_grammar(examples(docs))
    found = docs.select("doc_id", scan_secrets("text", grammar).alias("s"))
    n = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_listed(F.filter("s", lambda x: x["kind"].isin(*KINDS))).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
