"""License scans with a generalised suffix automaton of licence tokens.

All template texts are put into one automaton.  Streaming a file through it gives, at each
word, the longest suffix read so far that occurs in some template (matching statistics);
long matches of one template are then chained into covered spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import table, words_of
from eventlens.llm.license_texts import TEMPLATES

#: Fixed by the contract: phrase -> label; every place counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words a match must have to be chained, and words that may lie between two chained matches.
MIN_MATCH, MAX_GAP = 4, 12

#: A chain gives its label if it covers this share of its template's words, or so many of them.
SHARE, COVER = 0.4, 40

#: Most words that all templates may have: every worker builds the automaton, of at most twice as
#: many states.
TEMPLATE_WORDS = 200_000


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers (0: a word of no template)."""

    vocabulary: dict[bytes, int]
    step: list[dict[int, int]]
    link: list[int]
    length: list[int]
    ends: list[dict[int, int]]  #: of each state: template -> where the state's words first end in it
    templates: list[tuple[str, int]]  #: label and number of words
    phrases: list[tuple[tuple[int, str], ...]]
    pairs: np.ndarray  #: sorted codes of word numbers that stand side by side in a template
    single: bool  #: whether a phrase of one word exists

    @classmethod
    def build(cls, templates: dict[str, tuple[str, ...]], phrases: dict[str, str]) -> Automaton:
        texts = [(words_of(t), label) for label, many in templates.items() for t in many] + [(words_of(p), label) for p, label in phrases.items()]
        if (n := sum(len(ws) for ws, _ in texts)) > TEMPLATE_WORDS:
            raise ValueError(f"templates have {n} words, more than {TEMPLATE_WORDS}")
        vocabulary: dict[bytes, int] = {}
        coded = [([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], label) for ws, label in texts]
        step, link, length = [{}], [-1], [0]

        def extend(last: int, c: int) -> int:
            if c in step[last]:
                q = step[last][c]
                return q if length[q] == length[last] + 1 else split(last, c, q)
            new = len(step)
            step.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
            return new

        def split(p: int, c: int, q: int) -> int:
            twin = len(step)
            step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
            link[q] = twin
            while p != -1 and step[p].get(c) == q:
                step[p][c] = twin
                p = link[p]
            return twin

        for ws, _ in coded:
            last = 0
            for c in ws:
                last = extend(last, c)
        # the templates of a state and where it ends in them, by walking each text again
        ends: list[dict[int, int]] = [{} for _ in step]
        for t, (ws, _) in enumerate(coded):
            v = 0
            for i, c in enumerate(ws, 1):
                v = step[v][c]
                u = v
                while u > 0 and t not in ends[u]:
                    ends[u][t] = i
                    u = link[u]
        at: list[list[tuple[int, str]]] = [[] for _ in step]
        for p, label in phrases.items():
            v = 0
            for w in words_of(p):
                v = step[v][vocabulary[w]]
            at[v].append((len(words_of(p)), label))
        known: list[tuple[tuple[int, str], ...]] = [()] * len(step)
        for v in sorted(range(1, len(step)), key=lambda v: length[v]):
            known[v] = known[link[v]] + tuple(at[v])
        wide = len(vocabulary) + 1
        pairs = np.unique(np.array([a * wide + b for ws, _ in coded for a, b in zip(ws, ws[1:])], np.int64))
        return cls(vocabulary, step, link, length, ends, [(label, len(ws)) for ws, label in coded], known, pairs, any(len(words_of(p)) == 1 for p in phrases))

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words that may match: a match of two words or more consists of pairs of a template."""
        if self.single:
            hot = np.flatnonzero(ids)
        else:
            hot = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            code = ids[hot] * (len(self.vocabulary) + 1) + ids[hot + 1]
            at = np.searchsorted(self.pairs, code)
            hot = hot[(at < len(self.pairs)) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == code)] if len(self.pairs) else hot[:0]
        if len(hot):
            for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
                yield int(run[0]), int(run[-1]) + (1 if self.single else 2)

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(i, length, state) at each word i whose longest match with some template has two words or more (or one, if a phrase has one)."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        for lo, hi in self._runs(ids):
            v = l = 0
            for i in range(lo, hi):
                c = int(ids[i])
                while v and c not in self.step[v]:
                    v = self.link[v]
                    l = self.length[v]
                if c in self.step[v]:
                    v, l = self.step[v][c], l + 1
                yield i, l, v

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int, int, float]]]:
        """Words, phrase places (label, start, words) and spans (label, start, end, covered words, share of the template)."""
        words = words_of(text)
        places: list[tuple[str, int, int]] = []
        matches: list[tuple[int, int, int]] = []  # start, end, state of matches that no next word extends
        before = (-1, 0, 0)
        for i, l, v in self.statistics(words):
            j, m, u = before
            if m >= MIN_MATCH and (i != j + 1 or l <= m):
                matches.append((j + 1 - m, j + 1, u))
            before = i, l, v
            for n, label in self.phrases[v]:
                if n <= l:
                    places.append((label, i - n + 1, n))
        j, m, u = before
        if m >= MIN_MATCH:
            matches.append((j + 1 - m, j + 1, u))
        return len(words), places, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """Spans: each template's matches, with gaps of at most MAX_GAP words, that cover enough of it.

        Where spans of several labels overlap, those that cover the most words stay; of one label's, one.
        """
        open_: dict[int, list] = {}  # template -> start, end, covered words of it
        done: list[tuple[int, int, int, str, float]] = []

        def close(t: int) -> None:
            start, end, covered = open_.pop(t)
            label, n = self.templates[t]
            if len(covered) >= min(COVER, max(MIN_MATCH, SHARE * n)):
                done.append((-len(covered), start, end, label, len(covered) / n))

        for lo, hi, v in matches:
            for t, end in self.ends[v].items():
                if t in open_ and lo - open_[t][1] > MAX_GAP:
                    close(t)
                run = open_.setdefault(t, [lo, hi, set()])
                run[1] = max(run[1], hi)
                run[2].update(range(end - (hi - lo), end))
        for t in list(open_):
            close(t)
        kept: list[tuple[int, int, int, str, float]] = []
        for x in sorted(done, key=lambda x: (x[0], -x[4], *x[1:4])):
            over = [k for k in kept if x[1] < k[2] and k[1] < x[2]]
            if not any(k[3] == x[3] or k[0] < x[0] or k[4] > x[4] for k in over):
                kept.append(x)
        return sorted((label, start, end, -covered, share) for covered, start, end, label, share in kept)


@lru_cache(maxsize=4)
def _automaton(templates: tuple[tuple[str, tuple[str, ...]], ...], phrases: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton.build(dict(templates), dict(phrases))


_KIND = "n_words long, places array<struct<label:string,start:int,words:int>>, spans array<struct<label:string,start:int,end:int,covered:int,share:double>>"


def scan_licenses(text: Column | str, templates: dict[str, tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """Struct of n_words, places (every place of a phrase) and spans (covered template spans).

    Positions count words from 0, ends are exclusive.  Whole texts are scanned; null counts
    as empty and gives no places.  The automaton is as large as the templates, never as the
    data: more than TEMPLATE_WORDS words are refused.
    """
    held = tuple((k, tuple(v)) for k, v in (TEMPLATES if templates is None else templates).items()), tuple((PHRASES if phrases is None else phrases).items())
    _automaton(*held)  # refuses too many words before any task runs

    @F.pandas_udf(_KIND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(*held)
        for texts in batches:
            rows = [automaton.scan(t) for t in texts]
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "places": [[dict(zip(("label", "start", "words"), p)) for p in r[1]] for r in rows],
                    "spans": [[dict(zip(("label", "start", "end", "covered", "share"), s)) for s in r[2]] for r in rows],
                }
            )

    return run(text)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", scan_licenses("text").alias("s"))
    places = F.col("s.places")
    base = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
    all_labels = F.array_sort(F.array_union(base, F.transform("s.spans", lambda p: p["label"])))
    covered = F.aggregate("s.spans", F.lit(0), lambda a, s: a + s["covered"])
    strength = F.size(places) * 2 + covered
    return docs.select(
        "doc_id",
        F.col("s.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["start"])).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        (strength / (strength + 4.0)).alias("score"),
        F.col("s.spans").alias("spans"),
    )


QUERIES = {"op3_license_scan": op3_license_scan}
