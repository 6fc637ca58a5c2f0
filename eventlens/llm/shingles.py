"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes -> class: 0 white space between words, else the byte that is hashed.
_BLANK = np.array([0 if b in (32, 9, 10, 11, 12, 13) else 1 if b == 0 else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ASCII = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)

#: "blank": words between ASCII white space; "ascii": between ASCII bytes other than digits and
#: letters.  A-Z are lower-cased in both.  A zero byte in a word of "blank" is hashed as byte 1.
TABLES = {"blank": _BLANK, "ascii": _ASCII}

#: Bytes of text that are hashed together: bounds the arrays, at about 60 bytes for each.
CHUNK = 1 << 20

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        grown = np.full(max(n, 2 * len(_power)), _BASE)
        grown[0] = 1
        _power = np.multiply.accumulate(grown)
    return _power


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts as bytes, in runs of about CHUNK; a longer text makes a run of its own."""
    run, size = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if run and size + len(raw) > CHUNK:
            yield run
            run, size = [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield run


def _hashes(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of words that stand one after the other in ``letters`` and begin at ``at``."""
    size = np.diff(at, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(at, size)
    return mix(np.add.reduceat(_BYTE[letters] * _powers(int(size.max()))[place], at))


def word_runs(texts: list[str | None], kind: str, ends: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts, in order: 64-bit hashes of all their words, and where each text's begin (and end).

    With ``ends``, a third array: the word numbers before which a sentence ends or a line breaks.
    """
    table = TABLES[kind]
    for run in _chunks(texts):
        size = np.fromiter(map(len, run), np.int64, len(run)) + 1
        text_at = np.concatenate(([0], np.cumsum(size)))
        raw = b"\n".join(run) + b"\n"
        hashes, starts, stops, lo = [], [], [], 0
        while lo < len(raw):
            hi = _piece_end(raw, lo, table)
            part = np.frombuffer(raw, np.uint8, hi - lo, lo)
            b = table[part]
            kept = b != 0
            first = kept.copy()
            first[1:] &= ~kept[:-1]
            at = np.flatnonzero(first)
            starts.append(at + lo)
            hashes.append(_hashes(b[kept], np.flatnonzero(first[kept])) if len(at) else np.empty(0, np.uint64))
            if ends:
                stop = _STOP[part]
                stop[:-1] &= ~kept[1:]
                if hi < len(raw):
                    stop[-1:] &= table[raw[hi]] == 0
                stops.append(np.flatnonzero(stop | (part == 10)) + lo)
            lo = hi
        h, starts = np.concatenate(hashes), np.concatenate(starts)
        bounds = np.searchsorted(starts, text_at)
        if ends:
            yield h, bounds, np.searchsorted(starts, np.concatenate(stops))
        else:
            yield h, bounds


def _piece_end(raw: bytes, lo: int, table: np.ndarray) -> int:
    """Where the bytes that are hashed together end: after about CHUNK of them, not inside a word."""
    hi = lo + 2 * CHUNK
    while hi < len(raw):
        gap = np.flatnonzero(table[np.frombuffer(raw[hi : hi + CHUNK], np.uint8)] == 0)
        if len(gap):
            return hi + int(gap[0]) + 1
        hi += CHUNK
    return len(raw)


_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def shingle_sets(texts: list[str | None], kind: str, width: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of ``width`` words; fewer words make one; none, none."""
    out = []
    for h, bounds in word_runs(texts, kind):
        n = max(0, len(h) - width + 1)
        s = np.zeros(n, np.uint64)
        for i in range(width):
            s += h[i : i + n] * _ODD[i]
        s = mix(s)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= width:
                out.append(np.unique(s[lo : hi - width + 1]))
            elif hi > lo:
                out.append(mix((h[lo:hi] * _ODD[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
            else:
                out.append(np.empty(0, np.uint64))
    return out

