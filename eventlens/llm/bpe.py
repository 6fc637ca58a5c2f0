"""BPE encoding and decoding by forced boundaries.

Byte pairs that occur inside no vocabulary token mark places which no token can span.
Where such a pair also parts two kinds of pre-token (white space, letters, digits, signs),
the cut is certain: fragments are encoded independently and concatenated, so a fragment
that was met before costs one look-up, and a very long text is never handed to the
library whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from struct import Struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import table

#: Most fragments and bytes of fragments in each of a worker's two memos: when the first is full,
#: it takes the place of the second, from which fragments that come again are taken back.
MEMO_FRAGMENTS, MEMO_BYTES = 200_000, 24_000_000

#: Rows that are encoded, decoded and handed on together, and most fragments that are learnt at once:
#: both bound a worker's memory.
SLICE, STEP = 256, 50_000


def default_path() -> str:
    """The word-end BPE vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character: character -> byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def inner_pairs(vocabulary: list[str], suffix: str) -> np.ndarray:
    """256 x 256 booleans: which byte pairs stand side by side inside some token."""
    alphabet, seen = _byte_alphabet(), np.zeros((256, 256), bool)
    for token in vocabulary:
        raw = [alphabet[c] for c in token.removesuffix(suffix) if c in alphabet]
        seen[raw[:-1], raw[1:]] = True
    return seen


def certain_cuts(pairs: np.ndarray) -> np.ndarray:
    """256 x 256 booleans: pairs of lower-cased bytes between which every encoding has a boundary.

    Absent from all tokens, and of different kinds: white space, a letter, a digit, or a sign.
    Bytes beyond ASCII and apostrophes, whose pre-tokens depend on their neighbours, are no cuts.
    """
    kind = np.zeros(256, np.int8)
    kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
    kind[ord("a") : ord("z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 4
    differ = (kind[:, None] != kind[None, :]) & (kind[:, None] > 0) & (kind[None, :] > 0)
    return ~pairs & differ


class Encoder:
    """Encodes and decodes whole texts with one tokenizer file; one per worker and path."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        pairs = inner_pairs([t for t in spec["model"]["vocab"] if t.encode() not in self.special], suffix)
        blank = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
        if not suffix or pairs[blank].any() or pairs[:, blank].any() or any(b" " in s for s in self.special):
            raise ValueError("white space is no certain cut in this vocabulary")
        self.cuts = certain_cuts(pairs)
        self.cuts[blank] = self.cuts[:, blank] = False  # white space parts fragments by itself
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.ends = np.array([t.endswith(suffix) for t in self.tokens])
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.memo_bytes = 0

    def fragments(self, text: str) -> list[bytes]:
        """The parts between certain cuts, without white space."""
        raw = text.encode("utf-8", "replace")
        if any(s in raw for s in self.special):
            return raw.split()
        low = np.frombuffer(raw.lower(), np.uint8)
        at = np.flatnonzero(self.cuts[low[:-1], low[1:]]) + 1
        return (np.insert(np.frombuffer(raw, np.uint8), at, 32).tobytes() if len(at) else raw).split()

    def _learn(self, fragments: set[bytes]) -> dict[bytes, bytes]:
        """Packed ids of each of the fragments, which the first memo holds afterwards."""
        got = {f: self.old[f] for f in fragments if f in self.old}
        new = sorted(fragments.difference(got))
        texts = [f.decode("utf-8") for f in new]
        # ASCII letters alone are one pre-token, which normalization only lower-cases: the model takes it as it is
        plain, pack, known = self.library.model.tokenize, _PACK, set()
        for i, t in enumerate(texts):
            if t.isalpha() and t.isascii():
                ids = [x.id for x in plain(t.lower())]
                got[new[i]] = pack[len(ids)](*ids) if len(ids) < len(pack) else np.asarray(ids, "<u4").tobytes()
                known.add(i)
        # other letters alone are one pre-token each, too: many are encoded as one text, and its ids are
        # parted after the tokens that end a word
        words = [i for i, t in enumerate(texts) if i not in known and t.isalpha()]
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000]
            ids = np.asarray(self.library.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, "<u4")
            stop = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stop) == len(part) and stop[-1] == len(ids):
                packed = ids.tobytes()
                for i, a, z in zip(part, [0, *stop], stop):
                    got[new[i]] = packed[4 * a : 4 * z]
        rest = [i for i, f in enumerate(new) if f not in got]
        for lo in range(0, len(rest), 1000):
            part = rest[lo : lo + 1000]
            for i, e in zip(part, self.library.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                got[new[i]] = np.asarray(e.ids, "<u4").tobytes()
        size = sum(len(f) + len(x) for f, x in got.items())
        if len(self.memo) + len(got) > MEMO_FRAGMENTS or self.memo_bytes + size > MEMO_BYTES:
            self.old, self.memo, self.memo_bytes = self.memo, {}, 0
        if len(got) <= MEMO_FRAGMENTS and size <= MEMO_BYTES:
            self.memo.update(got)
            self.memo_bytes += size
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of several texts."""
        parts = [self.fragments(t) if t else [] for t in texts]
        found = [list(map(self.memo.get, p)) for p in parts]
        if open_ := [i for i, got in enumerate(found) if None in got]:
            missing = {f for i in open_ for f, x in zip(parts[i], found[i]) if x is None}
            if len(missing) <= STEP:
                fresh = self._learn(missing)
                for i in open_:
                    found[i] = [fresh[f] if x is None else x for f, x in zip(parts[i], found[i])]
            else:  # many new fragments: text by text, in steps
                for i in open_:
                    found[i] = list(self._in_steps(parts[i]))
        return [b"".join(got) for got in found]

    def _in_steps(self, fragments: list[bytes]) -> Iterator[bytes]:
        for lo in range(0, len(fragments), STEP):
            part = fragments[lo : lo + STEP]
            known = {f: x for f in part if (x := self.memo.get(f)) is not None}
            known.update(self._learn(set(part).difference(known)))
            yield b"".join(map(known.__getitem__, part))

    def decode(self, ids: bytes) -> str:
        """As the library without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Packers of so many ids.
_PACK = [Struct(f"<{n}I").pack for n in range(16)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(text: Column | str, path: str | None = None) -> Column:
    """Token ids of a text column, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give an empty value.  ``path``: a tokenizer file with word-end
    BPE, readable on every executor; by default the installed one.
    """

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path or default_path())
        for texts in batches:
            rows = texts.tolist()
            yield pd.Series([x for lo in range(0, len(rows), SLICE) for x in e.encode_many(rows[lo : lo + SLICE])], dtype=object)

    return run(text)


def decode(ids: Column | str, path: str | None = None) -> Column:
    """Text of packed ids; null gives an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path or default_path())
        for rows in batches:
            yield pd.Series([e.decode(x or b"") for x in rows], dtype=object)

    return run(ids)


def token_count(ids: Column | str) -> Column:
    """Number of packed ids."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return (F.octet_length(ids) / 4).cast("long")


def bpe_round_trip(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``documents`` with ``ids`` (packed) and ``decoded`` (text).

    Narrow: no shuffle, one row out for each row in; columns of those names are replaced.
    Texts are read whole; null counts as empty.  A worker's memory holds one batch of rows
    and the bounded fragment memo.
    """
    schema = T.StructType([f for f in documents.schema if f.name not in ("ids", "decoded")] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or default_path())
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ids = e.encode_many(part.column(text).to_pylist())
                columns = [part.column(f.name) for f in schema.fields[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array([e.decode(x) for x in ids], pa.string())], names=schema.names)

    return documents.mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")))


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return coded.select(
        "doc_id",
        token_count("ids").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_bpe": op4_bpe}
