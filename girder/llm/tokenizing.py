"""p8: encoding with a public byte-level BPE vocabulary, by forced boundaries.

A pair of adjacent bytes that occurs inside no token can't be bridged by any token, so a cut between
them is certain. Texts are cut at such pairs, but only where the vocabulary's own splitting pattern
sees the same pieces on both sides: between a character that isn't white space and white space, and,
inside long runs, anywhere but before an apostrophe. The fragments are encoded independently, each
distinct one once per worker while it is remembered, and their ids are concatenated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: white space as the pattern's \s understands it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACES = "\t\n\x0b\x0c\r "
WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LONG_RUN = 256
REMEMBERED = 200_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def unforced_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 flags: the byte pairs that occur inside a token. All others are certain cuts."""
    inside = np.zeros((256, 256), bool)
    for token in ranks:
        codes = np.frombuffer(token, np.uint8)
        inside[codes[:-1], codes[1:]] = True
    return inside


class Encoder:
    """Encodes texts by one vocabulary; holds at most REMEMBERED fragments, whatever the corpus."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self._bpe = tiktoken.Encoding("girder", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._inside = unforced_pairs(ranks)
        self._space_cut = re.compile("|".join(self._before(c) for c in ASCII_SPACES))
        free = not any(self._bridged(c) for c in ASCII_SPACES)
        self._quick = re.compile(f"[{ASCII_SPACES}]*[^{ASCII_SPACES}]+|[{ASCII_SPACES}]+").findall if free else None
        self._known: dict[str, list[int]] = {}

    def _bridged(self, space: str) -> list[int]:
        return [b for b in range(256) if self._inside[b, ord(space)] and not (b < 128 and chr(b).isspace())]

    def _before(self, space: str) -> str:
        """A pattern for the forced places before this white-space character."""
        bridged = self._bridged(space)
        barred = "".join(re.escape(chr(b)) for b in bridged if b < 128) + ("\x80-\U0010ffff" if any(b > 127 for b in bridged) else "")
        return f"(?<=[^{SPACES}{barred}])(?={re.escape(space)})"

    def fragments(self, text: str) -> list[str]:
        if self._quick and (text.isascii() or not WIDE_SPACE.search(text)):
            found = self._quick(text)  # the same places, found faster
        else:
            found = self._space_cut.split(text)
        if max(map(len, found)) <= LONG_RUN:
            return found
        return list(chain.from_iterable([f] if len(f) <= LONG_RUN else self._split_run(f) for f in found))

    def _split_run(self, run: str) -> list[str]:
        raw = run.encode("utf-8", "surrogatepass")
        codes = np.frombuffer(raw, np.uint8)
        a, b = codes[:-1], codes[1:]
        plain = lambda x: (x > 0x20) & (x < 0x7F)
        cuts = np.flatnonzero(~self._inside[a, b] & plain(a) & plain(b) & (b != 0x27)) + 1
        edges = [0, *cuts.tolist(), len(raw)]
        return [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(edges, edges[1:], strict=False)]

    def encode(self, text: str | None) -> list[int]:
        """The ids; an empty list for an empty or null text."""
        if not text:
            return []
        known, encode = self._known, self._bpe.encode_ordinary
        ids: list[int] = []
        for f in self.fragments(text):
            own = known.get(f)
            if own is None:
                own = encode(f)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(f) <= LONG_RUN:
                    known[f] = own
            ids += own
        return ids


def _encoders(spark: SparkSession, path: str):
    shared = spark.sparkContext.broadcast(read_ranks(path))  # bounded by the vocabulary, 50 000 entries
    return lambda: Encoder(shared.value)


def encoded(df: DataFrame, keys: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The key columns and `ids` (ARRAY<INT>) of each row, one row out per row in, nothing shuffled.

    Null and empty texts get an empty list. Strings of special tokens are ordinary text. Other columns
    of `df` are ignored, so their names can't clash.
    """
    kept = df.select(*keys, F.col(text).alias("__text"))
    make = _encoders(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(len(keys)).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], out], [*keys, "ids"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[: len(keys)], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counts(df: DataFrame, keys: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The key columns and `tokens` (BIGINT) of each row; 0 for null and empty texts."""
    kept = df.select(*keys, F.col(text).alias("__text"))
    make = _encoders(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            counts = pa.array([len(encoder.encode(t)) for t in batch.column(len(keys)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], counts], [*keys, "tokens"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[: len(keys)], T.StructField("tokens", T.LongType())]))
