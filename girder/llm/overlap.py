"""p3: records of evaluation splits that are also in the training split, exactly or nearly.

Captions are canonicalised (case, punctuation, spacing, character forms) and hashed; equal hashes are
one class, and everything below works on one row per class. Near matches are found without a miss by a
prefix filter: a caption of n words shares at least three quarters of them with any partner, so of its
n/4 + k rarest words at least k are the partner's too. The evaluation classes are the query set; they
are compared with all training classes in cells. In a cell every word has a bit row over the training
classes, and the bit rows of a caption's rarest words are added up bit by bit, so that one pass of a few
hundred operations on long integers rules out thousands of training classes. The few pairs left are
compared word by word. On texts whose vocabulary grows, most words' bit rows are nearly empty; with a
closed vocabulary the time grows with the product of the two sides.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Shared words over the larger number of words, from which two captions are of the same wording.
SAME_WORDING = 0.75
#: Codes that words are hashed to; words that share one can only add pairs to check.
CODES = 1 << 16
#: A caption's rarest words are counted beyond the necessary ones by this share of all its words.
SURPLUS = 1 / 4
#: Training classes in one bit row, and evaluation classes whose rows are added up together.
ROW_BITS, TOGETHER = 8_192, 32
#: Most classes of a side in one cell, the classes from which a side is split at all, and the parts it then has at least.
CELL, SMALL_CELL, LEAST_PARTS = 32_768, 4_096, 4

# Letters of other scripts that look like Latin ones, and the Latin ones.
LOOKALIKES = (
    {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
     "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "υ": "u", "ε": "e"}
)
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_SENTENCE = re.compile(r"[.!?;:]+(?=\s|$)|\n+")
_WORD = re.compile(r"\w+")


def canonical(text: str) -> list[list[str]]:
    """The words of each sentence in one form: no case, marks, accents, invisible or look-alike characters."""
    if not text.isascii() or "&" in text:
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", html.unescape(text)))
        for mark in [c for c in set(text) if unicodedata.combining(c)]:
            text = text.replace(mark, "")
        text = text.casefold()
        for letter in LOOKALIKES.keys() & set(text):
            text = text.replace(letter, LOOKALIKES[letter])
    else:
        text = text.lower()
    return [words for s in _SENTENCE.split(text) if (words := _WORD.findall(s))]


def _mapped(df: DataFrame, schema: str, make):
    """mapInArrow over single-use rows: `make` turns the columns of a batch into the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from make(batch)

    return df.mapInArrow(run, schema)


def canonical_captions(records: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep… and `canon`: the canonical words, one line a sentence; empty for null texts and texts without words."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lines = ["\n".join(map(" ".join, canonical(t or ""))) for t in batch.column(len(keep)).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lines, pa.string())], [*keep, "canon"])

    kept = records.select(*keep, F.col(text).alias("__text"))
    return _mapped(kept, ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keep) + ", canon STRING", make)


def code_row(canon: str, known: dict[str, list[int]]) -> np.ndarray:
    """A code of each word; the second use of a word is another word, so that shared words are shared codes."""
    used: dict[str, int] = {}
    codes = []
    for w in canon.split():
        n = used[w] = used.get(w, -1) + 1
        own = known.get(w)
        if own is None:
            if len(known) > 200_000:
                known.clear()
            own = known[w] = []
        if n == len(own):
            own.append(xxhash.xxh64_intdigest(w, n) % CODES)
        codes.append(own[n])
    return np.array(codes, np.uint16)


def coded(classes: DataFrame) -> DataFrame:
    """(class_id, in_train, in_eval, words, codes): number of words, and the code of each as 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            rows = [code_row(c, known) for c in batch.column(1).to_pylist()]
            words, packed = pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], words, packed], ["class_id", "in_train", "in_eval", "words", "codes"])

    return classes.select("class_id", "canon", "in_train", "in_eval").mapInArrow(run, "class_id BIGINT, in_train BOOLEAN, in_eval BOOLEAN, words INT, codes BINARY")


def _bit_rows(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row of bits per code of a block, set for the classes that have it, and the row of each code.

    The last row is empty; it is that of the codes nobody has.
    """
    code = np.concatenate(block)
    member = np.repeat(np.arange(len(block)), [len(r) for r in block])
    own, at = np.unique(code, return_inverse=True)
    flags = np.zeros((len(own) + 1, -(-len(block) // 64) * 64), bool)
    flags[at, member] = True
    row_of = np.full(CODES, len(own), np.int64)
    row_of[own] = np.arange(len(own))
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64), row_of


def at_least(rows: list[np.ndarray], least: int) -> np.ndarray:
    """The bits that are set in at least `least` of the rows: the rows are added up by carry-save adders."""
    planes: list[list[np.ndarray]] = [list(rows)]  # the bits of planes[k] count 2^k each
    k = 0
    while k < len(planes):
        waiting = planes[k]
        while len(waiting) > 1:
            a, b = waiting.pop(), waiting.pop()
            odd, carry = a ^ b, a & b
            if waiting:
                c = waiting.pop()
                carry |= odd & c
                odd ^= c
            if k + 1 == len(planes):
                planes.append([])
            planes[k + 1].append(carry)
            waiting.append(odd)
        k += 1
    # compare the sums with `least` from the highest bit down
    above = np.zeros_like(rows[0])
    equal = ~above
    for k in reversed(range(max(len(planes), least.bit_length()))):
        plane = planes[k][0] if k < len(planes) else np.zeros_like(above)
        if least >> k & 1:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above | equal


@dataclass
class _Side:
    """The classes of one side of a cell in order of their length."""

    ids: np.ndarray
    words: np.ndarray
    codes: list[np.ndarray]

    @staticmethod
    def of(table: pa.Table) -> _Side:
        table = table.sort_by("words")
        return _Side(table["class_id"].to_numpy(), table["words"].to_numpy().astype(np.int64), [np.frombuffer(c, np.uint16) for c in table["codes"].to_pylist()])


def possible_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """(eval_class, train_class): all pairs of two cells that may be of the same wording, by length and shared codes."""
    evals, trains = _Side.of(left), _Side.of(right)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(evals.ids) and len(trains.ids):
        frequency = np.bincount(np.concatenate(trains.codes), minlength=CODES)
        rare_first = [c[np.argsort(frequency[c], kind="stable")] for c in evals.codes]
        for start in range(0, len(trains.ids), ROW_BITS):
            end = min(start + ROW_BITS, len(trains.ids))
            bits, row_of = _bit_rows(trains.codes[start:end])
            # evaluation classes whose length is in reach of the block's lengths
            low = np.searchsorted(evals.words, SAME_WORDING * trains.words[start])
            high = np.searchsorted(evals.words, trains.words[end - 1] / SAME_WORDING, "right")
            for e in range(low, high, TOGETHER):
                group = range(e, min(e + TOGETHER, high))
                found += [(np.full(len(t), evals.ids[i]), trains.ids[t]) for i, t in _partners(group, rare_first, bits, row_of, trains, start)]
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"eval_class": x[x != y], "train_class": y[x != y]})


def _partners(group: range, rare_first: list[np.ndarray], bits: np.ndarray, row_of: np.ndarray, trains: _Side, start: int) -> Iterator[tuple[int, np.ndarray]]:
    """(evaluation class, places of its possible partners in the block that begins at `start`) of a group of like length."""
    needed = [math.ceil(SAME_WORDING * len(rare_first[i])) for i in group]
    surplus = min(needed[0], max(1, int(SURPLUS * len(rare_first[group[0]]))))  # the first is the shortest
    counted = [len(rare_first[i]) - n + surplus for i, n in zip(group, needed, strict=True)]
    place = np.full((max(counted), len(group)), len(bits) - 1)
    for k, i in enumerate(group):
        place[: counted[k], k] = row_of[rare_first[i][: counted[k]]]
    hits = at_least([bits[p] for p in place], surplus)
    flags = np.zeros(CODES, bool)
    for k in np.flatnonzero(hits.any(axis=1)):
        own = rare_first[group[k]]
        at = start + np.flatnonzero(np.unpackbits(hits[k].view(np.uint8), bitorder="little"))
        flags[own] = True
        shared = np.add.reduceat(flags[np.concatenate([trains.codes[t] for t in at])], np.r_[0, np.cumsum(trains.words[at])[:-1]], dtype=np.int64)
        flags[own] = False
        kept = at[shared >= SAME_WORDING * np.maximum(len(own), trains.words[at])]
        if len(kept):
            yield group[k], kept


def _parts(count: int) -> int:
    return max(-(-count // CELL), min(LEAST_PARTS, -(-count // SMALL_CELL)), 1)


def same_wording(a: str, b: str) -> bool:
    """Whether the shared words, in any order, are at least SAME_WORDING of the longer caption's words."""
    x, y = a.split(), b.split()
    longer, left = max(len(x), len(y)), Counter(y)
    if min(len(x), len(y)) < SAME_WORDING * longer:
        return False
    shared = 0
    for w in x:
        if n := left.get(w):
            left[w] = n - 1
            shared += 1
    return shared >= SAME_WORDING * longer


def near_classes(classes: DataFrame) -> DataFrame:
    """(eval_class, train_class): different classes of the same wording, one used in evaluation, one in training.

    `classes`: class_id, canon, in_train, in_eval. A class on both sides is compared as either. Each pair
    meets in one cell, that of its evaluation part and its training part.
    """
    sizes = classes.agg(F.count_if("in_eval").alias("evals"), F.count_if("in_train").alias("trains")).first()
    rows = cut_lineage(coded(classes))
    eval_parts, train_parts = _parts(sizes["evals"]), _parts(sizes["trains"])
    part = lambda parts: F.pmod(F.xxhash64("class_id"), F.lit(parts)).cast("bigint")
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    left = rows.where("in_eval").select(part(eval_parts).alias("e"), every(train_parts).alias("t"), "class_id", "words", "codes")
    right = rows.where("in_train").select(every(eval_parts).alias("e"), part(train_parts).alias("t"), "class_id", "words", "codes")
    candidates = left.groupBy("e", "t").cogroup(right.groupBy("e", "t")).applyInArrow(possible_pairs, "eval_class BIGINT, train_class BIGINT")
    text = classes.select("class_id", "canon")
    with_text = (
        candidates.join(text.withColumnsRenamed({"class_id": "eval_class", "canon": "eval_canon"}), "eval_class")
        .join(text.withColumnsRenamed({"class_id": "train_class", "canon": "train_canon"}), "train_class")
        .select("eval_class", "train_class", "eval_canon", "train_canon")
    )

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        same = [same_wording(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["eval_class", "train_class"]).filter(pa.array(same, pa.bool_()))

    return _mapped(with_text, "eval_class BIGINT, train_class BIGINT", make)


def image_number(image_id):
    """The number in an image id however it is written: padded or not, with prefix, suffix or spaces; else null."""
    wide = "".join(chr(0xFF10 + i) for i in range(10))
    digits = F.regexp_extract(F.translate(image_id, wide, "0123456789"), r"(\d{1,18})", 1)
    return F.when(digits != "", digits.cast("bigint"))


@dataclass(frozen=True)
class Sides:
    """members: id, is_train, number, class_id of every record; links: (eval_class, train_class), equal classes included."""

    members: DataFrame
    links: DataFrame


def linked_classes(records: DataFrame, id: str, split: str, image: str, caption: str, train: str) -> Sides:
    """The classes of equal canonical captions and their links; a record without words has a null class.

    A class is the captions of one hash and one length in characters, so that a chance collision of the
    64-bit hash alone doesn't join two wordings.
    """
    rows = records.where(F.col(split).isNotNull()).select(
        F.col(id).alias("id"), (F.col(split) == train).alias("is_train"), image_number(F.col(image)).alias("number"), F.col(caption).alias("caption")
    )
    canon = canonical_captions(rows, ["id", "is_train", "number"], "caption")
    members = cut_lineage(canon.withColumn("class_id", F.when(F.col("canon") != "", F.xxhash64("canon", F.length("canon")))))
    classes = cut_lineage(
        members.where("class_id is not null").groupBy("class_id").agg(F.min("canon").alias("canon"), F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_eval"))
    )
    same = classes.where("in_train and in_eval").select(F.col("class_id").alias("eval_class"), F.col("class_id").alias("train_class"))
    return Sides(members.drop("canon"), near_classes(classes).unionByName(same))


def split_overlaps(records: DataFrame, id: str, split: str, image: str, caption: str, train: str = "train") -> DataFrame:
    """(eval_id, train_id): all pairs of a training and an evaluation record with one image number or wording.

    Rows whose split is null take part in neither side. Null or unreadable image ids and null or blank
    captions match nothing. Repeated ids give repeated rows only once. Empty inputs give no rows.
    """
    sides = linked_classes(records, id, split, image, caption, train)
    of = lambda train, name, *more: sides.members.where(F.col("is_train") == train).select(F.col("id").alias(f"{name}_id"), *more)
    by_image = of(False, "eval", "number").join(of(True, "train", "number"), "number").drop("number")
    e, t = of(False, "eval", F.col("class_id").alias("eval_class")), of(True, "train", F.col("class_id").alias("train_class"))
    by_caption = sides.links.join(e, "eval_class").join(t, "train_class").select("eval_id", "train_id")
    return by_image.unionByName(by_caption).distinct()


def overlap_counts(records: DataFrame, id: str, split: str, image: str, caption: str, train: str = "train") -> DataFrame:
    """(eval_id, pairs): evaluation records with at least one training record, and the number of these.

    The pairs are not built: partners by image number and by caption are counted from the sizes of the
    numbers and classes, and those that are both are taken off once. Records with one id count as one.
    """
    sides = linked_classes(records, id, split, image, caption, train)
    members = sides.members.distinct()
    links = cut_lineage(sides.links)
    e = members.where("not is_train").select(F.col("id").alias("eval_id"), "number", F.col("class_id").alias("eval_class"))
    t = members.where("is_train").select("id", "number", F.col("class_id").alias("train_class"))
    size = F.count(F.lit(1))
    by_number = t.where("number is not null").groupBy("number").agg(size.alias("n_image"))
    by_class = links.join(t.groupBy("train_class").agg(size.alias("n")), "train_class").groupBy("eval_class").agg(F.sum("n").alias("n_caption"))
    kinds = e.where("number is not null and eval_class is not null").select("number", "eval_class").distinct()
    by_both = kinds.join(links, "eval_class").join(t.groupBy("number", "train_class").agg(size.alias("n")), ["number", "train_class"]).groupBy("number", "eval_class").agg(F.sum("n").alias("n_both"))
    found = e.join(by_number, "number", "left").join(by_class, "eval_class", "left").join(by_both, ["number", "eval_class"], "left").na.fill(0, ["n_image", "n_caption", "n_both"])
    pairs = F.col("n_image") + F.col("n_caption") - F.col("n_both")
    return found.groupBy("eval_id").agg(F.max(pairs).alias("pairs")).where("pairs > 0")
