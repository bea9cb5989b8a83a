"""Text similarity as column expressions, and over a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .boxes import let

#: Most n-grams whose document frequency every Python worker holds (16 bytes each).
LISTED = 1 << 20
#: Rows (at most 1024) and about as many words that are worked on at once.
ROWS, WORDS = 1024, 1 << 18


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores of any script; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), F.lit(1)), F.array().cast("array<string>"))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams in order, words joined by one space."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def ngram_f1(pred: Column, ref: Column) -> Column:
    """F1 of the sets of 1-grams and 2-grams; 0 if either text has no word."""
    grams = lambda text: let(tokens(text), lambda t: F.array_distinct(F.concat(t, ngrams(t, 2))))

    def score(s: Column) -> Column:
        # with x, y and shared members, precision and recall combine to 2 shared / (x + y)
        return F.when((s["x"] == 0) | (s["y"] == 0), F.lit(0.0)).otherwise(2.0 * s["shared"] / (s["x"] + s["y"]))

    sizes = lambda s: let(F.struct(F.size(s["x"]).alias("x"), F.size(s["y"]).alias("y"), F.size(F.array_intersect(s["x"], s["y"])).alias("shared")), score)
    return let(F.struct(grams(pred).alias("x"), grams(ref).alias("y")), sizes)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def length_factor(pred: Column, ref: Column, floor: float) -> Column:
    """exp(-((lp - lr) / sigma)^2 / 2) over word counts, sigma = max(0.6 lr, floor)."""
    lp, lr = word_count(pred), word_count(ref)
    z = (lp - lr) / F.greatest(lr * F.lit(0.6), F.lit(floor))
    return F.exp(-0.5 * z * z)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 if one is null, empty or all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def clip_score(image: Column, text: Column) -> Column:
    """max(0, 2.5 cos) of an image and a text embedding, null without an image."""
    return F.when(image.isNotNull(), F.greatest(F.lit(0.0), 2.5 * cosine(image, text)))


def consensus_score(pairs: DataFrame, id: str, pred: str, ref: str, most: int = 4, sigma: float = 6.0) -> DataFrame:
    """CIDEr-D per row from the published definition, with words as of `tokens`: (id, score).

    TF-IDF weighted n-grams (1 to `most`), document frequencies over the references, predicted counts
    clipped to the reference's, a Gaussian penalty on the length difference, ten times the mean over n.
    Rows without words on either side score 0. `pairs` is read more than once and should be materialised.
    """
    return caption_scores(pairs, id, pred, ref, most, sigma).select(id, "score")


def caption_scores(pairs: DataFrame, id: str, pred: str, ref: str, most: int = 4, sigma: float = 6.0, listed: int = LISTED) -> DataFrame:
    """(id, score, ngram_f1): `consensus_score` and `ngram_f1` of each row from one counting of its n-grams.

    n-grams are told apart by 64-bit hashes and counted where their row is. The `listed` most frequent ones
    of the references are known to every task with their document frequency; only if there are more do
    the others, of rows where pred and ref share an n-gram of that length, meet theirs in a join, and then
    `id` must be unique. So texts and sums are all that is written while the list holds all.
    """
    kept = pairs.select(F.col(id).alias("row"), F.col(pred).alias("__p"), F.col(ref).alias("__r"))
    hashed = lambda c: F.transform(tokens(F.col(c)), lambda w: F.xxhash64(w))
    # many rows share a reference: its n-grams are taken once and weighted
    refs = kept.groupBy("__r").agg(F.count(F.lit(1)).alias("k")).select("k", hashed("__r").alias("r"))
    df = cut_lineage(refs.mapInArrow(_document_counts(most), "g BIGINT, df BIGINT").groupBy("g").agg(F.sum("df").alias("df")))
    least, whole = _least_listed(df, listed)
    n_rows = kept.count()
    unseen = float(np.log(max(n_rows, 1)))
    top = df.where(F.col("df") >= least).toArrow().sort_by("g")
    known = (top["g"].to_numpy(), unseen - np.log(top["df"].to_numpy()), unseen, whole)
    shared = pairs.sparkSession.sparkContext.broadcast(known)  # bounded by `listed`
    schema = T.StructType([kept.schema["row"], *T._parse_datatype_string("gap INT, ngram_f1 DOUBLE, sums ARRAY<DOUBLE>, rest ARRAY<STRUCT<n: INT, g: BIGINT, p: INT, r: INT>>")])
    # the texts are smaller than the hashes of their words, and no task gets all rows of an image with many
    found = kept.repartition("row").select("row", hashed("__p").alias("p"), hashed("__r").alias("r")).mapInArrow(_pair_sums(most, shared), schema)
    if not whole:
        found = cut_lineage(found)
        rest = found.select("row", F.inline("rest")).join(df.where(F.col("df") < least), "g", "left")
        w = F.lit(unseen) - F.log(F.coalesce("df", F.lit(1)).cast("double"))
        terms = (F.least("p", "r") * F.col("r") * w * w, F.pow(F.col("p") * w, 2), F.pow(F.col("r") * w, 2))
        more = rest.groupBy("row").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("n") == n, t)), F.lit(0.0)) for n in range(1, most + 1) for t in terms]).alias("more"))
        added = F.when(F.col("more").isNotNull(), F.zip_with("sums", "more", lambda a, b: a + b)).otherwise(F.col("sums"))
        found = found.join(more, "row", "left").withColumn("sums", added)
    similar = []
    for n in range(most):
        dot, np_, nr = (F.col("sums")[3 * n + i] for i in range(3))
        similar.append(F.when((np_ > 0) & (nr > 0), dot / (F.sqrt(np_) * F.sqrt(nr))).otherwise(0.0))
    score = 10.0 / most * sum(similar[1:], similar[0]) * F.exp(-F.pow("gap", 2) / (2 * sigma * sigma))
    return found.select(F.col("row").alias(id), score.alias("score"), "ngram_f1")


def _least_listed(df: DataFrame, listed: int) -> tuple[int, bool]:
    """The smallest power of 2 (or 0) that at most `listed` document frequencies reach, and whether it is below all."""
    levels = {r["level"]: r["n"] for r in df.groupBy((F.length(F.bin("df")) - 1).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for level in sorted(levels, reverse=True):
        listed -= levels[level]
        if listed < 0:
            return 2 ** (level + 1), False
    return 0, True


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scrambled one to one (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows, and where each row's begin and end."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy().view(np.uint64), offsets - offsets[0]


def _parts(*offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded length and, if a row isn't longer by itself, words."""
    ends, a = sum(offsets), 0
    while a < len(ends) - 1:
        b = min(a + ROWS, max(a + 1, int(np.searchsorted(ends, ends[a] + WORDS, "right")) - 1), len(ends) - 1)
        yield a, b
        a = b


def _distinct(words: np.ndarray, line: np.ndarray, most: int, alive) -> Iterator[tuple[np.ndarray, ...]]:
    """For each n the distinct n-grams of each row: hash, row, how often on an even line, how often on any.

    Lines 2 i and 2 i + 1 are the two sides of row i; no n-gram spans lines. From n = 2 on only rows are
    looked at for which alive() holds.
    """
    g = _mixed(words + np.uint64(1))
    for n in range(1, most + 1):
        if n > 1:
            g = _mixed(g[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :] + np.uint64(n))
        first = line[: len(g)]
        at = np.flatnonzero((first == line[n - 1 :]) & alive()[first >> 1]) if n > 1 else np.arange(len(g))
        if not len(at):
            return
        one, side = g[at], first[at]
        row = side >> 1
        order = np.argsort((row.astype(np.uint64) << np.uint64(54)) | (one >> np.uint64(10)))
        one, row, even = one[order], row[order], (side[order] & 1) == 0
        starts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (row[1:] != row[:-1])]))
        yield one[starts].view(np.int64), row[starts], np.add.reduceat(even.astype(np.int64), starts), np.diff(np.append(starts, len(one)))


def _document_counts(most: int):
    def run(batches):
        for batch in batches:
            k, (words, at) = batch.column("k").to_numpy(), _flat(batch.column("r"))
            grams, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in _parts(at):
                line = np.repeat(np.arange(b - a) * 2, np.diff(at[a : b + 1]))
                everywhere = np.ones(b - a, bool)
                for g, row, *_ in _distinct(words[at[a] : at[b]], line, most, lambda: everywhere):  # noqa: B023
                    grams.append(g)
                    counts.append(k[a:b][row])
            g, k = np.concatenate(grams), np.concatenate(counts)
            order = np.argsort(g)
            g, k = g[order], k[order]
            starts = np.flatnonzero(np.diff(g, prepend=g[:1] - 1))
            yield pa.RecordBatch.from_arrays([pa.array(g[starts]), pa.array(np.add.reduceat(k, starts) if len(g) else k)], ["g", "df"])

    return run


def _pair_sums(most: int, shared):
    """Per row: words of pred less those of ref, F1 of the sets of 1- and 2-grams, (dot, pred's and ref's squared norm) of each n, and the n-grams still without weight."""

    def part(p: np.ndarray, pn: np.ndarray, r: np.ndarray, rn: np.ndarray):
        listed, weights, unseen, whole = shared.value
        size = len(pn)
        line = np.concatenate([np.repeat(np.arange(size) * 2, pn), np.repeat(np.arange(size) * 2 + 1, rn)])
        sums, sets, alive, rest = np.zeros((size, 3 * most)), np.zeros((3, size)), np.zeros(size, bool), []
        for n, (g, row, in_p, total) in enumerate(_distinct(np.concatenate([p, r]), line, most, lambda: alive)):
            in_r = total - in_p
            both = np.minimum(in_p, in_r)
            if n < 2:
                sets += [np.bincount(row[x > 0], minlength=size) for x in (in_p, in_r, both)]
            # a row without a common n-gram has similarity 0 at this n and any larger one
            alive = np.bincount(row, both, size) > 0
            on = alive[row]
            g, row, in_p, in_r, both = g[on], row[on], in_p[on], in_r[on], both[on]
            w = np.full(len(g), unseen)
            here = np.zeros(len(g), bool)
            if len(listed):
                at = np.minimum(np.searchsorted(listed, g), len(listed) - 1)
                here = listed[at] == g
                w[here] = weights[at[here]]
            if not whole:
                w[~here] = 0.0
                rest.append((np.full((~here).sum(), n + 1), *(x[~here] for x in (g, in_p, in_r, row))))
            for i, x in enumerate((both * in_r * w * w, (in_p * w) ** 2, (in_r * w) ** 2)):
                sums[:, 3 * n + i] = np.bincount(row, x, size)
        f1 = np.where((pn > 0) & (rn > 0), 2.0 * sets[2] / np.maximum(sets[0] + sets[1], 1), 0.0)
        n, g, in_p, in_r, row = map(np.concatenate, zip(*rest)) if rest else [np.zeros(0, np.int64)] * 5
        order = np.argsort(row, kind="stable")
        members = pa.StructArray.from_arrays([pa.array(x[order].astype(t)) for x, t in ((n, "i4"), (g, "i8"), (in_p, "i4"), (in_r, "i4"))], ["n", "g", "p", "r"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))]).astype("i4")
        return [
            pa.array((pn - rn).astype("i4")), pa.array(f1), pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype="i4") * (3 * most)), pa.array(sums.ravel())), pa.ListArray.from_arrays(pa.array(ends), members),
        ]

    def run(batches):
        for batch in batches:
            (p, at_p), (r, at_r) = _flat(batch.column("p")), _flat(batch.column("r"))
            for a, b in _parts(at_p, at_r):
                out = part(p[at_p[a] : at_p[b]], np.diff(at_p[a : b + 1]), r[at_r[a] : at_r[b]], np.diff(at_r[a : b + 1]))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), *out], ["row", "gap", "ngram_f1", "sums", "rest"])

    return run
