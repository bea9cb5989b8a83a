"""p6 (and the rule 'truncated' of p2): texts that lost their end after they were written.

Every answer is read once (answers.read). An ending inside an object is decisive. An ending without a
sentence mark is weighed: a right-censored length distribution is fitted per source and measure by
maximum likelihood, which gives at each candidate limit the posterior that a text of that length was
censored there; the evidence of the ending is how often whole texts of the corpus end in the same two
words. Both are multiplied as odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import answers

#: Prior odds that a text without a sentence mark at its end was cut mid-transfer, away from any limit.
TRANSFER_ODDS = 0.05
#: Chance that a cut falls behind one given pair of words, and the least chance of an ending of whole texts.
CUT_ENDING, LEAST_ENDING = 1e-4, 1e-5
#: An ending is usual if at least this share of the whole texts of its kind has it.
USUAL_ENDING = 0.01
#: Standard deviations by which the unfinished texts of a length must exceed the expected ones.
LEAST_EXCESS = 3.0

FEATURES = "source STRING, defects ARRAY<STRING>, kind STRING, ending STRING, whole BOOLEAN, stopped BOOLEAN, chars INT, bytes INT, caption_chars INT"
MEASURES = {"chars": "chars", "bytes": "bytes", "caption": "caption_chars"}


def examined(outputs: DataFrame, id: str) -> DataFrame:
    """Read each answer once. `outputs` has id, source, raw_output, prompt, lang; the result id and FEATURES.

    Null answers are empty; answers without a prompt or language are judged by the other rules.
    """
    kept = outputs.select(id, "source", "raw_output", "prompt", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, prompt, lang in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                reading = answers.read(text)
                end = answers.ending(reading)
                n = len(text) if text is not None else None
                size = n if n is None or text.isascii() else len(text.encode("utf-8", "surrogatepass"))
                rows.append((answers.defects(reading, prompt, lang), end.kind, end.words, end.whole, end.stopped, n, size, len(reading.caption) if reading.state == "closed" and reading.caption is not None else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [id, "source", "defects", "kind", "ending", "whole", "stopped", "chars", "bytes", "caption_chars"])

    return kept.mapInArrow(run, f"{id} {kept.schema[id].dataType.simpleString()}, {FEATURES}")


def _fit(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Log-normal (mu, sigma) by maximum likelihood (EM); `censored` is how many of each count were cut there."""
    x = np.log(lengths)
    seen = counts - censored
    mu, sigma = np.average(x, weights=counts), max(0.05, math.sqrt(np.cov(x, fweights=counts.astype(int), ddof=0)) if counts.sum() > 1 else 0.5)
    for _ in range(30):
        z = (x - mu) / sigma
        tail = np.maximum(_survival(z), 1e-12)
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        first = mu + sigma * hazard  # mean of a normal above the limit
        second = mu * mu + sigma * sigma + sigma * hazard * (x + mu)
        total = counts.sum()
        new_mu = (seen @ x + censored @ first) / total
        new_var = (seen @ (x * x) + censored @ second) / total - new_mu**2
        done = abs(new_mu - mu) < 1e-6
        mu, sigma = new_mu, math.sqrt(max(new_var, 0.0025))
        if done:
            break
    return mu, sigma


def _survival(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in z])


def limits_of(histogram: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and measure: length, answers, unfinished, expected, and posterior of being censored there.

    `histogram`: length, n, unstopped (how many of n end without a mark or inside an object) and, where
    there are several, `kind` of answer. Each kind has a length distribution of its own, and a source
    cuts all of them at the same limits, so what they let expect is added up. First the distributions are
    fitted to all lengths; lengths far more frequent among the unfinished texts than they allow become
    candidates; then they are fitted again with these as censored, and the posterior of a candidate is the
    share of its unfinished texts beyond the expected ones.
    """
    empty = pd.DataFrame({"length": [], "answers": [], "unfinished": [], "expected": [], "posterior": []})
    h = histogram[histogram["length"] > 0]
    if h.empty:
        return empty
    if "kind" not in h:
        h = h.assign(kind="")
    length = np.sort(h["length"].unique()).astype(float)
    kinds = [k.groupby("length")[["n", "unstopped"]].sum().reindex(length.astype("int64"), fill_value=0).to_numpy(float).T for _, k in h.groupby("kind")]
    n, unstopped = sum(k[0] for k in kinds), sum(k[1] for k in kinds)
    share_cut = np.zeros_like(n)
    for _ in range(2):
        expected = np.zeros_like(n)
        for own_n, own_unstopped in kinds:
            seen = own_n > 0
            mu, sigma = _fit(length[seen], own_n[seen], (own_unstopped * share_cut)[seen])
            density = _survival((np.log(np.maximum(length - 0.5, 0.5)) - mu) / sigma) - _survival((np.log(length + 0.5) - mu) / sigma)
            expected += density * own_unstopped.sum()  # unfinished texts that would have this length anyway
        excess = unstopped - expected
        candidate = (unstopped >= 5) & (excess > LEAST_EXCESS * np.sqrt(expected + 1)) & (unstopped >= 0.5 * n) & (unstopped > 4 * expected)
        share_cut = np.where(candidate, np.maximum(excess, 0) / np.maximum(unstopped, 1), 0)
    kept = candidate
    columns = {"length": length[kept].astype("int64"), "answers": n[kept].astype("int64"), "unfinished": unstopped[kept].astype("int64"), "expected": expected[kept], "posterior": np.clip(share_cut[kept], 0, 0.999)}
    return pd.DataFrame(columns)


LIMITS = "source STRING, measure STRING, length BIGINT, answers BIGINT, unfinished BIGINT, expected DOUBLE, posterior DOUBLE"


def field_limits(features: DataFrame, shares: DataFrame) -> DataFrame:
    """LIMITS: the limits at which sources cut, source null included.

    Unfinished are texts that end inside an object, or without a mark in words that few whole texts end
    in; of equally long ones with one ending one counts, since a field limit cuts wherever it falls while
    a repeated text always ends alike. A source's histogram has one row per kind and distinct length, so its size doesn't grow with its rows.
    """
    usual = shares.where(F.col("share") >= USUAL_ENDING).select("kind", "ending", F.lit(True).alias("usual"))  # at most 1/USUAL_ENDING a kind
    features = features.join(F.broadcast(usual), ["kind", "ending"], "left").withColumn("whole", F.coalesce("whole", "usual"))
    measured = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("bigint").alias("length"), F.lit(m == "caption").alias("of_caption")) for m, c in MEASURES.items()]))
    loose = F.when(F.col("m.of_caption"), (F.col("kind") == "caption") & F.col("whole").isNull()).otherwise(~F.coalesce("whole", F.lit(False)) & (F.col("kind") != "caption"))
    histogram = (
        features.where(F.size("defects") == 0).select("source", "kind", "whole", "ending", measured.alias("m")).where("m.length is not null")
        .groupBy("source", "m.measure", F.when(F.col("m.of_caption"), "caption").otherwise(F.col("kind")).alias("kind"), "m.length")
        .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(loose, F.col("ending"))).alias("unstopped"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = limits_of(pdf)
        out.insert(0, "measure", pdf["measure"].iloc[0])
        out.insert(0, "source", pdf["source"].iloc[0])
        return out

    return _without_echoes(features, cut_lineage(histogram.groupBy("source", "measure").applyInPandas(fit, LIMITS)))


def _without_echoes(features: DataFrame, limits: DataFrame) -> DataFrame:
    """Limits in characters whose texts mostly lie at one stronger limit in bytes, and the reverse, are its echo and dropped."""
    chars, size = (
        limits.where(F.col("measure") == m).select(F.col("source").alias(f"{m}_source"), F.col("length").alias(f"{m}_length"), F.col("unfinished").alias(f"{m}_strength")) for m in ("chars", "bytes")
    )
    at = lambda m: F.col("source").eqNullSafe(F.col(f"{m}_source")) & (F.col(m) == F.col(f"{m}_length"))
    loose = features.where(~F.coalesce("whole", F.lit(False)) & (F.col("kind") != "caption") & (F.size("defects") == 0)).select("source", "chars", "bytes")
    both = loose.join(chars, at("chars")).join(size, at("bytes"))
    echo = []
    for m, other in (("chars", "bytes"), ("bytes", "chars")):
        weaker = both.where(F.col(f"{m}_strength") < F.col(f"{other}_strength")).groupBy("source", f"{m}_length").agg(F.count(F.lit(1)).alias("shared"), F.max(f"{m}_strength").alias("strength"))
        echo.append(weaker.where(F.col("shared") * 2 >= F.col("strength")).select(F.col("source").alias("e_source"), F.lit(m).alias("e_measure"), F.col(f"{m}_length").alias("e_length")))
    dropped = echo[0].unionByName(echo[1])
    return limits.join(dropped, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("measure") == F.col("e_measure")) & (F.col("length") == F.col("e_length")), "left_anti")


def own_text() -> Column:
    """Answers that are neither empty nor copied from their prompt."""
    return ~F.arrays_overlap("defects", F.array(F.lit("empty"), F.lit("copied_prompt")))


def ending_shares(features: DataFrame) -> DataFrame:
    """(kind, ending, share): how often whole texts of a kind end in these two words, where that is at least LEAST_ENDING.

    Whole are texts that a sentence mark closes; added lines after an object have none, so all count.
    Answers with defects count too, unless they are empty or copied.
    """
    whole = features.where(own_text() & (F.col("ending") != "") & (F.col("stopped") | (F.col("kind") == "tail")))
    counts = cut_lineage(whole.groupBy("kind", "ending").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("of_kind"))  # one row a kind
    return counts.join(F.broadcast(totals), "kind").select("kind", "ending", (F.col("n") / F.col("of_kind")).alias("share")).where(F.col("share") >= LEAST_ENDING)


def unstopped_shares(features: DataFrame, shares: DataFrame) -> DataFrame:
    """(kind, unmarked): of the texts with an ending that is frequent in whole ones, the share without a mark."""
    usual = shares.where(F.col("share") >= USUAL_ENDING).select("kind", "ending")  # at most 1/USUAL_ENDING a kind
    known = features.where(F.size("defects") == 0).join(F.broadcast(usual), ["kind", "ending"])
    return known.groupBy("kind").agg(F.avg((~F.col("stopped")).cast("double")).alias("unmarked"))


def limits(features: DataFrame) -> DataFrame:
    """LIMITS of every source of `examined` rows."""
    return field_limits(features, cut_lineage(ending_shares(features)))


def judged(features: DataFrame, id: str) -> DataFrame:
    """(id, source, defects, truncated, evidence) of every row of `examined`; truncated answers may have other defects too.

    evidence: 'object' for an end inside an object, 'limit' or 'ending' for what the odds of a cut in
    other texts come from, null if not truncated. An answer that is empty or copied from its prompt has
    no text of its own that could be cut.
    """
    weighed = features.where(F.col("whole").isNull() & own_text())
    shares = cut_lineage(ending_shares(features))
    unmarked = unstopped_shares(features, shares)
    found = cut_lineage(field_limits(features, shares))
    at = lambda m: found.where(F.col("measure") == m).select(F.col("source").alias(f"s_{m}"), F.col("length").alias(f"l_{m}"), F.col("posterior").alias(f"p_{m}"))
    rows = weighed.join(shares, ["kind", "ending"], "left").join(F.broadcast(unmarked), "kind", "left")
    for m, c in MEASURES.items():
        own = (F.col("kind") == "caption") if m == "caption" else (F.col("kind") != "caption")
        rows = rows.join(at(m), F.col("source").eqNullSafe(F.col(f"s_{m}")) & (F.col(c) == F.col(f"l_{m}")) & own, "left")
    posterior = F.greatest(*[F.coalesce(f"p_{m}", F.lit(0.0)) for m in MEASURES])
    length_odds = posterior / (1 - posterior)
    mark_odds = 1.0 / F.greatest(F.coalesce("unmarked", F.lit(0.0)), F.lit(0.001))
    end_odds = F.lit(CUT_ENDING) / F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(LEAST_ENDING))
    odds = F.greatest(length_odds, F.lit(TRANSFER_ODDS)) * mark_odds * end_odds
    evidence = F.when(length_odds > TRANSFER_ODDS, "limit").otherwise("ending")
    cut = rows.where(odds > 1.0).select(F.col(id).alias("__id"), evidence.alias("__evidence")).groupBy("__id").agg(F.max("__evidence").alias("__evidence"))
    decided = features.join(cut, F.col(id) == F.col("__id"), "left")
    inside = ~F.coalesce("whole", F.lit(True)) & own_text()
    why = F.when(inside, "object").otherwise(F.col("__evidence"))
    return decided.select(id, "source", "defects", why.isNotNull().alias("truncated"), why.alias("evidence"))


def truncated_by_source(judgements: DataFrame) -> DataFrame:
    """(source, answers, truncated, rate, by_object, by_limit, by_ending) per source, null included."""
    hit = F.sum(F.col("truncated").cast("bigint"))
    return judgements.groupBy("source").agg(
        F.count(F.lit(1)).alias("answers"), hit.alias("truncated"), (hit / F.count(F.lit(1))).alias("rate"), *[F.count_if(F.col("evidence") == e).alias(f"by_{e}") for e in ("object", "limit", "ending")]
    )
