"""The queries p2 to p6 and p8 to p10, and the SQL of those that SQL can express."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import has_boxes, is_violated
from ..session import cut_lineage
from ..tables import CLASSES, METADATA, RULES, table
from . import cooccurrence, mixing, overlap, sampling, subjects, tokenizing, truncation


# p2 and p6: defective and truncated answers
def _examined(spark: SparkSession, folder: str) -> DataFrame:
    prompts = table(spark, folder, "prompt_text").select("prompt_id", "prompt", "lang")
    outputs = table(spark, folder, "predictions").select("prediction_id", "prompt_id", "source", "raw_output").join(prompts, "prompt_id", "left")
    return cut_lineage(truncation.examined(outputs, "prediction_id"))


def judged_answers(spark: SparkSession, folder: str) -> DataFrame:
    """prediction_id, source, defects, truncated, evidence of every answer."""
    return truncation.judged(_examined(spark, folder), "prediction_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    every = F.concat("defects", F.when(F.col("truncated"), F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>")))
    return judged_answers(spark, folder).select("prediction_id", F.explode(every).alias("defect"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return judged_answers(spark, folder).where("truncated").select("prediction_id")


def p6_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The fitted limits of each source and measure with what speaks for them."""
    return truncation.limits(_examined(spark, folder))


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated_by_source(judged_answers(spark, folder))


# p3: overlaps across splits
SAMPLE_COLUMNS = ("sample_id", "split", "image_id", "image_caption")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, folder, "raw_sample"), *SAMPLE_COLUMNS).select(F.least("eval_id", "train_id").alias("sample_id_a"), F.greatest("eval_id", "train_id").alias("sample_id_b"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and source of the evaluation record: its records, those also in training, and the pairs."""
    pairs = overlap.overlap_counts(table(spark, folder, "raw_sample"), *SAMPLE_COLUMNS)
    rows = table(spark, folder, "raw_sample").where("split in ('val', 'test')").select("sample_id", "split", "source")
    return rows.join(pairs, rows["sample_id"] == pairs["eval_id"], "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count("pairs").alias("leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )


# p4: sample by target proportions
def _cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, sampling.SamplePlan]:
    samples = table(spark, folder, "raw_sample")
    rows = samples.select("sample_id", "illumination", is_violated(F.col("rule_4_violation")).cast("bigint").alias("rule_4"))
    targets = table(spark, folder, "target_share").withColumnRenamed("share_pct", "share")
    total = samples.count()
    return rows, targets, sampling.SamplePlan("sample_id", ("illumination", "rule_4"), total // 10, rows=total)


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.proportional_sample(*_cells(spark, folder))


def _needed(rows: int) -> Column:
    return F.greatest("min_rows", F.floor(F.lit(rows) * F.col("share") / 1000)).cast("bigint")


def _report(spark: SparkSession, folder: str) -> DataFrame:
    rows, targets, plan = _cells(spark, folder)
    needed = _needed(rows.count() if plan.rows is None else plan.rows)
    report = sampling.sample_report(rows, targets, plan)
    return report.withColumn("needed", needed).withColumn("short", F.greatest(needed - F.col("available"), F.lit(0)))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder).select("illumination", "rule_4", F.col("share").alias("share_pct"), "min_rows", "needed", "available", "taken", "short")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Short cells: a draw that serves every cell's needed rows first takes fewer of theirs.

    The draw is as large as all needs together, so a cell that gets less has no more. The count of its
    rows is the check behind it; it alone decides a cell without a share, from which nothing is drawn.
    """
    rows, targets, plan = _cells(spark, folder)
    floors = targets.withColumn("min_rows", _needed(rows.count() if plan.rows is None else plan.rows))
    size = floors.agg(F.sum("min_rows")).first()[0] or 0
    report = sampling.sample_report(rows, floors, replace(plan, size=size))
    return report.where((F.col("taken") < F.col("min_rows")) & (F.col("available") < F.col("min_rows"))).select("illumination", "rule_4")


# p5: items that appear together
def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """One row per raw_sample row: sample_id and its items."""
    samples = table(spark, folder, "raw_sample")
    domains = table(spark, folder, "domain_value")
    flags: list[Column] = [F.when(is_violated(F.col(r)), F.lit(r)) for r in RULES] + [F.when(has_boxes(F.col(c)), F.lit(c)) for c in CLASSES]
    for c in METADATA:
        allowed = domains.where(F.col("column_name") == c).select(F.col("allowed_value").alias(c), F.concat(F.lit(f"{c}:"), "allowed_value").alias(f"__{c}")).distinct()
        samples = samples.join(allowed, c, "left")
        flags.append(F.col(f"__{c}"))
    return samples.select("sample_id", F.array_compact(F.array(*flags)).alias("items"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.pair_counts(baskets(spark, folder), "items")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    joint, n = F.col("joint"), F.col("baskets")
    case = (joint >= 10) & (joint * 100 >= n) & (joint * n * 4 > F.col("rows_a") * F.col("rows_b") * 5)
    return _pairs(spark, folder).where(case).select("item_a", "item_b")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("item_a", "item_b", "joint", "rows_a", "rows_b", F.round("lift", 6).alias("lift"))


# p8: encoding
def x12_chars_per_token(spark: SparkSession, folder: str) -> DataFrame:
    """Per source the answers, their characters and tokens, and the characters a token."""
    answers = table(spark, folder, "predictions").select("source", F.coalesce(F.length("raw_output"), F.lit(0)).alias("chars"), "raw_output")
    sizes = tokenizing.token_counts(answers, ["source", "chars"], "raw_output")
    total = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("answers"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    return total.withColumn("chars_per_token", F.round(F.when(F.col("tokens") > 0, F.col("chars") / F.col("tokens")).otherwise(0.0), 6))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.encoded(table(spark, folder, "documents"), ["doc_id"], "text")


# p9: mix of sources
def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokenizing.token_counts(table(spark, folder, "documents"), ["doc_id", "source"], "text")
    return mixing.mixture(sizes, table(spark, folder, "mix_target"), mixing.MixPlan())


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1].withColumn("share", F.round("share", 6))


# p10: subject areas
def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.assigned(table(spark, folder, "documents"), table(spark, folder, "doc_label"), table(spark, folder, "subject_area"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p10_accuracies(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.voter_accuracies(table(spark, folder, "documents"), table(spark, folder, "doc_label"), table(spark, folder, "subject_area"))


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per subject: documents that deal with it, their share of all documents, and its sentences in them."""
    documents = table(spark, folder, "documents").count()
    found = _subjects(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))
    return found.withColumn("share", F.col("documents") / F.lit(max(documents, 1)))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p6_limits": p6_limits,
    "p4_found": p4_found,
    "p4_sample": p4_sample,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p8_ids": p8_ids,
    "x12_chars_per_token": x12_chars_per_token,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
    "p10_accuracies": p10_accuracies,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
}

_SPACE = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_VIOLATED = f"({{0}} IS NOT NULL AND (coalesce(len({{0}}.bounding_box), 0) > 0 OR NOT coalesce(regexp_full_match({{0}}.reason, '{_SPACE}*'), true)))".replace("{0}", "@")
_violated = lambda c: _VIOLATED.replace("@", c).replace("{{", "{").replace("}}", "}")
_CELLS = f"""
r AS (SELECT illumination, CASE WHEN {_violated("rule_4_violation")} THEN 1 ELSE 0 END AS rule_4 FROM raw_sample),
n AS (SELECT count(*) AS n FROM r),
t AS (SELECT t.*, (SELECT count(*) FROM r WHERE r.illumination = t.illumination AND r.rule_4 = t.rule_4) AS available,
             greatest(t.min_rows, (SELECT n FROM n) * t.share_pct // 1000) AS needed FROM target_share t)"""
_ITEMS = " UNION ALL ".join(
    [f"SELECT sample_id, '{r}' AS item FROM raw_sample WHERE {_violated(r)}" for r in RULES]
    + [f"SELECT sample_id, '{c}' FROM raw_sample WHERE len({c}) > 0" for c in CLASSES]
    + [f"SELECT sample_id, '{c}:' || {c} FROM raw_sample WHERE {c} IN (SELECT allowed_value FROM domain_value WHERE column_name = '{c}')" for c in METADATA]
)
_PAIRS = f"""
i AS ({_ITEMS}),
s AS (SELECT item, count(*) AS n FROM i GROUP BY item),
j AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS joint FROM i a JOIN i b ON a.sample_id = b.sample_id AND a.item < b.item GROUP BY ALL),
p AS (SELECT j.*, a.n AS rows_a, b.n AS rows_b, (SELECT count(*) FROM raw_sample) AS n FROM j JOIN s a ON a.item = item_a JOIN s b ON b.item = item_b)"""

ORACLE = {
    "p4_found": f"WITH {_CELLS} SELECT illumination, rule_4 FROM t WHERE available < needed",
    "p4_sample": f"""WITH {_CELLS.replace("SELECT illumination,", "SELECT sample_id, illumination,", 1)},
k AS (SELECT r.*, t.share_pct, t.min_rows, CAST('0x' || substr(md5(concat_ws(':', '42', sample_id)), 1, 15) AS BIGINT) AS key FROM r JOIN t ON r.illumination = t.illumination AND r.rule_4 = t.rule_4),
o AS (SELECT *, row_number() OVER (PARTITION BY illumination, rule_4 ORDER BY key, sample_id) AS n FROM k),
p AS (SELECT *, CASE WHEN n <= min_rows THEN -1.0 / (1.0 + (n - 0.5) / share_pct) ELSE (n - 0.5) / share_pct END AS priority FROM o)
SELECT sample_id, illumination, CAST(rule_4 AS BIGINT) AS rule_4 FROM p ORDER BY priority, illumination, rule_4, key, sample_id LIMIT (SELECT n // 10 FROM n)""",
    "p4_report": f"""WITH {_CELLS},
ranks AS (SELECT illumination, rule_4, min_rows, share_pct, unnest(range(1, available + 1)) AS k FROM t),
order_ AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN k <= min_rows THEN -1.0 / (1.0 + (k - 0.5) / share_pct) ELSE (k - 0.5) / share_pct END, illumination, rule_4, k) AS place FROM ranks),
taken AS (SELECT illumination, rule_4, count(*) AS taken FROM order_ WHERE place <= (SELECT n FROM n) // 10 GROUP BY ALL)
SELECT t.illumination, t.rule_4, t.share_pct, t.min_rows, t.needed, t.available, CAST(coalesce(taken, 0) AS BIGINT) AS taken, greatest(t.needed - t.available, 0) AS short
FROM t LEFT JOIN taken USING (illumination, rule_4)""",
    "p5_found": f"WITH {_PAIRS} SELECT item_a, item_b FROM p WHERE joint >= 10 AND joint * 100 >= n AND joint * n * 4 > rows_a * rows_b * 5",
    "p5_pairs": f"WITH {_PAIRS} SELECT item_a, item_b, joint, rows_a, rows_b, round(joint * CAST(n AS DOUBLE) / (CAST(rows_a AS DOUBLE) * rows_b), 6) AS lift FROM p",
}
