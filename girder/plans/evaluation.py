"""Queries that score the answers of `predictions` which carry their annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonio
from ..operators import evaluation as ev
from ..operators import compare, rewards
from ..session import cut_lineage
from ..tables import RULES, table
from .evaluation_sql import ORACLE, paper_sql


#: The number in an image id however it is padded, null if there is none.
NUMBER = "try_cast(regexp_extract(image_id, '([0-9]+)', 1) as bigint)"


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """prediction_id, run_id, task, raw_output, sample, error, source, latency_seconds of all predictions."""
    tasks = table(spark, folder, "prompt_text").select("prompt_id", "task")
    return table(spark, folder, "predictions").join(F.broadcast(tasks), "prompt_id").select("prediction_id", "run_id", "image_id", "task", "raw_output", "sample", "source", "latency_seconds", "error", "logged_at")


def parsed_answers(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """All predictions with `parsed`: prediction_id, run_id, task, raw_output and more."""
    return jsonio.strictly_parsed(answers(spark, folder).select("prediction_id", "run_id", "task", "raw_output", *more), "raw_output", "task")


def scored_answers(spark: SparkSession, folder: str) -> DataFrame:
    """All predictions whose image is annotated, with `parsed` and `sample`.

    Most predictions carry no sample; theirs is the last one of raw_sample with the same image number. It
    is joined after the parsing, so it doesn't pass through Python.
    """
    samples = table(spark, folder, "raw_sample").withColumn("image", F.expr(NUMBER))
    rows = parsed_answers(spark, folder, "image_id", "sample").withColumn("image", F.expr(NUMBER))
    return ev.with_truth(rows, samples, "image", "sample_id").where("sample is not null").drop("image")


_scored = scored_answers


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _over(metric):
    return lambda spark, folder: _rounded(metric(_scored(spark, folder)))


def _classes(metric, *columns: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        out = metric(ev.class_facts(_scored(spark, folder).where("task = 'unified'")))
        return _rounded(out.select(*columns) if columns else out)

    return query


def _materialised(spark: SparkSession, folder: str) -> DataFrame:
    """The scored answers without their texts, written once for the families that read them."""
    return cut_lineage(_scored(spark, folder).select("prediction_id", "run_id", "task", "parsed", "sample"))


def _full(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.full_evaluation(_materialised(spark, folder), "task"))


def _dual(spark: SparkSession, folder: str) -> DataFrame:
    """Both passes side by side: strict counts failures as empty answers, valid leaves them out."""
    return _rounded(ev.full_evaluation(ev.by_pass(_materialised(spark, folder)), "task", "pass"))


def _reward_means(rows: DataFrame) -> DataFrame:
    names = [f"r_{n}" for n in rewards.WEIGHTS] + ["repetition", "total"]
    return rewards.composite(rows).groupBy("task").agg(F.count(F.lit(1)).alias("answers"), *[F.avg(n).alias(n) for n in names])


#: Settings of a task that is rewarded for rules alone.
VIOLATION_SETTINGS = {
    "reward_components": ["reward_format", "reward_violation_id", "reward_violation_grounding", "reward_reasoning"],
    "reward_weights": {"reward_format": 0.10, "reward_violation_id": 0.40, "reward_violation_grounding": 0.30, "reward_reasoning": 0.20},
}


def _task_rewards(rows: DataFrame) -> DataFrame:
    """The rewards of violations_only by its settings: rules, their boxes and reasons, and the format."""
    names = rewards.assembled(VIOLATION_SETTINGS)
    return rewards.task_rewards(rows.where("task = 'violations_only'"), VIOLATION_SETTINGS).select("prediction_id", *[f"r_{n}" for n in names], "weighted")


def _caption_suite(spark: SparkSession, folder: str) -> DataFrame:
    captions = [F.struct("parsed.caption").alias("parsed"), F.struct("sample.image_caption").alias("sample")]  # nothing else is written
    rows = cut_lineage(_scored(spark, folder).where("task = 'unified'").select("prediction_id", *captions))
    return _rounded(ev.caption_suite(rows, "prediction_id", "caption_"))


def _suite(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.stratified_suite(_materialised(spark, folder)))


PAPER = ["schema_rate", "presence_f1_micro", "mask_exist", "violation_f1_micro", "violation_f1_macro", "gated_f1_micro", "reason_score_macro", "ngram_f1"]


def _paper(spark: SparkSession, folder: str) -> DataFrame:
    """The table of strata; the main table has the same columns."""
    rows = _materialised(spark, folder)
    return _rounded(compare.paper_tables(ev.full_evaluation(rows), ev.stratified_suite(rows), PAPER)[1])


def _funnel(spark: SparkSession, folder: str) -> DataFrame:
    return ev.gates(parsed_answers(spark, folder), "run_id")


def _reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent reasons of failing, ties in the order of their names."""
    parsed = parsed_answers(spark, folder)
    reasons = parsed.where("parsed.error is not null").groupBy(jsonio.short_reason(F.col("parsed.error")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return reasons.orderBy(F.desc("n"), "reason").limit(10)


def _categories(spark: SparkSession, folder: str) -> DataFrame:
    """Answers by fate: valid, truncated, other, or the first error of their shape."""
    parsed = parsed_answers(spark, folder)
    bad = jsonio.failure_category(F.coalesce(jsonio.strip_open_fences(F.col("raw_output")), F.lit("")))
    category = F.when(F.col("parsed.schema_valid"), "valid").when(~F.col("parsed.json_valid"), bad).otherwise(F.get(F.split("parsed.error", ":"), F.lit(1)))
    return parsed.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _triage(spark: SparkSession, folder: str) -> DataFrame:
    """The log by source: empty, without closed fence, clean, failed, and the share of answers at all."""
    text = F.coalesce("raw_output", F.lit(""))
    empty = F.trim(text) == ""
    fence = text.rlike(jsonio.FENCE)
    n = F.count(F.lit(1))
    return _rounded(
        answers(spark, folder).groupBy("source").agg(
            n.alias("rows"), F.count_if(empty).alias("empty"), F.count_if(~empty & ~fence).alias("missing_fence"), F.count_if(fence).alias("clean"),
            F.count_if(F.col("error").isNotNull()).alias("errors"), (100.0 * F.count_if(~empty) / n).alias("success_pct"),
        )
    )


def _rule_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Per answer the rules it reports too much and misses."""
    rules = lambda side: F.array_compact(F.array(*[F.when(F.col(f"{side}.{r}").isNotNull(), F.lit(i + 1)) for i, r in enumerate(RULES)]))
    p, t = rules("parsed"), rules("sample")
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return _scored(spark, folder).select("prediction_id", join(F.array_intersect(p, t)).alias("common"), join(F.array_except(p, t)).alias("extra"), join(F.array_except(t, p)).alias("missed"))


def _consensus(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.text import consensus_score

    rows = cut_lineage(_scored(spark, folder).where("parsed.caption is not null").select("prediction_id", F.col("parsed.caption").alias("p"), F.col("sample.image_caption").alias("r")))
    return _rounded(consensus_score(rows, "prediction_id", "p", "r"))


PRESENCE = ("class", "tp", "fp", "fn", "tn", "exist", "precision", "recall", "f1")
QUERIES = {
    "a1_structural": lambda s, f: _rounded(ev.structural(parsed_answers(s, f), "task")),
    "a2_presence_confusion": _classes(lambda f: ev.presence(f).where("class not in ('micro', 'macro')"), "class", "tp", "fp", "fn", "tn", "exist"),
    "a3_a4_presence_prf": _classes(ev.presence, *PRESENCE),
    "a5_a8_grounding_iou": _classes(ev.grounding),
    "b8_mask_iou": lambda s, f: _rounded(ev.class_facts(_scored(s, f), "prediction_id").select("prediction_id", "class", F.col("mask.iou").alias("iou"), F.col("mask.inter").alias("inter"), F.col("mask.uni").alias("uni"))),
    "b7_greedy_iou": lambda s, f: _rounded(ev.class_facts(_scored(s, f), "prediction_id").select("prediction_id", "class", "greedy.iou", "greedy.inter", "greedy.uni")),
    "a9_a12_violation_prf": _over(ev.violation_scores),
    "a13_iou_conditioned": _over(ev.gated_scores),
    "a14_violation_grounding": _over(ev.violation_grounding),
    "a15_reasoning": _over(ev.reasoning),
    "a16_caption_words": _over(lambda r: ev.captions(r.where("task = 'unified'")).drop("ngram_f1")),
    "x1_caption_ngram_f1": _over(lambda r: ev.captions(r.where("task = 'unified'")).select("ngram_f1")),
    "x7_caption_consensus": _consensus,
    "a17_stratified_presence": _over(lambda r: ev.stratified(r.where("task = 'unified'"), lambda x, *by: ev.presence(ev.class_facts(x, *by), *by)).where("class in ('micro', 'macro')").select("field", "value", "class", "f1")),
    "a17_stratified_violations": _over(lambda r: ev.stratified(r, ev.violation_scores).where("rule in ('micro', 'macro')").select("field", "value", "rule", "f1")),
    "c7_full_evaluation": _full,
    "c8_dual_pass": _dual,
    "c7_failures": lambda s, f: ev.failures(parsed_answers(s, f), "prediction_id"),
    "x10_caption_suite": _caption_suite,
    "a17_stratified_suite": _suite,
    "k10_paper_strata": _paper,
    "a31_gates": _funnel,
    "a32_log_triage": _triage,
    "a33_failure_reasons": _reasons,
    "a30_t26_failure_categories": _categories,
    "o12_rule_sets": _rule_sets,
    "r8_r9_reward_breakdown": _over(lambda r: rewards.composite(r).select("prediction_id", *[f"r_{n}" for n in rewards.WEIGHTS], "repetition", "total")),
    "r8_reward_means": _over(_reward_means),
    "r5_rule_f2": _over(lambda r: rewards.components(r, ("violation_id",)).select("prediction_id", "r_violation_id")),
    "r11_task_rewards": _over(_task_rewards),
    "r12_legacy_rewards": _over(lambda r: rewards.legacy(r).select("prediction_id", "r_json", "r_caption", "r_rules", "r_boxes")),
}

ORACLE["k10_paper_strata"] = paper_sql(PAPER)
