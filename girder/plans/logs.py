"""Queries over the answer log: repair and its reports, resume, deduplication, runs compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import repair, text
from ..functions.predicates import is_blank
from ..operators import arrange, audit, compare, conversations, rewards
from ..operators import evaluation as ev
from ..session import cut_lineage
from ..tables import RULES, table
from .evaluation import NUMBER, answers, scored_answers
from .evaluation_sql import MODEL_VALUES, RULE_SCORES, TEXT_WORDS


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repair.with_repair(answers(spark, folder).select("prediction_id", "run_id", "task", "raw_output"), "raw_output", "task")


def _statuses(spark: SparkSession, folder: str) -> DataFrame:
    counts = _repaired(spark, folder).groupBy("task", F.col("repair.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("task")), 2))


def _events(kind: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        events = _repaired(spark, folder).select("prediction_id", F.explode(f"repair.{kind}").alias("e"))
        each = events.groupBy("prediction_id", "e.type").agg(F.count(F.lit(1)).alias("k"))
        return each.groupBy("type").agg(F.sum("k").alias("occurrences"), F.count(F.lit(1)).alias("records"))

    return query


def _broken(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder).where("repair.status in ('invalid_json', 'invalid_schema')").select("prediction_id", F.col("repair.status").alias("status"), F.col("repair.error").alias("error"), F.size("repair.changes").alias("changes_attempted"))


def _repaired_log(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repaired_log(answers(spark, folder).select("prediction_id", "task", "raw_output"), "raw_output", "task")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "predictions").select("prediction_id", "run_id", "image_id", "raw_output", "latency_seconds", "source", "error", "logged_at", "arrived_at")


def _pending(spark: SparkSession, folder: str) -> DataFrame:
    """Images of raw_sample (by number) without a non-empty answer."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9]+)', 1) as bigint)")
    images = table(spark, folder, "raw_sample").select(number("image_id").alias("image")).where("image is not null").distinct()
    log = _log(spark, folder).select(number("image_id").alias("image"), "raw_output").where("image is not null")
    return arrange.pending(images, log, "image")


def _first_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The first non-empty answer of each run and image, by log time and id."""
    log = _log(spark, folder).where(~is_blank(F.col("raw_output"))).select("run_id", "image_id", "prediction_id", "logged_at")
    return arrange.first_per_key(log, ["run_id", "image_id"], [F.col("logged_at"), F.col("prediction_id")]).select("run_id", "image_id", "prediction_id")


def _islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of consecutive failed answers within each model run."""
    return audit.islands(_log(spark, folder).select("run_id", "prediction_id", "error"), "run_id", "prediction_id", F.col("error").isNotNull())


def _latency(spark: SparkSession, folder: str) -> DataFrame:
    out = audit.summary(_log(spark, folder), "latency_seconds", "run_id")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


MODEL_METRICS = ("json_rate", "schema_rate", "violation_f1_micro", "violation_f1_macro", "presence_f1_micro", "mask_exist", "gated_f1_micro", "reason_score_all", "ngram_f1")


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(run, metric, value) of each model over all its answers."""
    models = table(spark, folder, "model_run").select("run_id", F.col("model_name").alias("run"))
    rows = cut_lineage(scored_answers(spark, folder).join(F.broadcast(models), "run_id").select("run", "task", "parsed", "sample"))
    return ev.full_evaluation(rows, "run").where(F.col("metric").isin(*MODEL_METRICS))


def _against(spark: SparkSession, folder: str) -> DataFrame:
    out = compare.against(_metrics(spark, folder), "run", "vlm_base_a")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    out = compare.wide(_metrics(spark, folder), "run", list(MODEL_METRICS), True)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _outstanding(spark: SparkSession, folder: str) -> DataFrame:
    """Images on which the tuned models gain most over the others, and those on which they fail."""
    models = table(spark, folder, "model_run").select("run_id", F.when(F.col("model_name").contains("reward"), "final").otherwise("base").alias("run"))
    rows = scored_answers(spark, folder).join(F.broadcast(models), "run_id")
    scores = rewards.components(rows, ("violation_id",)).select("image_id", "run", F.col("r_violation_id").alias("score"))
    return compare.outstanding(compare.merged_answers(scores, "image_id", "run", ["base", "final"]), "image_id", "base", "final")


def _word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts of true and answered captions and reasons, as summaries per source of the text."""
    side = lambda origin, kind, t: F.struct(F.lit(origin).alias("origin"), F.lit(kind).alias("kind"), t.alias("t"))
    texts = [side("truth", "caption", F.col("sample.image_caption")), side("answer", "caption", F.col("parsed.caption"))]
    for r in RULES:
        texts += [side(o, "reason", F.when(F.col(f"{c}.{r}").isNotNull(), F.coalesce(f"{c}.{r}.reason", F.lit("")))) for o, c in (("truth", "sample"), ("answer", "parsed"))]
    flat = scored_answers(spark, folder).select(F.inline(F.array(*texts))).where("t is not null").withColumn("words", text.word_count(F.col("t")))
    out = audit.summary(flat, "words", "origin", "kind")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _with_image(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with the resolution of their image, by image number; null where the image is missing."""
    number = F.expr("try_cast(regexp_extract(image_id, '([0-9]+)', 1) as bigint)")
    images = table(spark, folder, "raw_sample").select(number.alias("image"), "resolution").where("image is not null").groupBy("image").agg(F.max("resolution").alias("resolution"))
    log = table(spark, folder, "predictions").select("prediction_id", number.alias("image"))
    return log.join(images, "image", "left").select("prediction_id", "resolution")


def _cosines(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each embedding with the next one by id."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


def _seeded(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded evaluation sample of 200 test images (the size is the operator's parameter)."""
    rows = table(spark, folder, "raw_sample").where("split = 'test'").select("sample_id", "split")
    return arrange.seeded_first_n(rows, "sample_id", 200)


def _missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Image ids of predictions, as written, that no sample has."""
    return arrange.missing_keys(table(spark, folder, "predictions"), table(spark, folder, "raw_sample"), "image_id")


def _id_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of each run that failed and that are usable, by id."""
    status = F.when(is_blank(F.col("raw_output")), "failed").otherwise("usable")
    return _log(spark, folder).select("run_id", "prediction_id", status.alias("status"))


def _rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with the last sample of their image number, those of unknown images left out."""
    number = F.expr(NUMBER)
    images = table(spark, folder, "raw_sample").select(number.alias("image"), "sample_id", "split", "resolution")
    log = table(spark, folder, "predictions").select("prediction_id", number.alias("image"))
    return conversations.rejoined(log, images, "image", "sample_id").drop("image")


CHARTS = {"shape": ["json_rate", "schema_rate", "repair_rate"], "rules": ["violation_f1_micro", "violation_f1_macro", "gated_f1_micro"], "boxes": ["mask_exist", "presence_f1_micro"]}
MODELS = ["vlm_base_a", "vlm_base_b", "vlm_tuned_a", "vlm_tuned_b", "vlm_reward_a", "vlm_reward_b"]


def _charts(spark: SparkSession, folder: str) -> DataFrame:
    out = compare.chart(cut_lineage(_metrics(spark, folder)), "run", CHARTS)
    return out.withColumn("value", F.round("value", 6))


def _heat_map(spark: SparkSession, folder: str) -> DataFrame:
    out = compare.heat_map(_metrics(spark, folder), "run", MODELS, list(MODEL_METRICS))
    return out.select("metric", *[F.round(m, 6).alias(m) for m in MODELS])


def _clip_mean(spark: SparkSession, folder: str) -> DataFrame:
    """CLIPScore of each vector as an image with the next one as its text, per label; vectors without a next one have no text."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    score = text.clip_score(F.col("embedding"), F.col("other"))
    return e.join(nxt, "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 5).alias("clipscore"))


QUERIES = {
    "c5_chart_rows": _charts,
    "c6_heat_map": _heat_map,
    "x9_clip_score": _clip_mean,
    "o4_seeded_sample": _seeded,
    "j6_missing_ids": _missing_ids,
    "o15_failure_ids": _id_lists,
    "a27_repair_status": _statuses,
    "a28_repair_changes": _events("changes"),
    "a28_repair_warnings": _events("warnings"),
    "t25_still_broken": _broken,
    "t24_repaired_log": _repaired_log,
    "j4_pending_images": _pending,
    "o10_first_answers": _first_answers,
    "o9_failure_runs": _islands,
    "a24_latency_summary": _latency,
    "c2_model_metrics": _wide,
    "c4_against_base": _against,
    "o3_outstanding": _outstanding,
    "x11_word_counts": _word_counts,
    "j1_rejoined": _rejoined,
    "j2_with_image": _with_image,
    "x2_cosine": _cosines,
}

_NUMBER = "TRY_CAST(NULLIF(regexp_extract(image_id, '([0-9]+)', 1), '') AS BIGINT)"
_EMPTY = "regexp_full_match(coalesce(raw_output, ''), '[\\x{0009}-\\x{000D}\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*')"
ORACLE = {
    "o4_seeded_sample": "SELECT sample_id, split FROM raw_sample WHERE split = 'test' ORDER BY CAST('0x' || substr(md5(concat_ws(':', '42', sample_id)), 1, 15) AS BIGINT), sample_id LIMIT 200",
    "j6_missing_ids": "SELECT DISTINCT image_id FROM predictions WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM raw_sample WHERE image_id IS NOT NULL)",
    "o15_failure_ids": f"SELECT run_id, prediction_id, CASE WHEN {_EMPTY} THEN 'failed' ELSE 'usable' END AS status FROM predictions",
    "j1_rejoined": f"SELECT p.prediction_id, i.sample_id, i.split, i.resolution FROM (SELECT prediction_id, {_NUMBER} AS image FROM predictions) p JOIN (SELECT {_NUMBER} AS image, max(sample_id) AS sample_id FROM raw_sample GROUP BY 1) m USING (image) JOIN raw_sample i ON i.sample_id = m.sample_id",
    "j4_pending_images": f"SELECT DISTINCT {_NUMBER} AS image FROM raw_sample WHERE {_NUMBER} IS NOT NULL AND {_NUMBER} NOT IN (SELECT {_NUMBER} FROM predictions WHERE trim(coalesce(raw_output, '')) <> '' AND {_NUMBER} IS NOT NULL)",
    "o10_first_answers": "SELECT run_id, image_id, prediction_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image_id ORDER BY logged_at, prediction_id) AS k FROM predictions WHERE NOT regexp_full_match(coalesce(raw_output, ''), '[\\x{0009}-\\x{000D}\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*')) WHERE k = 1",
    "o9_failure_runs": "WITH p AS (SELECT run_id, prediction_id, error IS NOT NULL AS f, row_number() OVER (PARTITION BY run_id ORDER BY prediction_id) AS n FROM predictions), r AS (SELECT *, n - row_number() OVER (PARTITION BY run_id ORDER BY prediction_id) AS run FROM p WHERE f) SELECT run_id, min(prediction_id) AS first, max(prediction_id) AS last, count(*) AS length FROM r GROUP BY run_id, run",
    "a24_latency_summary": "SELECT run_id, count(latency_seconds) AS count, round(min(latency_seconds), 6) AS min, round(max(latency_seconds), 6) AS max, round(avg(latency_seconds), 6) AS mean, round(stddev_pop(latency_seconds), 6) AS std, " + ", ".join(f"round(quantile_cont(latency_seconds, {p / 100}), 6) AS p{p:02d}" for p in audit.PERCENTILES) + " FROM predictions GROUP BY run_id",
    "j2_with_image": f"WITH i AS (SELECT {_NUMBER} AS image, max(resolution) AS resolution FROM raw_sample GROUP BY 1) SELECT p.prediction_id, i.resolution FROM (SELECT prediction_id, {_NUMBER} AS image FROM predictions) p LEFT JOIN i ON i.image = p.image",
    "x2_cosine": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
ORACLE["c2_model_metrics"] = f"{MODEL_VALUES} SELECT k_run AS run, {', '.join(f"coalesce(round(max(CASE WHEN metric = '{m}' THEN 100 * value END), 6), 0) AS {m}" for m in MODEL_METRICS)} FROM every GROUP BY k_run"
ORACLE["c4_against_base"] = f"""{MODEL_VALUES}, mm AS (SELECT * FROM every WHERE metric IN ({", ".join(f"'{m}'" for m in MODEL_METRICS)})),
base AS (SELECT metric, value FROM mm WHERE k_run = 'vlm_base_a'), grid AS (SELECT DISTINCT a.k_run, b.metric FROM mm a, mm b WHERE a.k_run <> 'vlm_base_a'),
jj AS (SELECT k_run AS run, metric, coalesce(base.value, 0) AS b, coalesce(mm.value, 0) AS x FROM grid LEFT JOIN mm USING (k_run, metric) LEFT JOIN base USING (metric))
SELECT run, metric, round(b, 6) AS base_value, round(x, 6) AS value, round(x - b, 6) AS delta, round(CASE WHEN b <> 0 THEN (x - b) / abs(b) * 100 WHEN x > 0 THEN 100 ELSE 0 END, 6) AS delta_pct FROM jj"""
ORACLE["o3_outstanding"] = f"""{RULE_SCORES}, q AS (SELECT image_id, coalesce(max(CASE WHEN model_name NOT LIKE '%reward%' THEN r_violation_id END), 0) AS base, coalesce(max(CASE WHEN model_name LIKE '%reward%' THEN r_violation_id END), 0) AS final
  FROM o JOIN model_run USING (run_id) GROUP BY image_id)
(SELECT image_id, base, final, 'triumph' AS kind FROM q WHERE final > 0.6 AND base < 0.3 ORDER BY final - base DESC, image_id LIMIT 5)
UNION ALL (SELECT image_id, base, final, 'failure' FROM q WHERE final < 0.1 ORDER BY final, image_id LIMIT 5)"""
ORACLE["x11_word_counts"] = f"""{TEXT_WORDS} SELECT origin, kind, count(n) AS count, CAST(min(n) AS INT) AS min, CAST(max(n) AS INT) AS max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std,
{", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS p{p:02d}" for p in audit.PERCENTILES)} FROM u GROUP BY origin, kind"""
ORACLE["c5_chart_rows"] = f"""{MODEL_VALUES}, ch AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{m}')" for c, names in CHARTS.items() for m in names)}) AS x(chart, metric)), rr AS (SELECT DISTINCT k_run FROM every)
SELECT chart, rr.k_run AS run, ch.metric, round(coalesce(e.value, 0), 6) AS value FROM ch CROSS JOIN rr LEFT JOIN every e ON e.metric = ch.metric AND e.k_run = rr.k_run WHERE ch.metric IN (SELECT metric FROM every)"""
ORACLE["c6_heat_map"] = f"""{MODEL_VALUES} SELECT metric, {", ".join(f"coalesce(round(max(CASE WHEN k_run = '{m}' THEN value END), 6), 0) AS {m}" for m in MODELS)} FROM every WHERE metric IN ({", ".join(f"'{m}'" for m in MODEL_METRICS)}) GROUP BY metric"""
ORACLE["x9_clip_score"] = "SELECT a.label, count(*) AS pairs, round(avg(greatest(0, 2.5 * list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 5) AS clipscore FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label"
