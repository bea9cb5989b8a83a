"""Queries of the general training-data operators: p1 (column profile) and p7 (nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import nested, profile
from ..tables import CLASSES, METADATA, RULES, table

SPEC = profile.ProfileSpec(columns=METADATA, load="load_no", patterns=dict.fromkeys(METADATA, r"^[a-z][a-z' -]*$"))
MISSING_OVER, SHIFT_OVER = 0.05, 0.155


def _profiled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lineage = table(spark, folder, "load_batch").select(F.col("load_no").alias("load_key"), F.col("baseline_load_no").alias("baseline_key"))
    return table(spark, folder, "raw_sample"), table(spark, folder, "domain_value"), lineage


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    samples, domains, lineage = _profiled(spark, folder)
    return profile.findings(samples, "sample_id", domains, lineage, SPEC, MISSING_OVER, SHIFT_OVER)


def p1_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_profile(profile.profile(*_profiled(spark, folder), SPEC))


ALL_COLUMNS = (*METADATA, "image_id", "image_caption", "split", "source", "resolution", "site_id", "captured_at", "loaded_at", *CLASSES)
ANSWER_COLUMNS = ("image_id", "source", "latency_seconds", "error", "logged_at", "arrived_at", "prompt_id")


def _rounded_profile(out: DataFrame) -> DataFrame:
    rates = ("ks", "tv", "missing_rate")
    return out.select(*[c for c in out.columns if c not in rates], *[F.round(c, 6).alias(c) for c in rates])


def p1_profile_all(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of raw_sample per load: texts, numbers, times and lists of boxes."""
    samples, domains, lineage = _profiled(spark, folder)
    return _rounded_profile(profile.profile(samples, domains, lineage, profile.ProfileSpec(ALL_COLUMNS, "load_no")))


def p1_profile_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of predictions per run; a run is compared with the one before it."""
    runs = table(spark, folder, "model_run").select("run_id").distinct()
    lineage = runs.select(F.col("run_id").alias("load_key"), F.lag("run_id").over(Window.partitionBy().orderBy("run_id")).alias("baseline_key"))  # a fixed table of 24 runs
    none = table(spark, folder, "domain_value").limit(0)
    return _rounded_profile(profile.profile(table(spark, folder, "predictions"), none, lineage, profile.ProfileSpec(ANSWER_COLUMNS, "run_id")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.violation_boxes(table(spark, folder, "annotation_export"), "export_id", "payload").withColumnRenamed("doc_key", "export_id")


def _flat(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.flat_tables(table(spark, folder, "annotation_export"), "export_id", "payload")[name].drop("doc_row")

    return query


def p7_raw_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The structs of raw_sample, which are typed already: their boxes are exploded without any parsing."""
    return nested.struct_boxes(table(spark, folder, "raw_sample"), "sample_id", RULES)


QUERIES = {
    "p1_found": p1_found,
    "p1_profile": p1_profile,
    "p1_profile_all": p1_profile_all,
    "p1_profile_answers": p1_profile_answers,
    "p7_found": p7_found,
    "p7_samples": _flat("sample"),
    "p7_violations": _flat("violation"),
    "p7_boxes": _flat("box"),
    "p7_objects": _flat("object"),
    "p7_raw_boxes": p7_raw_boxes,
}

_BLANK = r"'^[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$'"
_VALUES = f"""
v0 AS (SELECT sample_id, load_no, unnest(['illumination', 'camera_distance', 'view', 'quality_of_info']) AS column_name,
              unnest([illumination, camera_distance, view, quality_of_info]) AS value FROM raw_sample),
v AS (SELECT v0.*, CASE WHEN value IS NULL OR regexp_full_match(value, {_BLANK}) THEN 'missing'
                        WHEN d.allowed_value IS NULL THEN 'invalid' END AS issue
      FROM v0 LEFT JOIN domain_value d ON d.column_name = v0.column_name AND d.allowed_value = v0.value),
c AS (SELECT column_name, load_no, value, count(*) AS n FROM v WHERE issue IS NULL AND load_no IS NOT NULL GROUP BY ALL),
own AS (SELECT column_name, load_no, sum(n) AS rows_n FROM c GROUP BY ALL),
grid AS (SELECT o.column_name, o.load_no, o.rows_n, b.load_no AS base_no, b.rows_n AS base_n
         FROM own o JOIN load_batch l ON l.load_no = o.load_no JOIN own b ON b.load_no = l.baseline_load_no AND b.column_name = o.column_name),
steps AS (SELECT g.column_name, g.load_no, d.allowed_value AS value,
                 coalesce(x.n, 0) / g.rows_n AS share, coalesce(y.n, 0) / g.base_n AS base_share
          FROM grid g JOIN domain_value d ON d.column_name = g.column_name
          LEFT JOIN c x ON x.column_name = g.column_name AND x.load_no = g.load_no AND x.value = d.allowed_value
          LEFT JOIN c y ON y.column_name = g.column_name AND y.load_no = g.base_no AND y.value = d.allowed_value),
tv AS (SELECT column_name, load_no, sum(abs(share - base_share)) / 2 AS tv FROM steps GROUP BY ALL),
ks AS (SELECT column_name, load_no, max(abs(gap)) AS ks FROM (
         SELECT column_name, load_no, sum(share - base_share) OVER (PARTITION BY column_name, load_no ORDER BY value) AS gap FROM steps) GROUP BY ALL),
t AS (SELECT column_name, load_no, count(*) AS row_count, count(*) FILTER (value IS NULL) AS null_rows,
             count(*) FILTER (issue = 'missing') AS missing_rows, count(*) FILTER (issue = 'invalid') AS invalid_rows,
             count(*) FILTER (value IS NOT NULL AND NOT regexp_matches(value, '^[a-z][a-z'' -]*$')) AS pattern_rows FROM v GROUP BY ALL)"""

ORACLE = {
    "p1_found": f"""WITH {_VALUES}
SELECT 'row' AS scope, sample_id AS key_id, column_name, issue FROM v WHERE issue IS NOT NULL
UNION ALL SELECT 'load', load_no, column_name, 'missing_rate' FROM t WHERE missing_rows / row_count > 0.05 AND load_no IS NOT NULL
UNION ALL SELECT 'load', load_no, column_name, 'shift' FROM tv WHERE tv > 0.155""",
    "p1_profile": f"""WITH {_VALUES},
q AS (SELECT column_name, load_no, count(*) AS valid_rows, count(DISTINCT value) AS distinct_values, min(value) AS value_min, max(value) AS value_max,
             quantile_disc(value, 0.25) AS q25, quantile_disc(value, 0.5) AS q50, quantile_disc(value, 0.75) AS q75
      FROM v WHERE issue IS NULL GROUP BY ALL)
SELECT t.column_name, t.load_no AS load_key, t.row_count, t.null_rows, t.missing_rows, t.invalid_rows, t.pattern_rows,
       CAST(coalesce(q.valid_rows, 0) AS BIGINT) AS valid_rows, CAST(coalesce(b.rows_n, 0) AS BIGINT) AS base_valid_rows,
       CAST(coalesce(q.distinct_values, 0) AS BIGINT) AS distinct_values, q.value_min, q.value_max, q.q25, q.q50, q.q75,
       round(ks.ks, 6) AS ks, round(tv.tv, 6) AS tv, round(t.missing_rows / t.row_count, 6) AS missing_rate
FROM t LEFT JOIN q USING (column_name, load_no) LEFT JOIN tv USING (column_name, load_no) LEFT JOIN ks USING (column_name, load_no)
LEFT JOIN load_batch l ON l.load_no = t.load_no LEFT JOIN own b ON b.load_no = l.baseline_load_no AND b.column_name = t.column_name""",
}


def _profile_sql(source: str, load: str, lineage: str, kinds: dict[str, str]) -> str:
    """SQL: the profile of columns by kind (text, number, time, json) against the baseline of each load."""
    text = {"json": "CAST(to_json({c}) AS VARCHAR)"}
    number = {"number": "CAST({c} AS DOUBLE)", "time": "CAST(epoch_us({c}) AS DOUBLE)"}
    rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {load} AS load_key, {text.get(k, 'CAST({c} AS VARCHAR)').replace('{c}', c)} AS value, {number.get(k, 'CAST(NULL AS DOUBLE)').replace('{c}', c)} AS k FROM {source}" for c, k in kinds.items())
    return f"""WITH v0 AS ({rows}),
d AS (SELECT DISTINCT column_name, allowed_value FROM domain_value WHERE '{source}' = 'raw_sample'),
v AS (SELECT v0.*, CASE WHEN value IS NULL OR regexp_full_match(value, {_BLANK}) THEN 'missing' WHEN d.allowed_value IS NULL AND v0.column_name IN (SELECT column_name FROM d) THEN 'invalid' END AS issue
      FROM v0 LEFT JOIN d ON d.column_name = v0.column_name AND d.allowed_value = v0.value),
t AS (SELECT column_name, load_key, count(*) AS row_count, count(*) FILTER (value IS NULL) AS null_rows, count(*) FILTER (issue = 'missing') AS missing_rows, count(*) FILTER (issue = 'invalid') AS invalid_rows FROM v GROUP BY ALL),
c AS (SELECT column_name, load_key, value, k, count(*) AS n FROM v WHERE issue IS NULL AND load_key IS NOT NULL GROUP BY ALL),
l AS ({lineage}),
b AS (SELECT column_name, load_key, value, k, sum(n) AS n, sum(m) AS m FROM (SELECT *, 0 AS m FROM c UNION ALL SELECT column_name, l.load_key, value, k, 0, n FROM c JOIN l ON l.baseline_key = c.load_key) GROUP BY ALL),
w AS (SELECT *, sum(n) OVER o AS cn, sum(m) OVER o AS cm, sum(n) OVER a AS tn, sum(m) OVER a AS tm FROM b WINDOW o AS (PARTITION BY column_name, load_key ORDER BY k, value), a AS (PARTITION BY column_name, load_key)),
q AS (SELECT column_name, load_key, CAST(max(tn) AS BIGINT) AS valid_rows, CAST(max(tm) AS BIGINT) AS base_valid_rows, count(*) FILTER (n > 0) AS distinct_values,
             arg_min(value, cn) FILTER (n > 0) AS value_min, arg_max(value, cn) FILTER (n > 0) AS value_max,
             {", ".join(f"arg_min(value, cn) FILTER (n > 0 AND cn >= {q} * tn) AS q{round(q * 100)}" for q in profile.QUANTILES)},
             max(abs(cn / tn - cm / tm)) FILTER (tn > 0 AND tm > 0) AS ks, sum(abs(n / tn - m / tm)) FILTER (tn > 0 AND tm > 0) / 2 AS tv FROM w GROUP BY ALL)
SELECT t.column_name, t.load_key, row_count, null_rows, missing_rows, invalid_rows, CAST(0 AS BIGINT) AS pattern_rows, coalesce(valid_rows, 0) AS valid_rows, coalesce(base_valid_rows, 0) AS base_valid_rows,
       coalesce(distinct_values, 0) AS distinct_values, value_min, value_max, q25, q50, q75, round(ks, 6) AS ks, round(tv, 6) AS tv, round(missing_rows / row_count, 6) AS missing_rate
FROM t LEFT JOIN q USING (column_name, load_key)"""


_KINDS = {"resolution": "number", "site_id": "number", "latency_seconds": "number", "prompt_id": "number", "captured_at": "time", "loaded_at": "time", "logged_at": "time", "arrived_at": "time"} | dict.fromkeys(CLASSES, "json")
ORACLE["p1_profile_all"] = _profile_sql("raw_sample", "load_no", "SELECT load_no AS load_key, baseline_load_no AS baseline_key FROM load_batch WHERE baseline_load_no IS NOT NULL", {c: _KINDS.get(c, "text") for c in ALL_COLUMNS})
ORACLE["p1_profile_answers"] = _profile_sql("predictions", "run_id", "SELECT run_id AS load_key, lag(run_id) OVER (ORDER BY run_id) AS baseline_key FROM model_run", {c: _KINDS.get(c, "text") for c in ANSWER_COLUMNS})
_GOOD = "[b FOR b IN coalesce({r}.bounding_box, []) IF b IS NOT NULL AND len(b) = 4 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN b])]"
ORACLE["p7_raw_boxes"] = " UNION ALL ".join(
    f"""SELECT sample_id, CAST({i} AS BIGINT) AS rule_no, CAST(0 AS BIGINT) AS violation_no, CAST(unnest(range(0, len({_GOOD.replace("{r}", r)}))) AS BIGINT) AS box_no FROM raw_sample WHERE {r} IS NOT NULL
    UNION ALL SELECT sample_id, {i}, 0, -1 FROM raw_sample WHERE {r} IS NOT NULL AND len({_GOOD.replace("{r}", r)}) = 0 AND NOT regexp_full_match(coalesce({r}.reason, ''), {_BLANK})"""
    for i, r in enumerate(RULES, 1)
)
