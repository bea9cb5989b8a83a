"""Queries over annotated samples: audit, statistics, strata, splits, orders, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.jsonio import TASKS
from ..functions.predicates import is_violated
from ..operators import arrange, audit, conversations
from ..tables import CLASSES, METADATA, RULES, table

PIXEL_CAP, THRESHOLDS, EDGES = 1_204_224, [500_000, 800_000, 1_000_000, 1_204_224, 2_000_000], [500_000, 1_000_000, 1_500_000, 2_000_000]
BUCKET, BINS = 32, 50


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_sample")


def _on(operator):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = operator(_samples(spark, folder))
        return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    return query


def _boxes_text(box):
    return F.array_join(F.transform(box, lambda c: F.format_string("%.3f", c)), ",")


def _boxes_text_list(boxes_column):
    return F.array_join(F.transform(boxes_column, _boxes_text), ";")


def _audit(samples: DataFrame) -> DataFrame:
    return audit.audit_boxes(samples, "sample_id", "split").select("sample_id", "split", "class", F.coalesce("box_no", F.lit(-1)).alias("box_no"), F.coalesce("area", F.lit(0.0)).alias("area"), "issues")


def _crosstab(samples: DataFrame) -> DataFrame:
    found = audit.audit_boxes(samples, "split").where("issues <> ''").withColumn("k", F.concat_ws("|", "split", "class"))
    kinds = ("missing_box", "out_of_range", "x_order", "y_order", "near_zero_area")
    hit = [F.count_if(F.array_contains(F.split("issues", ";"), k)).alias(k) for k in kinds]
    return found.groupBy("split", "class").agg(*hit)


def _split(samples: DataFrame) -> DataFrame:
    return arrange.stratified_split(samples.where("split = 'train'"), "sample_id")


def _buckets(samples: DataFrame) -> DataFrame:
    return arrange.bucket_order(samples.where("resolution is not null"), "sample_id", BUCKET, seed=42, epoch=0)


def _examples(samples: DataFrame) -> DataFrame:
    """The first sample of each value of each metadata field, by sample_id."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in METADATA])
    return samples.select("sample_id", F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.category", "p.value").agg(F.min("sample_id").alias("sample_id"))


def _targets(task: str):
    return lambda samples: samples.select("sample_id", conversations.target_json(task).alias("target_json"))


def _truth(task: str):
    """The fields of the true answer, one row each with its boxes as text (none: the class or rule has no boxes)."""

    def query(samples: DataFrame) -> DataFrame:
        names = [*RULES, *CLASSES] if task == "unified" else [*RULES]
        of = lambda n: F.struct(F.lit(n).alias("field"), _boxes_text_list(F.col(f"g.{n}.bounding_box") if n in RULES else F.col(f"g.{n}")).alias("boxes"), (F.col(f"g.{n}.reason") if n in RULES else F.col("g.caption") if task == "unified" else F.lit(None).cast("string")).alias("text"))
        return samples.select("sample_id", conversations.ground_truth(task).alias("g")).select("sample_id", F.concat_ws("|", *[F.coalesce(f"g.{m}", F.lit("-")) for m in METADATA]).alias("metadata"), F.inline(F.array(*map(of, names))))

    return query


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each load against the number its batch declared."""
    found = _samples(spark, folder).where("load_no is not null").groupBy("load_no").agg(F.count(F.lit(1)).alias("n"))
    expected = table(spark, folder, "load_batch").select("load_no", F.col("declared_rows").alias("expected"))
    return audit.expected_counts(found, expected, ["load_no"])


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Off-list metadata values set to the allowed value of the same letters, where exactly one has them."""
    samples = _samples(spark, folder)
    letters = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    allowed = table(spark, folder, "domain_value").select("column_name", "allowed_value", letters(F.col("allowed_value")).alias("k"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("given")) for c in METADATA])
    given = samples.select("sample_id", F.explode(pairs).alias("p")).select("sample_id", "p.*").where("given is not null").withColumn("k", letters(F.col("given")))
    edits = given.join(F.broadcast(allowed), ["column_name", "k"]).where("given <> allowed_value").select("sample_id", "column_name", F.col("allowed_value").alias("value"))
    fixed = conversations.corrected(samples, edits, "sample_id")
    return audit.value_table(fixed)


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of each training sample and prompt, one row per part of a turn."""
    rows = conversations.conversations(_samples(spark, folder).where("split = 'train'"), "sample_id", table(spark, folder, "prompt_text"))
    turns = rows.select("sample_id", "prompt_id", F.posexplode("messages").alias("turn", "m"))
    return turns.select("sample_id", "prompt_id", "turn", "m.role", F.posexplode("m.content").alias("part", "c")).select("sample_id", "prompt_id", "turn", "role", "part", "c.type", "c.text", "c.image_ref")


def _reward_prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.reward_prompts(_samples(spark, folder).where("split = 'train'"), "sample_id", F.lit("Report on safety."), "violations_only")
    return rows.select("sample_id", "image_id", "ground_truth")


def _shard_export(samples: DataFrame) -> DataFrame:
    return conversations.task_shards(samples, "sample_id")


def _json_boxes(samples: DataFrame) -> DataFrame:
    """Class boxes written in four notations in turn, and read again."""
    first = F.get("excavator", F.lit(0))
    corner = F.transform("excavator", lambda b: F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]))
    held = F.transform("excavator", lambda b: F.struct(b.alias("bounding_box")))
    turn = F.col("sample_id") % 4
    written = F.when(turn == 0, F.to_json("excavator")).when(turn == 1, F.to_json(first)).when(turn == 2, F.to_json(corner)).otherwise(F.to_json(held))
    return samples.select("sample_id", _boxes_text_list(boxes.from_json_text(written)).alias("boxes"))


def _edits(samples: DataFrame) -> DataFrame:
    """Annotations after edits: boxes of no extent removed, hollow violations nulled, missing views set, one class's boxes replaced by clean ones."""
    none = F.lit(None).cast("string")
    edit = lambda kind, c, value, b: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("column_name"), value.alias("value"), b.alias("boxes"))
    flat = lambda c: F.filter(boxes.normalized(F.col(c)), lambda b: F.coalesce(F.get(b, F.lit(0)) >= F.get(b, F.lit(2)), F.lit(False)))
    when = lambda condition, e: F.when(condition, e)
    each = [when(F.size(flat("excavator")) > 0, edit("remove_box", "excavator", none, flat("excavator")))]
    each += [when(F.col(r).isNotNull() & ~is_violated(F.col(r)), edit("null_violation", r, none, boxes.none())) for r in RULES]
    each += [when(F.col("view").isNull(), edit("set_value", "view", F.lit("ground view"), boxes.none())), when(F.size("rebar") > 0, edit("replace_boxes", "rebar", none, boxes.clean(F.col("rebar"))))]
    edits = samples.select("sample_id", F.inline(F.array_compact(F.array(*each))))
    out = conversations.point_edits(samples, edits, "sample_id")
    return out.select("sample_id", "view", *[F.col(r).isNotNull().alias(r) for r in RULES], *[_boxes_text_list(F.col(c)).alias(c) for c in ("excavator", "rebar")])


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of each task, as the registry gives it."""
    prompts = table(spark, folder, "prompt_text")
    return spark.createDataFrame([(t, conversations.prompt_of(prompts, t)) for t in TASKS], "task STRING, prompt STRING")


def _lookup(samples: DataFrame) -> DataFrame:
    """The samples of one image: that of the first sample with an id."""
    first = samples.where("image_id is not null").orderBy("sample_id").select("image_id").first()
    return conversations.lookup(samples, first["image_id"] if first else "").select("sample_id", "image_id", "split")


def _training_counts(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.training_set(_samples(spark, folder).where("split = 'train'"), "sample_id", table(spark, folder, "prompt_text"))[1]


QUERIES = {
    "b1_json_boxes": _on(_json_boxes),
    "c10_fix_checks": _on(lambda s: audit.named_checks(s, audit.fix_checks())),
    "pr12_point_edits": _on(_edits),
    "pr11_prompts": _prompts,
    "pr21_point_lookup": _on(_lookup),
    "pr8_training_counts": _training_counts,
    "a24_extreme_sizes": _on(lambda s: audit.extreme_sizes(s, "resolution", "sample_id", "split")),
    "b9_b10_box_audit": _on(_audit),
    "a23_audit_crosstab": _on(_crosstab),
    "b11_repeated_boxes": _on(lambda s: audit.repeated_boxes(s, "sample_id", 1)),
    "b2_b3_clean_boxes": _on(lambda s: s.select("sample_id", *[F.size(boxes.clean(F.col(c))).alias(c) for c in CLASSES])),
    "b4_scaled_boxes": _on(lambda s: s.select("sample_id", F.array_join(F.transform(F.flatten(boxes.to_thousand(boxes.clean(F.col("excavator")))), lambda c: c.cast("string")), ",").alias("grid"))),
    "a18_value_table": _on(audit.value_table),
    "a19_prevalence": _on(lambda s: audit.prevalence(s, "split")),
    "a20_rule_cooccurrence": _on(lambda s: audit.cooccurrence(s, RULES)),
    "a20_class_cooccurrence": _on(lambda s: audit.cooccurrence(s, CLASSES)),
    "a24_resolution_summary": _on(lambda s: audit.summary(s, "resolution", "split")),
    "a25_resolution_histogram": _on(lambda s: audit.histogram(s, "resolution", BINS)),
    "a26_resolution_buckets": _on(lambda s: audit.buckets(s, "resolution", EDGES)),
    "pr18_thresholds": _on(lambda s: audit.below_thresholds(s, "resolution", THRESHOLDS)),
    "pr17_over_cap": _on(lambda s: audit.over_cap(s, PIXEL_CAP)),
    "d1_uniqueness": _on(lambda s: audit.uniqueness(s, "image_id")),
    "c9_checks": _on(lambda s: audit.checks(s, "sample_id")),
    "j7_declared_rows": _expected,
    "pr1_strata": _on(lambda s: s.select("sample_id", arrange.stratum().alias("stratum"))),
    "a21_stratum_distribution": _on(lambda s: arrange.distribution(s.select("split", arrange.stratum().alias("stratum")), "split", "stratum")),
    "a22_stratum_pivot": _on(lambda s: s.groupBy(arrange.label(arrange.stratum()).alias("label")).pivot("split", ["train", "val", "test"]).count().na.fill(0)),
    "o5_stratified_split": _on(_split),
    "o6_oversampled": _on(lambda s: arrange.oversampled(s.where("split = 'train'")).select("sample_id", "copy_no")),
    "a29_oversampling_manifest": _on(lambda s: arrange.oversampling_manifest(s.where("split = 'train'"))),
    "o1_by_resolution": _on(lambda s: s.where("split = 'train'").select("sample_id", "resolution").orderBy(F.asc_nulls_last("resolution"), "sample_id")),
    "o7_resolution_buckets": _on(_buckets),
    "o8_rare_order": _on(lambda s: arrange.rare_class_order(s, "sample_id")),
    "pr16_rare_flag": _on(lambda s: s.select("sample_id", arrange.is_rare().alias("rare"))),
    "pr20_first_examples": _on(_examples),
    "o11_first_examples": _on(lambda s: arrange.first_n_per_key(s.where("source is not null").select("source", "sample_id"), "source", [F.col("sample_id")], 3)),
    "pr5_target_json": _on(_targets("unified")),
    "pr6_violations_target": _on(_targets("violations_only")),
    "pr2_ground_truth": _on(_truth("unified")),
    "pr3_violations_truth": _on(_truth("violations_only")),
    "pr7_conversations": _conversations,
    "pr9_reward_prompts": _reward_prompts,
    "pr12_corrected_values": _corrected,
    "k12_export_rows": _on(_shard_export),
}

_FLAT_BOXES = f"""
x AS ({" UNION ALL ".join(f"SELECT sample_id, split, '{c}' AS class, {c} AS boxes, false AS rule FROM raw_sample WHERE len({c}) > 0" for c in CLASSES)}
      UNION ALL {" UNION ALL ".join(f"SELECT sample_id, split, '{r}', coalesce({r}.bounding_box, []), true FROM raw_sample WHERE {r} IS NOT NULL" for r in RULES)}),
b AS (SELECT sample_id, split, class, i - 1 AS box_no, boxes[i] AS box FROM (SELECT *, unnest(range(1, len(boxes) + 1)) AS i FROM x)
      UNION ALL SELECT sample_id, split, class, -1, NULL FROM x WHERE len(boxes) = 0),
q AS (SELECT *, (box[3] - box[1]) * (box[4] - box[2]) AS area FROM b),
a AS (SELECT *, CASE WHEN box IS NULL THEN 'missing_box' ELSE concat_ws(';', CASE WHEN len(box) <> 4 THEN 'wrong_length' END,
  CASE WHEN list_bool_or([c < -1e-6 OR c > 1 + 1e-6 FOR c IN box]) THEN 'out_of_range' END, CASE WHEN box[1] >= box[3] THEN 'x_order' END,
  CASE WHEN box[2] >= box[4] THEN 'y_order' END, CASE WHEN abs(area) < 1e-5 THEN 'near_zero_area' END) END AS issues FROM q)"""
_VIOL = lambda c: f"({c} IS NOT NULL AND (coalesce(len({c}.bounding_box), 0) > 0 OR NOT coalesce(regexp_full_match({c}.reason, '[\\x{{0009}}-\\x{{000D}}\\x{{0020}}\\x{{0085}}\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]*'), true)))"
_FLAGS = {r: f"CAST({_VIOL(r)} AS INT)" for r in RULES} | {c: f"CAST(coalesce(len({c}), 0) > 0 AS INT)" for c in CLASSES}
_LONG_FLAGS = " UNION ALL ".join(f"SELECT split, resolution, '{k}' AS name, {v} AS flag FROM raw_sample" for k, v in _FLAGS.items())
_matrix = lambda names: " UNION ALL ".join(f"SELECT '{a}' AS name, {', '.join(f'CAST(coalesce(sum({_FLAGS[a]} * {_FLAGS[b]}), 0) AS BIGINT) AS {b}' for b in names)} FROM raw_sample" for a in names)
_STRATUM = "CASE WHEN rule_4_violation IS NOT NULL THEN 0 WHEN rule_2_violation IS NOT NULL THEN 1 WHEN rule_3_violation IS NOT NULL THEN 2 WHEN rule_1_violation IS NOT NULL THEN 3 WHEN len(worker_with_white_hard_hat) > 0 THEN 4 WHEN len(rebar) > 0 THEN 5 WHEN len(excavator) > 0 THEN 6 ELSE 7 END"
_LABELS = "['" + "', '".join(arrange.STRATA) + "']"
_COPIES = "CASE WHEN rule_2_violation IS NOT NULL OR rule_4_violation IS NOT NULL THEN 4 WHEN rule_3_violation IS NOT NULL THEN 2 ELSE 1 END"
_key = lambda seed, c: f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {c})), 1, 15) AS BIGINT)"
_CLEANED = lambda c: f"[b FOR b IN coalesce({c}, []) IF len(b) = 4 AND list_bool_and([x >= -1e-6 AND x <= 1 + 1e-6 FOR x IN b]) AND b[3] - b[1] > 1e-4 AND b[4] - b[2] > 1e-4]"

ORACLE = {
    "b9_b10_box_audit": f"WITH {_FLAT_BOXES} SELECT sample_id, split, class, CAST(box_no AS INT) AS box_no, round(coalesce(area, 0), 6) AS area, issues FROM a",
    "a23_audit_crosstab": f"WITH {_FLAT_BOXES} SELECT split, class, {', '.join(f'count(*) FILTER (list_contains(string_split(issues, {chr(39)};{chr(39)}), {chr(39)}{k}{chr(39)})) AS {k}' for k in ('missing_box', 'out_of_range', 'x_order', 'y_order', 'near_zero_area'))} FROM a WHERE issues <> '' GROUP BY split, class",
    "b11_repeated_boxes": f"WITH {_FLAT_BOXES} SELECT sample_id, class, array_to_string([printf('%.6f', c) FOR c IN box], ',') AS box, count(*) AS n FROM b WHERE box IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "b2_b3_clean_boxes": "SELECT sample_id, " + ", ".join(f"CAST(len({_CLEANED(c)}) AS INT) AS {c}" for c in CLASSES) + " FROM raw_sample",
    "b4_scaled_boxes": f"SELECT sample_id, array_to_string([CAST(round_even(x * 1000.0, 0) AS INT) FOR x IN flatten({_CLEANED('excavator')})], ',') AS grid FROM raw_sample",
    "a18_value_table": " UNION ALL ".join(f"SELECT '{c}' AS category, {c} AS value, count(*) AS n FROM raw_sample GROUP BY {c}" for c in METADATA),
    "a19_prevalence": f"SELECT split, name, CAST(sum(flag) AS BIGINT) AS positives, round(avg(flag) * 100, 6) AS pct FROM ({_LONG_FLAGS}) GROUP BY split, name",
    "a20_rule_cooccurrence": _matrix(RULES),
    "a20_class_cooccurrence": _matrix(CLASSES),
    "a24_resolution_summary": "SELECT split, count(resolution) AS count, min(resolution) AS min, max(resolution) AS max, round(avg(resolution), 6) AS mean, round(stddev_pop(resolution), 6) AS std, " + ", ".join(f"round(quantile_cont(resolution, {p / 100}), 6) AS p{p:02d}" for p in audit.PERCENTILES) + " FROM raw_sample GROUP BY split",
    "a25_resolution_histogram": f"WITH e AS (SELECT CAST(min(resolution) AS DOUBLE) AS lo, CAST(max(resolution) AS DOUBLE) AS hi FROM raw_sample) SELECT CAST(least(floor((resolution - lo) / ((hi - lo) / {BINS})), {BINS - 1}) AS BIGINT) AS bin, count(*) AS n FROM raw_sample, e WHERE resolution IS NOT NULL GROUP BY 1",
    "a26_resolution_buckets": f"SELECT CAST({' + '.join(f'CAST(resolution >= {e} AS INT)' for e in EDGES)} AS INT) AS bucket, count(*) AS n, min(resolution) AS low, max(resolution) AS high, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM raw_sample WHERE resolution IS NOT NULL GROUP BY 1",
    "pr18_thresholds": " UNION ALL ".join(f"SELECT CAST({t} AS BIGINT) AS threshold, count(*) FILTER (resolution < {t}) AS n, round(100.0 * count(*) FILTER (resolution < {t}) / count(resolution), 6) AS pct FROM raw_sample" for t in THRESHOLDS),
    "pr17_over_cap": f"SELECT name, count(*) AS images, count(*) FILTER (resolution > {PIXEL_CAP}) AS over, round(100.0 * count(*) FILTER (resolution > {PIXEL_CAP}) / count(*), 6) AS pct FROM ({_LONG_FLAGS}) WHERE flag = 1 GROUP BY name",
    "d1_uniqueness": "SELECT count(*) AS rows, count(DISTINCT image_id) AS distinct_keys, count(*) - count(DISTINCT image_id) AS surplus FROM raw_sample",
    "c9_checks": f"""WITH {_FLAT_BOXES}, c AS (SELECT 'bad_boxes' AS check_name, count(*) AS n FROM a WHERE issues <> '' UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT sample_id) FROM raw_sample
UNION ALL {" UNION ALL ".join(f"SELECT 'null_{c}', count(*) FILTER ({c} IS NULL) FROM raw_sample" for c in (*METADATA, "image_caption"))}) SELECT check_name, n = 0 AS passed, CAST(n AS VARCHAR) AS detail FROM c""",
    "j7_declared_rows": "WITH f AS (SELECT load_no, count(*) AS n FROM raw_sample WHERE load_no IS NOT NULL GROUP BY load_no) SELECT coalesce(f.load_no, b.load_no) AS load_no, coalesce(n, 0) AS n, declared_rows AS expected, CASE WHEN coalesce(n, 0) IS NOT DISTINCT FROM declared_rows THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM f FULL JOIN load_batch b ON f.load_no = b.load_no",
    "pr1_strata": f"SELECT sample_id, CAST({_STRATUM} AS INT) AS stratum FROM raw_sample",
    "a21_stratum_distribution": f"WITH s AS (SELECT split, {_STRATUM} AS k FROM raw_sample), g AS (SELECT DISTINCT split, unnest(range(0, 8)) AS k FROM s), c AS (SELECT g.split, g.k, count(s.k) AS n FROM g LEFT JOIN s ON s.split = g.split AND s.k = g.k GROUP BY 1, 2) SELECT split, CAST(k AS INT) AS stratum, {_LABELS}[k + 1] AS label, n, round(100.0 * n / sum(n) OVER (PARTITION BY split), 2) AS pct FROM c",
    "a22_stratum_pivot": f"SELECT {_LABELS}[{_STRATUM} + 1] AS label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM raw_sample GROUP BY 1",
    "o5_stratified_split": f"WITH r AS (SELECT sample_id, {_STRATUM} AS k, row_number() OVER (PARTITION BY {_STRATUM} ORDER BY {_key(42, 'sample_id')}, sample_id) AS n, count(*) OVER (PARTITION BY {_STRATUM}) AS c FROM raw_sample WHERE split = 'train') SELECT sample_id, CAST(k AS INT) AS stratum, CASE WHEN n <= round_even(c * 0.1, 0) THEN 'val' ELSE 'train' END AS part FROM r",
    "o6_oversampled": f"SELECT sample_id, CAST(unnest(range(1, {_COPIES} + 1)) AS INT) AS copy_no FROM raw_sample WHERE split = 'train'",
    "a29_oversampling_manifest": f"WITH c AS (SELECT {_COPIES} AS c FROM raw_sample WHERE split = 'train') SELECT count(*) AS original, count(*) FILTER (c = 4) AS rare, count(*) FILTER (c = 2) AS scarce, count(*) FILTER (c = 1) AS common, 4 * count(*) FILTER (c = 4) AS rare_copies, 2 * count(*) FILTER (c = 2) AS scarce_copies, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c) AS BIGINT) - count(*) AS added FROM c",
    "o1_by_resolution": "SELECT sample_id, resolution FROM raw_sample WHERE split = 'train' ORDER BY resolution, sample_id",
    "o7_resolution_buckets": f"WITH r AS (SELECT sample_id, resolution, row_number() OVER (ORDER BY resolution, {_key(0, 'sample_id')}, sample_id) - 1 AS place FROM raw_sample WHERE resolution IS NOT NULL) SELECT *, place // {BUCKET} AS bucket, {_key(42, f'place // {BUCKET}')} AS bucket_key FROM r",
    "o8_rare_order": f"""WITH a AS (SELECT sample_id, rule_2_violation IS NOT NULL OR rule_3_violation IS NOT NULL OR rule_4_violation IS NOT NULL AS rare FROM raw_sample),
r AS (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY {_key(42, 'sample_id')}, sample_id) - 1 AS k, count(*) OVER () AS n, count(*) FILTER (rare) OVER () AS m FROM a),
g AS (SELECT *, least(floor(k * (n / m) + {_key(43, 'sample_id')} / 1152921504606846976.0 * (n / m)), n - 1) - k AS gap FROM r WHERE rare),
h AS (SELECT *, k + max(gap) OVER (ORDER BY k) AS pos FROM g),
free AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS c FROM (SELECT unnest(range(0, (SELECT max(n) FROM r))) AS slot) WHERE slot NOT IN (SELECT pos FROM h WHERE pos < n)),
fill AS (SELECT sample_id, rare, row_number() OVER (ORDER BY NOT rare, k) - 1 AS c FROM (SELECT sample_id, rare, k FROM h WHERE pos >= n UNION ALL SELECT sample_id, rare, k FROM r WHERE NOT rare))
SELECT sample_id, rare, CAST(pos AS BIGINT) AS place FROM h WHERE pos < n UNION ALL SELECT sample_id, rare, CAST(slot AS BIGINT) FROM fill JOIN free USING (c)""",
    "pr16_rare_flag": "SELECT sample_id, rule_2_violation IS NOT NULL OR rule_3_violation IS NOT NULL OR rule_4_violation IS NOT NULL AS rare FROM raw_sample",
    "pr20_first_examples": " UNION ALL ".join(f"SELECT '{c}' AS category, {c} AS value, min(sample_id) AS sample_id FROM raw_sample WHERE {c} IS NOT NULL GROUP BY {c}" for c in METADATA),
    "o11_first_examples": "SELECT source, sample_id, CAST(place AS INT) AS place FROM (SELECT source, sample_id, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS place FROM raw_sample WHERE source IS NOT NULL) WHERE place <= 3",
    "pr12_corrected_values": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, {c} AS value FROM raw_sample" for c in METADATA) + ") SELECT category, coalesce(d.allowed_value, value) AS value, count(*) AS n FROM v LEFT JOIN domain_value d ON d.column_name = category AND lower(regexp_replace(d.allowed_value, '[^A-Za-z]', '', 'g')) = lower(regexp_replace(value, '[^A-Za-z]', '', 'g')) GROUP BY 1, 2",
}

_box_text = lambda boxes: f"array_to_string([array_to_string([printf('%.3f', x) FOR x IN b], ',') FOR b IN {boxes}], ';')"
_META = "concat_ws('|', " + ", ".join(f"coalesce({m}, '-')" for m in METADATA) + ") AS metadata"


def _truth_sql(classes: bool) -> str:
    rules = [f"SELECT sample_id, {_META}, '{r}' AS field, CASE WHEN {r} IS NOT NULL THEN {_box_text(_CLEANED(r + '.bounding_box'))} END AS boxes, CASE WHEN {r} IS NOT NULL THEN coalesce({r}.reason, '') END AS text FROM raw_sample" for r in RULES]
    return " UNION ALL ".join(rules + ([f"SELECT sample_id, {_META}, '{c}', {_box_text(_CLEANED(c))}, image_caption FROM raw_sample" for c in CLASSES] if classes else []))


ORACLE["pr2_ground_truth"] = _truth_sql(True)
ORACLE["pr3_violations_truth"] = _truth_sql(False)


def _target_sql(classes: bool) -> str:
    """SQL: the fenced JSON to learn."""
    grid = lambda boxes: f"'[' || array_to_string(['[' || array_to_string([CAST(CAST(round_even(x * 1000.0, 0) AS INT) AS VARCHAR) FOR x IN b], ',') || ']' FOR b IN {_CLEANED(boxes)}], ',') || ']'"
    quoted = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    parts = [f"""'"{r}":' || CASE WHEN {r} IS NULL THEN 'null' ELSE '{{"bounding_box":' || {grid(r + ".bounding_box")} || ',"reason":' || {quoted(f"coalesce({r}.reason, '')")} || '}}' END""" for r in RULES]
    if classes:
        parts = [f"""'"caption":' || coalesce({quoted("image_caption")}, 'null')""", *parts, *[f"""'"{c}":' || {grid(c)}""" for c in CLASSES]]
    return "'```json' || chr(10) || '{' || " + " || ',' || ".join(parts) + " || '}' || chr(10) || '```'"


ORACLE["pr5_target_json"] = f"SELECT sample_id, {_target_sql(True)} AS target_json FROM raw_sample"
ORACLE["pr6_violations_target"] = f"SELECT sample_id, {_target_sql(False)} AS target_json FROM raw_sample"
_TASK_TARGET = f"CASE WHEN task = 'unified' THEN {_target_sql(True)} ELSE {_target_sql(False)} END"
ORACLE["k12_export_rows"] = f"SELECT task, split, sample_id, image_id, {_TASK_TARGET} AS target_json FROM raw_sample, (SELECT unnest(['unified', 'violations_only']) AS task) WHERE task <> 'unified' OR image_caption IS NOT NULL"
ORACLE["pr7_conversations"] = f"""WITH c AS (SELECT sample_id, prompt_id, prompt, image_id, {_TASK_TARGET} AS answer FROM raw_sample, prompt_text WHERE split = 'train' AND (task <> 'unified' OR image_caption IS NOT NULL))
SELECT sample_id, prompt_id, CAST(0 AS INT) AS turn, 'user' AS role, CAST(0 AS INT) AS part, 'image' AS type, CAST(NULL AS VARCHAR) AS text, image_id AS image_ref FROM c
UNION ALL SELECT sample_id, prompt_id, 0, 'user', 1, 'text', prompt, NULL FROM c UNION ALL SELECT sample_id, prompt_id, 1, 'assistant', 0, 'text', answer, NULL FROM c"""
_quoted_sql = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
_numbers_sql = lambda boxes: f"'[' || array_to_string(['[' || array_to_string([CAST(x AS VARCHAR) FOR x IN b], ',') || ']' FOR b IN {_CLEANED(boxes)}], ',') || ']'"
_TRUE_JSON = " || ',' || ".join(
    [f"""'"{m}":' || coalesce({_quoted_sql(m)}, 'null')""" for m in METADATA]
    + [f"""'"{r}":' || CASE WHEN {r} IS NULL THEN 'null' ELSE '{{"bounding_box":' || {_numbers_sql(r + ".bounding_box")} || ',"reason":' || {_quoted_sql(f"coalesce({r}.reason, '')")} || '}}' END""" for r in RULES]
)
ORACLE["pr9_reward_prompts"] = f"SELECT sample_id, image_id, '{{' || {_TRUE_JSON} || '}}' AS ground_truth FROM raw_sample WHERE split = 'train'"
ORACLE["b1_json_boxes"] = f"SELECT sample_id, {_box_text('(CASE WHEN sample_id % 4 = 1 THEN coalesce(excavator, [])[1:1] WHEN sample_id % 4 = 2 THEN [b FOR b IN coalesce(excavator, []) IF len(b) >= 4] ELSE coalesce(excavator, []) END)')} AS boxes FROM raw_sample"
_EVERY_BOX = "flatten([" + ", ".join(f"coalesce({c}, [])" for c in (*CLASSES, *[f"{r}.bounding_box" for r in RULES])) + "])"
_any_box = lambda test: f"len([b FOR b IN {_EVERY_BOX} IF {test}]) > 0"
_FAULTS = {
    "null_class_lists": " OR ".join(f"{c} IS NULL" for c in CLASSES), "hollow_violations": " OR ".join(f"({r} IS NOT NULL AND NOT {_VIOL(r)})" for r in RULES),
    "boxes_of_wrong_length": _any_box("len(b) <> 4"), "boxes_out_of_range": _any_box("list_bool_or([x < -1e-6 OR x > 1 + 1e-6 FOR x IN b])"), "boxes_turned_around": _any_box("b[1] >= b[3] OR b[2] >= b[4]"),
    "repeated_boxes": " OR ".join(f"len(list_distinct(coalesce({c}, []))) < len(coalesce({c}, []))" for c in CLASSES), "missing_metadata": " OR ".join(f"{m} IS NULL" for m in METADATA),
}
ORACLE["c10_fix_checks"] = "SELECT check_name, n = 0 AS passed, CAST(n AS VARCHAR) AS detail FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER ({v}) AS n FROM raw_sample" for k, v in _FAULTS.items()) + ")"
ORACLE["pr12_point_edits"] = (
    f"SELECT sample_id, coalesce(view, 'ground view') AS view, {', '.join(f'({r} IS NOT NULL AND {_VIOL(r)}) AS {r}' for r in RULES)}, {_box_text('[b FOR b IN excavator IF NOT coalesce(b[1] >= b[3], false)]')} AS excavator, "
    f"CASE WHEN len(rebar) > 0 THEN {_box_text(_CLEANED('rebar'))} ELSE {_box_text('rebar')} END AS rebar FROM raw_sample"
)
ORACLE["pr11_prompts"] = "SELECT task, arg_min(prompt, prompt_id) AS prompt FROM prompt_text GROUP BY task"
ORACLE["pr21_point_lookup"] = "SELECT sample_id, image_id, split FROM raw_sample WHERE image_id = (SELECT arg_min(image_id, sample_id) FROM raw_sample WHERE image_id IS NOT NULL)"
ORACLE["pr8_training_counts"] = "SELECT prompt_id, count(*) AS samples, count(*) FILTER (task = 'unified' AND image_caption IS NULL) AS skipped FROM raw_sample, prompt_text WHERE split = 'train' GROUP BY prompt_id"
ORACLE["a24_extreme_sizes"] = "SELECT DISTINCT split, first_value(sample_id) OVER (PARTITION BY split ORDER BY resolution, sample_id) AS min_id, first_value(sample_id) OVER (PARTITION BY split ORDER BY resolution DESC, sample_id) AS max_id FROM raw_sample WHERE resolution IS NOT NULL"
