"""Typed profiles, edits, registries, suites, reports of repairs and files, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from girder.functions import boxes, jsonio, repair, text
from girder.operators import arrange, audit, compare, conversations, nested, profile, rewards
from girder.operators import evaluation as ev
from girder.sources import artefacts, files


def test_profile_orders_values_by_their_type(spark):
    rows = [(i, i % 2, float(i), i * 9, f"2024-01-{1 + i % 28:02} 00:00:00", bool(i % 3), [i % 2]) for i in range(1, 41)] + [(99, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id INT, load INT, x DOUBLE, n BIGINT, t STRING, flag BOOLEAN, list ARRAY<INT>").withColumn("t", F.to_timestamp("t"))
    spec = profile.ProfileSpec(("x", "n", "t", "flag", "list"), "load", partitions=3)
    domains = spark.createDataFrame([], "column_name STRING, allowed_value STRING")
    lineage = spark.createDataFrame([(0, None), (1, 0)], "load_key INT, baseline_key INT")
    got = {(r["column_name"], r["load_key"]): r for r in profile.profile(df, domains, lineage, spec).collect()}
    assert (got["x", 1]["value_min"], got["x", 1]["value_max"], got["x", 1]["q50"]) == ("1.0", "39.0", "19.0")  # as text 9.0 would be the greatest
    assert (got["n", 0]["value_min"], got["n", 0]["value_max"], got["n", 0]["distinct_values"]) == ("18", "360", 20)
    assert got["t", 1]["value_min"].startswith("2024-01-02") and got["list", 1]["value_min"] == "[1]" and got["flag", 0]["value_max"] == "true"
    assert got["list", 1]["tv"] == 1.0 and got["list", 1]["ks"] == 1.0 and got["x", None]["null_rows"] == 1


def test_islands_of_a_long_key(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", i * 3, f) for i, f in enumerate(flags)] + [("b", 5, 1), ("c", 1, 0), ("c", 9, None)], "k STRING, at BIGINT, f INT")
    for rows in (1, 3, 100):
        got = sorted(map(tuple, audit.islands(df, "k", "at", F.col("f") == 1, bucket_rows=rows).collect()))
        assert got == [("a", 3, 6, 2), ("a", 12, 12, 1), ("a", 21, 27, 3), ("b", 5, 5, 1)]
    assert audit.islands(df.limit(0), "k", "at", F.col("f") == 1).count() == 0


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (None, []), ("", []), ("[]", []), ("5", []), ('"x"', []), ("null", []), ("[1,2,3,4]", [[1, 2, 3, 4]]), ("[0,0,1]", [[0, 0, 1]]), ("[[1,2,3,4],[5,6]]", [[1, 2, 3, 4], [5, 6]]),
        ('[{"bounding_box":[1,2,3,4]},{"xmin":5,"ymin":6,"xmax":7,"ymax":8},{"xmin":1},"t",7]', [[1, 2, 3, 4], [5, 6, 7, 8]]), ("[[]]", [[]]),
    ],
)
def test_boxes_of_untyped_json(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v STRING")
    assert df.select(boxes.from_json_text(F.col("v")).alias("b")).first()["b"] == expected


def test_point_edits(spark, sample_schema, make_sample):
    v = ([[0.1, 0.2, 0.3, 0.4], [0.5, 0.5, 0.5, 0.6]], "r")
    df = spark.createDataFrame([make_sample("1", rules={1: v, 2: v}, excavator=[[0.1] * 4, [0.2] * 4, [0.1] * 4]), make_sample("2", rules={3: v}), make_sample("3")], sample_schema)
    edits = [
        ("1", "remove_box", "excavator", None, [[0.1] * 4]), ("1", "remove_box", "rule_1_violation", None, [[0.5, 0.5, 0.5, 0.6]]), ("1", "null_violation", "rule_2_violation", None, None), ("1", "set_value", "view", "far", None),
        ("2", "replace_boxes", "rule_3_violation", None, [[0.0, 0.0, 1.0, 1.0]]), ("9", "null_violation", "rule_1_violation", None, None), ("2", "nonsense", "view", "x", None), ("2", "set_value", "nowhere", "x", None),
    ]
    got = {r["image_id"]: r for r in conversations.point_edits(df, spark.createDataFrame(edits, f"image_id STRING, {conversations.EDIT}"), "image_id").collect()}
    assert got["1"]["excavator"] == [[0.2] * 4] and got["1"]["rule_1_violation"]["bounding_box"] == [[0.1, 0.2, 0.3, 0.4]] and got["1"]["rule_2_violation"] is None and got["1"]["view"] == "far"
    assert got["2"]["rule_3_violation"]["bounding_box"] == [[0.0, 0.0, 1.0, 1.0]] and got["2"]["rule_3_violation"]["reason"] == "r" and got["2"]["view"] == "ground view" and len(got) == 3
    kept = conversations.point_edits(df, spark.createDataFrame([], f"image_id STRING, {conversations.EDIT}"), "image_id")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect())) and kept.columns == df.columns


def test_prompts_lookup_and_training_set(spark, sample_schema, make_sample):
    prompts = spark.createDataFrame([(2, "unified", "b"), (1, "unified", "a"), (3, "violations_only", "c")], "prompt_id INT, task STRING, prompt STRING")
    assert conversations.prompt_of(prompts, "unified") == "a"
    with pytest.raises(ValueError, match="unified"):
        conversations.prompt_of(prompts, "poetry")
    df = spark.createDataFrame([make_sample("0000001"), make_sample("5", caption=None), make_sample("7")], sample_schema)
    assert conversations.lookup(df, 5).count() == 1 and conversations.lookup(df, "1").count() == 0
    rows, counts = conversations.training_set(df, "image_id", prompts, cap=2)
    assert {(r["prompt_id"], r["samples"], r["skipped"]) for r in counts.collect()} == {(1, 2, 1), (2, 2, 1), (3, 2, 0)} and rows.count() == 4
    assert spark.range(1).select(arrange.pixels(F.lit(30), F.lit(40)).alias("p")).first()["p"] == 1200


def test_rewards_of_settings(spark, sample_schema, make_sample):
    assert rewards.assembled({}) == rewards.WEIGHTS and rewards.assembled({"reward_components": ["reward_format", "caption"], "reward_weights": {"reward_format": 0.5, "other": 1}}) == {"format": 0.5, "caption": rewards.WEIGHTS["caption"]}
    with pytest.raises(ValueError, match="nonsense"):
        rewards.assembled({"reward_components": ["nonsense"]})
    answers = spark.createDataFrame([(1, "violations_only", "{}", make_sample("1"))], f"id INT, task STRING, raw_output STRING, sample STRUCT<{sample_schema}>")
    out = rewards.task_rewards(ev.scored(answers), {"reward_components": ["reward_format", "reward_violation_id"], "reward_weights": {"reward_format": 0.4, "reward_violation_id": 0.6}}).first()
    assert out["weighted"] == pytest.approx(0.4 + 0.6 * 0.1)
    chat = spark.createDataFrame([([("user", "a"), ("assistant", "b")],), ([],), (None,)], "turns ARRAY<STRUCT<role: STRING, content: STRING>>")
    assert [r["c"] for r in chat.select(rewards.last_content(F.col("turns")).alias("c")).collect()] == ["b", None, None]


def test_truth_is_joined_where_none_is_embedded(spark, sample_schema, make_sample):
    answers = spark.createDataFrame([(1, 7, make_sample("a")), (2, 7, None), (3, None, None), (4, 99, None)], f"id INT, image INT, sample STRUCT<{sample_schema}>")
    samples = spark.createDataFrame([(7, 1, *make_sample("old")), (7, 2, *make_sample("new")), (None, 3, *make_sample("none"))], f"image INT, sample_id INT, {sample_schema}")
    got = {r["id"]: r["sample"] and r["sample"]["image_id"] for r in ev.with_truth(answers, samples, "image", "sample_id").collect()}
    assert got == {1: "a", 2: "new", 3: None, 4: None}


def test_full_evaluation_gates_families_by_task(spark, sample_schema, make_sample):
    v = ([[0.1, 0.1, 0.5, 0.5]], "a ladder is not tied")
    answer = json.dumps({"caption": "a site", "excavator": [[100, 100, 500, 500]], "rule_1_violation": {"bounding_box": [[100, 100, 500, 500]], "reason": "a ladder is not tied"}})
    rows = [(1, "unified", answer, make_sample("1", rules={1: v}, excavator=[[0.1, 0.1, 0.5, 0.5]])), (2, "unified", "no json", make_sample("2")), (3, "violations_only", "{}", make_sample("3", rules={1: v}))]
    scored = ev.scored(spark.createDataFrame(rows, f"id INT, task STRING, raw_output STRING, sample STRUCT<{sample_schema}>"))
    got = {(r["task"], r["metric"]): r["value"] for r in ev.full_evaluation(scored, "task").collect()}
    assert got["unified", "schema_rate"] == 0.5 and got["unified", "presence_f1_micro"] == 1.0 and got["unified", "mask_exist"] == pytest.approx(1.0) and got["unified", "reason_score_all"] == 1.0
    assert got["unified", "violation_f1_micro"] == 1.0 and got["unified", "violation_f1_macro"] == 0.25 and got["unified", "gated_f1_micro"] == 1.0 and got["unified", "violation_iou_macro_tn0_all"] == pytest.approx(0.25)
    assert got["violations_only", "violation_f1_micro"] == 0.0 and not any(t == "violations_only" and m.startswith(("mask", "presence", "words", "ngram")) for t, m in got)
    assert ev.full_evaluation(scored.limit(0), "task").count() == 0


def test_caption_suite_fails_fast(spark, sample_schema, make_sample):
    rows = [(1, "unified", json.dumps({"caption": "a b c"}), make_sample("1", caption="a b c"), [1.0, 0.0], [1.0, 0.0]), (2, "unified", json.dumps({"caption": " "}), make_sample("2", caption=None), None, [1.0, 0.0])]
    scored = ev.scored(spark.createDataFrame(rows, f"id INT, task STRING, raw_output STRING, sample STRUCT<{sample_schema}>, img ARRAY<DOUBLE>, emb ARRAY<DOUBLE>"))
    got = {r["metric"]: r["value"] for r in ev.caption_suite(scored, "id", "c_", {"same": lambda p, t: (p == t).cast("double")}, "img", "emb").collect()}
    assert got["c_ngram_f1"] == 1.0 and got["c_same"] == 1.0 and got["c_clipscore"] == 2.5 and got["c_words_avg"] == 2.0 and got["c_ciderd"] > 0
    with pytest.raises(ValueError):
        ev.caption_suite(scored.limit(0), "id")
    with pytest.raises(ValueError):
        ev.caption_suite(scored, "id", image="img")


def test_consensus_tells_lengths_of_ngrams_apart(spark):
    pairs = spark.createDataFrame([(1, "a b a b", "a b a b"), (2, "x y", "p q"), (3, None, "a"), (4, "b a", "a b")], "id INT, p STRING, r STRING")
    got = {r["id"]: r["score"] for r in text.consensus_score(pairs, "id", "p", "r").collect()}
    assert got[1] == pytest.approx(10.0) and got[2] == 0 and got[3] == 0
    assert got[4] == pytest.approx(2.5)  # its words agree, its pair doesn't


def test_charts_and_heat_maps(spark):
    m = spark.createDataFrame([("a", "f", 0.5), ("b", "g", 0.25)], "run STRING, metric STRING, value DOUBLE")
    assert {tuple(r) for r in compare.chart(m, "run", {"one": ["f", "never"], "two": ["g"]}).collect()} == {("one", "a", "f", 0.5), ("one", "b", "f", 0.0), ("two", "a", "g", 0.0), ("two", "b", "g", 0.25)}
    assert [tuple(r) for r in compare.heat_map(m, "run", ["a", "b"], ["g", "f"]).collect()] == [("g", 0.0, 0.25), ("f", 0.5, 0.0)]


def test_struct_boxes(spark, sample_schema, make_sample):
    odd = ([[0.1] * 4, [1.0, 2.0], None, [0.1, 0.2, None, 0.4], [0.1, 0.2, float("nan"), 0.4], [0.2] * 4], None)
    df = spark.createDataFrame([make_sample("1", rules={1: odd, 2: ([], " "), 3: ([], "r"), 4: (None, None)})], sample_schema)
    assert sorted(map(tuple, nested.struct_boxes(df, "image_id", tuple(f"rule_{i}_violation" for i in range(1, 5))).collect())) == [("1", 1, 0, 0), ("1", 1, 0, 1), ("1", 3, 0, -1)]


def test_reports_of_repairs(spark, tmp_path):
    """The rows that the queries of statuses, changes, warnings, the repaired log and the broken rows are made of."""
    good = json.dumps({"caption": "a", "rebar": [[1, 2, 3, 4]] * 4})
    rows = [(1, "unified", good), (2, "unified", '{"caption": "a",}'), (3, "unified", '{"caption": "a", "rebar": "1,2,3,4", "x": [1,],}'), (4, "unified", "none"), (5, "unified", '{"rebar": [[1, 2], [3, 4], [5, 6]]}'), (6, None, None)]
    df = spark.createDataFrame(rows, "id INT, task STRING, raw STRING")
    done = repair.with_repair(df, "raw", "task")
    assert {r["id"]: r["repair"]["status"] for r in done.collect()} == {1: "valid_raw", 2: "fixed_valid", 3: "fixed_valid", 4: "invalid_json", 5: "invalid_schema", 6: "invalid_json"}
    changes = {tuple(r) for r in artefacts.event_summary(done, "id", "changes").collect()}
    assert changes == {("json_syntax_trailing_comma_removed", 2, 2), ("box_string_coordinates_parsed", 1, 1), ("box_dropped_unpaired_point", 1, 1), ("box_point_pairs_combined", 1, 1)}
    assert [tuple(r) for r in artefacts.event_summary(done, "id", "warnings").collect()] == [("duplicate_box_detected", 1, 1)]
    report = artefacts.write_repair(df, "id", "raw", "task", str(tmp_path / "run"))
    assert report["status_counts"] == {"valid_raw": 1, "fixed_valid": 2, "invalid_json": 2, "invalid_schema": 1} and report["change_type_summary"]["json_syntax_trailing_comma_removed"] == {"total_occurrences": 2, "records_affected": 2}
    twin = json.loads((tmp_path / "run" / "repaired.json").read_text())
    assert len(twin) == 6 and {r["id"] for r in twin if r["original_raw_output"] is not None} == {2, 3}


def test_files_on_any_file_system(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"image_id": "1", "raw_output": "x"}\n\nbroken{\n{"image_id": "2"}\n')
    good, bad = files.read_jsonl_tolerant(spark, str(tmp_path / "log.jsonl"), "image_id STRING, raw_output STRING")
    assert sorted(map(tuple, good.collect()), key=str) == [("1", "x"), ("2", None)] and [r["line"] for r in bad.collect()] == ["broken{"]
    for name, body in (("a", '[{"image_id": "1", "raw_output": "p"}]'), ("b", '{"image_id": "1", "raw_output": "q"}\n{"image_id": "2", "raw_output": "r"}\n')):
        (tmp_path / f"{name}.json").write_text(body)
    both = files.read_evaluated(spark, {n: str(tmp_path / f"{n}.json") for n in "ab"}, "image_id STRING, raw_output STRING")
    assert sorted(map(tuple, both.collect())) == [("a", "1", "p"), ("b", "1", "q"), ("b", "2", "r")]
    with pytest.raises(ValueError):
        files.read_evaluated(spark, {})
    targets = spark.createDataFrame([("7", "t"), (None, "u"), (None, "v")], "image_id STRING, target_json STRING")
    files.write_target_cache(targets, str(tmp_path / "cache"))
    assert {r["image_id"] for r in files.read_target_cache(spark, str(tmp_path / "cache"), 3).collect()} == {"7", "unknown_0", "unknown_1"}
    with pytest.raises(ValueError):
        files.read_target_cache(spark, str(tmp_path / "cache"), 4)
    files.rows_to_csv(spark, [{"a": 1, "b": "x"}, {"a": 2}], str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).collect())) == [("1", "x"), ("2", None)]
    with pytest.raises(ValueError):
        files.rows_to_csv(spark, [{"a": 1}, {"b": 2}], str(tmp_path / "csv2"))
    files.rows_to_csv(spark, [], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() and files.matching(spark, str(tmp_path / "*.jsonl"))[0].endswith("log.jsonl")
    shards = spark.createDataFrame([("unified", "train", 1, "7", "t"), ("unified", None, 2, "8", "u")], "task STRING, split STRING, sample_id INT, image_id STRING, target_json STRING")
    files.write_task_shards(shards, str(tmp_path / "shards"))
    assert spark.read.json(str(tmp_path / "shards")).where("task = 'unified'").count() == 2


def test_short_reason_and_extremes(spark):
    df = spark.createDataFrame([("a:b",), ("c",)], "e STRING")
    assert [r["r"] for r in df.select(jsonio.short_reason(F.col("e")).alias("r")).collect()] == ["a", "c"]
    sizes = spark.createDataFrame([(3, 5), (1, 5), (2, 9), (4, None)], "id INT, n INT")
    assert tuple(audit.extreme_sizes(sizes, "n", "id").first()) == (1, 2)
