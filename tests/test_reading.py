"""Strict reading and repair of answers."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.functions import jsonio, repair, tolerant

GOOD = {"caption": "a", "excavator": [[1, 2, 3, 4]]}


@pytest.mark.parametrize(
    ("value", "error"),
    [
        (GOOD, None), ({}, "caption_missing"), ({"caption": None}, "caption_type"), ({"caption": 5}, "caption_type"), ({"caption": ""}, None),
        (GOOD | {"excavator": [["1", "2", 3, 4]]}, None), (GOOD | {"excavator": [[True, 2, 3, 4]]}, None), (GOOD | {"excavator": None}, "excavator_shape"),
        (GOOD | {"excavator": [1, 2, 3, 4]}, "excavator_shape"), (GOOD | {"rebar": [[1, 2, 3]]}, "rebar_shape"), (GOOD | {"rebar": [[1, 2, 3, None]]}, "rebar_shape"),
        (GOOD | {"rule_1_violation": True}, "rule_1_violation_shape"), (GOOD | {"rule_1_violation": "x"}, "rule_1_violation_shape"), (GOOD | {"rule_1_violation": {}}, None),
        (GOOD | {"rule_2_violation": {"bounding_box": [1, 2, 3, 4]}}, "rule_2_violation_shape"), (GOOD | {"rule_2_violation": {"reason": None, "bounding_box": None}}, None),
        (GOOD | {"rule_2_violation": {"reason": 5}}, "rule_2_violation_shape"), (GOOD | {"other": 1}, None), ([GOOD], "object_type"), (5, "object_type"),
    ],
)
def test_schema_rules(value, error):
    assert jsonio.first_error(value, "unified") == error


def test_violations_only_needs_nothing():
    assert jsonio.first_error({}, "violations_only") is None
    assert jsonio.first_error({"excavator": 5, "caption": 1}, "violations_only") is None


@pytest.mark.parametrize(("text", "valid"), [('{"caption":"a"} extra', False), ("{'caption':'a'}", False), ('{"caption":"a","x":NaN}', True), ('{"caption":"a","caption":"b"}', True), ('{"caption":"a",}', False), ("", False), (None, False), ("null", False), ("5", True), ('x ```json\n{"caption":"a"}\n``` y', True)])
def test_json_gate(text, valid):
    assert jsonio.parsed(text, "unified")[0] is valid


def test_strict_columns(spark):
    rows = [(1, '```json\n{"caption":"a","excavator":[["1",2,3,4]],"rule_1_violation":{}}\n```', "unified", 9), (2, None, "unified", 9), (3, "{}", "violations_only", 9), (4, "{}", None, 9)]
    df = spark.createDataFrame(rows, "id INT, raw STRING, task STRING, json_valid INT")  # a column with a clashing name
    got = {r["id"]: r["parsed"] for r in jsonio.strictly_parsed(df, "raw", "task").collect()}
    assert got[1]["schema_valid"] and got[1]["excavator"] == [[1.0, 2.0, 3.0, 4.0]] and got[1]["rule_1_violation"] is None
    assert got[2]["error"] == "json_parse_error" and got[3]["schema_valid"]
    assert jsonio.strictly_parsed(df.limit(0), "raw", "task").count() == 0


@pytest.mark.parametrize(("text", "out"), [("pre ```JSON\n x ``` post", "x"), ("  y ", "y"), ("``` ```", ""), ("```json\n{", "```json\n{")])
def test_strip_fences(spark, text, out):
    row = spark.createDataFrame([(text,)], "t STRING").select(jsonio.strip_fences(F.col("t")).alias("a"), jsonio.strip_open_fences(F.col("t")).alias("b")).first()
    assert row["a"] == out and jsonio.unfenced(text) == out
    if text.startswith("```json"):
        assert row["b"] == "{"


def fixed(text, task="unified"):
    r = repair.repaired(text, task)
    return r["status"], json.loads(r["fixed"]) if r["fixed"] else None, [c["type"] for c in r["changes"]]


@pytest.mark.parametrize(
    ("text", "field", "value", "event"),
    [
        ('```json\n{"caption":"a","excavator":[[1,2,3,4],],}\n```', "excavator", [[1, 2, 3, 4]], "json_syntax_trailing_comma_removed"),
        ("{'caption': 'it\\'s', 'rule_1_violation': None}", "caption", "it's", "json_python_literal_fallback_used"),
        ('{“caption”: "a"}', "caption", "a", "json_syntax_smart_quotes_normalized"),
        ('{"caption":"a" /* no */}', "caption", "a", "json_syntax_block_comment_removed"),
        ('{"caption":"a","rebar":[[1,2,3,4],[5,6', "rebar", [[1, 2, 3, 4]], "json_truncation_repaired"),
        ('{"caption":"a","rule_1_violation":{"reason":"cut he', "caption", "a", "json_truncation_repaired"),
        ('[{"caption":"a"}]', "caption", "a", None),
        ('{"caption":"a","rebar":null,"violations":[{"rule":2,"reason":"r"}]}', "rule_2_violation", {"bounding_box": [], "reason": "r"}, "violation_list_entry_expanded"),
        ('{"caption":"a","rebar":null,"rule_1_reason":"r","rule_1_bbox":[1,2,3,4]}', "rule_1_violation", {"bounding_box": [[1, 2, 3, 4]], "reason": "r"}, "violation_flattened_keys_merged"),
        ('{"caption":"a","rebar":"1,2,3,4"}', "rebar", [[1, 2, 3, 4]], "box_string_coordinates_parsed"),
        ('{"caption":"a","rebar":"1,2,3,4,5,6,7,8"}', "rebar", [[1, 2, 3, 4], [5, 6, 7, 8]], "box_string_multi_box_reshaped"),
        ('{"caption":"a","rebar":"1,2,3,4,5"}', "rebar", [], "box_dropped_unreconstructable"),
        ('{"caption":"a","rebar":[[1,2],[3,4]]}', "rebar", [[1, 2, 3, 4]], "box_point_pairs_combined"),
        ('{"caption":"a","rebar":[[[1,2,3,4]]]}', "rebar", [[1, 2, 3, 4]], "box_redundant_nesting_removed"),
        ('{"caption":"a","rule_3_violation":true}', "rule_3_violation", {"bounding_box": [], "reason": ""}, "violation_bool_converted"),
        ('{"caption":"a","rule_3_violation":"n/a"}', "rule_3_violation", None, "violation_string_normalized_to_null"),
        ('{"caption":"a","rule_3_violation":[]}', "rule_3_violation", None, "violation_list_dropped"),
        ('{"caption":"a","rebar":[{"left":1,"top":2,"right":3,"bottom":4}]}', "rebar", [[1, 2, 3, 4]], "box_dict_corners_converted"),
        ('{"caption":"a","rebar":[{"x":1,"y":2,"w":3,"h":4}]}', "rebar", [], "box_dropped_unreconstructable"),
        ('{"description":"a","rebar":null}', "caption", "a", "key_renamed"),
        ('{"caption":["a","b"]}', "caption", "a b", "caption_list_joined"),
        ('{"caption":"a","rebar":["1,2,3,4]}', "rebar", [[1, 2, 3, 4]], "box_string_missing_closing_quote_repaired"),
        ('{"caption":"a","rule_1_violation":{"reason":["x.","y"],"bbox":[]}}', "rule_1_violation", {"bounding_box": [], "reason": "x. y"}, "violation_reason_list_joined"),
    ],
)
def test_repairs(text, field, value, event):
    status, out, events = fixed(text)
    assert status == "fixed_valid" and out[field] == value
    assert event is None or event in events
    assert repair.repaired(json.dumps(out), "unified")["status"] == "valid_raw"  # a second pass has nothing to do


@pytest.mark.parametrize(
    ("text", "value", "mends"),
    [
        ('{"a": True, "b": False, "c": None, "d": NaN, "e": -Infinity}', {"a": True, "b": False, "c": None, "d": None, "e": None},
         {"json_syntax_python_true_converted": 1, "json_syntax_python_false_converted": 1, "json_syntax_python_none_converted": 1, "json_syntax_nan_converted": 1, "json_syntax_infinity_converted": 1}),
        ('{"a": 1, // one\n "b": "http://x" /* two */}', {"a": 1, "b": "http://x"}, {"json_syntax_line_comment_removed": 1, "json_syntax_block_comment_removed": 1}),
        ('{"a": [(1, 2, 3, 4)]}', {"a": [[1, 2, 3, 4]]}, {"json_syntax_parentheses_boxes": 2}),
        ('{"a": [1,2,3,4], [5,6,7,8]], "b": 1}', {"a": [[1, 2, 3, 4], [5, 6, 7, 8]], "b": 1}, {"json_syntax_missing_outer_bracket": 1}),
        ('{"a": [[190, 35, [700, 680], [1, 2, 3, 4]]}', {"a": [[190, 35, 700, 680], [1, 2, 3, 4]]}, {"json_syntax_rogue_internal_bracket": 1}),
        ('{"r": {"bbox": [["35,560,70,620"]}, "b": 1}', {"r": {"bbox": ["35,560,70,620"]}, "b": 1}, {"json_syntax_extra_string_bracket": 1}),
        ('{"a": [[1, 2, 3, 4]}}', {"a": [[1, 2, 3, 4]]}, {"json_syntax_mismatched_end_closures": 1}),
        ('{"a": [[1, 2] [3, 4]] "b": 1}', {"a": [[1, 2], [3, 4]], "b": 1}, {"json_syntax_missing_comma_inserted": 2}),
        ('{"a": ["1,2,3,4,\n "5,6,7,8"]}', {"a": ["1,2,3,4", "5,6,7,8"]}, {"json_syntax_missing_closing_quote_in_list": 1}),
        ('{"a": ["1,2,3, 4]}', {"a": ["1,2,3,4"]}, {"box_string_missing_closing_quote_repaired": 1}),
        ('{“a”: "x ”y“ \\" z"}', {"a": 'x ”y“ " z'}, {"json_syntax_smart_quotes_normalized": 1}),
        ('{"a": 1, "b": {"c": [1, 2', {"a": 1, "b": {"c": [1, 2]}}, {"json_truncation_repaired": 1}),
        ('{"a": 1, "b": "cut off he', {"a": 1}, {"json_truncation_repaired": 1}),
        ('{"a": [1,], }', {"a": [1]}, {"json_syntax_trailing_comma_removed": 2}),
    ],
)
def test_mends(text, value, mends):
    assert tolerant.read_damaged(text) == (value, mends)


@pytest.mark.parametrize("text", ["", "no bracket", "{a: 1}", '{"a" 1}', '{"a": 1,, "b": 2}', '{"a": "line\nbreak"}', '{"a": }', "{'a': 1}", '{"a": 1 / 2}'])
def test_what_no_mend_covers_is_refused(text):
    with pytest.raises(tolerant.Unreadable):
        tolerant.read_damaged(text)


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=20))
def test_whole_json_is_read_as_it_is(value):
    assert tolerant.read_damaged(json.dumps({"v": value})) == ({"v": value}, {})
    assert tolerant.balanced_object("x " + json.dumps({"v": value}) + " {") == json.dumps({"v": value})


def test_regions_in_order():
    text = 'a ```\n{"x": 1}\n``` b ```JSON {"y": 1}``` <json>{"z": 1}</json> ``` open'
    assert repair.regions(text) == ['{"y": 1}', '{"x": 1}', '{"z": 1}', text]
    assert tolerant.balanced_object('{"a": "}"') is None and tolerant.balanced_object("none") is None


def test_repeats_in_a_valid_answer_are_warned_about():
    text = json.dumps({"caption": "a", "rebar": [[1, 2, 3, 4]] * 6, "rule_2_violation": {"bounding_box": [[5, 6, 7, 8]] * 4 + [[0, 0, 1, 1]] * 4}})
    r = repair.repaired(text, "unified")
    assert r["status"] == "valid_raw" and not r["changes"]
    assert [(w["type"], w["field"]) for w in r["warnings"]] == [("duplicate_box_detected", "rebar")] + [("duplicate_box_detected", "rule_2_violation.bounding_box")] * 2


def test_violation_lists_follow_the_first_rule_key():
    entries = [{"rule": "rule 3", "id": 1, "explanation": "r", "bbox": [1, 2, 3, 4]}, {"type": 2, "reason": "x"}, {"rule_id": 12}, {"Rule-Number": "4", "box": []}, "x"]
    status, out, events = fixed(json.dumps({"caption": "a", "rebar": None, "rule_4_violation": {"reason": "kept"}, "violations": entries}))
    assert status == "fixed_valid" and "violations" not in out and out["rule_3_violation"] == {"bounding_box": [[1, 2, 3, 4]], "reason": "r"}
    assert out["rule_4_violation"]["reason"] == "kept" and out["rule_1_violation"] is None and out["rule_2_violation"] is None
    assert events.count("violation_list_entry_expanded") == 1


def test_unrepairable():
    assert fixed("no json at all")[0] == "invalid_json" and fixed(None)[0] == "invalid_json"
    assert fixed('{"rebar": []}')[0] == "invalid_schema"
    assert fixed('{"description": "x"}', "violations_only")[0] == "valid_raw"
    warned = repair.repaired(json.dumps({"caption": ["a"], "rebar": [[1, 2, 3, 4]] * 4}), "unified")["warnings"]
    assert [w["type"] for w in warned] == ["duplicate_box_detected"]


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-5, 1500) | st.text(max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from(["caption", "rebar", "rule_1", "rule_2_violation", "violations", "bbox", "reason"]), c, max_size=4), max_leaves=12), st.integers(0, 60))
def test_repair_is_idempotent_and_never_raises(value, cut):
    text = json.dumps(value)
    for t in (text, text[:cut]):
        r = repair.repaired(t, "unified")
        if r["status"] == "fixed_valid":
            assert repair.repaired(r["fixed"], "unified")["status"] == "valid_raw"


def test_repaired_log(spark):
    rows = [(1, "unified", '{"caption":"a",}'), (2, "unified", '{"caption":"a"}'), (3, "unified", "x"), (4, "unified", None)]
    out = {r["id"]: r for r in repair.repaired_log(spark.createDataFrame(rows, "id INT, task STRING, raw STRING"), "raw", "task").collect()}
    assert out[1]["original_raw_output"] == '{"caption":"a",}' and out[1]["repair_status"] == "fixed_valid"
    assert out[2]["raw"] == '{"caption":"a"}' and out[2]["original_raw_output"] is None and out[4]["repair_status"] == "invalid_json"


def test_failure_category_and_short_reason(spark):
    df = spark.createDataFrame([("{[",), ("no",), ("x" * 4000,)], "t STRING").select(jsonio.failure_category(F.col("t")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["truncated", "other", "truncated"]
