"""Metrics and rewards against hand-computed values."""

import json

import pytest
from pyspark.sql import functions as F

from girder.functions import text
from girder.operators import evaluation as ev
from girder.operators import rewards

A, B = [[0.1, 0.1, 0.5, 0.5]], [[100, 100, 500, 500]]


def answer(**keys):
    return "```json\n" + json.dumps({"caption": "a site"} | keys) + "\n```"


@pytest.fixture(scope="module")
def rows(spark, sample_schema, make_sample):
    def build(pairs, task="unified"):
        data = [(i, task, raw, sample) for i, (raw, sample) in enumerate(pairs)]
        return ev.scored(spark.createDataFrame(data, f"id INT, task STRING, raw_output STRING, sample STRUCT<{sample_schema.replace(' STRUCT', ': STRUCT').replace(' ARRAY', ': ARRAY').replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT').replace('reason:: ', 'reason: ').replace('bounding_box:: ', 'bounding_box: ')}>"))

    return build


def test_presence_and_grounding(rows, make_sample):
    s = make_sample
    r = rows([(answer(excavator=B), s(excavator=A)), (answer(rebar=B), s(excavator=A)), ("nothing", s()), (answer(), s(rebar=A)), (answer(), None)])
    got = {x["class"]: x for x in ev.presence(ev.class_facts(r)).collect()}
    assert (got["excavator"]["tp"], got["excavator"]["fn"], got["excavator"]["tn"]) == (1, 1, 2)
    assert (got["rebar"]["fp"], got["rebar"]["fn"], got["micro"]["tp"]) == (1, 1, 1)
    assert got["micro"]["precision"] == 0.5 and got["macro"]["precision"] == pytest.approx(1 / 3)
    g = {x["class"]: x for x in ev.grounding(ev.class_facts(r)).collect()}
    assert g["excavator"]["mask_tn0"] == pytest.approx(0.25) and g["excavator"]["mask_tn1"] == pytest.approx(0.75)
    assert g["excavator"]["mask_exist"] == pytest.approx(0.5) and g["excavator"]["mask_micro"] == pytest.approx(0.5)
    assert g["all"]["mask_macro_exist"] == pytest.approx((0.5 + 0 + 0) / 3)


def test_violations(rows, make_sample):
    s, v = make_sample, {"bounding_box": B, "reason": "no hat"}
    r = rows([(answer(rule_1_violation=v), s(rules={1: (A, "no hat")})), (answer(rule_2_violation=v), s()), (answer(), s(rules={1: (A, "x")})), (answer(), s())])
    got = {x["rule"]: x for x in ev.violation_scores(r).collect()}
    assert (got["micro"]["tp"], got["micro"]["fp"], got["micro"]["fn"]) == (1, 1, 1) and got["micro"]["f1"] == 0.5
    assert (got["0"]["tp"], got["0"]["fp"], got["0"]["fn"]) == (1, 1, 1)
    gated = {x["rule"]: x for x in ev.gated_scores(r, gate=1.01).collect()}
    assert (gated["1"]["tp"], gated["1"]["fp"], gated["1"]["fn"]) == (0, 1, 2)
    ground = {x["rule"]: x for x in ev.violation_grounding(r).collect()}
    assert ground["all"]["macro_tn0"] == pytest.approx(0.25) and ground["1"]["common"] == 1
    reason = {x["rule"]: x["score"] for x in ev.reasoning(r).collect()}
    assert reason["all"] == 1.0 and reason["macro"] == 0.25


def test_structural_dual_and_strata(rows, make_sample):
    r = rows([(answer(), make_sample()), ("prose", make_sample()), ('{"other": 1}', make_sample(illumination="x"))])
    got = ev.structural(r).first()
    assert (got["json_valid"], got["schema_valid"]) == (2, 1)
    assert ev.by_pass(r).groupBy("pass").count().orderBy("pass").collect() == [("strict", 3), ("valid", 1)]
    assert {x["detail"] for x in ev.failures(r, "id").collect()} == {None, "caption_missing"}
    by = ev.stratified(r, ev.structural, ("illumination",)).collect()
    assert {x["value"]: x["answers"] for x in by} == {"night": 2, "x": 1}
    with pytest.raises(ValueError):
        ev.assert_not_empty(r.limit(0), "answers")


def test_golden_arithmetic(spark):
    published = [("excavator", 597, 144, 483), ("rebar", 106, 294, 221), ("hat", 101, 628, 213)]
    df = spark.createDataFrame(published, "class STRING, tp BIGINT, fp BIGINT, fn BIGINT")
    got = {r["class"]: r for r in ev.with_averages(df, "class", ["tp", "fp", "fn"], ()).collect()}
    assert round(got["excavator"]["precision"], 4) == 0.8057 and round(got["micro"]["precision"], 4) == 0.4299 and round(got["micro"]["recall"], 4) == 0.4672


def test_rewards(rows, make_sample):
    s, v = make_sample, {"bounding_box": B, "reason": "no hat"}
    r = rows([(answer(excavator=B), s(excavator=A)), (answer(rule_1_violation=v, rule_2_violation=v), s(rules={1: (A, "no hat"), 3: (A, "x")})), ("bad", s()), (answer(rebar=B * 6), s())])
    got = {x["id"]: x for x in rewards.composite(r).collect()}
    assert got[0]["r_grounding"] == pytest.approx((1 + 0.1 + 0.1) / 3) and got[0]["r_violation_id"] == pytest.approx(0.10)
    assert got[1]["r_violation_id"] == pytest.approx(0.5) and got[1]["r_reasoning"] == pytest.approx(1.0) and got[1]["r_grounding"] == pytest.approx(0.10)
    assert got[2]["total"] == 0.0
    plain = sum(rewards.WEIGHTS[n] * got[3][f"r_{n}"] for n in rewards.WEIGHTS)
    assert got[3]["repetition"] == 1.0 and got[3]["total"] == pytest.approx(plain / 2)
    assert sum(rewards.WEIGHTS.values()) == pytest.approx(1.0)
    with pytest.raises(KeyError):
        rewards.components(r, ("nonsense",))
    old = {x["id"]: x for x in rewards.legacy(r).collect()}
    assert old[0]["r_rules"] == 1.0 and old[2]["r_json"] == 0.0


def test_text(spark):
    rows = [("A site, a crane", "a site a crane", 1.0), ("été", "hiver", 0.0), ("", "x", 0.0), (None, "x", 0.0)]
    df = spark.createDataFrame(rows, "p STRING, r STRING, f DOUBLE").select("f", text.ngram_f1(F.col("p"), F.col("r")).alias("g"), text.word_count(F.col("p")).alias("n"))
    got = df.collect()
    assert all(r["g"] == pytest.approx(r["f"]) for r in got) and [r["n"] for r in got] == [4, 1, 0, 0]
    cos = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([], [1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>").select(text.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(r["c"], 6) for r in cos] == [0.0, 1.0, 0.0]
    pairs = spark.createDataFrame([(1, "a crane lifts pipes", "a crane lifts pipes"), (2, "b", "other words here"), (3, None, "x y")], "id INT, p STRING, r STRING")
    scores = {r["id"]: r["score"] for r in text.consensus_score(pairs, "id", "p", "r").collect()}
    assert scores[1] == pytest.approx(10.0) and scores[2] == 0.0 and scores[3] == 0.0
