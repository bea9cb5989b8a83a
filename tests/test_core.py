"""Profile, nested records, ranks, arrangement, audit, files, streaming and the entry contract."""

import json
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.operators import arrange, audit, compare, conversations, nested, profile, ranking
from girder.sources import artefacts, files
from girder.streaming import ingest

SPEC = profile.ProfileSpec(columns=("view", "tone"), load="load", patterns={"view": "^[a-z]+$"}, partitions=3)
DOMAIN = [("view", v) for v in ("near", "far", "top")]


def profiled(spark, rows, lineage):
    df = spark.createDataFrame(rows, "id BIGINT, load BIGINT, view STRING, tone STRING, value STRING, issue INT")  # clashing names
    return df, spark.createDataFrame(DOMAIN, "column_name STRING, allowed_value STRING"), spark.createDataFrame(lineage, "load_key BIGINT, baseline_key BIGINT")


def test_profile_against_brute_force(spark):
    values = ["near", "far", "top", " ", " \t", None, "Near", "near "]
    rows = [(i, [1, 2, 3, None][i % 4] if i % 7 else 2, values[(i * 5 + i // 9) % 8], f"t{i % 5}", "x", 1) for i in range(200)]
    got = {(r["column_name"], r["load_key"]): r for r in profile.profile(*profiled(spark, rows, [(1, None), (2, 1), (3, 2)]), SPEC).collect()}
    assert len(got) == 8
    for (column, load), r in got.items():
        own = [x[2] if column == "view" else x[3] for x in rows if x[1] == load]
        ok = [v for v in own if v is not None and v.strip() and (column == "tone" or v in ("near", "far", "top"))]
        assert r["row_count"] == len(own) and r["missing_rows"] == sum(v is None or not v.strip() for v in own)
        if load is None:
            continue
        assert r["valid_rows"] == len(ok) and r["distinct_values"] == len(set(ok))
        assert r["q50"] == sorted(ok)[max(0, math.ceil(len(ok) * 0.5) - 1)]
        if load > 1:
            base = [x[2] if column == "view" else x[3] for x in rows if x[1] == load - 1]
            base = [v for v in base if v is not None and v.strip() and (column == "tone" or v in ("near", "far", "top"))]
            f = lambda v, xs: sum(x <= v for x in xs) / len(xs)
            assert r["ks"] == pytest.approx(max(abs(f(v, ok) - f(v, base)) for v in set(ok + base)))
            a, b = Counter(ok), Counter(base)
            assert r["tv"] == pytest.approx(sum(abs(a[v] / len(ok) - b[v] / len(base)) for v in set(ok + base)) / 2)
        else:
            assert r["ks"] is None


def test_profile_of_nothing_and_findings(spark):
    assert profile.profile(*profiled(spark, [], [(1, None)]), SPEC).count() == 0
    rows = [(i, 1, "near", "t", "x", 1) for i in range(30)] + [(100 + i, 2, "far", "t", "x", 1) for i in range(28)] + [(200, 2, None, "t", "x", 1), (201, 2, "bad", None, "x", 1)]
    found = {tuple(r) for r in profile.findings(*profiled(spark, rows, [(1, None), (2, 1)])[:1], "id", *profiled(spark, rows, [(1, None), (2, 1)])[1:], SPEC, 0.03, 0.155).collect()}
    assert found == {("row", 200, "view", "missing"), ("row", 201, "view", "invalid"), ("row", 201, "tone", "missing"), ("load", 2, "view", "missing_rate"), ("load", 2, "view", "shift"), ("load", 2, "tone", "missing_rate")}


BOX = [0.1, 0.2, 0.3, 0.4]
SAMPLE = {"image_id": "1", "rule_1_violation": {"bounding_box": [BOX, {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}, "5,6,7,8", [1, 2, 3], None], "reason": "r"}}


@pytest.mark.parametrize(
    ("payload", "rows"),
    [
        (SAMPLE, [(0, 1, 0, 0), (0, 1, 0, 1), (0, 1, 0, 2)]), ([{}, SAMPLE], [(1, 1, 0, 0), (1, 1, 0, 1), (1, 1, 0, 2)]),
        ({"meta": {"flags": ["a"]}, "sample": json.dumps({"image_id": "1", "rule_2_violation": [{}, {"reason": {"text": "x", "by": "a"}}, {"reason": " ", "bounding_box": []}]})}, [(0, 2, 1, -1)]),
        ({"batch": {"id": 3, "samples": [SAMPLE | {"rule_1_violation": None, "violations": [{"rule": "rule_3", "bounding_box": BOX}, {}, {"rule": 3, "reason": ["a"]}]}]}}, [(0, 3, 0, 0), (0, 3, 1, -1)]),
        ({"image_id": "1", "rule_4_violation": {"bounding_box": [[BOX]], "reason": None}}, [(0, 4, 0, 0)]), ({"image_id": "1", "rule_4_violation": {"reason": ""}}, []), ({}, []), ([], []),
    ],
)
def test_nested_boxes(spark, payload, rows):
    df = spark.createDataFrame([(7, json.dumps(payload), 1), (7, json.dumps(json.dumps(payload)), 1)], "k BIGINT, p STRING, pre INT")
    got = sorted(tuple(r)[1:] for r in nested.violation_boxes(df, "k", "p").collect())
    assert got == sorted(rows * 2)  # a repeated key doesn't mix two documents


def test_nested_bad_payloads_and_tables(spark):
    bad = [(1, None), (2, ""), (3, "{"), (4, '{"image_id": "1"} x'), (None, "null"), (6, "[" * 3000)]
    df = spark.createDataFrame(bad, "k BIGINT, p STRING")
    assert nested.violation_boxes(df, "k", "p").count() == 0 and nested.violation_boxes(df.limit(0), "k", "p").count() == 0
    tables = nested.flat_tables(spark.createDataFrame([(1, json.dumps([SAMPLE | {"rebar": [BOX], "view": 5}, SAMPLE]))], "k BIGINT, p STRING"), "k", "p")
    assert [tables[t].count() for t in ("sample", "violation", "box", "object")] == [2, 2, 6, 1]
    keys = {r["sample_pre"] for r in tables["sample"].collect()}
    assert {r["sample_pre"] for r in tables["box"].collect()} == keys and tables["sample"].first()["view"] == "5"


@pytest.mark.parametrize("depth", [65, 5000, 20_000])
def test_nested_depth(depth):
    deep = lambda text: "[" * depth + text + "]" * depth
    found = depth < 10_000  # deeper than the JSON reader goes there are no nodes
    kinds = lambda text: [n["kind"] for n in nested.labelled_nodes(text)]
    assert kinds(deep(json.dumps(SAMPLE))) == ["sample", "violation", "box", "box", "box"] * found
    assert kinds(json.dumps({"a": deep(json.dumps(SAMPLE)), "b": SAMPLE})).count("sample") == 1 + found
    reasons = [n["text"] for n in nested.labelled_nodes('{"rule_1": {"reason": ' + deep('"r"') + "}}") if n["kind"] == "violation"]
    assert reasons == ["r"] * found
    chain = '{"violations": ' * depth + '{"rule_2": "r"}' + "}" * depth
    assert kinds(chain) == ["sample", "violation"] * found


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(max_size=4), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from(["rule_1", "violations", "rule", "bounding_box", "reason", "sample"]), c, max_size=4), max_leaves=20))
def test_interval_labels_nest(value):
    nodes = nested.labelled_nodes(json.dumps(value))
    edges = sorted([n["pre"] for n in nodes] + [n["post"] for n in nodes])
    assert edges == list(range(2 * len(nodes))) and all(n["pre"] < n["post"] for n in nodes)
    for a in nodes:
        for b in nodes:
            assert not a["pre"] < b["pre"] < a["post"] < b["post"]


def test_ranks_without_large_groups(spark):
    rows = [(i, "hot" if i % 3 else None, i % 10) for i in range(500)]
    df = spark.createDataFrame(rows, "id BIGINT, g STRING, w BIGINT").withColumn("k", ranking.seeded_key(1, F.col("id")))
    got = ranking.group_rank(df, ["g"], "k", ["id"], "r", 16).collect()
    for g in ("hot", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["k"], r["id"]))
        assert [r["r"] for r in own] == list(range(1, len(own) + 1))
    total = ranking.running_total(df, ["g"], "k", ["id"], "w", "s", 7).collect()
    assert max(r["s"] for r in total if r["g"] == "hot") == sum(r[2] for r in rows if r[1] == "hot")
    least = ranking.smallest(df.withColumn("p", (F.col("id") % 50).cast("double")), "p", ["id"], 123).collect()
    assert sorted(r["id"] for r in least) == sorted(sorted(range(500), key=lambda i: (i % 50, i))[:123])
    assert ranking.smallest(df.withColumn("p", F.lit(1.0)), "p", ["id"], 0).count() == 0


def test_strata_split_and_copies(spark, sample_schema, make_sample):
    v = ([], "r")
    samples = spark.createDataFrame(
        [make_sample(str(i), rules=r) for i, r in enumerate([{1: v}, {2: v}, {4: v}, {3: v}, {3: v, 4: v}, {}])] + [make_sample("7", hat=[[0.1] * 4]), make_sample("8", rebar=[[0.1] * 4]), make_sample("9", excavator=[[0.1] * 4])], sample_schema
    )
    assert [r["s"] for r in samples.select(arrange.stratum().alias("s")).collect()] == [3, 1, 0, 2, 0, 7, 4, 5, 6]
    manifest = arrange.oversampling_manifest(samples.limit(6)).first()
    assert manifest["total"] == 16 and manifest["added"] == 10 and arrange.oversampled(samples.limit(6)).count() == 16
    many = spark.createDataFrame([make_sample(str(i), rules={2: v} if i % 4 else {}) for i in range(400)], sample_schema)
    split = arrange.stratified_split(many, "image_id").groupBy("stratum", "part").count().collect()
    assert {(r["stratum"], r["part"]): r["count"] for r in split} == {(1, "val"): 30, (1, "train"): 270, (7, "val"): 10, (7, "train"): 90}
    shares = arrange.distribution(many.select(F.lit("x").alias("split"), arrange.stratum().alias("stratum")), "split", "stratum").collect()
    assert len(shares) == 8 and sum(r["pct"] for r in shares) == 100.0


def test_orders(spark, sample_schema, make_sample):
    v = ([], "r")
    samples = spark.createDataFrame([make_sample(f"{i:03}", rules={2: v} if i % 10 == 0 else {}, resolution=(i * 7) % 40) for i in range(103)], sample_schema)
    buckets = arrange.bucket_order(samples, "image_id", 10, 1, 0).collect()
    assert Counter(r["bucket"] for r in buckets) == {**{b: 10 for b in range(10)}, 10: 3}
    ordered = sorted(buckets, key=lambda r: r["place"])
    assert [r["resolution"] for r in ordered] == sorted(r["resolution"] for r in buckets)
    assert arrange.bucket_order(samples, "image_id", 10, 1, 0, drop_last=True).count() == 100
    placed = sorted(arrange.rare_class_order(samples, "image_id").collect(), key=lambda r: r["place"])
    assert [r["place"] for r in placed] == list(range(103))
    at = [r["place"] for r in placed if r["rare"]]
    assert max(b - a for a, b in zip(at, at[1:])) < 30
    assert placed == sorted(arrange.rare_class_order(samples, "image_id").collect(), key=lambda r: r["place"])
    assert arrange.rare_class_order(samples.where("resolution < 0"), "image_id").count() == 0
    log = spark.createDataFrame([("a", 2, "x"), ("a", 1, ""), ("b", 1, None)], "image_id STRING, n INT, raw_output STRING")
    assert arrange.first_per_key(log, ["image_id"], [F.col("n")]).where("image_id = 'a'").first()["n"] == 1
    assert [r["image_id"] for r in arrange.pending(log.select("image_id").distinct(), log, "image_id").collect()] == ["b"]


def test_pairing(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, p STRING")
    t = spark.createDataFrame([(2, "x"), (1, "y")], "id INT, t STRING")
    assert arrange.paired(p, t, "id").count() == 2
    for bad in (t.limit(0), t.limit(1), t.unionAll(t), t.where("id = 1").unionAll(spark.createDataFrame([(3, "z")], "id INT, t STRING"))):
        with pytest.raises(ValueError):
            arrange.paired(p, bad, "id")
    assert [r["id"] for r in arrange.missing_keys(p, t.where("id = 1"), "id").collect()] == [2]
    many = spark.range(100)
    assert arrange.seeded_first_n(many, "id", 7).collect() == arrange.seeded_first_n(many.repartition(5), "id", 7).collect()


def test_artefacts(spark, tmp_path):
    rows = [(1, "unified", '{"caption":"a",}'), (2, "unified", "x"), (3, "unified", '{"caption":"a"}')]
    report = artefacts.write_repair(spark.createDataFrame(rows, "id INT, task STRING, raw STRING"), "id", "raw", "task", str(tmp_path))
    assert report["status_counts"] == {"fixed_valid": 1, "invalid_json": 1, "valid_raw": 1} and report["total_records"] == 3
    assert report["change_type_summary"]["json_syntax_trailing_comma_removed"] == {"total_occurrences": 1, "records_affected": 1}
    assert spark.read.json(str(tmp_path / "broken")).count() == 1 and spark.read.json(str(tmp_path / "repaired")).count() == 3


def test_audit(spark, sample_schema, make_sample):
    s = spark.createDataFrame([make_sample("1", rules={1: ([], "r"), 2: ([[0.5, 0.1, 0.4, 0.2]], "r")}, rebar=[[0.1, 0.1, 0.2, 0.2]] * 5), make_sample("2")], sample_schema)
    issues = Counter((r["class"], r["issues"]) for r in audit.audit_boxes(s, "image_id").collect())
    assert issues == {("rebar", ""): 5, ("rule_1_violation", "missing_box"): 1, ("rule_2_violation", "x_order"): 1}
    assert audit.repeated_boxes(s, "image_id", 3).first()["n"] == 5
    runs = spark.createDataFrame([(1, i, f) for i, f in enumerate([0, 1, 1, 0, 1])], "k INT, i INT, f INT")
    assert sorted((r["first"], r["last"], r["length"]) for r in audit.islands(runs, "k", "i", F.col("f") == 1).collect()) == [(1, 2, 2), (4, 4, 1)]
    assert audit.checks(s, "image_id").where("not passed").count() == 1
    assert audit.summary(s.limit(0), "resolution").first()["count"] == 0


def test_conversations(spark, sample_schema, make_sample):
    s = spark.createDataFrame([make_sample("1", caption='Ü "q"', rules={1: ([[0.1, 0.1, 0.5, 0.5]], None)}), make_sample("2", caption=None)], sample_schema)
    target = s.select(conversations.target_json("unified").alias("t")).first()["t"]
    value = json.loads(target.removeprefix("```json\n").removesuffix("\n```"))
    assert list(value) == ["caption", *[f"rule_{i}_violation" for i in range(1, 5)], "excavator", "rebar", "worker_with_white_hard_hat"]
    assert value["caption"] == 'Ü "q"' and value["rule_1_violation"] == {"bounding_box": [[100, 100, 500, 500]], "reason": ""} and "Ü" in target
    prompts = spark.createDataFrame([(1, "unified", "look"), (2, "violations_only", "check")], "prompt_id INT, task STRING, prompt STRING")
    assert conversations.conversations(s, "image_id", prompts).count() == 3
    with pytest.raises(KeyError):
        conversations.target_json("nonsense")
    fixed = conversations.corrected(s, spark.createDataFrame([("1", "view", "far")], "image_id STRING, column_name STRING, value STRING"), "image_id").orderBy("image_id").collect()
    assert [r["view"] for r in fixed] == ["far", "ground view"]
    cache = spark.createDataFrame([("1", "t"), ("9", "t")], "image_id STRING, target_json STRING")
    images = spark.createDataFrame([(1, "z", 1), (1, "b", 2)], "image_id INT, path STRING, n INT")
    assert conversations.rejoined(cache, images, "image_id", "n").collect() == [("1", "t", "b", 2)] and conversations.rejoined(cache, images, "image_id", "n", "left").count() == 2
    assert conversations.missing_images(cache, images, "image_id") == 1


@pytest.mark.parametrize("share", [0.0, 0.05, 0.6, 0.95, 1.0])
def test_rare_order_is_that_of_sequential_probing(spark, sample_schema, make_sample, share, monkeypatch):
    monkeypatch.setattr(arrange, "ROWS_PER_BUCKET", 16)
    n, m = 150, int(150 * share)
    samples = spark.createDataFrame([make_sample(f"{i:03}", rules={4: ([], "r")} if i < m else {}) for i in range(n)], sample_schema)
    keys = {r["image_id"]: (r["k"], r["u"]) for r in samples.select("image_id", ranking.seeded_key(42, F.col("image_id")).alias("k"), ranking.uniform(ranking.seeded_key(43, F.col("image_id"))).alias("u")).collect()}
    order = sorted(keys, key=lambda i: keys[i][0])
    slots: list = [None] * n
    for k, i in enumerate(x for x in order if int(x) < m):
        at = min(math.floor(k * (n / m) + keys[i][1] * (n / m)), n - 1)
        while slots[at] is not None:
            at = (at + 1) % n
        slots[at] = i
    commons = iter(x for x in order if int(x) >= m)
    want = [i if i is not None else next(commons) for i in slots]
    got = sorted(arrange.rare_class_order(samples, "image_id").collect(), key=lambda r: r["place"])
    assert [r["image_id"] for r in got] == want and [r["place"] for r in got] == list(range(n))


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_smallest_narrows_any_spread(spark, spread):
    values = [(i, float(i % 97) if i % 3 else i * spread) for i in range(3000)]
    df = spark.createDataFrame(values, "id BIGINT, p DOUBLE")
    for n in (0, 1, 700, 2999, 5000):
        got = sorted(r["id"] for r in ranking.smallest(df, "p", ["id"], n, slice_rows=20).collect())
        assert got == sorted(i for i, _ in sorted(values, key=lambda x: (x[1], x[0]))[:n])


def test_compare(spark):
    m = spark.createDataFrame([("base", "f", 0.0), ("tuned", "f", 0.5), ("base", "g", 2.0), ("tuned", "g", 1.0), ("tuned", "h", 0.0)], "run STRING, metric STRING, value DOUBLE")
    got = {r["metric"]: (r["delta"], r["delta_pct"]) for r in compare.against(m, "run", "base").collect()}
    assert got == {"f": (0.5, 100.0), "g": (-1.0, -50.0), "h": (0.0, 0.0)}
    assert compare.flattened({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a/b": 1, "a/c/d": 2, "e": 3}


def test_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"image_id": "1", "raw_output": "x"}\n\n{bad\n{"image_id": "2"}\n', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        files.read_jsonl(spark, str(log), files.ANSWER_LOG).collect()
    good, bad = files.read_jsonl_tolerant(spark, str(log), files.ANSWER_LOG)
    assert sorted(r["image_id"] for r in good.collect()) == ["1", "2"] and [r["line"] for r in bad.collect()] == ["{bad"]
    out = str(tmp_path / "csv")
    files.append_csv(spark.createDataFrame([(1, "a")], "x INT, y STRING"), out)
    files.append_csv(spark.createDataFrame([("b", 2, 9)], "y STRING, x INT, z INT"), out)
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(out).collect()) == [("1", "a"), ("2", "b")]
    files.write_csv(spark.createDataFrame([], "x INT"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    for run, value in (("a", {"valid": {"f1": 0.5}}), ("b", None)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(json.dumps(value) if value else "{", encoding="utf-8")
    with pytest.warns(UserWarning):
        assert files.read_runs(spark, str(tmp_path / "*" / "metrics.json")).collect() == [("a", "valid/f1", 0.5)]
    assert files.merge_settings({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": 2}) == {"a": {"x": 1, "y": 3}, "b": 2}
    path = str(tmp_path / "m.json")
    files.merge_metrics(path, {"s": {"a": 1}})
    assert files.merge_metrics(path, {"s": {"b": 2}}) == {"s": {"a": 1, "b": 2}}
    files.write_samples(spark.createDataFrame([(1, "train"), (2, "val")], "id INT, split STRING"), str(tmp_path / "p"), "split")
    assert files.read_samples(spark, str(tmp_path / "p"), "val").first()["id"] == 2
    files.write_target_cache(spark.createDataFrame([(None, "t"), ("1", "u")], "image_id STRING, target_json STRING"), str(tmp_path / "c"))
    assert files.read_jsonl(spark, str(tmp_path / "c"), files.TARGET_CACHE).where("image_id like 'unknown_%'").count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "image_id STRING, source STRING, raw_output STRING, at TIMESTAMP"
    first = [{"image_id": "1", "source": "a", "raw_output": "x", "at": "2031-01-01T00:00:00Z"}, {"image_id": "1", "source": "a", "raw_output": "y", "at": "2031-01-01T00:05:00Z"}, {"image_id": "2", "source": "a", "raw_output": "", "at": "2031-01-01T00:06:00Z"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, first)), encoding="utf-8")

    def run():
        stream = ingest.first_answers(ingest.answer_stream(spark, str(tmp_path / "in"), schema), "image_id", "at")
        ingest.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        return sorted(r["image_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["1"]
    (tmp_path / "in" / "2.json").write_text(json.dumps({"image_id": "2", "source": "a", "raw_output": "z", "at": "2031-01-01T01:00:00Z"}), encoding="utf-8")
    assert run() == ["1", "2"]
    windows = ingest.rate_per_window(spark.readStream.schema(schema).json(str(tmp_path / "in")), "at")
    q = windows.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("rates").agg(F.sum("answers"), F.sum("empty")).first() == (4, 1)


def test_entry_contract():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 80 and set(oracles) <= set(queries) and {"p1_found", "p7_found"} <= set(queries)
