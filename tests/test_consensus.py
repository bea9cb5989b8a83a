"""Caption scores over a corpus: against their definition, and what they write."""

import json
import math
import random
import re
from collections import Counter

import pytest

from girder.functions import text
from girder.operators import evaluation as ev
from girder.plans import evaluation


def _brute_consensus(pairs, most=4, sigma=6.0):
    """CIDEr-D and F1 of the sets of 1- and 2-grams, straight from their definitions."""
    words = {i: tuple(re.findall(r"\w+", (t or "").lower()) for t in (p, r)) for i, p, r in pairs}
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    df = Counter(g for _, r in words.values() for n in range(1, most + 1) for g in grams(r, n))
    out = {}
    for i, (p, r) in words.items():
        score = 0.0
        for n in range(1, most + 1):
            x, y = grams(p, n), grams(r, n)
            w = {g: math.log(len(words)) - math.log(df.get(g, 1)) for g in x | y}
            a, b = (math.sqrt(sum((k * w[g]) ** 2 for g, k in c.items())) for c in (x, y))
            score += sum(min(x[g], y[g]) * y[g] * w[g] ** 2 for g in x) / (a * b) if a and b else 0.0
        x, y = (set(grams(t, 1)) | set(grams(t, 2)) for t in (p, r))
        out[i] = (10 / most * score * math.exp(-((len(p) - len(r)) ** 2) / (2 * sigma**2)), 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0)
    return out


def test_consensus_writes_no_ngrams(spark):
    """each n-gram of each row went through two shuffles, 15 times the input on disk."""
    pairs = spark.createDataFrame([(1, "a b a b", "a b a b"), (2, "x y", "p q")], "id INT, p STRING, r STRING")
    plan = text.consensus_score(pairs, "id", "p", "r")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("listed", [text.LISTED, 40, 1, 0])
def test_consensus_equals_its_definition_however_many_ngrams_are_listed(spark, listed):
    draw = random.Random(7)
    say = lambda n: " ".join(draw.choice("a b c d e f é 名 g_1 42".split()) for _ in range(n))
    refs = [say(draw.randrange(12)) for _ in range(30)] + ["a b a b a b", "", None]
    rows = []
    for i in range(1500):
        r = draw.choice(refs)
        p = r if i % 7 == 0 else None if i % 11 == 0 else "empty" if i % 5 == 0 else " ".join(w for w in (r or "").split() if draw.random() < 0.8) + " " + say(draw.randrange(4))
        rows.append((i, p, r))
    expected = _brute_consensus(rows)
    pairs = spark.createDataFrame(rows, "id INT, p STRING, r STRING").repartition(3)
    got = {r["id"]: (r["score"], r["ngram_f1"]) for r in text.caption_scores(pairs, "id", "p", "r", listed=listed).collect()}
    assert got.keys() == expected.keys() and all(got[i] == pytest.approx(expected[i], abs=1e-12) for i in got)


def test_consensus_of_long_texts_and_of_none(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))  # more words than are worked on at once
    rows = [(1, long, long), (2, "w1 w2", long), (3, "q", "q r")]
    got = {r["id"]: r["score"] for r in text.consensus_score(spark.createDataFrame(rows, "id INT, p STRING, r STRING").coalesce(1), "id", "p", "r").collect()}
    expected = _brute_consensus(rows)
    assert all(got[i] == pytest.approx(expected[i][0], abs=1e-9) for i in (1, 2, 3))
    assert text.consensus_score(spark.createDataFrame([], "id INT, p STRING, r STRING"), "id", "p", "r").count() == 0


def test_caption_suite_writes_captions_alone(spark, sample_schema, make_sample, monkeypatch):
    """whole answers and samples were written, and the n-grams of both sides shuffled for the consensus."""
    said = [("a crane lifts pipes", "a crane lifts long pipes"), ("two men dig", "two men dig a pit"), (None, "a wall"), (" ", None)]
    rows = [(i, "unified", json.dumps({"caption": p}), make_sample(str(i), caption=r)) for i, (p, r) in enumerate(said)]
    scored = ev.scored(spark.createDataFrame(rows, f"prediction_id INT, task STRING, raw_output STRING, sample STRUCT<{sample_schema}>"))
    written = []
    monkeypatch.setattr(evaluation, "_scored", lambda *_: scored)
    monkeypatch.setattr(evaluation, "cut_lineage", lambda df: written.append(df.schema.simpleString()) or df)
    suite = evaluation._caption_suite(spark, "")
    assert written == ["struct<prediction_id:int,parsed:struct<caption:string>,sample:struct<image_caption:string>>"]
    assert "Join" not in suite._jdf.queryExecution().executedPlan().toString()
    got = {r["metric"]: r["value"] for r in suite.collect()}
    expected = _brute_consensus([(i, *(t if t and t.strip() else "empty" for t in pair)) for i, pair in enumerate(said)]).values()
    assert got["caption_ciderd"] == pytest.approx(sum(s for s, _ in expected) / 4, abs=1e-6)
    assert got["caption_ngram_f1"] == pytest.approx(sum(f for _, f in expected) / 4, abs=1e-6)
    assert (got["caption_words_avg"], got["caption_words_min"], got["caption_words_max"]) == (2.25, 1.0, 4.0)
