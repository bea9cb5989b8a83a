"""Box geometry against hand-computed values and plain-Python versions."""

import random

import pytest
from pyspark.sql import functions as F

from girder.functions import boxes


def one(spark, expression, **columns):
    schema = ", ".join(f"{k} ARRAY<ARRAY<DOUBLE>>" if k != "box" else "box ARRAY<DOUBLE>" for k in columns)
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "iou", "uni"), [([0.0, 0.0, 1.0, 1.0], [0.5, 0.5, 1.5, 1.5], 0.25 / 1.75, 1.75), ([0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0], 0.0, 2.0), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], 0.0, 0.0)]
)
def test_iou(spark, a, b, iou, uni):
    x = one(spark, boxes.iou(F.col("p")[0], F.col("t")[0]), p=[a], t=[b])
    assert x["iou"] == pytest.approx(iou) and x["uni"] == pytest.approx(uni)


def test_clean_rejects_bad_boxes(spark):
    bad = [[1.0, 1.0, 0.0, 0.0], [0.0] * 4, [0.0, 0.0, 1.0], [float("nan"), 0.0, 1.0, 1.0], [0.0, 0.0, None, 1.0], [0.0, 0.0, 1.2, 1.0], None, []]
    assert one(spark, boxes.clean(F.col("p")), p=[*bad, [0.1, 0.1, 0.5, 0.5]]) == [[0.1, 0.1, 0.5, 0.5]]
    assert one(spark, boxes.clean(F.col("p")), p=None) == []


def test_scaling(spark):
    assert one(spark, boxes.from_thousand(F.col("p")), p=[[1500.0, -500.0, 2000.0, 100.0]]) == [[1.0, 0.0, 1.0, 0.1]]
    assert one(spark, boxes.to_thousand(F.col("p")), p=[[0.0025, 0.0035, 0.5, 1.0]]) == [[2, 4, 500, 1000]]


def test_greedy_worked_case(spark):
    x = one(spark, boxes.greedy_iou(F.col("p"), F.col("t")), p=[[0.0, 0.0, 0.5, 0.5], [0.5, 0.5, 1.0, 1.0]], t=[[0.0, 0.0, 0.5, 0.5], [0.6, 0.6, 1.0, 1.0]])
    assert (round(x["iou"], 6), round(x["inter"], 6), round(x["uni"], 6)) == (0.82, 0.41, 0.5)
    assert tuple(one(spark, boxes.greedy_iou(F.col("p"), F.col("t")), p=[], t=[])) == (0, 0, 0)
    assert tuple(one(spark, boxes.greedy_iou(F.col("p"), F.col("t")), p=[], t=[[0.0, 0.0, 0.5, 0.5]])) == (0, 0, 0.25)


def plain_greedy(pred, truth):
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    over = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    left, ious, inter, uni = list(pred), 0.0, 0.0, 0.0
    for t in truth:
        if not left:
            uni += area(t)
            continue
        scores = [over(p, t) / (area(p) + area(t) - over(p, t)) for p in left]
        k = scores.index(max(scores))
        p = left.pop(k)
        ious, inter, uni = ious + scores[k], inter + over(p, t), uni + area(p) + area(t) - over(p, t)
    return (ious / len(truth) if truth else 0.0, inter, uni + sum(map(area, left)))


def test_greedy_and_mask_equal_brute_force(spark):
    r = random.Random(3)

    def box():
        x, y = r.randrange(8), r.randrange(8)
        return [x / 10, y / 10, (x + r.randint(1, 10 - x)) / 10, (y + r.randint(1, 10 - y)) / 10]

    rows = [(i, [box() for _ in range(r.randrange(5))], [box() for _ in range(r.randrange(5))]) for i in range(120)]
    df = spark.createDataFrame(rows, "i INT, p ARRAY<ARRAY<DOUBLE>>, t ARRAY<ARRAY<DOUBLE>>")
    got = df.select("i", boxes.greedy_iou(F.col("p"), F.col("t")).alias("g"), boxes.mask_iou(F.col("p"), F.col("t")).alias("m")).collect()
    cells = lambda bs: {(x, y) for b in bs for x in range(round(b[0] * 10), round(b[2] * 10)) for y in range(round(b[1] * 10), round(b[3] * 10))}
    for row in got:
        _, p, t = rows[row["i"]]
        assert tuple(row["g"]) == pytest.approx(plain_greedy(p, t))
        a, b = cells(p), cells(t)
        assert row["m"]["inter"] == pytest.approx(len(a & b) / 100, abs=1e-9) and row["m"]["uni"] == pytest.approx(len(a | b) / 100)
        assert (row["m"]["iou"] is None) == (not p and not t)


def test_audit_and_repeats(spark):
    issues = lambda b: one(spark, boxes.audit_issues(F.col("box")), box=b)
    assert issues([0.1, 0.1, 0.5, 0.5]) == ""
    assert issues([0.5, 0.1, 0.5, 1.5]) == "out_of_range;x_order;near_zero_area"
    assert issues([0.1, 0.2, 0.3]) == "wrong_length"
    assert one(spark, boxes.most_repeats(F.col("p")), p=[[1.0] * 4] * 4 + [[2.0] * 4]) == 4
    assert one(spark, boxes.most_repeats(F.col("p")), p=[]) == 0
