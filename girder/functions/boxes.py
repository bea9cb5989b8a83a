"""Box geometry as column expressions. A box is ARRAY<DOUBLE> [xmin, ymin, xmax, ymax].

Everything here is built from higher-order functions, so it stays in the JVM and fuses with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SIDE, TOLERANCE = 1e-4, 1e-6
BOXES = "array<array<double>>"


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once; an expression used twice is otherwise computed twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none() -> Column:
    return F.array().cast(BOXES)


def normalized(boxes: Column) -> Column:
    """Null counts as no boxes; null entries are dropped."""
    return F.coalesce(F.filter(boxes, lambda b: b.isNotNull()), none())


def from_json_text(text: Column) -> Column:
    """Boxes of untyped JSON: a list of boxes, one flat box, and boxes as mappings (bounding_box, or all four corners).

    Null, an empty list, anything that isn't a list, and entries of no such form give no boxes. Boxes keep
    their numbers as they are, of whatever count.
    """
    entries = F.from_json(text, "array<string>")
    corners = "bounding_box array<double>, xmin double, ymin double, xmax double, ymax double"

    def box(entry: Column) -> Column:
        named = F.from_json(entry, corners)
        four = F.array(*[named[c] for c in ("xmin", "ymin", "xmax", "ymax")])
        whole = F.when(F.forall(four, lambda c: c.isNotNull()), four)
        return F.when(entry.startswith("["), F.from_json(entry, "array<double>")).when(entry.startswith("{"), F.coalesce(named["bounding_box"], whole))

    def read(e: Column) -> Column:
        first = F.get(e, F.lit(0))
        flat = F.array(F.transform(e, lambda x: x.try_cast("double")))
        return F.when(first.try_cast("double").isNotNull(), flat).otherwise(F.filter(F.transform(e, box), lambda b: b.isNotNull()))

    return F.when(F.coalesce(F.ltrim(text).startswith("["), F.lit(False)), F.coalesce(let(entries, read), none())).otherwise(none())


def is_valid(box: Column, min_side: float = MIN_SIDE) -> Column:
    """Four numbers within [0, 1] (up to TOLERANCE) with both sides over `min_side`; NaN and null never are."""
    inside = F.forall(box, lambda c: c.isNotNull() & ~F.isnan(c) & (c >= -TOLERANCE) & (c <= 1 + TOLERANCE))
    return F.coalesce((F.size(box) == 4) & inside & (F.get(box, 2) - F.get(box, 0) > min_side) & (F.get(box, 3) - F.get(box, 1) > min_side), F.lit(False))


def clean(boxes: Column) -> Column:
    return F.filter(normalized(boxes), lambda b: is_valid(b))  # a second parameter would be given the position


def to_thousand(boxes: Column) -> Column:
    """From [0, 1] to whole numbers of [0, 1000], halves to even."""
    return F.transform(normalized(boxes), lambda b: F.transform(b, lambda c: F.rint(c * 1000.0).cast("int")))


def from_thousand(boxes: Column) -> Column:
    """From [0, 1000] to [0, 1], clipped; NaN becomes 0."""
    return F.transform(normalized(boxes), lambda b: F.transform(b, lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(c, F.lit(0.0)) / 1000.0))))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def _overlap(a: Column, b: Column) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Column, b: Column) -> Column:
    """STRUCT<iou, inter, uni> of two boxes; zeros if one is null or the union has no area."""
    zero = F.lit(0.0)

    def shares(x: Column) -> Column:
        union = x["areas"] - x["inter"]
        ok = F.coalesce(union > 0, F.lit(False))
        return F.struct(F.when(ok, x["inter"] / union).otherwise(zero).alias("iou"), F.when(ok, x["inter"]).otherwise(zero).alias("inter"), F.when(ok, union).otherwise(zero).alias("uni"))

    return let(F.struct(_overlap(a, b).alias("inter"), (area(a) + area(b)).alias("areas")), shares)


def total_area(boxes: Column) -> Column:
    return F.aggregate(boxes, F.lit(0.0), lambda t, b: t + area(b))


def greedy_iou(pred: Column, truth: Column) -> Column:
    """See _greedy; the inputs are computed once."""
    return let(F.struct(pred.alias("p"), truth.alias("t")), lambda s: _greedy(s["p"], s["t"]))


def _greedy(pred: Column, truth: Column) -> Column:
    """STRUCT<iou, inter, uni>: each true box in turn takes the remaining prediction of highest IoU.

    The first one wins ties, and a match without overlap still uses its prediction up. The union holds the
    area of unmatched true boxes and of predictions left over; iou is the mean over the true boxes, 0
    where there are none.
    """
    zero = F.lit(0.0)
    start = F.struct(pred.alias("left"), zero.alias("ious"), zero.alias("inter"), zero.alias("uni"))

    def step(state: Column, t: Column) -> Column:
        left = state["left"]

        def take(best: Column) -> Column:
            # the largest (iou, -position) is the first of equals; null if nothing is left
            some = best.isNotNull()
            at = -best["neg"]
            return F.struct(
                F.when(some, F.filter(left, lambda p, i: i != at)).otherwise(left).alias("left"),
                (state["ious"] + F.when(some, best["iou"]).otherwise(zero)).alias("ious"),
                (state["inter"] + F.when(some, best["inter"]).otherwise(zero)).alias("inter"),
                (state["uni"] + F.when(some, best["uni"]).otherwise(area(t))).alias("uni"),
            )

        def rated(p: Column, i: Column) -> Column:
            return let(iou(p, t), lambda x: F.struct(x["iou"].alias("iou"), (-i).alias("neg"), x["inter"].alias("inter"), x["uni"].alias("uni")))

        return let(F.array_max(F.transform(left, rated)), take)

    def finish(state: Column) -> Column:
        n = F.size(truth)
        return F.struct(
            F.when(n > 0, state["ious"] / n).otherwise(zero).alias("iou"), state["inter"].alias("inter"), (state["uni"] + total_area(state["left"])).alias("uni")
        )

    return F.aggregate(truth, start, step, finish)


def union_area(boxes: Column) -> Column:
    """Area covered by at least one box: slabs between neighbouring x edges, intervals merged along y in each."""

    def slabs(s: Column) -> Column:
        edges, by_y = s["edges"], s["by_y"]

        def slab(total: Column, i: Column) -> Column:
            x0, x1 = F.get(edges, i), F.get(edges, i + 1)
            merged = F.aggregate(
                by_y,
                F.struct(F.lit(float("-inf")).alias("upto"), F.lit(0.0).alias("length")),
                lambda m, b: F.when(
                    (b["x0"] <= x0) & (b["x1"] >= x1),
                    F.struct(F.greatest(m["upto"], b["y1"]).alias("upto"), (m["length"] + F.greatest(F.lit(0.0), b["y1"] - F.greatest(m["upto"], b["y0"]))).alias("length")),
                ).otherwise(m),
            )
            return total + (x1 - x0) * merged["length"]

        return F.aggregate(F.sequence(F.lit(0), F.size(edges) - 2), F.lit(0.0), slab)

    def sorted_parts(d: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(d, lambda b: F.array(b[0], b[2])))))
        # sorted by ymin, the struct's first field
        by_y = F.array_sort(F.transform(d, lambda b: F.struct(b[1].alias("y0"), b[3].alias("y1"), b[0].alias("x0"), b[2].alias("x1"))))
        return let(F.struct(edges.alias("edges"), by_y.alias("by_y")), slabs)

    alone = F.when(F.size(boxes) == 0, F.lit(0.0)).when(F.size(boxes) == 1, area(F.get(boxes, F.lit(0))))
    return alone.otherwise(let(F.array_distinct(boxes), sorted_parts))


def mask_iou(pred: Column, truth: Column) -> Column:
    """STRUCT<iou, inter, uni> of the covered regions; iou is null if both are empty, 0 if one is."""

    def shares(x: Column) -> Column:
        inter = F.greatest(F.lit(0.0), x["p"] + x["t"] - x["both"])
        value = F.when(x["empty"], F.lit(None).cast("double")).when(x["both"] > 0, inter / x["both"]).otherwise(F.lit(0.0))
        return F.struct(value.alias("iou"), inter.alias("inter"), x["both"].alias("uni"))

    def areas(s: Column) -> Column:
        p, t = s["p"], s["t"]
        empty = (F.size(p) == 0) & (F.size(t) == 0)
        return let(F.struct(empty.alias("empty"), union_area(p).alias("p"), union_area(t).alias("t"), union_area(F.concat(p, t)).alias("both")), shares)

    return let(F.struct(pred.alias("p"), truth.alias("t")), areas)


def audit_issues(box: Column, tolerance: float = TOLERANCE, least_area: float = 1e-5) -> Column:
    """The defects of an annotated box joined by ';', '' if it has none; missing corners only make it too short."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    tests = [
        ("wrong_length", F.size(box) != 4), ("out_of_range", F.exists(box, lambda c: (c < -tolerance) | (c > 1 + tolerance))), ("x_order", x0 >= x1),
        ("y_order", y0 >= y1), ("near_zero_area", F.abs((x1 - x0) * (y1 - y0)) < least_area),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, test in tests])), ";")


def most_repeats(boxes: Column) -> Column:
    """How often the most frequent box occurs; 0 without boxes."""
    tally = lambda s: F.array_max(F.transform(F.array_distinct(s), lambda b: F.size(F.filter(s, lambda x: x == b))))
    return F.coalesce(let(boxes, tally), F.lit(0))
