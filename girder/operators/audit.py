"""Audit and statistics of annotations and of plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.predicates import has_boxes, is_violated
from ..tables import CLASSES, METADATA, RULES
from .ranking import ROWS_PER_BUCKET, running

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def exploded_boxes(samples: DataFrame, *keep: str) -> DataFrame:
    """One row per box: keep…, class (an object class or a rule), box_no, box.

    A violation without boxes gives one row with a null box; an object class without boxes gives none.
    """
    objects = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("boxes"), F.lit(False).alias("rule")) for c in CLASSES])
    rules = F.array(*[F.struct(F.lit(r).alias("class"), F.when(F.col(r).isNotNull(), F.coalesce(F.col(f"{r}.bounding_box"), boxes.none())).alias("boxes"), F.lit(True).alias("rule")) for r in RULES])
    flat = samples.select(*keep, F.explode(F.concat(objects, rules)).alias("f")).where("f.boxes is not null and (f.rule or size(f.boxes) > 0)")
    return flat.select(*keep, "f.class", F.posexplode_outer("f.boxes").alias("box_no", "box"))


def audit_boxes(samples: DataFrame, *keep: str) -> DataFrame:
    """Each box with its area and issues ('' for none, 'missing_box' where a violation has no box)."""
    rows = exploded_boxes(samples, *keep)
    box = F.col("box")
    issues = F.when(box.isNull(), "missing_box").otherwise(boxes.audit_issues(box))
    side = lambda i: F.get(box, F.lit(i))
    return rows.withColumn("area", (side(2) - side(0)) * (side(3) - side(1))).withColumn("issues", issues)


def repeated_boxes(samples: DataFrame, id: str, more_than: int = 3) -> DataFrame:
    """(id, class, box, n): a box that occurs more than `more_than` times in one field."""
    flat = exploded_boxes(samples, id).where("box is not null")
    return flat.groupBy(id, "class", F.array_join(F.transform("box", lambda c: F.format_string("%.6f", c)), ",").alias("box")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def value_table(samples: DataFrame, columns: tuple[str, ...] = METADATA) -> DataFrame:
    """(category, value, n) of each metadata value, nulls included."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in columns])
    return samples.select(F.explode(pairs).alias("p")).groupBy("p.category", "p.value").agg(F.count(F.lit(1)).alias("n"))


def flags() -> dict[str, Column]:
    """0/1 of each rule being violated and each class being present."""
    return {r: is_violated(F.col(r)).cast("int") for r in RULES} | {c: has_boxes(F.col(c)).cast("int") for c in CLASSES}


def prevalence(samples: DataFrame, *by: str) -> DataFrame:
    """(by…, name, positives, pct) per rule and class."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("flag")) for k, v in flags().items()])
    return samples.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.name").agg(F.sum("p.flag").alias("positives"), (F.avg("p.flag") * 100).alias("pct"))


def cooccurrence(samples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The matrix of joint counts, one row per name and one column per name, the diagonal being the counts.

    One pass with a sum for each pair of the fixed names; nothing but one row is shuffled.
    """
    own = flags()
    sums = [F.coalesce(F.sum(own[a] * own[b]), F.lit(0)).alias(f"{a}|{b}") for a in names for b in names]
    one = samples.agg(*sums)
    rows = F.array(*[F.struct(F.lit(a).alias("name"), *[F.col(f"`{a}|{b}`").alias(b) for b in names]) for a in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    """count, min, max, mean, population standard deviation and exact, interpolated percentiles of non-null values.

    All percentiles come from one sketch-free pass over the counts of the distinct values of each group.
    """
    x = F.col(column)
    shares = F.array(*[F.lit(p / 100) for p in PERCENTILES])
    out = df.groupBy(*by).agg(
        F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.percentile(x, shares).alias("__p"),
    )
    return out.select(*by, "count", "min", "max", "mean", "std", *[F.get("__p", F.lit(i)).alias(f"p{p:02d}") for i, p in enumerate(PERCENTILES)])


def extreme_sizes(df: DataFrame, column: str, id: str, *by: str) -> DataFrame:
    """by…, min_id, max_id: the first row by id with the smallest and with the largest value (null for no value)."""
    x = F.col(column)
    kept = df.where(x.isNotNull())
    return kept.groupBy(*by).agg(F.min_by(id, F.struct(x, F.col(id))).alias("min_id"), F.min_by(id, F.struct(-x, F.col(id))).alias("max_id"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) over `bins` equal bins between the extremes, the last one closed; bins without rows don't occur."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")
    return df.where(x.isNotNull()).join(F.broadcast(ends)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def buckets(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bucket, n, pct, low, high) of half-open buckets [edge, next edge), open at the outer ends; nulls are left out."""
    x = F.col(column)
    at = F.lit(0)
    for e in edges:
        at = at + (x >= e).cast("int")
    return df.where(x.isNotNull()).groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).withColumn(
        "pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    )


def below_thresholds(df: DataFrame, column: str, thresholds: list[int]) -> DataFrame:
    """(threshold, n, pct): rows under each threshold, in one pass."""
    x = F.col(column)
    one = df.agg(F.count(x).alias("all"), *[F.count_if(x < t).alias(f"t{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"t{t}").alias("n")) for t in thresholds])
    return one.select("all", F.explode(rows).alias("r")).select("r.threshold", "r.n", F.when(F.col("all") > 0, 100.0 * F.col("r.n") / F.col("all")).otherwise(0.0).alias("pct"))


def over_cap(samples: DataFrame, cap: int) -> DataFrame:
    """(name, images, over, pct): of the images with a class or violated rule, those with more than `cap` pixels."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("flag")) for k, v in flags().items()])
    flat = samples.select("resolution", F.explode(pairs).alias("p")).where("p.flag = 1")
    return flat.groupBy("p.name").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("resolution") > cap).alias("over"), (100.0 * F.count_if(F.col("resolution") > cap) / F.count(F.lit(1))).alias("pct"))


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """rows, distinct keys and surplus rows; null keys count as rows only."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_keys")).withColumn("surplus", F.col("rows") - F.col("distinct_keys"))


def islands(df: DataFrame, key: str, order: str, flag: Column, bucket_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Runs of consecutive flagged rows within each key: (key, first, last, length), by position in `order` (a number, not null).

    A run is a flagged row's number of unflagged rows before it. The running count works on buckets of
    `order`, so a key that holds most rows isn't sorted in one task.
    """
    rows = df.select(key, order, F.coalesce(flag, F.lit(False)).alias("__f")).withColumn("__gap", (~F.col("__f")).cast("bigint"))
    low, high, count = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    width = max((high - low + 1) / max(1, -(-count // bucket_rows)), 1) if count else 1
    bucket = F.floor((F.col(order) - F.lit(low)) / F.lit(float(width))).cast("bigint")
    placed = running(rows, [key], bucket, [F.col(order)], "__gap", "__run")
    return placed.where("__f").groupBy(key, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def expected_counts(found: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Observed against expected counts: key…, n, expected, status (MATCH or MISMATCH); a missing group counts 0."""
    both = found.join(expected, key, "full").na.fill(0, ["n"])
    return both.withColumn("status", F.when(F.col("n").eqNullSafe(F.col("expected")), "MATCH").otherwise("MISMATCH"))


def report(row: DataFrame) -> DataFrame:
    """(check_name, passed, detail) from one row of counts: a check passes if its count is 0."""
    each = F.array(*[F.struct(F.lit(c).alias("check_name"), (F.col(c) == 0).alias("passed"), F.col(c).cast("string").alias("detail")) for c in row.columns])
    return row.select(F.inline(each))


def checks(samples: DataFrame, id: str) -> DataFrame:
    """The validation report: (check_name, passed, detail), one row per check."""
    issue = audit_boxes(samples, id).where("issues <> ''").agg(F.count(F.lit(1)).alias("bad_boxes"))
    row = samples.agg((F.count(F.lit(1)) - F.countDistinct(id)).alias("repeated_ids"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (*METADATA, "image_caption")])
    return report(issue).unionByName(report(row))


def named_checks(samples: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """The report of named checks in one pass: each fails on the rows for which its condition holds."""
    return report(samples.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in faults.items()]))


def fix_checks() -> dict[str, Column]:
    """What the corrections of annotations must have removed, as conditions of a faulty sample."""
    every = F.concat(*[boxes.normalized(F.col(c)) for c in CLASSES], *[boxes.normalized(F.col(f"{r}.bounding_box")) for r in RULES])
    hollow = lambda r: F.col(r).isNotNull() & ~is_violated(F.col(r))
    return {
        "null_class_lists": F.greatest(*[F.col(c).isNull() for c in CLASSES]),
        "hollow_violations": F.greatest(*[hollow(r) for r in RULES]),
        "boxes_of_wrong_length": F.exists(every, lambda b: F.size(b) != 4),
        "boxes_out_of_range": F.exists(every, lambda b: F.exists(b, lambda c: (c < -boxes.TOLERANCE) | (c > 1 + boxes.TOLERANCE))),
        "boxes_turned_around": F.exists(every, lambda b: (F.get(b, F.lit(0)) >= F.get(b, F.lit(2))) | (F.get(b, F.lit(1)) >= F.get(b, F.lit(3)))),
        "repeated_boxes": F.greatest(*[F.size(F.array_distinct(boxes.normalized(F.col(c)))) < F.size(boxes.normalized(F.col(c))) for c in CLASSES]),
        "missing_metadata": F.greatest(*[F.col(c).isNull() for c in METADATA]),
    }
