"""Column profiles of loads: value counts, exact quantiles and distances between loads.

Values are unpivoted and counted per (column, value, load) before anything moves, so the size of the
sort is the number of distinct values and not of rows. Numbers and times are ordered as such, everything
else as text in binary order. The counts are range-sorted by (column, value) and written once; running counts within a partition plus the totals of the partitions before it are
the exact cumulative curves. Laid over each other, the curves of a load and of its baseline give the
Kolmogorov-Smirnov distance (largest gap) and the total variation (half the summed steps of the gap).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import is_blank
from ..session import cut_lineage

QUANTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class ProfileSpec:
    """What is profiled: columns of any type, the load a row came with, and optional patterns by column."""

    columns: tuple[str, ...]
    load: str
    patterns: dict[str, str] = field(default_factory=dict)
    partitions: int | None = None


def rank_key(column: Column, kind: T.DataType) -> Column:
    """The number by which values of a type are ordered, null for types that are ordered as text."""
    if isinstance(kind, T.NumericType | T.BooleanType):
        return column.cast("double")
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def unpivoted(df: DataFrame, spec: ProfileSpec, *keep: str) -> DataFrame:
    """One row per row and profiled column: keep…, load_key, column_name, value (text) and rank_key (number, for types that have an order of their own).

    Arrays, maps and structs are compared as JSON text.
    """

    def text(c: str, kind: T.DataType) -> Column:
        return F.to_json(F.col(c)) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else F.col(c).cast("string")

    kinds = {c: df.schema[c].dataType for c in spec.columns}
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), text(c, k).alias("value"), rank_key(F.col(c), k).alias("rank_key")) for c, k in kinds.items()])
    return df.select(*keep, F.col(spec.load).alias("load_key"), F.inline(each))


def judged(values: DataFrame, domains: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add `issue`: 'missing', 'invalid' (not exactly an allowed value) or null.

    `domains` is (column_name, allowed_value), one row per allowed value. A column without any allowed
    value has no domain, so nothing in it is invalid. The values are joined with the domains by column and
    value, so neither side has to be small.
    """
    allowed = domains.where(F.col("allowed_value").isNotNull() & F.col("column_name").isin(*columns)).select("column_name", F.col("allowed_value").alias("value")).distinct()
    limited = [r["column_name"] for r in allowed.select("column_name").distinct().collect()]  # at most the profiled columns
    known = allowed.withColumn("__allowed", F.lit(True))
    off = F.col("column_name").isin(*limited) & F.col("__allowed").isNull() if limited else F.lit(False)
    return (
        values.join(known, ["column_name", "value"], "left")
        .withColumn("issue", F.when(is_blank(F.col("value")), "missing").when(off, "invalid"))
        .drop("__allowed")
    )


def value_counts(df: DataFrame, domains: DataFrame, spec: ProfileSpec) -> DataFrame:
    """(column_name, load_key, value, rank_key, issue, n)."""
    counts = unpivoted(df, spec).groupBy("column_name", "load_key", "value", "rank_key").agg(F.count(F.lit(1)).alias("n"))
    return judged(counts, domains, spec.columns)


def merged_curves(counts: DataFrame, lineage: DataFrame, spec: ProfileSpec) -> DataFrame:
    """The cumulative curves of each load and its baseline over the usable values.

    Columns: column_name, load_key, value, rank_key, n, base_n, cum_n, cum_base_n. `lineage` is (load_key,
    baseline_key). Usable are values without an issue. A load without a baseline has base_n 0.
    """
    usable = counts.where(F.col("issue").isNull() & F.col("load_key").isNotNull())
    own = usable.select("column_name", "load_key", "value", "rank_key", "n", F.lit(0).cast("bigint").alias("base_n"))
    links = lineage.where("baseline_key is not null").select(F.col("load_key").alias("child"), "baseline_key").distinct()
    base = usable.join(links, usable["load_key"] == links["baseline_key"]).select(
        "column_name", F.col("child").alias("load_key"), "value", "rank_key", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("base_n")
    )
    both = own.unionByName(base).groupBy("column_name", "load_key", "value", "rank_key").agg(F.sum("n").alias("n"), F.sum("base_n").alias("base_n"))
    parts = spec.partitions or int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(
        both.repartitionByRange(parts, "column_name", "rank_key", "value", "load_key").withColumn("part", F.spark_partition_id())
    )
    curve = ["column_name", "load_key"]
    totals = ordered.groupBy(*curve, "part").agg(F.sum("n").alias("t_n"), F.sum("base_n").alias("t_base_n"))
    before = Window.partitionBy(*curve).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *curve, "part",
        F.coalesce(F.sum("t_n").over(before), F.lit(0)).alias("o_n"),
        F.coalesce(F.sum("t_base_n").over(before), F.lit(0)).alias("o_base_n"),
    )
    within = Window.partitionBy(*curve, "part").orderBy("rank_key", "value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ordered.withColumn("cum_n", F.sum("n").over(within))
        .withColumn("cum_base_n", F.sum("base_n").over(within))
        .join(prefix, [*curve, "part"])
        .select(*curve, "value", "rank_key", "n", "base_n", (F.col("cum_n") + F.col("o_n")).alias("cum_n"), (F.col("cum_base_n") + F.col("o_base_n")).alias("cum_base_n"))
    )


def distances(curves: DataFrame) -> DataFrame:
    """(column_name, load_key, valid_rows, base_valid_rows, distinct_values, value_min, value_max, q…, ks, tv).

    ks is the largest gap between the two curves, tv half the sum of the steps of the gap from one value
    to the next. Both are null where the load or its baseline has no usable value.
    """
    curve = ["column_name", "load_key"]
    sizes = curves.groupBy(*curve).agg(F.max("cum_n").alias("valid_rows"), F.max("cum_base_n").alias("base_valid_rows"))
    rows, base = F.col("valid_rows"), F.col("base_valid_rows")
    comparable = (rows > 0) & (base > 0)
    after = F.col("cum_n") / rows - F.col("cum_base_n") / base
    before = (F.col("cum_n") - F.col("n")) / rows - (F.col("cum_base_n") - F.col("base_n")) / base
    place = F.struct("rank_key", "value")
    seen = F.col("n") > 0
    at = lambda p: F.when(p, place)
    quantile = lambda q: F.min(at(seen & (F.col("cum_n") >= F.lit(q) * rows)))["value"]
    return curves.join(sizes, curve).groupBy(*curve, "valid_rows", "base_valid_rows").agg(
        F.count_if(seen).alias("distinct_values"), F.min(at(seen))["value"].alias("value_min"), F.max(at(seen))["value"].alias("value_max"),
        *[quantile(q).alias(f"q{round(q * 100):02d}") for q in QUANTILES],
        F.max(F.when(comparable, F.abs(after))).alias("ks"), (F.sum(F.when(comparable, F.abs(after - before))) / 2).alias("tv"),
    )


def profile(df: DataFrame, domains: DataFrame, lineage: DataFrame, spec: ProfileSpec) -> DataFrame:
    """One row per column and load with counts, rates, quantiles and distances to the baseline load.

    Rows whose load is null are counted under a null load_key without distances. An empty input gives
    no rows. Values are sorted by the order of their type: numbers, times and booleans by value, all
    others as text in binary order.
    """
    counts = value_counts(df, domains, spec)
    pattern: Column = F.lit(False)
    for c, p in spec.patterns.items():
        pattern = pattern | ((F.col("column_name") == c) & ~F.col("value").rlike(p))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    totals = counts.groupBy("column_name", "load_key").agg(
        F.sum("n").alias("row_count"),
        n(F.col("value").isNull())("null_rows"), n(F.col("issue") == "missing")("missing_rows"),
        n(F.col("issue") == "invalid")("invalid_rows"), n(pattern & F.col("value").isNotNull())("pattern_rows"),
    )
    d = distances(merged_curves(counts, lineage, spec)).withColumnsRenamed({"column_name": "d_column", "load_key": "d_load"})
    return (
        totals.join(d, (F.col("column_name") == F.col("d_column")) & F.col("load_key").eqNullSafe(F.col("d_load")), "left")
        .drop("d_column", "d_load")
        .withColumn("missing_rate", F.col("missing_rows") / F.col("row_count"))
        .na.fill(0, ["valid_rows", "base_valid_rows", "distinct_values"])
    )


def findings(df: DataFrame, key: str, domains: DataFrame, lineage: DataFrame, spec: ProfileSpec, missing_over: float, shift_over: float) -> DataFrame:
    """Row and load findings in long form: scope, key_id, column_name, issue."""
    rows = judged(unpivoted(df, spec, key), domains, spec.columns).where("issue is not null")
    loads = profile(df, domains, lineage, spec).where("load_key is not null")
    found = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("missing_rate") > missing_over, F.lit("missing_rate")),
                F.when(F.col("tv") > shift_over, F.lit("shift")),
            )
        )
    )
    return rows.select(F.lit("row").alias("scope"), F.col(key).cast("bigint").alias("key_id"), "column_name", "issue").unionByName(
        loads.select(F.lit("load").alias("scope"), F.col("load_key").cast("bigint").alias("key_id"), "column_name", found.alias("issue"))
    )
