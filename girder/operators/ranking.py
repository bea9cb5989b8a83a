"""Exact ranks and running values without putting a group into one task.

Rows are cut into buckets along the order: a bucket is a function of the row alone, so the values of the
buckets (aggregated map-side) and the rows agree without any materialisation, and only one bucket of one
group is ever sorted in a task, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000
#: Bits of a seeded key; 15 hexadecimal digits.
KEY_BITS = 60
SLICES = 1_024


def buckets_for(rows: int) -> int:
    """Buckets so that one holds about ROWS_PER_BUCKET rows of the largest possible group."""
    return max(1, -(-rows // ROWS_PER_BUCKET))


def seeded_key(seed: int, *columns: Column) -> Column:
    """A pseudo-random BIGINT of KEY_BITS bits of the row's identity; the same in every engine that has MD5. Nulls are left out."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])), 1, KEY_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def uniform(key: Column) -> Column:
    """A seeded_key as a DOUBLE from 0 to below 1."""
    return key / F.lit(float(2**KEY_BITS))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a seeded_key: order-preserving, of equal expected size."""
    return F.floor(uniform(key) * F.lit(float(buckets))).cast("bigint")


def running(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: str, out: str, how: str = "sum") -> DataFrame:
    """Add `out`: the sum or maximum ('max') of `value` over the rows of the same group up to and with this one, in `order`.

    `bucket` must not fall along the order, which must be total within a group, else equal rows get values
    in any order. Nulls in `value` count as 0 (as nothing in a maximum), nulls in `group` form a group. An
    empty input stays empty.
    """
    b, whole, before = "__bucket", "__whole", "__before"
    taken = F.coalesce(F.col(value), F.lit(0)) if how == "sum" else F.col(value)
    combine = F.sum if how == "sum" else F.max
    rows = df.withColumn(b, bucket)
    wholes = rows.groupBy(*group, b).agg(combine(taken).alias(whole))
    earlier = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    renamed = {c: f"__g{i}" for i, c in enumerate([*group, b])}
    offsets = wholes.select(*[F.col(c).alias(n) for c, n in renamed.items()], combine(whole).over(earlier).alias(before))
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in renamed.items()]
    within = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn(out, combine(taken).over(within)).join(offsets, on, "left")
    total = F.col(out) + F.coalesce(before, F.lit(0)) if how == "sum" else F.greatest(out, before)
    return joined.withColumn(out, total).drop(b, before, *renamed.values())


def running_total(df: DataFrame, group: list[str], key: str, ties: list[str], weight: str, out: str, buckets: int) -> DataFrame:
    """Add `out`: the running sum of `weight` within the group by (seeded key, ties)."""
    return running(df, group, bucket_of(F.col(key), buckets), [F.col(key), *map(F.col, ties)], weight, out)


def group_rank(df: DataFrame, group: list[str], key: str, ties: list[str], out: str, buckets: int) -> DataFrame:
    """Add `out`: row_number within the group by (key, ties), starting at 1."""
    return running_total(df.withColumn("__one", F.lit(1)), group, key, ties, "__one", out, buckets).drop("__one")


def smallest(df: DataFrame, priority: str, ties: list[str], n: int, slice_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """The `n` rows of least `priority` (a DOUBLE, not null), ties broken by `ties`.

    Histograms of the priorities, each within the slice of the one before that holds the n-th row, narrow
    the range down to `slice_rows` rows or to one value, however the priorities are spread. Rows below
    the range are kept as they are; only its own rows are ranked.
    """
    if n <= 0:
        return df.limit(0)
    p = F.col(priority)
    low, high, count = df.agg(F.min(p), F.max(p), F.count(p)).first()
    if count <= n:
        return df
    left = n
    while count > slice_rows and high > low:
        width = (high - low) / SLICES
        number = F.least(F.floor((p - F.lit(low)) / F.lit(width)), F.lit(SLICES - 1))
        slices = df.where(p.between(low, high)).groupBy(number.alias("s")).agg(F.min(p).alias("low"), F.max(p).alias("high"), F.count(p).alias("n")).collect()
        for s in sorted(slices, key=lambda r: r["s"]):
            low, high, count = s["low"], s["high"], s["n"]
            if left <= count:
                break
            left -= count
    return df.where(p < low).unionByName(df.where(p.between(low, high)).orderBy(priority, *ties).limit(left))
