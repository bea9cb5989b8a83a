"""Strata, splits, oversampling, orders and deduplication of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import has_boxes
from ..session import cut_lineage
from .ranking import ROWS_PER_BUCKET, buckets_for, group_rank, running, seeded_key, uniform

# The strata, rarest first, and copies of rare samples.
STRATA = ("rule_4", "rule_2", "rule_3", "rule_1", "white_hard_hat", "rebar", "excavator", "other")
COPIES_RARE, COPIES_SCARCE = 4, 2


def stratum() -> Column:
    """0 to 7: the first of rules 4, 2, 3, 1 (not null), hard hat, rebar, excavator (with boxes) that holds, else 7."""
    tests = [F.col(f"rule_{i}_violation").isNotNull() for i in (4, 2, 3, 1)] + [has_boxes(F.col(c)) for c in ("worker_with_white_hard_hat", "rebar", "excavator")]
    out = F.when(tests[0], 0)
    for i, t in enumerate(tests[1:], 1):
        out = out.when(t, i)
    return out.otherwise(7)


def label(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STRATA)), number + 1)


def stratified_split(samples: DataFrame, id: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """id, stratum, part: of each stratum the nearest whole number to `share` of its rows is 'val', the rest 'train'.

    The choice is by a hash of the id, the same on any cluster; rows that share an id are kept apart by
    their order. Strata may hold any part of the rows: ranks are found bucket by bucket.
    """
    rows = samples.select(id, stratum().alias("stratum")).withColumn("__key", seeded_key(seed, F.col(id)))
    ranked = group_rank(rows, ["stratum"], "__key", [id], "__rank", buckets_for(samples.count()))
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("__n"))
    return ranked.join(sizes, "stratum").select(id, "stratum", F.when(F.col("__rank") <= F.rint(F.col("__n") * share), "val").otherwise("train").alias("part"))


def distribution(df: DataFrame, by: str, number: str) -> DataFrame:
    """(by, stratum, label, n, pct) for all eight strata of each group, 0 where a stratum is absent; pct has two places."""
    counts = df.groupBy(by, number).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(by).distinct().withColumn(number, F.explode(F.array(*[F.lit(i) for i in range(len(STRATA))])))
    full = grid.join(counts, [by, number], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(by))
    return full.select(by, number, label(F.col(number)).alias("label"), "n", F.round(100.0 * F.col("n") / total, 2).alias("pct"))


def copies() -> Column:
    """4 for samples with rule 2 or 4, 2 for rule 3, else 1."""
    rare = F.col("rule_2_violation").isNotNull() | F.col("rule_4_violation").isNotNull()
    return F.when(rare, COPIES_RARE).when(F.col("rule_3_violation").isNotNull(), COPIES_SCARCE).otherwise(1)


def oversampled(samples: DataFrame) -> DataFrame:
    """Each row as often as `copies` says, with copy_no from 1; nothing is shuffled."""
    return samples.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies())))


def oversampling_manifest(samples: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    c = copies()
    of = lambda k: F.count_if(c == k)
    added = F.coalesce(F.sum(c), F.lit(0)) - n
    return samples.agg(
        n.alias("original"), of(COPIES_RARE).alias("rare"), of(COPIES_SCARCE).alias("scarce"), of(1).alias("common"),
        (of(COPIES_RARE) * COPIES_RARE).alias("rare_copies"), (of(COPIES_SCARCE) * COPIES_SCARCE).alias("scarce_copies"), F.coalesce(F.sum(c), F.lit(0)).alias("total"), added.alias("added"),
    )


def is_rare() -> Column:
    return F.col("rule_2_violation").isNotNull() | F.col("rule_3_violation").isNotNull() | F.col("rule_4_violation").isNotNull()


def bucket_order(samples: DataFrame, id: str, size: int, seed: int, epoch: int, drop_last: bool = False) -> DataFrame:
    """id, bucket, place: rows sorted by resolution in buckets of `size`; `place` orders the shuffled buckets.

    The rank by resolution is found with counts per resolution, so only rows of equal resolution are
    sorted together. A remainder forms a bucket of its own unless `drop_last`.
    """
    counts = samples.groupBy("resolution").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy(F.asc_nulls_first("resolution")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before)  # one row per resolution, not per image
    total = samples.count()
    keyed = samples.select(id, "resolution").withColumn("__key", seeded_key(0, F.col(id)))
    ranked = group_rank(keyed, ["resolution"], "__key", [id], "__rank", buckets_for(total)).join(starts.withColumnRenamed("resolution", "__r"), F.col("resolution").eqNullSafe(F.col("__r")))
    bucket = F.floor((F.col("__before") + F.col("__rank") - 1) / size).cast("bigint")
    placed = ranked.select(id, "resolution", (F.col("__before") + F.col("__rank") - 1).alias("place"), bucket.alias("bucket"))
    if drop_last:
        placed = placed.where(F.col("bucket") < total // size)
    return placed.withColumn("bucket_key", seeded_key(seed + epoch, F.col("bucket")))


def rare_class_order(samples: DataFrame, id: str, seed: int = 42) -> DataFrame:
    """id, rare, place: an order in which the rare rows are evenly spread, places from 0.

    The rare rows, in seeded order, get jittered slots at even steps; a slot that is taken moves the row on
    to the next free one, past the end to the first free one; the common rows fill the rest in seeded
    order. As the slots of the k-th rows don't fall, the k-th row lies at k plus the running maximum of
    slot - k, and the c-th free slot at c plus the number of rare rows with at most c free slots before
    them. Both are running values over buckets, so the order is that of the whole table at any size.
    """
    rows = samples.select(id, is_rare().alias("rare")).withColumn("__key", seeded_key(seed, F.col(id)))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("rare").alias("m")).first()
    n, m = sizes["n"], sizes["m"]
    ranked = group_rank(rows, ["rare"], "__key", [id], "__k", buckets_for(n)).withColumn("__k", F.col("__k") - 1)
    ranked = cut_lineage(ranked.withColumn("__row", F.monotonically_increasing_id()))
    step = n / max(m, 1)
    slot = F.least(F.floor(F.col("__k") * F.lit(step) + uniform(seeded_key(seed + 1, F.col(id))) * F.lit(step)), F.lit(n - 1))
    by_rank = F.floor(F.col("__k") / ROWS_PER_BUCKET)
    spread = running(ranked.where("rare").withColumn("__gap", slot - F.col("__k")), [], by_rank, [F.col("__k")], "__gap", "__free", "max")
    spread = cut_lineage(spread.withColumn("__at", F.col("__k") + F.col("__free")))  # __free: free slots before it
    fixed = spread.where(F.col("__at") < n)
    wrapped = m - fixed.count()
    filling = spread.where(F.col("__at") >= n).select("__row", (F.col("__k") - (m - wrapped)).alias("c")).unionByName(ranked.where("not rare").select("__row", (F.col("__k") + wrapped).alias("c")))
    rare_before = fixed.groupBy(F.col("__free").alias("c")).agg(F.count(F.lit(1)).alias("w")).select(F.lit(None).cast("bigint").alias("__row"), "c", "w")
    merged = filling.withColumn("w", F.lit(0).cast("bigint")).unionByName(rare_before)
    filled = running(merged, [], F.floor(F.col("c") / ROWS_PER_BUCKET), [F.col("c"), F.col("__row").isNotNull()], "w", "__rare").where("__row is not null")
    places = fixed.select("__row", F.col("__at").alias("place")).unionByName(filled.select("__row", (F.col("c") + F.col("__rare")).alias("place")))
    return ranked.join(places, "__row").select(id, "rare", F.col("place").cast("bigint").alias("place"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Aggregated as a minimum of structs, so a hot key costs no sort and no single task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def first_n_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key (a bounded report); Spark keeps only n rows a key before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def pending(inputs: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Inputs without a non-empty answer in the log: what an interrupted run has still to do."""
    done = log.where("trim(coalesce(raw_output, '')) <> ''").select(key).distinct()
    return inputs.join(done, key, "left_anti")


def first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an explicit order (a cap that the caller asks for)."""
    return df.orderBy(*order).limit(n)


def seeded_first_n(df: DataFrame, id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn by a hash of the id: the same ones for the same seed, on any cluster."""
    return first_n(df, [seeded_key(seed, F.col(id)), F.col(id)], n)


def paired(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Inner join of predictions and references by key, in place of matching by position.

    Raises if either side is empty, repeats a key, or holds a key that the other side lacks.
    """
    sides = {"predictions": predictions, "references": references}
    sizes = {name: df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("k")).first() for name, df in sides.items()}
    for name, size in sizes.items():
        if not size["n"]:
            raise ValueError(f"no {name}")
        if size["n"] != size["k"]:
            raise ValueError(f"{name} repeat or lack keys: {size['n']} rows, {size['k']} keys")
    joined = predictions.join(references, key)
    if not sizes["predictions"]["n"] == sizes["references"]["n"] == joined.count():
        raise ValueError("predictions and references don't have the same keys")
    return joined


def missing_keys(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Distinct expected keys that weren't found; null keys are never expected."""
    return expected.where(F.col(key).isNotNull()).select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def pixels(width: Column, height: Column) -> Column:
    """The resolution of an image; null where a side is null."""
    return (width * height).cast("bigint")


def aspect_drift(width: Column, height: Column, new_width: Column, new_height: Column) -> Column:
    """Change of the aspect ratio by a resize in percent; null where a side is 0 or null."""
    before = F.when(height > 0, width / height)
    after = F.when(new_height > 0, new_width / new_height)
    return F.when(before > 0, F.abs(after - before) / before * 100)
