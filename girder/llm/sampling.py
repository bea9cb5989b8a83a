"""p4: a sample whose categories have given shares, by divisor-method priorities.

Each category's rows get a random rank; the priority of a row is (rank - 0.5) / share. The n rows of
least priority over all categories are the Sainte-Lague apportionment of n seats, and a category that
runs out of rows leaves its seats to the next priorities by itself. Rows up to a category's minimum
come before all others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import buckets_for, group_rank, seeded_key, smallest
from ..session import cut_lineage


@dataclass(frozen=True)
class SamplePlan:
    """`cell`: the category columns; targets hold them, `share` (weights of any scale) and `min_rows`. `rows`: how many rows there are, if known."""

    id: str
    cell: tuple[str, ...]
    size: int
    seed: int = 42
    rows: int | None = None


def prioritised(rows: DataFrame, targets: DataFrame, plan: SamplePlan, total: int) -> DataFrame:
    """id, cell columns and `priority` of the rows that belong to a target cell.

    Rows of no target cell (null categories included) can't be drawn. Rows that share an id are ordered
    by it and get ranks of their own.
    """
    cell = list(plan.cell)
    usable = targets.where(F.col("share") > 0).select(*cell, F.col("share").cast("double").alias("share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"))
    keyed = rows.select(plan.id, *cell).join(usable, cell).withColumn("__key", seeded_key(plan.seed, F.col(plan.id)))
    ranked = group_rank(keyed, cell, "__key", [plan.id], "__rank", buckets_for(total))
    priority = (F.col("__rank") - 0.5) / F.col("share")
    first = -1.0 / (1.0 + priority)  # below 0, in the order of the priorities
    return ranked.select(plan.id, *cell, F.col("__key"), F.when(F.col("__rank") <= F.col("min_rows"), first).otherwise(priority).alias("priority"))


def proportional_sample(rows: DataFrame, targets: DataFrame, plan: SamplePlan) -> DataFrame:
    """The drawn rows: id and cell columns; at most `plan.size`, fewer only if the target cells hold fewer.

    Ties of priority fall to the smaller cell, then to the smaller random key. An empty input or no
    target gives no rows.
    """
    total = rows.count() if plan.rows is None else plan.rows
    ready = cut_lineage(prioritised(rows, targets, plan, total))
    return smallest(ready, "priority", [*plan.cell, "__key", plan.id], plan.size).select(plan.id, *plan.cell)


def sample_report(rows: DataFrame, targets: DataFrame, plan: SamplePlan) -> DataFrame:
    """Each target cell: share, min_rows, needed (the larger of minimum and whole share), available, taken, short.

    `short` is how many rows the cell lacks: needed - available where positive. `missed` is what the
    sample itself lacks.
    """
    cell = list(plan.cell)
    total = targets.agg(F.sum("share").alias("s")).first()["s"] or 1
    available = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("available"))
    taken = proportional_sample(rows, targets, plan).groupBy(*cell).agg(F.count(F.lit(1)).alias("taken"))
    needed = F.greatest(F.coalesce("min_rows", F.lit(0)), F.floor(F.lit(plan.size) * F.col("share") / F.lit(total))).cast("bigint")
    return (
        targets.join(available, cell, "left")
        .join(taken, cell, "left")
        .na.fill(0, ["available", "taken"])
        .withColumn("needed", needed)
        .withColumn("short", F.greatest(F.col("needed") - F.col("available"), F.lit(0)))
        .withColumn("missed", F.greatest(F.col("needed") - F.col("taken"), F.lit(0)))
    )
