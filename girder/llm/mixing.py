"""p9: a mix of sources by target weights in tokens, by Sainte-Lague apportionment of equal-token blocks.

The documents of a source, in seeded order, form a line of tokens; a source may be walked through
`max_repeats` times. The line is cut into blocks of equal size, and the blocks are dealt to shards in
turn. In each shard, seats go to the sources by highest quotients, which gives integer quotas; a
document is used if the block in which it starts is within the quota of its source and shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import buckets_for, running_total, seeded_key
from ..session import cut_lineage


@dataclass(frozen=True)
class MixPlan:
    """total_tokens: size of the mix; None takes the largest one that meets all weights without running out."""

    block_tokens: int = 1024
    total_tokens: int | None = None
    seats_per_shard: int = 50_000
    seed: int = 42


def capacities(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target source: weight, max_repeats, available (tokens of one pass), capacity (of all allowed passes)."""
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    return targets.join(have, "source", "left").na.fill(0, ["available", "documents"]).withColumn("capacity", F.col("available") * F.col("max_repeats"))


def mixture(sizes: DataFrame, targets: DataFrame, plan: MixPlan) -> tuple[DataFrame, DataFrame]:
    """(used documents, report) of `sizes` (doc_id, source, tokens) and `targets` (source, weight, max_repeats).

    Used: doc_id, source, tokens, use_no (1 to max_repeats), shard, block. Documents of no target source
    (null included) and without tokens are never used. Sources without documents, with a weight of 0 or
    less or max_repeats below 1 get no seats; their share goes to the others and shows in the report.
    Report: source, weight, documents, available, capacity, quota (blocks), uses, tokens, share, met (share
    within one block or one longest document of the weight), total_tokens (the size of the mix that was
    asked for or found) and limits_total (whether this source's capacity is what that size is due to).
    """
    usable = cut_lineage(sizes.where("source is not null and tokens > 0").select("doc_id", "source", "tokens"))
    ready = cut_lineage(capacities(usable, targets.select("source", F.col("weight").cast("double").alias("weight"), "max_repeats")))
    live = ready.where("weight > 0 and capacity > 0")
    bounds = live.agg(F.sum("weight").alias("w"), F.min(F.col("capacity") / F.col("weight")).alias("least"), F.sum("documents").alias("docs")).first()
    weight_sum, documents = bounds["w"] or 1.0, bounds["docs"] or 0
    total = plan.total_tokens if plan.total_tokens is not None else math.floor((bounds["least"] or 0) * weight_sum)
    seats = total // plan.block_tokens
    shards = max(1, -(-seats // plan.seats_per_shard))
    wanted = -(-seats // shards)

    per_shard = F.ceil(F.ceil(F.col("capacity") / plan.block_tokens) / F.lit(shards))
    most = F.least(per_shard, F.lit(wanted)).cast("bigint")  # no source can win more seats than there are
    quotients = live.select("source", "weight", F.explode(F.sequence(F.lit(1).cast("bigint"), most)).alias("seat"))
    quotients = quotients.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    priority = (F.col("seat") - 0.5) / F.col("weight")
    by_priority = Window.partitionBy("shard").orderBy(priority, "source", "seat")
    quotas = (
        quotients.withColumn("place", F.row_number().over(by_priority))
        .where((F.col("place") <= F.lit(wanted)) & ((F.col("place") - 1) * shards + F.col("shard") < F.lit(seats)))
        .groupBy("shard", "source").agg(F.count(F.lit(1)).alias("quota"))
    )
    quotas = cut_lineage(quotas)

    keyed = usable.join(live.select("source", "max_repeats", "available"), "source")
    copies = keyed.withColumn("use_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("max_repeats").cast("bigint"))))
    copies = copies.withColumn("__key", seeded_key(plan.seed, F.col("use_no"), F.col("doc_id")))
    lined = running_total(copies, ["source", "use_no"], "__key", ["doc_id", "tokens"], "tokens", "__upto", buckets_for(documents))
    start = (F.col("use_no") - 1) * F.col("available") + F.col("__upto") - F.col("tokens")
    placed = lined.withColumn("block", F.floor(start / F.lit(plan.block_tokens))).withColumn("shard", F.col("block") % F.lit(shards))
    used = (
        placed.join(quotas, ["source", "shard"])
        .where(F.floor(F.col("block") / F.lit(shards)) < F.col("quota"))
        .select("doc_id", "source", "tokens", "use_no", "shard", "block")
    )
    taken = used.groupBy("source").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    quota = quotas.groupBy("source").agg(F.sum("quota").alias("quota"))
    report = ready.join(quota, "source", "left").join(taken, "source", "left").na.fill(0, ["quota", "uses", "tokens", "longest"])
    all_tokens = F.sum("tokens").over(Window.partitionBy())
    share = F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0))
    scarcest = F.when((F.col("weight") > 0) & (F.col("capacity") > 0), F.col("capacity") / F.col("weight"))
    limiting = F.coalesce(scarcest == F.min(scarcest).over(Window.partitionBy()), F.lit(False)) & F.lit(plan.total_tokens is None)
    slack = F.greatest(F.lit(plan.block_tokens), F.col("longest")) / F.greatest(all_tokens, F.lit(1))
    return used, report.select(
        "source", "weight", "max_repeats", "documents", "available", "capacity", "quota", "uses", "tokens",
        share.alias("share"), (F.abs(share - F.col("weight")) <= slack).alias("met"), F.lit(total).cast("bigint").alias("total_tokens"), limiting.alias("limits_total"),
    )
