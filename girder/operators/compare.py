"""Comparison of runs over long metric tables (run, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change(base: Column, new: Column) -> tuple[Column, Column]:
    """Absolute and percent change; from 0 it is 100 % if the new value is positive, else 0."""
    pct = F.when(base != 0, (new - base) / F.abs(base) * 100).when(new > 0, 100.0).otherwise(0.0)
    return new - base, pct


def against(metrics: DataFrame, run: str, base: str) -> DataFrame:
    """(run, metric, base_value, value, delta, delta_pct) of every other run against the base; missing values count 0."""
    b = metrics.where(F.col(run) == base).select("metric", F.col("value").alias("base_value"))
    others = metrics.where(F.col(run) != base)
    grid = others.select(run).distinct().join(F.broadcast(metrics.select("metric").distinct()), F.lit(True))  # runs by metric names
    full = grid.join(others, [run, "metric"], "left").join(b, "metric", "left").na.fill(0.0, ["value", "base_value"])
    delta, pct = change(F.col("base_value"), F.col("value"))
    return full.select(run, "metric", "base_value", "value", delta.alias("delta"), pct.alias("delta_pct"))


def wide(metrics: DataFrame, run: str, names: list[str], as_percent: bool = False) -> DataFrame:
    """One row per run, one column per metric, 0 where it is missing."""
    scale = 100.0 if as_percent else 1.0
    return metrics.groupBy(run).pivot("metric", names).agg(F.first("value") * scale).na.fill(0.0)


def heat_map(metrics: DataFrame, run: str, runs: list[str], names: list[str]) -> DataFrame:
    """One row per metric in the order of `names`, one column per run; 0 where it is missing."""
    wanted = metrics.where(F.col("metric").isin(*names)).groupBy("metric").pivot(run, runs).agg(F.first("value")).na.fill(0.0)
    return wanted.orderBy(F.array_position(F.array(*map(F.lit, names)), F.col("metric")))


def chart(metrics: DataFrame, run: str, charts: dict[str, list[str]]) -> DataFrame:
    """(chart, run, metric, value): what each chart shows. A metric that a run lacks is 0; one that all runs lack is left out."""
    chosen = F.array(*[F.struct(F.lit(c).alias("chart"), F.lit(m).alias("metric")) for c, names in charts.items() for m in names])
    shown = metrics.select(F.explode(chosen).alias("c")).select("c.*").distinct().join(metrics.select("metric").distinct(), "metric", "left_semi")
    grid = shown.join(metrics.select(run).distinct(), F.lit(True))  # runs by names of metrics
    return grid.join(metrics.select(run, "metric", "value"), [run, "metric"], "left").select("chart", run, "metric", F.coalesce("value", F.lit(0.0)).alias("value"))


def paper_tables(metrics: DataFrame, strata: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The main table (one row, one column per metric) and the table of strata (field, stratum and the metrics)."""
    main = metrics.groupBy().pivot("metric", names).agg(F.first("value"))
    return main, strata.groupBy("field", "stratum").pivot("metric", names).agg(F.first("value"))


def merged_answers(scores: DataFrame, id: str, run: str, runs: list[str]) -> DataFrame:
    """One row per id with the score of each run, null where a run has none."""
    return scores.groupBy(id).pivot(run, runs).agg(F.max("score"))


def outstanding(merged: DataFrame, id: str, base: str, final: str, k: int = 5) -> DataFrame:
    """The k largest gains (final over 0.6, base under 0.3) and the k worst failures (final under 0.1), missing scores as 0."""
    rows = merged.select(id, F.coalesce(base, F.lit(0.0)).alias("base"), F.coalesce(final, F.lit(0.0)).alias("final"))
    gains = rows.where("final > 0.6 and base < 0.3").orderBy(F.desc(F.col("final") - F.col("base")), id).limit(k)
    losses = rows.where("final < 0.1").orderBy("final", id).limit(k)
    return gains.withColumn("kind", F.lit("triumph")).unionByName(losses.withColumn("kind", F.lit("failure")))


def flattened(value: dict, prefix: str = "") -> dict:
    """A nested mapping as path -> value, path parts joined by '/'."""
    out: dict = {}
    for k, v in value.items():
        path = f"{prefix}/{k}" if prefix else str(k)
        out |= flattened(v, path) if isinstance(v, dict) else {path: v}
    return out
