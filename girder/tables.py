"""Loading of the Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULES = ("rule_1_violation", "rule_2_violation", "rule_3_violation", "rule_4_violation")
CLASSES = ("excavator", "rebar", "worker_with_white_hard_hat")
METADATA = ("illumination", "camera_distance", "view", "quality_of_info")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
