"""Session creation and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "girder") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("GIRDER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` to the folder all executors share.

    The cluster names the folder in spark.checkpoint.dir. Only where that is unset (tests, single
    machine) a folder of this machine is used, which local mode shares by definition. Set
    spark.cleaner.referenceTracking.cleanCheckpoints there too, so that Spark removes the files of
    checkpoints nobody refers to any more; the folder of a local run is removed when Python ends.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or _own_folder())
    return df.checkpoint(eager=True)


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="girder-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
