"""Readers and writers of the engine's files: JSON lines, JSON documents, CSV, Parquet, YAML settings."""

from __future__ import annotations

import json
import os
import tempfile
import warnings
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
ANSWER_LOG = "image_id STRING, raw_output STRING, sample STRING, latency_seconds DOUBLE, error STRING"
TARGET_CACHE = "image_id STRING, target_json STRING"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line is an error when the rows are read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines as `line`); blank lines are neither. The lines are read and parsed by one expression each."""
    declared = T._parse_datatype_string(schema)
    with_bad = T.StructType([*declared.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", parsed.alias("__row"))
    good = lines.where(F.col(f"__row.{CORRUPT}").isNull()).select(*[F.col(f"__row.{f.name}").alias(f.name) for f in declared.fields])
    return good, lines.where(F.col(f"__row.{CORRUPT}").isNotNull()).select(F.col("value").alias("line"))


def read_json(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path as it knows it, so that cluster stores work as local folders do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob pattern matches, sorted; none if nothing does."""
    fs, at = _filesystem(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def read_documents(spark: SparkSession, paths: list[str]) -> dict[str, Any]:
    """Small JSON documents by path; unreadable ones are warned about and left out."""
    found = {}
    for path, text in spark.sparkContext.wholeTextFiles(",".join(paths)).collect() if paths else []:
        try:
            found[path] = json.loads(text)
        except ValueError as why:
            warnings.warn(f"skipped {path}: {why}", stacklevel=2)
    return found


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, metric, value) of `<run>/<file>.json` metric files; absent or unreadable ones are warned about and skipped."""
    from ..operators.compare import flattened

    rows = []
    for path, document in sorted(read_documents(spark, matching(spark, pattern)).items()):
        flat = flattened(document) if isinstance(document, dict) else {}
        rows += [(path.rsplit("/", 2)[-2], k, float(v)) for k, v in flat.items() if isinstance(v, int | float) and not isinstance(v, bool)]
    if not rows:
        warnings.warn(f"no metric file matches {pattern}", stacklevel=2)
    return spark.createDataFrame(rows, "run STRING, metric STRING, value DOUBLE")


EVALUATED = "image_id STRING, raw_output STRING, latency_seconds DOUBLE, parsed_output STRING, ground_truth STRING"


def read_evaluated(spark: SparkSession, paths: dict[str, str], schema: str = EVALUATED) -> DataFrame:
    """Evaluated predictions of several models, each a JSON array or JSON lines in a file of its own: model and the columns of `schema`."""
    out = None
    for model, path in paths.items():
        lines = not spark.read.text(path).where(F.trim("value") != "").limit(1).where(F.ltrim("value").startswith("[")).count()
        one = spark.read.schema(schema).option("multiLine", str(not lines)).option("mode", "FAILFAST").json(path).select(F.lit(model).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no model")
    return out


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Saved samples, all splits or one; a path that doesn't exist is an error."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_samples(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet, one folder per value of the partition columns, replaced as a whole by Spark's commit protocol."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_atomically(value: Any, path: str) -> None:
    """A small JSON document of the driver (manifest, report): written beside and then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(temporary, path)


def merge_metrics(path: str, new: dict) -> dict:
    """Add metrics to an existing file, sections one level deep; new values win."""
    old = read_json(path) if os.path.exists(path) else {}
    merged = merge_settings(old, new)
    write_json_atomically(merged, path)
    return merged


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_target_cache(targets: DataFrame, path: str) -> None:
    """image_id and target_json as JSON lines; a missing id becomes unknown_ and the row's number among those without one."""
    named = targets.where(F.col("image_id").isNotNull()).select("image_id", "target_json")
    nameless = targets.where(F.col("image_id").isNull())
    if nameless.isEmpty():
        write_jsonl(named, path)
        return
    numbered = nameless.select("target_json").rdd.zipWithIndex().map(lambda x: (f"unknown_{x[1]}", x[0][0]))  # counts per partition, no sort
    write_jsonl(named.unionByName(targets.sparkSession.createDataFrame(numbered, "image_id STRING, target_json STRING")), path)


def read_target_cache(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """image_id and target_json of a cache; another number of rows than expected is an error."""
    cache = read_jsonl(spark, path, TARGET_CACHE)
    if expected_rows is not None and (found := cache.count()) != expected_rows:
        raise ValueError(f"{path} has {found} targets, not {expected_rows}")
    return cache


def write_task_shards(shards: DataFrame, path: str) -> None:
    """JSON lines of conversations.task_shards, one folder per task and split, in one job."""
    shards.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("task", "split").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a CSV folder with a header: in the column order that is already there, unknown columns dropped."""
    if matching(df.sparkSession, f"{path}/*.csv"):
        have = df.sparkSession.read.option("header", True).csv(path).columns
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in have])
    df.write.mode("append").option("header", True).csv(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array of all rows as the twin of a JSON-lines folder; rows pass through the driver one partition at a time."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            f.write((",\n" if i else "\n") + row["j"])
        f.write("\n]\n")
    os.replace(temporary, path)


def rows_to_csv(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Overwrite a CSV folder with rows of the driver; nothing for no rows, and a key that the first row lacks is an error."""
    if not rows:
        return
    columns = list(rows[0])
    extra = {k for r in rows for k in r} - set(columns)
    if extra:
        raise ValueError(f"keys that the first row lacks: {sorted(extra)}")
    text = lambda v: None if v is None else str(v)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    write_csv(spark.createDataFrame([tuple(text(r.get(c)) for c in columns) for r in rows], schema), path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV folder; nothing is written for no rows."""
    if not df.isEmpty():
        df.write.mode("overwrite").option("header", True).csv(path)


def merge_settings(*parts: dict) -> dict:
    """Later settings win; mappings are merged one level deep."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_settings(*paths: str) -> dict:
    """YAML files merged in order (base, registry, training, task)."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML settings needs the package yaml") from missing
    return merge_settings(*[yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {} for p in paths])


def markdown(rows: list[dict], title: str) -> str:
    """A short report of examples (a handful of rows already on the driver)."""
    out = [f"# {title}", ""]
    for r in rows:
        out += [f"## {r.get('kind', '')} {r.get('id', '')}".rstrip(), "", *[f"- {k}: {v}" for k, v in r.items() if k not in ("kind", "id")], ""]
    return "\n".join(out)
