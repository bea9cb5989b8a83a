"""The sets of files that a repair and a scoring run leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.repair import with_repair
from ..session import cut_lineage
from .files import write_json_array, write_json_atomically, write_jsonl


def event_summary(repaired: DataFrame, id: str, kind: str) -> DataFrame:
    """(type, total_occurrences, records_affected) of changes or warnings."""
    each = repaired.select(id, F.explode(f"repair.{kind}").alias("e")).groupBy(id, "e.type").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("type").agg(F.sum("k").alias("total_occurrences"), F.count(F.lit(1)).alias("records_affected"))


def write_repair(answers: DataFrame, id: str, text: str, task: str, folder: str) -> dict:
    """Repaired log (JSON lines and a JSON array), change manifest, still broken rows (JSON lines) and the report; the answers are repaired once."""
    done = cut_lineage(with_repair(answers, text, task))
    fixed = F.col("repair.status") == "fixed_valid"
    log = (
        done.select(*[c for c in answers.columns if c != text], F.when(fixed, F.col("repair.fixed")).otherwise(F.col(text)).alias(text), F.when(fixed, F.col(text)).alias("original_raw_output"), F.col("repair.status").alias("repair_status"))
    )
    write_jsonl(log, f"{folder}/repaired")
    write_json_array(log, f"{folder}/repaired.json")
    write_jsonl(done.where("size(repair.changes) > 0 or size(repair.warnings) > 0").select(id, "repair.status", "repair.changes", "repair.warnings"), f"{folder}/changes")
    broken = done.where("repair.status in ('invalid_json', 'invalid_schema')")
    write_jsonl(broken.select(id, "repair.status", "repair.error", F.col(text).alias("raw_output"), F.col("repair.fixed").alias("parsed"), F.col("repair.changes").alias("changes_attempted"), "repair.warnings"), f"{folder}/broken")
    counts = {r["status"]: r["count"] for r in done.groupBy("repair.status").count().collect()}
    total = sum(counts.values())
    summary = lambda kind: {r["type"]: {"total_occurrences": r["total_occurrences"], "records_affected": r["records_affected"]} for r in event_summary(done, id, kind).collect()}
    report = {
        "total_records": total, "status_counts": counts, "status_percentages": {k: round(100 * v / total, 2) for k, v in counts.items()},
        "change_type_summary": summary("changes"), "warning_type_summary": summary("warnings"),
    }
    write_json_atomically(report, f"{folder}/repair_report.json")
    return report


def write_scoring(rows: DataFrame, id: str, metrics: dict, folder: str) -> None:
    """Metrics, failures by gate, parsed answers and the combined log of scored rows."""
    write_json_atomically(metrics, f"{folder}/metrics.json")
    kind = F.split("parsed.error", ":")[0]
    for gate in ("json_parse_error", "schema_validation_error"):
        write_jsonl(rows.where(kind == gate).select(id, kind.alias("error_type"), F.col("raw_output").alias("raw_prediction")), f"{folder}/{gate}s")
    write_jsonl(rows.where("parsed.schema_valid").select(id, "parsed"), f"{folder}/parsed")
    write_jsonl(rows.select(id, "raw_output", "parsed", F.col("sample").alias("ground_truth")), f"{folder}/combined")
