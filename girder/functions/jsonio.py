"""The strict reading of model answers: fences, whole JSON, and the declared shape of each task."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import CLASSES, RULES

TASKS = ("unified", "violations_only")
FENCE = r"(?is)```(?:json)?(.*?)```"
_FENCE = re.compile(FENCE)

VIOLATION = "STRUCT<bounding_box: ARRAY<ARRAY<DOUBLE>>, reason: STRING>"
PARSED = ", ".join(
    ["json_valid BOOLEAN", "schema_valid BOOLEAN", "error STRING", "caption STRING", *[f"{r} {VIOLATION}" for r in RULES], *[f"{c} ARRAY<ARRAY<DOUBLE>>" for c in CLASSES]]
)
_BOXES = pa.list_(pa.list_(pa.float64()))
_VIOLATION = pa.struct([("bounding_box", _BOXES), ("reason", pa.string())])
_ARROW = [pa.bool_(), pa.bool_(), pa.string(), pa.string(), *[_VIOLATION] * 4, *[_BOXES] * 3]


def strip_fences(text: Column) -> Column:
    """The content of the first closed fence, else the whole text, without white space at the ends."""
    inner = F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    return F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")


def strip_open_fences(text: Column) -> Column:
    """As strip_fences, but a fence that is never closed is taken off too."""
    opened = r"(?is)```(?:json)?(.*)$"
    return F.when(text.rlike(FENCE), strip_fences(text)).otherwise(
        F.regexp_replace(F.when(text.rlike(opened), F.regexp_extract(text, opened, 1)).otherwise(text), r"(?U)^\s+|\s+$", "")
    )


def unfenced(text: str) -> str:
    m = _FENCE.search(text)
    return (m[1] if m else text).strip()


def coordinate(x: Any) -> float | None:
    """What a lax number field takes: numbers, booleans and numeric texts."""
    if isinstance(x, bool | int | float):
        return float(x)
    if isinstance(x, str):
        try:
            return float(x)
        except ValueError:
            return None
    return None


def box_list(value: Any) -> list[list[float]] | None:
    """A list of lists of exactly four coordinates, or None if it is anything else."""
    if not isinstance(value, list):
        return None
    out = []
    for box in value:
        if not isinstance(box, list) or len(box) != 4:
            return None
        numbers = [coordinate(c) for c in box]
        if None in numbers:
            return None
        out.append(numbers)
    return out


def violation(value: Any) -> dict | None:
    """A mapping with an optional box list and an optional text as reason; None if it isn't one."""
    if not isinstance(value, dict):
        return None
    boxes, reason = value.get("bounding_box"), value.get("reason")
    boxes = [] if boxes is None else box_list(boxes)
    if boxes is None or not (reason is None or isinstance(reason, str)):
        return None
    return {"bounding_box": boxes, "reason": reason or ""}


def first_error(value: Any, task: str) -> str | None:
    """Why an object isn't of the task's shape: the first failing field, '' for its kind; None if it is.

    Unified needs a caption that is a text; class lists may be missing but not null; rules may be missing
    or null. violations_only looks at the rules alone. Unknown keys are ignored.
    """
    if not isinstance(value, dict):
        return "object_type"
    if task == "unified":
        if "caption" not in value:
            return "caption_missing"
        if not isinstance(value["caption"], str):
            return "caption_type"
    for key in RULES:
        if value.get(key) is not None and violation(value[key]) is None:
            return f"{key}_shape"
    if task == "unified":
        for key in CLASSES:
            if key in value and box_list(value[key]) is None:
                return f"{key}_shape"
    return None


def parsed(text: str | None, task: str) -> tuple:
    """The values of PARSED. A violation that is an empty mapping counts as none, as null does."""
    failed = (None,) * 8
    try:
        value = json.loads(unfenced(text or ""))
    except (ValueError, RecursionError):
        return (False, False, "json_parse_error", *failed)
    if value is None:
        return (False, False, "json_parse_error", *failed)
    if (error := first_error(value, task)) is not None:
        return (True, False, f"schema_validation_error:{error}", *failed)
    rules = [violation(value[r]) if value.get(r) else None for r in RULES]
    classes = [box_list(value.get(c, [])) if task == "unified" else [] for c in CLASSES]
    return (True, True, None, value.get("caption") if task == "unified" else None, *rules, *classes)


def strictly_parsed(answers: DataFrame, text: str, task: str) -> DataFrame:
    """All columns of `answers` and a struct `parsed` with PARSED; one row out per row in, nothing shuffled.

    Null and empty texts are json_parse_error. `answers` must not have a column named parsed.
    """
    names = [f.name for f in T._parse_datatype_string(PARSED).fields]
    at_text, at_task = answers.columns.index(text), answers.columns.index(task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(x, t or "") for x, t in zip(batch.column(at_text).to_pylist(), batch.column(at_task).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], names)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, "parsed"])

    schema = T.StructType([*answers.schema.fields, T.StructField("parsed", T._parse_datatype_string(PARSED))])
    return answers.mapInArrow(run, schema)


def failure_category(text: Column, long: int = 3500) -> Column:
    """Of an answer that isn't JSON: 'truncated' (unclosed brackets, or longer than `long`) or 'other'."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.when((count("{") > count("}")) | (count("[") > count("]")) | (F.length(text) > long), "truncated").otherwise("other")


def short_reason(error: Column) -> Column:
    """The part before the first colon, or the whole."""
    return F.coalesce(F.element_at(F.split(error, ":"), 1), error)


def caption_or_empty(caption: Column) -> Column:
    """'empty' in place of a missing or blank caption."""
    return F.when(F.coalesce(F.trim(caption), F.lit("")) == "", "empty").otherwise(caption)
