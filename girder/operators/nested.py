"""Flattening of nested records into related tables by interval labels.

A depth-first walk numbers every node of a document: `pre` when it is entered, `post` when it is left.
A node lies inside another one exactly if its interval lies inside the other's, so the node tables of
all types need only (document key, pre, post) to be linked, and a link is found in one pass over the
nodes in `pre` order, whatever the depth.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import is_blank
from ..tables import CLASSES, METADATA

# Keys of a sample and the notations of a box's corners.
SAMPLE_KEYS = frozenset({"image_id", "image_caption", "violations", *METADATA, *CLASSES})
BOX_KEYS = ("bounding_box", "bounding_boxes", "bbox", "boxes")
CORNERS = ("xmin", "ymin", "xmax", "ymax")
RULE_KEY = re.compile(r"^\s*rule[_\s-]*([1-4])(?:[_\s-]*violations?)?\s*$", re.I)
RULE_VALUE = re.compile(r"^\s*(?:rule)?[_\s-]*([1-4])(?:[_\s-]*violations?)?\s*$", re.I)

NODE = "pre INT, post INT, kind STRING, rule_no INT, ordinal BIGINT, name STRING, text STRING, corners ARRAY<DOUBLE>, attributes MAP<STRING, STRING>"
_NODE_ARROW = pa.struct(
    [
        ("pre", pa.int32()), ("post", pa.int32()), ("kind", pa.string()), ("rule_no", pa.int32()), ("ordinal", pa.int64()),
        ("name", pa.string()), ("text", pa.string()), ("corners", pa.list_(pa.float64())), ("attributes", pa.map_(pa.string(), pa.string())),
    ]
)


def held(value: Any) -> Any:
    """What a value holds: a string that is itself serialised JSON counts as its content.

    One nested deeper than the JSON reader goes (some 10 000 levels) stays a string.
    """
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            break
    return value


def number(value: Any) -> float | None:
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        return None
    try:
        x = float(value)
    except (ValueError, OverflowError):
        return None
    return x if math.isfinite(x) else None


def boxes(value: Any) -> Iterator[list[float]]:
    """The readable boxes: exactly four numbers as a list, a text or a mapping of corners, at any depth."""
    stack = [value]
    while stack:
        v = held(stack.pop())
        if isinstance(v, str):
            v = [x for x in re.split(r"[\s,;]+", v.strip(" \t\n()[]")) if x]
            if len(v) == 4 and None not in (corners := [number(x) for x in v]):
                yield corners
        elif isinstance(v, dict):
            if set(CORNERS) <= v.keys():
                corners = [number(v[c]) for c in CORNERS]
                if None not in corners:
                    yield corners
            else:
                stack += [v[k] for k in reversed(BOX_KEYS) if k in v]
        elif isinstance(v, list):
            corners = [number(x) for x in v]
            if v and None not in corners:
                if len(v) == 4:
                    yield corners
            else:
                stack += reversed(v)


def reason_text(value: Any) -> str | None:
    """The text of a reason: plain, a list of texts, or a mapping with `text`; null if nothing but white space."""
    texts, stack = [], [value]
    while stack:
        v = held(stack.pop())
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            stack += [v["text"]] if "text" in v else reversed(v.values())
        elif isinstance(v, int | float) and not isinstance(v, bool):
            texts.append(str(v))
        elif isinstance(v, str) and v.strip():
            texts.append(v)
    return " ".join(texts) or None


def is_sample(value: Any) -> bool:
    return isinstance(value, dict) and any(k in SAMPLE_KEYS or RULE_KEY.match(k) for k in value)


def entries_of(sample: dict) -> Iterator[tuple[int, int, Any]]:
    """(rule, place among the entries of that rule, entry) of a sample, entries of rule keys first."""
    places: dict[int, int] = {}

    def placed(rule: int, entry: Any) -> tuple[int, int, Any]:
        place = places.get(rule, 0)
        places[rule] = place + 1
        return rule, place, entry

    listed: Any = sample
    while isinstance(listed, dict):  # `violations` may be a mapping by rule, which may have `violations` again
        for key, value in listed.items():
            if (m := RULE_KEY.match(key)) and (value := held(value)) is not None:
                for entry in value if isinstance(value, list) else [value]:
                    yield placed(int(m[1]), held(entry))
        listed = held(listed.get("violations"))
    for entry in listed if isinstance(listed, list) else []:
        entry = held(entry)
        if isinstance(entry, dict) and (m := RULE_VALUE.match(str(entry.get("rule")))):
            yield placed(int(m[1]), entry)


def labelled_nodes(payload: str | None) -> list[dict]:
    """The typed nodes of one document with their interval labels, in `pre` order.

    Kinds: sample, violation, box (of the violation around it), object (a box of the class `name`).
    A payload that is null or not one whole JSON text has no nodes. Samples are found at any depth that
    the JSON reader takes (some 10 000 levels); a payload nested deeper has no nodes either.
    """
    try:
        root = json.loads(payload) if payload is not None else None
    except (ValueError, RecursionError):
        return []
    nodes: list[dict] = []
    clock = 0

    def enter(kind: str, ordinal: int, **more: Any) -> dict:
        nonlocal clock
        node = {"pre": clock, "kind": kind, "ordinal": ordinal} | more
        clock += 1
        nodes.append(node)
        return node

    def leave(node: dict) -> None:
        nonlocal clock
        node["post"] = clock
        clock += 1

    def walk_sample(sample: dict, place: int) -> None:
        texts = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k in ("image_id", "image_caption", *METADATA) if (v := sample.get(k)) is not None}
        node = enter("sample", place, attributes=list(texts.items()))
        for rule, at, entry in entries_of(sample):
            whole = entry if isinstance(entry, dict) else {"reason": entry if isinstance(entry, str) else None}
            violation = enter("violation", at, rule_no=rule, text=reason_text(whole.get("reason")))
            for i, corners in enumerate(boxes([whole[k] for k in BOX_KEYS if k in whole])):
                leave(enter("box", i, rule_no=rule, corners=corners))
            leave(violation)
        for name in CLASSES:
            for i, corners in enumerate(boxes(sample.get(name))):
                leave(enter("object", i, name=name, corners=corners))
        leave(node)

    waiting = [(root, 0)]  # a stack, so that samples are found at any depth
    while waiting:
        value, place = waiting.pop()
        value = held(value)
        if is_sample(value):
            walk_sample(value, place)
        elif isinstance(value, dict):
            waiting.extend((x, 0) for x in reversed(value.values()))
        elif isinstance(value, list):
            waiting.extend((x, i) for i, x in reversed(list(enumerate(value))))
    return nodes


def node_table(df: DataFrame, key: str, payload: str) -> DataFrame:
    """One row per typed node: the key, and pre, post, kind, rule_no, ordinal, name, text, corners, attributes.

    Documents are parsed where they lie; nothing is shuffled. Other columns of `df` are ignored, so
    their names can't clash. Keys may repeat or be null: a hidden row id keeps documents apart.
    """
    kept = df.select(F.monotonically_increasing_id().alias("doc_row"), F.col(key).alias("doc_key"), F.col(payload).cast("string").alias("payload"))
    schema = T.StructType([*kept.schema.fields[:2], T.StructField("nodes", T.ArrayType(T._parse_datatype_string(NODE)))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([labelled_nodes(p) for p in batch.column(2).to_pylist()], pa.list_(_NODE_ARROW))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes], ["doc_row", "doc_key", "nodes"])

    return kept.mapInArrow(parse, schema).select("doc_row", "doc_key", F.inline("nodes"))


def containing(kind: str) -> Column:
    """The node of that kind whose interval contains the current one's (null if there is none).

    Nodes of one kind don't nest here, so it is the last one entered before, if it isn't left yet.
    """
    order = Window.partitionBy("doc_row").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == kind, F.struct("pre", "post", "ordinal", "text", "rule_no")), ignorenulls=True).over(order)
    return F.when(last["post"] > F.col("post"), last)


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """The node table with the sample and the violation around each node and the node entered next."""
    ahead = Window.partitionBy("doc_row").orderBy("pre")
    return nodes.select(
        "*", containing("sample").alias("in_sample"), containing("violation").alias("in_violation"),
        F.lead(F.struct("kind", "post")).over(ahead).alias("next_node"),
    )


def flat_tables(df: DataFrame, key: str, payload: str) -> dict[str, DataFrame]:
    """Tables sample, violation, box and object; children carry the keys of their parents.

    A parent key is (doc_key, sample_pre) or (doc_key, violation_pre); doc_row tells apart documents
    that share a key.
    """
    linked = linked_nodes(node_table(df, key, payload))
    doc = ["doc_row", "doc_key"]
    of = lambda kind: linked.where(F.col("kind") == kind)
    corner = [F.col("corners")[i].alias(c) for i, c in enumerate(CORNERS)]
    sample_pre, violation_pre = F.col("in_sample.pre").alias("sample_pre"), F.col("in_violation.pre").alias("violation_pre")
    return {
        "sample": of("sample").select(*doc, F.col("pre").alias("sample_pre"), "post", F.col("ordinal").alias("sample_no"), *[F.col("attributes")[c].alias(c) for c in ("image_id", "image_caption", *METADATA)]),
        "violation": of("violation").select(*doc, sample_pre, F.col("pre").alias("violation_pre"), "post", "rule_no", F.col("ordinal").alias("violation_no"), F.col("text").alias("reason")),
        "box": of("box").select(*doc, sample_pre, violation_pre, "pre", "post", "rule_no", F.col("ordinal").alias("box_no"), *corner),
        "object": of("object").select(*doc, sample_pre, "pre", "post", F.col("name").alias("class"), F.col("ordinal").alias("box_no"), *corner),
    }


def violation_boxes(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(doc_key, sample_no, rule_no, violation_no, box_no): each readable box of a violation.

    A violation without one gives a row with box_no -1 if it has a reason, else none.
    """
    linked = linked_nodes(node_table(df, key, payload).select("doc_row", "doc_key", "pre", "post", "kind", "rule_no", "ordinal", "text"))
    is_box = F.col("kind") == "box"
    boxless = (F.col("kind") == "violation") & F.col("text").isNotNull() & ~F.coalesce((F.col("next_node.kind") == "box") & (F.col("next_node.post") < F.col("post")), F.lit(False))
    return linked.where(is_box | boxless).select(
        "doc_key",
        F.col("in_sample.ordinal").alias("sample_no"),
        F.col("rule_no").cast("bigint").alias("rule_no"),
        F.when(is_box, F.col("in_violation.ordinal")).otherwise(F.col("ordinal")).alias("violation_no"),
        F.when(is_box, F.col("ordinal")).otherwise(F.lit(-1)).cast("bigint").alias("box_no"),
    )


def struct_boxes(df: DataFrame, key: str, rules: tuple[str, ...]) -> DataFrame:
    """(key, rule_no, violation_no, box_no) of violations that are typed structs, by the rules of violation_boxes.

    A struct is the only violation of its rule; boxes without exactly four finite numbers are skipped.
    """
    readable = lambda v: F.filter(F.coalesce(v["bounding_box"], F.array().cast("array<array<double>>")), lambda b: F.coalesce((F.size(b) == 4) & F.forall(b, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))

    def entry(i: int, rule: str) -> Column:
        v = F.col(rule)
        numbers = F.transform(readable(v), lambda _, at: at.cast("bigint"))
        alone = F.when(~is_blank(v["reason"]), F.array(F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        return F.when(v.isNotNull(), F.struct(F.lit(i).cast("bigint").alias("rule_no"), F.when(F.size(numbers) > 0, numbers).otherwise(alone).alias("boxes")))

    each = F.array_compact(F.array(*[entry(i, r) for i, r in enumerate(rules, 1)]))
    return df.select(key, F.inline(each)).select(key, "rule_no", F.lit(0).cast("bigint").alias("violation_no"), F.explode("boxes").alias("box_no"))
