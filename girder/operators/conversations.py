"""Samples as training conversations, prompts and target JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.jsonio import TASKS
from ..tables import CLASSES, METADATA, RULES


def _violation(rule: str, fill_reason: bool) -> Column:
    reason = F.col(f"{rule}.reason")
    return F.when(
        F.col(rule).isNotNull(),
        F.struct(boxes.clean(F.col(f"{rule}.bounding_box")).alias("bounding_box"), (F.coalesce(reason, F.lit("")) if fill_reason else reason).alias("reason")),
    )


def ground_truth(task: str) -> Column:
    """The true answer as a struct: caption (unified), metadata, rules with cleaned boxes, classes (unified)."""
    if task not in TASKS:
        raise KeyError(f"unknown task: {task}")
    fields = [*METADATA] + [_violation(r, True).alias(r) for r in RULES]
    if task == "unified":
        fields = [F.col("image_caption").alias("caption"), *fields, *[boxes.clean(F.col(c)).alias(c) for c in CLASSES]]
    return F.struct(*fields)


def target_json(task: str) -> Column:
    """The answer to learn: compact JSON in a fence, keys in the order caption, rules, classes, nulls written."""
    if task not in TASKS:
        raise KeyError(f"unknown task: {task}")
    thousand = lambda r: F.when(F.col(r).isNotNull(), F.struct(boxes.to_thousand(boxes.clean(F.col(f"{r}.bounding_box"))).alias("bounding_box"), F.coalesce(F.col(f"{r}.reason"), F.lit("")).alias("reason")))
    fields = [thousand(r).alias(r) for r in RULES]
    if task == "unified":
        fields = [F.col("image_caption").alias("caption"), *fields, *[boxes.to_thousand(boxes.clean(F.col(c))).alias(c) for c in CLASSES]]
    return F.concat(F.lit("```json\n"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.lit("\n```"))


def _text(kind: Column, text: Column, image: Column) -> Column:
    return F.struct(kind.alias("type"), text.alias("text"), image.alias("image_ref"))


def user_turn(prompt: Column, image: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("user").alias("role"), F.array(_text(F.lit("image"), none, image), _text(F.lit("text"), prompt, none)).alias("content"))


def conversations(samples: DataFrame, id: str, prompts: DataFrame) -> DataFrame:
    """id, prompt_id, messages (a user and an assistant turn) for each sample and prompt of a task.

    Samples without a caption can't be learned for the unified task and are left out there.
    """
    pairs = samples.join(F.broadcast(prompts.select("prompt_id", "task", "prompt")), F.lit(True))  # a few fixed prompts
    answer = F.when(F.col("task") == "unified", target_json("unified")).otherwise(target_json("violations_only"))
    none = F.lit(None).cast("string")
    assistant = F.struct(F.lit("assistant").alias("role"), F.array(_text(F.lit("text"), F.col("__a"), none)).alias("content"))
    return (
        pairs.where("task <> 'unified' or image_caption is not null").withColumn("__a", answer).select(id, "prompt_id", F.array(user_turn(F.col("prompt"), F.col("image_id")), assistant).alias("messages"))
    )


def task_shards(samples: DataFrame, id: str) -> DataFrame:
    """task, split, id, image_id and target_json of each sample and task, as an export writes them."""
    rows = samples.withColumn("task", F.explode(F.array(*map(F.lit, TASKS)))).where("task <> 'unified' or image_caption is not null")
    target = F.when(F.col("task") == "unified", target_json("unified")).otherwise(target_json("violations_only"))
    return rows.select("task", "split", id, "image_id", target.alias("target_json"))


def reward_prompts(samples: DataFrame, id: str, prompt: Column, task: str) -> DataFrame:
    """id, prompt (the user turn alone), ground_truth as JSON text, image_id."""
    return samples.select(id, F.array(user_turn(prompt, F.col("image_id"))).alias("prompt"), F.to_json(ground_truth(task), {"ignoreNullFields": "false"}).alias("ground_truth"), "image_id")


def corrected(samples: DataFrame, corrections: DataFrame, id: str) -> DataFrame:
    """Point edits: `corrections` has id, column_name and value for metadata columns; the last by value wins a tie.

    The corrections are pivoted to one row a sample and joined once; other cells stay as they are.
    """
    wide = corrections.groupBy(F.col(id).alias("__id")).pivot("column_name", list(METADATA)).agg(F.max("value")).withColumnsRenamed({c: f"__new_{c}" for c in METADATA})
    joined = samples.join(wide, F.col(id) == F.col("__id"), "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in METADATA else F.col(c) for c in samples.columns])


def without_box(boxes_column: Column, box: Column) -> Column:
    """The boxes without exact copies of one."""
    return F.filter(boxes_column, lambda b: ~F.coalesce(b == box, F.lit(False)))


#: kind is remove_box, replace_boxes, null_violation or set_value; `boxes` holds the box or boxes, `value` the text to set.
EDIT = "kind STRING, column_name STRING, value STRING, boxes ARRAY<ARRAY<DOUBLE>>"


def point_edits(samples: DataFrame, edits: DataFrame, id: str) -> DataFrame:
    """Samples with keyed edits (id and EDIT): exact boxes removed, boxes replaced, a violation nulled, an attribute set.

    The edits of a sample are gathered into one row and applied in one pass, in the order null_violation,
    replace_boxes, remove_box; of edits of one kind to one column the last by (value, boxes) counts, but
    every removal is made. Edits of unknown samples, columns or kinds have no effect.
    """
    each = F.struct("kind", "column_name", "value", "boxes")
    gathered = edits.groupBy(F.col(id).alias("__id")).agg(F.array_sort(F.collect_list(each)).alias("__edits"))  # the edits of one sample
    joined = samples.join(gathered, F.col(id) == F.col("__id"), "left")
    of = lambda kind, c: F.filter(F.coalesce("__edits", F.array()), lambda e: (e["kind"] == kind) & (e["column_name"] == c))
    last = lambda kind, c: F.try_element_at(of(kind, c), F.lit(-1))

    def edited(c: str, own: Column) -> Column:
        replaced = F.coalesce(last("replace_boxes", c)["boxes"], own)
        removed = F.flatten(F.transform(of("remove_box", c), lambda e: F.coalesce(e["boxes"], boxes.none())))
        return F.when(F.size(of("remove_box", c)) > 0, F.filter(replaced, lambda b: ~F.coalesce(F.array_contains(removed, b), F.lit(False)))).otherwise(replaced)

    def column(c: str) -> Column:
        if c in CLASSES:
            return edited(c, F.col(c))
        if c in RULES:
            kept = F.struct(edited(c, F.col(f"{c}.bounding_box")).alias("bounding_box"), F.col(f"{c}.reason").alias("reason"))
            return F.when(F.col(c).isNotNull() & (F.size(of("null_violation", c)) == 0), kept)
        if c in METADATA:
            return F.coalesce(last("set_value", c)["value"], F.col(c))
        return F.col(c)

    return joined.select(*[column(c).alias(c) for c in samples.columns])


def prompt_of(prompts: DataFrame, task: str) -> str:
    """The prompt of a task: that of the least prompt_id. A task without one is an error that names those there are."""
    known = {r["task"]: r["prompt"] for r in prompts.groupBy("task").agg(F.min_by("prompt", "prompt_id").alias("prompt")).collect()}  # the fixed list of tasks
    if task not in known:
        raise ValueError(f"no prompt for the task {task!r}; there are {sorted(known)}")
    return known[task]


def lookup(samples: DataFrame, image_id: str | int) -> DataFrame:
    """The samples of one image, its id compared as text."""
    return samples.where(F.col("image_id").cast("string") == str(image_id))


def training_set(samples: DataFrame, id: str, prompts: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, counts) of the first `cap` samples by id, or all; counts: per prompt its samples, those skipped for want of a caption."""
    kept = samples if cap is None else samples.orderBy(id).limit(cap)
    skipped = (F.col("task") == "unified") & F.col("image_caption").isNull()
    tasks = prompts.select("prompt_id", "task")
    counts = kept.join(F.broadcast(tasks), F.lit(True)).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(skipped).alias("skipped"))  # a few fixed prompts
    return conversations(kept, id, prompts), counts


def rejoined(cache: DataFrame, images: DataFrame, key: str, order: str, how: str = "inner") -> DataFrame:
    """Cached rows with the columns of their image by key as text; of images with one key the last by `order` counts.

    With 'inner' rows of unknown images are left out (missing_images counts them), with 'left' they get nulls.
    """
    rest = [c for c in images.columns if c != key]
    latest = images.groupBy(F.col(key).cast("string").alias("__k")).agg(F.max_by(F.struct(*rest), order).alias("__i"))
    joined = cache.join(latest, F.col(key).cast("string") == F.col("__k"), how)
    return joined.select(*cache.columns, *[F.col(f"__i.{c}").alias(f"image_{c}" if c in cache.columns else c) for c in rest])


def missing_images(cache: DataFrame, images: DataFrame, key: str) -> int:
    """How many cached rows have an image that isn't there, null keys included."""
    known = images.select(F.col(key).cast("string").alias("__k")).distinct()
    return cache.join(known, F.col(key).cast("string") == F.col("__k"), "left_anti").count()
