"""Row-wise reward scores of an answer, as columns over `scored` rows.

A failed answer, a missing truth or any null scores 0. Presence of a violation is stricter here than in
the metrics: an object without a box and without a reason doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions.predicates import is_violated
from ..tables import CLASSES, RULES

# Component weights, and the reward of agreeing that nothing is there.
WEIGHTS = {"format": 0.05, "caption": 0.15, "grounding": 0.25, "violation_id": 0.30, "violation_grounding": 0.15, "reasoning": 0.10}
NOTHING_THERE, REPETITION_FACTOR, REPETITION_OVER = 0.10, 0.5, 5
CAPTION_FLOOR, REASON_FLOOR = 5.0, 3.0
ABSENT_WORDS = ("false", "none", "null", "n/a", "")


def reported(side: str) -> Column:
    """ARRAY<INT> of the rules with a box or a reason that says something."""
    says = lambda v: is_violated(v) & ~(~(F.coalesce(F.size(v["bounding_box"]), F.lit(0)) > 0) & F.lower(F.trim(v["reason"])).isin(*ABSENT_WORDS))
    return F.array_compact(F.array(*[F.when(says(F.col(f"{side}.{r}")), F.lit(i + 1)) for i, r in enumerate(RULES)]))


def reward_format() -> Column:
    return F.col("parsed.schema_valid").cast("double")


def reward_caption(similarity: Column | None = None) -> Column:
    """(0.6 max(0, similarity) + 0.4 n-gram F1) times the length factor; without embeddings the n-gram part alone."""
    pred, truth = F.col("parsed.caption"), F.col("sample.image_caption")
    grams = text.ngram_f1(pred, truth)
    closeness = grams if similarity is None else 0.6 * F.greatest(F.lit(0.0), similarity) + 0.4 * grams
    some = (F.length(F.trim(pred)) > 0) & (F.length(F.trim(truth)) > 0)
    return F.coalesce(F.when(some, closeness * text.length_factor(pred, truth, CAPTION_FLOOR)), F.lit(0.0))


def _class_boxes() -> Column:
    """One struct per class: p and t, the cleaned boxes of both sides. One expression serves all of them."""
    raw = F.array(*[F.struct(F.col(f"parsed.{c}").alias("p"), F.col(f"sample.{c}").alias("t")) for c in CLASSES])
    return F.transform(raw, lambda s: F.struct(boxes.clean(boxes.from_thousand(s["p"])).alias("p"), boxes.clean(s["t"]).alias("t")))


def _mean(values: Column, n: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n


def reward_grounding() -> Column:
    """Mean over the classes: mask IoU, 0.10 where the class is absent on both sides."""
    return _mean(F.transform(_class_boxes(), lambda s: F.coalesce(boxes.mask_iou(s["p"], s["t"])["iou"], F.lit(NOTHING_THERE))), len(CLASSES))


def reward_violation_id() -> Column:
    """F2 over the sets of rules; 0.10 if both are empty."""
    p, t = F.col("p_rules"), F.col("t_rules")
    tp, fp, fn = F.size(F.array_intersect(p, t)), F.size(F.array_except(p, t)), F.size(F.array_except(t, p))
    score = F.when(tp > 0, 5.0 * tp / (5.0 * tp + 4.0 * fn + fp)).otherwise(F.lit(0.0))
    return F.when((F.size(p) == 0) & (F.size(t) == 0), F.lit(NOTHING_THERE)).otherwise(score)


def _common_rules(*more: Column) -> Column:
    """One struct per rule that both sides report: p and t, the violations of both sides."""
    both = lambda i: F.array_contains("p_rules", i + 1) & F.array_contains("t_rules", i + 1)
    return F.array_compact(F.array(*[F.when(both(i), F.struct(F.col(f"parsed.{r}").alias("p"), F.col(f"sample.{r}").alias("t"), *[m[i].alias(f"m{k}") for k, m in enumerate(more)])) for i, r in enumerate(RULES)]))


def _mean_of(values: Column) -> Column:
    """Mean of an array, 0 for none."""
    return boxes.let(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(F.lit(0.0)))


def reward_violation_grounding() -> Column:
    """Mean mask IoU of the rules on both sides; 0 if there is none."""
    iou = lambda s: boxes.mask_iou(boxes.clean(boxes.from_thousand(s["p"]["bounding_box"])), boxes.clean(s["t"]["bounding_box"]))["iou"]
    return _mean_of(F.transform(_common_rules(), lambda s: F.coalesce(iou(s), F.lit(0.0))))


def reward_reasoning(similarity: Column | None = None) -> Column:
    """Mean over the rules on both sides whose reasons are both not empty; `similarity` holds one cosine a rule."""
    rules = _common_rules(*([similarity] if similarity is not None else []))
    some = F.filter(rules, lambda s: F.coalesce((F.length(F.trim(s["p"]["reason"])) > 0) & (F.length(F.trim(s["t"]["reason"])) > 0), F.lit(False)))

    def score(s: Column) -> Column:
        p, t = s["p"]["reason"], s["t"]["reason"]
        grams = text.ngram_f1(p, t)
        closeness = grams if similarity is None else 0.6 * F.greatest(F.lit(0.0), s["m0"]) + 0.4 * grams
        return closeness * text.length_factor(p, t, REASON_FLOOR)

    return _mean_of(F.transform(some, score))


def repeats_boxes() -> Column:
    """One box more than REPETITION_OVER times over all fields of the answer together."""
    every = [boxes.normalized(F.col(f"parsed.{c}")) for c in CLASSES] + [boxes.normalized(F.col(f"parsed.{r}.bounding_box")) for r in RULES]
    return boxes.most_repeats(F.concat(*every)) > REPETITION_OVER


REGISTRY = {
    "format": reward_format, "caption": reward_caption, "grounding": reward_grounding, "violation_id": reward_violation_id,
    "violation_grounding": reward_violation_grounding, "reasoning": reward_reasoning,
}


def assembled(settings: dict) -> dict[str, float]:
    """Component and weight of a task's settings: `reward_components` (all if absent) and `reward_weights`.

    Components are named with or without the prefix reward_. One that doesn't exist is an error; a weight
    whose name is no component of the task has no effect, and the default stays.
    """
    plain = lambda name: str(name).removeprefix("reward_")
    names = [plain(n) for n in settings.get("reward_components") or WEIGHTS]
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown reward components: {unknown}; there are {sorted(REGISTRY)}")
    own = {plain(n): float(w) for n, w in (settings.get("reward_weights") or {}).items()}
    return {n: own.get(n, WEIGHTS[n]) for n in names}


def task_rewards(rows: DataFrame, settings: dict) -> DataFrame:
    """All columns, one of each component of the task's settings, and `weighted`, their weighted sum (no halving for repeats)."""
    weights = assembled(settings)
    return components(rows, tuple(weights)).withColumn("weighted", sum((F.col(f"r_{n}") * w for n, w in weights.items()), F.lit(0.0)))


def last_content(turns: Column) -> Column:
    """The text of an answer given as a chat: the content of its last turn; null for no turn."""
    return F.try_element_at(turns, F.lit(-1))["content"]


def components(rows: DataFrame, names: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """All columns and one of each reward named; an unknown name is an error. A failed answer scores 0 in each."""
    unknown = set(names) - REGISTRY.keys()
    if unknown:
        raise KeyError(f"unknown rewards: {sorted(unknown)}")
    good = F.col("parsed.schema_valid") & F.col("sample").isNotNull()
    rows = rows.select("*", reported("parsed").alias("p_rules"), reported("sample").alias("t_rules"))
    return rows.select("*", *[F.coalesce(F.when(good, REGISTRY[n]()), F.lit(0.0)).alias(f"r_{n}") for n in names])


def composite(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Components, repetition (0 or 1) and total: the weighted sum, halved for answers that repeat a box."""
    weights = weights or WEIGHTS
    scored = components(rows, tuple(weights)).withColumn("repetition", F.coalesce(repeats_boxes(), F.lit(False)).cast("double"))
    total = sum((F.col(f"r_{n}") * w for n, w in weights.items()), F.lit(0.0))
    return scored.withColumn("total", total * F.when(F.col("repetition") > 0, F.lit(REPETITION_FACTOR)).otherwise(F.lit(1.0)))


def legacy(rows: DataFrame) -> DataFrame:
    """The earlier set: JSON validity, caption n-gram F1, rule F1 (1 if both are empty) and mean greedy IoU."""
    rows = rows.select("*", reported("parsed").alias("p_rules"), reported("sample").alias("t_rules"))
    p, t = F.col("p_rules"), F.col("t_rules")
    tp, fp, fn = F.size(F.array_intersect(p, t)), F.size(F.array_except(p, t)), F.size(F.array_except(t, p))
    rule_f1 = F.when((F.size(p) == 0) & (F.size(t) == 0), F.lit(1.0)).when(tp > 0, 2.0 * tp / (2.0 * tp + fp + fn)).otherwise(F.lit(0.0))
    greedy = _mean(F.transform(_class_boxes(), lambda s: boxes.greedy_iou(s["p"], s["t"])["iou"]), len(CLASSES))
    zero = F.lit(0.0)
    good = F.col("parsed.schema_valid")
    return rows.select(
        "*", F.col("parsed.json_valid").cast("double").alias("r_json"), F.when(good, text.ngram_f1(F.col("parsed.caption"), F.col("sample.image_caption"))).otherwise(zero).alias("r_caption"),
        F.when(good, rule_f1).otherwise(zero).alias("r_rules"), F.when(good, greedy).otherwise(zero).alias("r_boxes"),
    )
