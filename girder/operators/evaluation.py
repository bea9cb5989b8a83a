"""Scoring of model answers against the annotation of their image.

Input of everything here is `scored`: one row per answer with the strictly parsed answer and the true
sample. From it come two narrow fact tables, one row per answer and class and one per answer and rule;
every metric is a conditional aggregate over one of them, on at most a handful of keys, so the only
shuffle moves partial sums. Pooled and averaged values are computed from the few sums of each group in
one more step, so no fact is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions.jsonio import caption_or_empty, strictly_parsed
from ..tables import CLASSES, METADATA, RULES

#: Least overlap of a rule's boxes for a hit that is conditioned on it.
IOU_GATE = 0.25
STRICT, VALID = "strict", "valid"


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def assert_not_empty(df: DataFrame, what: str) -> DataFrame:
    """Scoring nothing is an error, as is scoring lists of different lengths where rows are matched by position."""
    if df.isEmpty():
        raise ValueError(f"no {what} to score")
    return df


def with_truth(answers: DataFrame, samples: DataFrame, key: str, order: str) -> DataFrame:
    """`answers` (key, sample, …) with the missing samples filled in from `samples` (key, order, the fields of a sample).

    An embedded sample is kept. Of several samples with one key the last by `order` counts; answers whose
    key is null or in no sample keep a null. The samples are made unique before the join, so a key that
    many answers share meets one row.
    """
    fields = [f.name for f in answers.schema["sample"].dataType.fields]
    last = samples.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*fields), order).alias("__truth"))
    joined = answers.join(last, F.when(F.col("sample").isNull(), F.col(key)) == F.col("__key"), "left")
    return joined.withColumn("sample", F.coalesce("sample", "__truth")).drop("__key", "__truth")


def scored(answers: DataFrame) -> DataFrame:
    """Answers with `parsed`. `answers`: id, task, raw_output, sample and any further columns.

    Rows without a sample can't be scored and are left out.
    """
    return strictly_parsed(answers.where("sample is not null"), "raw_output", "task")


def by_pass(rows: DataFrame) -> DataFrame:
    """Each row in the strict pass (failures score as empty answers), valid ones in the valid pass too."""
    both = F.when(F.col("parsed.schema_valid"), F.array(F.lit(STRICT), F.lit(VALID))).otherwise(F.array(F.lit(STRICT)))
    return rows.withColumn("pass", F.explode(both))


def structural(rows: DataFrame, *by: str) -> DataFrame:
    """answers, json_valid, schema_valid and their rates over all rows, failures included."""
    n = F.count(F.lit(1))
    valid, shaped = (F.count_if(F.col(f"parsed.{c}")) for c in ("json_valid", "schema_valid"))
    return rows.groupBy(*by).agg(n.alias("answers"), valid.alias("json_valid"), shaped.alias("schema_valid"), ratio(valid, n).alias("json_rate"), ratio(shaped, n).alias("schema_rate"))


def class_facts(rows: DataFrame, *keep: str) -> DataFrame:
    """keep…, class, pred, truth (cleaned boxes in [0, 1]) and their mask and greedy IoU structs."""
    per_class = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"parsed.{c}").alias("p"), F.col(f"sample.{c}").alias("t")) for c in CLASSES])
    flat = rows.select(*keep, F.explode(per_class).alias("f")).select(
        *keep, "f.class", boxes.clean(boxes.from_thousand(F.col("f.p"))).alias("pred"), boxes.clean(F.col("f.t")).alias("truth")
    )
    return flat.withColumn("mask", boxes.mask_iou(F.col("pred"), F.col("truth"))).withColumn("greedy", boxes.greedy_iou(F.col("pred"), F.col("truth")))


def presence(facts: DataFrame, *by: str) -> DataFrame:
    """Per class tp, fp, fn, tn, exist, precision, recall, f1; with 'micro' (pooled) and 'macro' (mean) rows.

    Every class has a row, 0 where it never occurs; macro divides by the number of classes.
    """
    p, t = F.size("pred") > 0, F.size("truth") > 0
    counts = facts.groupBy(*by, "class").agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), F.count_if(t).alias("exist")
    )
    return with_averages(counts, "class", ["tp", "fp", "fn", "tn", "exist"], by)


def per_group(counts: DataFrame, by: tuple[str, ...], rows) -> DataFrame:
    """by… and the fields of the structs that `rows` makes of each group's list of rows (an array column to an array column)."""
    fields = [c for c in counts.columns if c not in by]
    lists = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__rows")).where("size(__rows) > 0")
    return lists.select(*by, F.inline(rows(F.col("__rows"))))


def pooled(rows: Column, key: str, name: str, columns: list[str]) -> Column:
    """One struct like those of `rows`, its key `name` and its columns summed."""

    def total(c: str) -> Column:
        zero = F.lit(0).cast("bigint" if c in COUNTS else "double")
        return F.aggregate(rows, zero, lambda t, r: t + r[c]).alias(c)

    return F.struct(F.lit(name).alias(key), *[total(c) for c in columns])


def mean_of(rows: Column, column: str, n: int | None = None) -> Column:
    """The mean of a column of the structs, over `n` if that is given."""
    return F.aggregate(rows, F.lit(0.0), lambda t, r: t + r[column]) / (F.size(rows) if n is None else F.lit(n))


def precision_recall(row: Column) -> list[Column]:
    precision, recall = ratio(row["tp"], row["tp"] + row["fp"]), ratio(row["tp"], row["tp"] + row["fn"])
    return [precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1")]


#: Columns that are counts; all others are sums of numbers.
COUNTS = frozenset({"tp", "fp", "fn", "tn", "exist", "rows", "there", "common", "tn_count", "pairs"})


def with_averages(counts: DataFrame, key: str, columns: list[str], by: tuple[str, ...], apart: str = "") -> DataFrame:
    """Precision, recall and F1 of each row, of the pooled counts ('micro') and their means ('macro').

    A row whose key is `apart` has its own values but no part in the pooled and averaged ones.
    """

    def rows(own: Column) -> Column:
        whole = pooled(F.filter(own, lambda r: r[key] != apart), key, "micro", columns)
        scored = F.transform(F.concat(own, F.array(whole)), lambda r: F.struct(r[key].alias(key), *[r[c].alias(c) for c in columns], *precision_recall(r)))

        def with_macro(every: Column) -> Column:
            averaged = F.filter(every, lambda r: ~r[key].isin(apart, "micro"))
            means = boxes.let(averaged, lambda a: F.struct(*[mean_of(a, c).alias(c) for c in ("precision", "recall", "f1")]))
            macro = boxes.let(means, lambda m: F.struct(F.lit("macro").alias(key), *[F.lit(None).cast("bigint").alias(c) for c in columns], *[m[c].alias(c) for c in ("precision", "recall", "f1")]))
            return F.concat(every, F.array(macro))

        return boxes.let(scored, with_macro)

    return per_group(counts.select(*by, key, *columns), by, rows)


MEASURES = ("mask", "greedy")


def grounding(facts: DataFrame, *by: str) -> DataFrame:
    """Overlap of boxes per class and over all ('all'): means, micro ratios and exist-only values.

    For mask and greedy: tn0 and tn1 (mean with true negatives as 0 or 1), micro (sum of intersections by
    sum of unions), exist (mean where the class is there), exist_micro. 'all' has pooled tn0 and tn1,
    macro_tn0, macro_tn1 and macro_exist as means of the classes' values, and pooled micro ratios.
    """
    empty = (F.size("pred") == 0) & (F.size("truth") == 0)
    there = F.size("truth") > 0
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("tn"), F.count_if(there).alias("there")]
    per_class = facts.groupBy(*by, "class").agg(*counts, *_overlap_sums(empty, there))
    summed = [c for c in per_class.columns if c not in (*by, "class")]
    averaged = [f"{m}_{x}" for m in MEASURES for x in ("tn0", "tn1", "exist")]

    def values(r: Column) -> list[Column]:
        out = []
        for m in MEASURES:
            c = lambda x, m=m: r[f"{m}_{x}"]
            out += [
                ratio(c("s"), r["rows"]).alias(f"{m}_tn0"), ratio(c("s") + r["tn"], r["rows"]).alias(f"{m}_tn1"),
                ratio(c("i"), c("u")).alias(f"{m}_micro"), ratio(c("eiou"), r["there"]).alias(f"{m}_exist"),
                ratio(c("einter"), c("euni")).alias(f"{m}_exist_micro"),
            ]
        return out

    def macro_names(values_of) -> list[Column]:
        return [values_of(c).alias(f"{c.split('_')[0]}_macro_{c.split('_')[1]}") for c in averaged]

    def rows(own: Column) -> Column:
        single = F.transform(own, lambda r: F.struct(r["class"].alias("class"), *values(r), *macro_names(lambda _: F.lit(None).cast("double"))))
        total = F.array(pooled(own, "class", "all", summed))
        with_all = lambda s: F.concat(s, F.transform(total, lambda r: F.struct(r["class"].alias("class"), *values(r), *macro_names(lambda c: mean_of(s, c)))))
        return boxes.let(single, with_all)

    return per_group(per_class, by, rows)


def _overlap_sums(empty: Column, there: Column) -> list[Column]:
    out = []
    for m in MEASURES:
        value = F.coalesce(F.col(f"{m}.iou"), F.lit(0.0))
        out += [F.sum(F.when(empty, 0.0).otherwise(value)).alias(f"{m}_s"), F.sum(f"{m}.inter").alias(f"{m}_i"), F.sum(f"{m}.uni").alias(f"{m}_u")]
        out += [F.coalesce(F.sum(F.when(there, F.col(f"{m}.{x}"))), F.lit(0.0)).alias(f"{m}_e{x}") for x in ("iou", "inter", "uni")]
    return out


def rule_facts(rows: DataFrame, *keep: str) -> DataFrame:
    """keep…, rule, p and t (reported and true, by not being null), cleaned boxes and reasons of both sides."""
    per_rule = F.array(*[F.struct(F.lit(i + 1).alias("rule"), F.col(f"parsed.{r}").alias("p"), F.col(f"sample.{r}").alias("t")) for i, r in enumerate(RULES)])
    return rows.select(*keep, F.explode(per_rule).alias("f")).select(
        *keep, "f.rule", F.col("f.p").isNotNull().alias("p"), F.col("f.t").isNotNull().alias("t"),
        boxes.clean(boxes.from_thousand(F.col("f.p.bounding_box"))).alias("pred"), boxes.clean(F.col("f.t.bounding_box")).alias("truth"),
        F.coalesce("f.p.reason", F.lit("")).alias("pred_reason"), F.coalesce("f.t.reason", F.lit("")).alias("true_reason"),
    )


def violation_counts(rows: DataFrame, *by: str) -> DataFrame:
    """by…, rule, tp, fp, fn for the rules '0' to '4'.

    Rule 0 says that nothing is wrong: it is reported by an answer without a violation and true of a
    sample without one, so a false alarm on a safe image is a miss of rule 0, and vice versa.
    """
    says = lambda side: [F.col(f"{side}.{r}").isNotNull() for r in RULES]
    flag = lambda i, p, t: F.struct(F.lit(str(i)).alias("rule"), p.alias("p"), t.alias("t"))
    p, t = says("parsed"), says("sample")
    each = F.array(flag(0, ~F.greatest(*p), ~F.greatest(*t)), *[flag(i, a, b) for i, (a, b) in enumerate(zip(p, t, strict=True), 1)])
    x, y = F.col("p"), F.col("t")
    return rows.select(*by, F.inline(each)).groupBy(*by, "rule").agg(F.count_if(x & y).alias("tp"), F.count_if(x & ~y).alias("fp"), F.count_if(~x & y).alias("fn"))


def violation_scores(rows: DataFrame, *by: str) -> DataFrame:
    """Per rule 0 to 4 tp, fp, fn, precision, recall, f1; micro pools and macro averages rules 1 to 4."""
    return with_averages(violation_counts(rows, *by), "rule", ["tp", "fp", "fn"], by, apart="0")


def gated_scores(rows: DataFrame, *by: str, gate: float = IOU_GATE) -> DataFrame:
    """As violation_scores for rules 1 to 4, but a hit whose boxes overlap less than `gate` is a false alarm and a miss."""
    facts = rule_facts(rows, *by)
    p, t = F.col("p"), F.col("t")
    good = p & t & (boxes.greedy_iou(F.col("pred"), F.col("truth"))["iou"] >= gate)
    counts = facts.groupBy(*by, F.col("rule").cast("string").alias("rule")).agg(F.count_if(good).alias("tp"), F.count_if(p & ~good).alias("fp"), F.count_if(t & ~good).alias("fn"))
    return with_averages(counts, "rule", ["tp", "fp", "fn"], by)


def violation_grounding(rows: DataFrame, *by: str) -> DataFrame:
    """Mask overlap of rules that both sides report: per rule tn0, tn1, micro, tn_count, common; 'all' with macro over four rules."""
    facts = rule_facts(rows, *by).where("p and t").withColumn("m", boxes.mask_iou(F.col("pred"), F.col("truth")))
    sums = facts.groupBy(*by, F.col("rule").cast("string").alias("rule")).agg(
        F.count(F.lit(1)).alias("common"), F.count_if(F.col("m.iou").isNull()).alias("tn_count"), F.sum(F.coalesce("m.iou", F.lit(0.0))).alias("s"),
        F.sum("m.inter").alias("i"), F.sum("m.uni").alias("u"),
    )

    def values(r: Column, tn0: Column, tn1: Column) -> Column:
        means = [ratio(r["s"], r["common"]).alias("tn0"), ratio(r["s"] + r["tn_count"], r["common"]).alias("tn1"), ratio(r["i"], r["u"]).alias("micro")]
        return F.struct(r["rule"].alias("rule"), r["common"].alias("common"), r["tn_count"].alias("tn_count"), *means, tn0.alias("macro_tn0"), tn1.alias("macro_tn1"))

    def all_rows(own: Column) -> Column:
        none = F.lit(None).cast("double")
        single = F.transform(own, lambda r: values(r, none, none))
        total = F.array(pooled(own, "rule", "all", ["common", "tn_count", "s", "i", "u"]))
        with_all = lambda x: F.concat(x, F.transform(total, lambda r: values(r, *[mean_of(x, c, len(RULES)) for c in ("tn0", "tn1")])))
        return boxes.let(single, with_all)

    return per_group(sums, by, all_rows)


def reasoning(rows: DataFrame, *by: str, scorer=text.ngram_f1) -> DataFrame:
    """Mean score of the reasons of rules that both sides report: per rule, pooled ('all') and macro over four rules.

    `scorer` takes the two reason columns and gives a score; a model-backed one fits in the same place.
    """
    facts = rule_facts(rows, *by).where("p and t").withColumn("__s", scorer(F.col("pred_reason"), F.col("true_reason")))
    sums = facts.groupBy(*by, F.col("rule").cast("string").alias("rule")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("__s").alias("s"))

    def all_rows(own: Column) -> Column:
        scores = lambda a: F.transform(a, lambda r: F.struct(r["rule"].alias("rule"), r["pairs"].alias("pairs"), ratio(r["s"], r["pairs"]).alias("score")))
        single, whole = scores(own), pooled(own, "rule", "all", ["pairs", "s"])
        macro = F.struct(F.lit("macro").alias("rule"), whole["pairs"].alias("pairs"), mean_of(single, "score", len(RULES)).alias("score"))
        return F.concat(single, scores(F.array(whole)), F.array(macro))

    return per_group(sums, by, all_rows)


def captions(rows: DataFrame, *by: str) -> DataFrame:
    """Word counts of predicted captions (avg, min, max) and mean n-gram F1 with the true ones."""
    pred = caption_or_empty(F.col("parsed.caption"))
    n = text.word_count(pred)
    return rows.groupBy(*by).agg(
        F.avg(n).alias("words_avg"), F.min(n).alias("words_min"), F.max(n).alias("words_max"), F.avg(text.ngram_f1(pred, caption_or_empty(F.col("sample.image_caption")))).alias("ngram_f1")
    )


def caption_suite(rows: DataFrame, id: str, prefix: str = "", scorers: dict | None = None, image: str | None = None, embedding: str | None = None) -> DataFrame:
    """(metric, value) of predicted captions: lengths, n-gram F1, consensus, CLIPScore where embeddings are given, and any further scorer.

    `rows` (id, parsed, sample and the embedding columns) should be materialised; none is an error, as is
    an image embedding without one of the text. A scorer takes the two caption columns and gives a score;
    model-backed ones fit there. Missing and blank captions count as 'empty' on both sides.
    """
    assert_not_empty(rows, "captions")
    if (image is None) != (embedding is None):
        raise ValueError("CLIPScore needs the embeddings of images and of texts")
    pred, truth = caption_or_empty(F.col("parsed.caption")), caption_or_empty(F.col("sample.image_caption"))
    n = text.word_count(pred)
    values = [F.avg(n).alias("words_avg"), F.min(n).alias("words_min"), F.max(n).alias("words_max")]
    values += [F.avg(scorer(pred, truth)).alias(name) for name, scorer in (scorers or {}).items()]
    if image is not None and embedding is not None:
        values.append(F.coalesce(F.avg(text.clip_score(F.col(image), F.col(embedding))), F.lit(0.0)).alias("clipscore"))
    one = rows.agg(*values)
    scores = text.caption_scores(rows.select(id, pred.alias("__p"), truth.alias("__t")), id, "__p", "__t")
    both = scores.agg(F.avg("ngram_f1").alias("ngram_f1"), F.avg("score").alias("ciderd"))
    out = long(one, [], one.columns).unionByName(long(both, [], both.columns))
    return out.withColumn("metric", F.concat(F.lit(prefix), "metric"))


def stratified_suite(rows: DataFrame, fields: tuple[str, ...] = METADATA) -> DataFrame:
    """field, stratum, metric, value: all families for each value of each metadata field; `rows` should be materialised."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"sample.{f}").alias("stratum")) for f in fields])
    return full_evaluation(rows.select("*", F.inline(pairs)).where("stratum is not null"), "field", "stratum")


def failures(rows: DataFrame, id: str) -> DataFrame:
    """(id, error_type, detail, raw_output) of answers that failed one of the two gates."""
    error = F.col("parsed.error")
    return rows.where(error.isNotNull()).select(id, F.split(error, ":")[0].alias("error_type"), F.get(F.split(error, ":"), F.lit(1)).alias("detail"), "raw_output")


def gates(rows: DataFrame, *by: str) -> DataFrame:
    """The funnel: answers, past JSON, past the schema, lost at the second gate, and a verdict at 95 and 80 %."""
    s = structural(rows, *by)
    pct = F.round(100.0 * F.col("schema_rate"), 2)
    verdict = F.when(pct >= 95, "ready").when(pct >= 80, "usable").otherwise("poor")
    return s.select(*by, "answers", "json_valid", "schema_valid", (F.col("json_valid") - F.col("schema_valid")).alias("gate2_only"), pct.alias("schema_pct"), verdict.alias("verdict"))


def stratified(rows: DataFrame, metric, fields: tuple[str, ...] = METADATA) -> DataFrame:
    """`metric(rows, 'field', 'value')` for each value of each metadata field; strata without rows don't occur."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"sample.{f}").alias("value")) for f in fields])
    return metric(rows.select("*", F.explode(pairs).alias("__s")).select("*", "__s.field", "__s.value").drop("__s").where("value is not null"), "field", "value")


def _named(df: DataFrame, by: tuple[str, ...], key: str, values: dict[str, tuple[str, ...]], prefix: str) -> DataFrame:
    """by…, metric, value: the columns of the rows whose key is named, as prefix + column + _ + key."""
    chosen = [F.struct(F.concat(F.lit(f"{prefix}{c}_"), F.col(key)).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(k).alias("k")) for k, columns in values.items() for c in columns]
    return df.select(*by, key, F.inline(F.array(*chosen))).where((F.col(key) == F.col("k")) & F.col("value").isNotNull()).select(*by, "metric", "value")


def full_evaluation(rows: DataFrame, *by: str, scorer=text.ngram_f1) -> DataFrame:
    """by…, metric, value: all families of metrics that apply to a row's task.

    Captions and boxes of classes are scored for the unified task only; shape, rules, their boxes and
    their reasons for all. `rows` is used by every family and should be materialised.
    """
    unified = rows.where("task = 'unified'")
    facts = class_facts(unified, *by)
    shape = structural(rows, *by)
    averages = {"micro": ("f1",), "macro": ("f1",)}
    overlap = [f"{m}_{x}" for m in MEASURES for x in ("tn0", "tn1", "micro", "exist", "exist_micro", "macro_tn0", "macro_tn1", "macro_exist")]
    parts = [
        long(shape, list(by), ["answers", "json_rate", "schema_rate"]),
        _named(presence(facts, *by), by, "class", averages, "presence_"),
        long(grounding(facts, *by).where("class = 'all'"), list(by), overlap),
        _named(violation_scores(rows, *by), by, "rule", averages, "violation_"),
        _named(gated_scores(rows, *by), by, "rule", averages, "gated_"),
        _named(violation_grounding(rows, *by), by, "rule", {"all": ("tn0", "tn1", "micro", "macro_tn0", "macro_tn1")}, "violation_iou_"),
        _named(reasoning(rows, *by, scorer=scorer), by, "rule", {"all": ("score",), "macro": ("score",)}, "reason_"),
        long(captions(unified, *by), list(by), ["words_avg", "words_min", "words_max", "ngram_f1"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def long(df: DataFrame, keys: list[str], value_columns: list[str]) -> DataFrame:
    """keys…, metric, value: one row per number that isn't null."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in value_columns])
    return df.select(*keys, F.inline(each)).where("value is not null")
