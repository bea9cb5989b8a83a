"""SQL of the evaluation queries. Boxes of answers are read leniently; only answers of the right shape are used."""

from __future__ import annotations

from ..operators.rewards import ABSENT_WORDS, CAPTION_FLOOR, NOTHING_THERE, REASON_FLOOR, REPETITION_FACTOR, REPETITION_OVER, WEIGHTS
from ..tables import CLASSES, METADATA, RULES

_FENCE = r"(?is)```(?:json)?(.*?)```"


def _box_list(path: str) -> str:
    """SQL: the value at the path is a list of lists of four numbers."""
    inner = f"from_json(v->'{path}', '[\"JSON\"]')"
    return f"(json_type(v->'{path}') = 'ARRAY' AND coalesce(list_bool_and([json_type(b) = 'ARRAY' AND json_array_length(b) = 4 AND coalesce(list_bool_and([json_type(c) IN ('UBIGINT', 'BIGINT', 'DOUBLE') FOR c IN from_json(b, '[\"JSON\"]')]), false) FOR b IN {inner}]), true))"


def _rule_ok(r: str) -> str:
    at = f"json_type(v->'$.{r}')"
    box, reason = f"json_type(v->'$.{r}.bounding_box')", f"json_type(v->'$.{r}.reason')"
    return f"({at} IS NULL OR {at} = 'NULL' OR ({at} = 'OBJECT' AND ({box} IS NULL OR {box} = 'NULL' OR {_box_list(f'$.{r}.bounding_box')}) AND ({reason} IS NULL OR {reason} IN ('NULL', 'VARCHAR'))))"


_RULES_OK = " AND ".join(map(_rule_ok, RULES))
_CLASSES_OK = " AND ".join(f"(json_type(v->'$.{c}') IS NULL OR {_box_list(f'$.{c}')})" for c in CLASSES)
_CLEAN = "[b FOR b IN {0} IF len(b) = 4 AND list_bool_and([c >= -1e-6 AND c <= 1 + 1e-6 FOR c IN b]) AND b[3] - b[1] > 1e-4 AND b[4] - b[2] > 1e-4]"
_clean = lambda x: _CLEAN.replace("{0}", x)
_scaled = lambda path: f"[[least(1.0, greatest(0.0, c / 1000.0)) FOR c IN b] FOR b IN coalesce(from_json(v->'{path}', '[[\"DOUBLE\"]]'), [])]"
NUMBER_SQL = "TRY_CAST(NULLIF(regexp_extract(image_id, '([0-9]+)', 1), '') AS BIGINT)"
_STRUCT = "struct_pack(" + ", ".join(f"{c} := {c}" for c in ("image_id", "image_caption", *METADATA, *RULES, *CLASSES, "resolution")) + ")"
_PARSED = f"""
r AS (SELECT {NUMBER_SQL} AS image, arg_max({_STRUCT}, sample_id) AS truth FROM raw_sample WHERE {NUMBER_SQL} IS NOT NULL GROUP BY 1),
e AS (SELECT p.prediction_id, p.run_id, p.image_id, t.task, coalesce(p.sample, r.truth) AS sample, p.source, p.error, p.raw_output,
             CASE WHEN regexp_matches(coalesce(raw_output, ''), '{_FENCE}') THEN regexp_extract(raw_output, '{_FENCE}', 1) ELSE coalesce(raw_output, '') END AS body
      FROM (SELECT *, {NUMBER_SQL} AS image FROM predictions) p JOIN prompt_text t USING (prompt_id) LEFT JOIN r ON r.image = p.image),
j0 AS (SELECT *, CASE WHEN json_valid(body) AND NOT regexp_matches(body, ',\\s*[}}\\]]') AND NOT regexp_full_match(body, '\\s*null\\s*') THEN CAST(body AS JSON) END AS v FROM e),
j AS (SELECT *, v IS NOT NULL AS json_valid,
             coalesce(json_type(v) = 'OBJECT' AND {_RULES_OK} AND (task <> 'unified' OR (json_type(v->'$.caption') = 'VARCHAR' AND {_CLASSES_OK})), false) AS schema_valid FROM j0),
s AS (SELECT *, {", ".join(f"schema_valid AND coalesce(json_type(v->'$.{r}') = 'OBJECT' AND CAST(v->'$.{r}' AS VARCHAR) <> '{{}}', false) AS p{i + 1}, sample.{r} IS NOT NULL AS t{i + 1}" for i, r in enumerate(RULES))}
      FROM j WHERE sample IS NOT NULL)"""
_CLASS_FACTS = f"""
f AS ({" UNION ALL ".join(f"SELECT prediction_id, sample, '{c}' AS class, CASE WHEN schema_valid AND task = 'unified' THEN {_clean(_scaled(f'$.{c}'))} ELSE [] END AS pred, {_clean(f'coalesce(sample.{c}, [])')} AS truth FROM s" for c in CLASSES)})"""
_UNIFIED_FACTS = _CLASS_FACTS.replace("FROM s", "FROM s WHERE task = 'unified'")
_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"
_CONFUSION = "count(*) FILTER (len(pred) > 0 AND len(truth) > 0) AS tp, count(*) FILTER (len(pred) > 0 AND len(truth) = 0) AS fp, count(*) FILTER (len(pred) = 0 AND len(truth) > 0) AS fn, count(*) FILTER (len(pred) = 0 AND len(truth) = 0) AS tn, count(*) FILTER (len(truth) > 0) AS exist"
# the covered area of a list of boxes, by cells between all edges
_MASK = """
x AS (SELECT prediction_id, class, pred, truth, list_sort(list_distinct(flatten([[b[1], b[3]] FOR b IN list_concat(pred, truth)]))) AS xs,
             list_sort(list_distinct(flatten([[b[2], b[4]] FOR b IN list_concat(pred, truth)]))) AS ys FROM f),
cells AS (SELECT prediction_id, class, pred, truth, xs[i] AS x0, xs[i + 1] AS x1, ys[k] AS y0, ys[k + 1] AS y1
          FROM (SELECT *, unnest(range(1, len(ys))) AS k FROM (SELECT *, unnest(range(1, len(xs))) AS i FROM x))),
hit AS (SELECT *, (x1 - x0) * (y1 - y0) AS a, coalesce(list_bool_or([b[1] <= x0 AND b[3] >= x1 AND b[2] <= y0 AND b[4] >= y1 FOR b IN pred]), false) AS inp,
               coalesce(list_bool_or([b[1] <= x0 AND b[3] >= x1 AND b[2] <= y0 AND b[4] >= y1 FOR b IN truth]), false) AS int_ FROM cells),
m AS (SELECT f.prediction_id, f.class, coalesce(sum(a) FILTER (inp AND int_), 0) AS inter, coalesce(sum(a) FILTER (inp OR int_), 0) AS uni, any_value(f.pred) AS pred, any_value(f.truth) AS truth
      FROM f LEFT JOIN hit h ON h.prediction_id = f.prediction_id AND h.class = f.class GROUP BY f.prediction_id, f.class)"""
_RULE_COUNTS = " UNION ALL ".join(f"SELECT '{i}' AS rule, count(*) FILTER (p{i} AND t{i}) AS tp, count(*) FILTER (p{i} AND NOT t{i}) AS fp, count(*) FILTER (NOT p{i} AND t{i}) AS fn FROM s" for i in range(1, 5))
_ANY_P, _ANY_T = "(p1 OR p2 OR p3 OR p4)", "(t1 OR t2 OR t3 OR t4)"
_R6 = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
_SAYS = lambda v: f"({v} IS NOT NULL AND (coalesce(len({v}.bounding_box), 0) > 0 OR lower(trim(coalesce({v}.reason, ''))) NOT IN ('', 'false', 'none', 'null', 'n/a')))"
_PSAYS = lambda r: f"(schema_valid AND coalesce(json_type(v->'$.{r}') = 'OBJECT', false) AND (coalesce(json_array_length(v->'$.{r}.bounding_box'), 0) > 0 OR lower(trim(coalesce(v->>'$.{r}.reason', ''))) NOT IN ('', 'false', 'none', 'null', 'n/a')))"
_TPFN = lambda a, b: " + ".join(f"CAST({a(r)} AND {b(r)} AS INT)" for r in RULES)
_p, _t = _PSAYS, (lambda r: _SAYS(f"sample.{r}"))
_not = lambda g: (lambda r: f"NOT {g(r)}")

ORACLE = {
    "a1_structural": f"WITH {_PARSED} SELECT task, count(*) AS answers, count(*) FILTER (json_valid) AS json_valid, count(*) FILTER (schema_valid) AS schema_valid, round(count(*) FILTER (json_valid) / count(*), 6) AS json_rate, round(count(*) FILTER (schema_valid) / count(*), 6) AS schema_rate FROM j GROUP BY task",
    "a2_presence_confusion": f"WITH {_PARSED}, {_UNIFIED_FACTS} SELECT class, {_CONFUSION} FROM f GROUP BY class",
    "a3_a4_presence_prf": f"""WITH {_PARSED}, {_UNIFIED_FACTS}, c AS (SELECT class, {_CONFUSION} FROM f GROUP BY class),
k AS (SELECT *, {_PRF} FROM c UNION ALL SELECT *, {_PRF} FROM (SELECT 'micro' AS class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(exist) AS BIGINT) AS exist FROM c))
SELECT class, tp, fp, fn, tn, exist, {_R6} FROM k
UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, NULL, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM k WHERE class <> 'micro'""",
    "b8_mask_iou": f"WITH {_PARSED}, {_CLASS_FACTS}, {_MASK} SELECT prediction_id, class, round(CASE WHEN len(pred) = 0 AND len(truth) = 0 THEN NULL WHEN uni > 0 THEN inter / uni ELSE 0 END, 6) AS iou, round(inter, 6) AS inter, round(uni, 6) AS uni FROM m",
    "a9_a12_violation_prf": f"""WITH {_PARSED}, c AS ({_RULE_COUNTS}),
z AS (SELECT '0' AS rule, count(*) FILTER (NOT {_ANY_P} AND NOT {_ANY_T}) AS tp, count(*) FILTER (NOT {_ANY_P} AND {_ANY_T}) AS fp, count(*) FILTER ({_ANY_P} AND NOT {_ANY_T}) AS fn FROM s),
k AS (SELECT *, {_PRF} FROM (SELECT * FROM c UNION ALL SELECT * FROM z UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c))
SELECT rule, tp, fp, fn, {_R6} FROM k UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM k WHERE rule IN ('1', '2', '3', '4')""",
    "a16_caption_words": f"""WITH {_PARSED}, w AS (SELECT len([x FOR x IN regexp_split_to_array(CASE WHEN schema_valid AND trim(v->>'$.caption') <> '' THEN v->>'$.caption' ELSE 'empty' END, '\\s+') IF x <> '']) AS n FROM s WHERE task = 'unified')
SELECT round(avg(n), 6) AS words_avg, CAST(min(n) AS INT) AS words_min, CAST(max(n) AS INT) AS words_max FROM w""",
    "a31_gates": f"""WITH {_PARSED}, g AS (SELECT run_id, count(*) AS answers, count(*) FILTER (json_valid) AS json_valid, count(*) FILTER (schema_valid) AS schema_valid FROM j GROUP BY run_id)
SELECT *, json_valid - schema_valid AS gate2_only, round(100.0 * schema_valid / answers, 2) AS schema_pct, CASE WHEN round(100.0 * schema_valid / answers, 2) >= 95 THEN 'ready' WHEN round(100.0 * schema_valid / answers, 2) >= 80 THEN 'usable' ELSE 'poor' END AS verdict FROM g""",
    "a32_log_triage": f"""WITH e AS (SELECT source, error, coalesce(raw_output, '') AS x FROM predictions)
SELECT source, count(*) AS rows, count(*) FILTER (trim(x) = '') AS empty, count(*) FILTER (trim(x) <> '' AND NOT regexp_matches(x, '{_FENCE}')) AS missing_fence, count(*) FILTER (regexp_matches(x, '{_FENCE}')) AS clean,
       count(error) AS errors, round(100.0 * count(*) FILTER (trim(x) <> '') / count(*), 6) AS success_pct FROM e GROUP BY source""",
    "o12_rule_sets": f"""WITH {_PARSED} SELECT prediction_id, concat_ws(',', {", ".join(f"CASE WHEN p{i} AND t{i} THEN '{i}' END" for i in range(1, 5))}) AS common,
concat_ws(',', {", ".join(f"CASE WHEN p{i} AND NOT t{i} THEN '{i}' END" for i in range(1, 5))}) AS extra, concat_ws(',', {", ".join(f"CASE WHEN t{i} AND NOT p{i} THEN '{i}' END" for i in range(1, 5))}) AS missed FROM s""",
    "r5_rule_f2": f"""WITH {_PARSED}, k AS (SELECT prediction_id, schema_valid, {_TPFN(_p, _t)} AS tp, {_TPFN(_p, _not(_t))} AS fp, {_TPFN(_not(_p), _t)} AS fn FROM s)
SELECT prediction_id, round(CASE WHEN NOT schema_valid THEN 0.0 WHEN tp + fp + fn = 0 THEN 0.1 WHEN tp > 0 THEN 5.0 * tp / (5.0 * tp + 4.0 * fn + fp) ELSE 0.0 END, 6) AS r_violation_id FROM k""",
    "a17_stratified_violations": f"""WITH {_PARSED}, l AS ({" UNION ALL ".join(f"SELECT '{m}' AS field, sample.{m} AS value, s.* FROM s WHERE sample.{m} IS NOT NULL" for m in METADATA)}),
c AS ({" UNION ALL ".join(f"SELECT field, value, '{i}' AS rule, count(*) FILTER (p{i} AND t{i}) AS tp, count(*) FILTER (p{i} AND NOT t{i}) AS fp, count(*) FILTER (NOT p{i} AND t{i}) AS fn FROM l GROUP BY field, value" for i in range(1, 5))}),
k AS (SELECT *, {_PRF} FROM c)
SELECT field, value, 'macro' AS rule, round(avg(f1), 6) AS f1 FROM k GROUP BY field, value
UNION ALL SELECT field, value, 'micro', round(f1, 6) FROM (SELECT field, value, {_PRF} FROM (SELECT field, value, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY field, value))""",
    "a17_stratified_presence": f"""WITH {_PARSED}, {_UNIFIED_FACTS}, l AS ({" UNION ALL ".join(f"SELECT '{m}' AS field, sample.{m} AS value, f.* FROM f WHERE sample.{m} IS NOT NULL" for m in METADATA)}),
c AS (SELECT field, value, class, {_CONFUSION} FROM l GROUP BY ALL), k AS (SELECT *, {_PRF} FROM c)
SELECT field, value, 'macro' AS class, round(avg(f1), 6) AS f1 FROM k GROUP BY field, value
UNION ALL SELECT field, value, 'micro', round(f1, 6) FROM (SELECT field, value, {_PRF} FROM (SELECT field, value, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY field, value))""",
}
_G = lambda m, i: f"round(CASE WHEN {i} > 0 THEN {m} / {i} ELSE 0 END, 6)"
ORACLE["a14_violation_grounding"] = f"""WITH {_PARSED},
f AS ({" UNION ALL ".join(f"SELECT prediction_id, '{i + 1}' AS class, {_clean(_scaled(f'$.{r}.bounding_box'))} AS pred, {_clean(f'coalesce(sample.{r}.bounding_box, [])')} AS truth FROM s WHERE p{i + 1} AND t{i + 1}" for i, r in enumerate(RULES))}), {_MASK},
q AS (SELECT class AS rule, count(*) AS common, count(*) FILTER (len(pred) = 0 AND len(truth) = 0) AS tn_count, sum(CASE WHEN uni > 0 THEN inter / uni ELSE 0 END) AS s, sum(inter) AS i, sum(uni) AS u FROM m GROUP BY class),
w AS (SELECT rule, common, tn_count, s / common AS tn0, (s + tn_count) / common AS tn1, CASE WHEN u > 0 THEN i / u ELSE 0 END AS micro FROM q)
SELECT rule, common, tn_count, round(tn0, 6) AS tn0, round(tn1, 6) AS tn1, round(micro, 6) AS micro, NULL AS macro_tn0, NULL AS macro_tn1 FROM w
UNION ALL SELECT 'all', CAST(sum(common) AS BIGINT), CAST(sum(tn_count) AS BIGINT), round(sum(s) / sum(common), 6), round((sum(s) + sum(tn_count)) / sum(common), 6), round(sum(i) / sum(u), 6),
       (SELECT round(sum(tn0) / 4, 6) FROM w), (SELECT round(sum(tn1) / 4, 6) FROM w) FROM q"""


# boxes matched greedily: one step per true box, the first of the best remaining predictions is used up
def _area(b: str) -> str:
    return f"(greatest(0, {b}[3] - {b}[1]) * greatest(0, {b}[4] - {b}[2]))"


_INTER = "(greatest(0, least(p[3], t[3]) - greatest(p[1], t[1])) * greatest(0, least(p[4], t[4]) - greatest(p[2], t[2])))"
_GREEDY = f"""
g AS (SELECT prediction_id, class, pred AS rest, truth, 0 AS k, CAST(0 AS DOUBLE) AS ious, CAST(0 AS DOUBLE) AS inter, CAST(0 AS DOUBLE) AS uni FROM f
      UNION ALL
      SELECT prediction_id, class, CASE WHEN best IS NULL THEN rest ELSE list_concat(rest[:best - 1], rest[best + 1:]) END, truth, k + 1,
             ious + coalesce(iou[best], 0), inter + coalesce(inters[best], 0), uni + coalesce({_area("rest[best]")} + {_area("t")} - inters[best], {_area("t")})
      FROM (SELECT *, list_position(iou, list_max(iou)) AS best
            FROM (SELECT *, [i / a FOR i, a IN inters] AS unused, [CASE WHEN {_area("p")} + {_area("t")} - {_INTER} > 0 THEN {_INTER} / ({_area("p")} + {_area("t")} - {_INTER}) ELSE 0 END FOR p IN rest] AS iou
                  FROM (SELECT *, [{_INTER} FOR p IN rest] AS inters FROM (SELECT *, truth[k + 1] AS t FROM g WHERE k < len(truth)))))),
gr AS (SELECT prediction_id, class, CASE WHEN k > 0 THEN ious / k ELSE 0 END AS iou, inter, uni + coalesce(list_sum([{_area("b")} FOR b IN rest]), 0) AS uni FROM g WHERE k = len(truth))""".replace("[i / a FOR i, a IN inters] AS unused, ", "")
_RULE_FACTS = " UNION ALL ".join(
    f"SELECT prediction_id, '{i + 1}' AS class, {_clean(_scaled(f'$.{r}.bounding_box'))} AS pred, {_clean(f'coalesce(sample.{r}.bounding_box, [])')} AS truth, coalesce(v->>'$.{r}.reason', '') AS pr, coalesce(sample.{r}.reason, '') AS tr FROM s WHERE p{i + 1} AND t{i + 1}"
    for i, r in enumerate(RULES)
)
_MIOU = "CASE WHEN len(pred) = 0 AND len(truth) = 0 THEN NULL WHEN uni > 0 THEN inter / uni ELSE 0 END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def _gram_f1(a: str, b: str) -> str:
    """SQL: F1 of the sets of 1-grams and 2-grams."""
    grams = lambda x: f"[list_distinct(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) FOR t IN [{_tokens(x)}]][1]"
    return f"[CASE WHEN len(q.a) = 0 OR len(q.b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(q.a, q.b)) / (len(q.a) + len(q.b)) END FOR q IN [{{'a': {grams(a)}, 'b': {grams(b)}}}]][1]"


_SPACES = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _word_count(x: str) -> str:
    return f"len([w FOR w IN regexp_split_to_array({x}, '{_SPACES}') IF w <> ''])"


def _length_factor(a: str, b: str, floor: float) -> str:
    return f"exp(-0.5 * pow(({_word_count(a)} - {_word_count(b)}) / greatest({_word_count(b)} * 0.6, {floor}), 2))"


_CAPTION = "CASE WHEN schema_valid AND task = 'unified' AND trim(v->>'$.caption') <> '' THEN v->>'$.caption' ELSE 'empty' END"
_TRUE_CAPTION = "CASE WHEN trim(coalesce(sample.image_caption, '')) <> '' THEN sample.image_caption ELSE 'empty' END"


def evaluation_sql(keys: str, columns: tuple[str, ...]) -> str:
    """SQL: all families of metrics, long, for groups of answers; `keys` selects prediction_id and the key columns from s."""
    by = ", ".join(columns)
    overlap = lambda m: f"""{_ratio(f"sum(CASE WHEN e THEN 0 ELSE {m}i END)", "count(*)")} AS {m}_tn0, {_ratio(f"(sum(CASE WHEN e THEN 0 ELSE {m}i END) + count(*) FILTER (e))", "count(*)")} AS {m}_tn1,
      {_ratio(f"sum({m}x)", f"sum({m}u)")} AS {m}_micro, coalesce({_ratio(f"sum({m}i) FILTER (th)", "count(*) FILTER (th)")}, 0) AS {m}_exist, coalesce({_ratio(f"sum({m}x) FILTER (th)", f"sum({m}u) FILTER (th)")}, 0) AS {m}_exist_micro"""  # noqa: E731
    means = lambda m: ", ".join(f"avg({m}_{x}) AS {m}_macro_{x}" for x in ("tn0", "tn1", "exist"))
    measures = ("mask", "greedy")
    wide = [f"{m}_{x}" for m in measures for x in ("tn0", "tn1", "micro", "exist", "exist_micro", "macro_tn0", "macro_tn1", "macro_exist")]
    unpivot = lambda cte, names: " UNION ALL ".join(f"SELECT {by}, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {cte}" for n in names)
    rule_counts = " UNION ALL ".join(f"SELECT {by}, '{i}' AS rule, count(*) FILTER (p{i} AND t{i}) AS tp, count(*) FILTER (p{i} AND NOT t{i}) AS fp, count(*) FILTER (NOT p{i} AND t{i}) AS fn, count(*) FILTER (p{i} AND t{i} AND gated[{i}]) AS gtp FROM sk GROUP BY {by}" for i in range(1, 5))
    averages = lambda cte, name: f"""SELECT {by}, '{name}_f1_micro' AS metric, {_ratio("2 * sum(tp)", "(2 * sum(tp) + sum(fp) + sum(fn))")} AS value FROM {cte} GROUP BY {by}
      UNION ALL SELECT {by}, '{name}_f1_macro', avg({_ratio("2 * tp", "(2 * tp + fp + fn)")}) FROM {cte} GROUP BY {by}"""  # noqa: E731
    rf = _MASK.replace("FROM f)", "FROM rf)").replace("FROM f ", "FROM rf ").replace("x AS", "rx AS").replace("FROM x", "FROM rx").replace("cells", "rcells").replace("hit AS", "rhit AS").replace("JOIN hit", "JOIN rhit").replace("m AS", "rm AS").replace("f.", "rf.")
    rg = _GREEDY.replace("FROM f\n", "FROM rf\n").replace("g AS", "rg AS").replace("FROM g ", "FROM rg ").replace("gr AS", "rgr AS")
    return f"""WITH RECURSIVE {_PARSED}, {_CLASS_FACTS}, {_MASK}, {_GREEDY}, rf AS ({_RULE_FACTS}), {rf}, {rg},
keys AS ({keys}),
d AS (SELECT {by}, m.class, len(m.pred) > 0 AS p, len(m.truth) > 0 AS th, len(m.pred) = 0 AND len(m.truth) = 0 AS e, coalesce({_MIOU.replace("uni", "m.uni").replace("inter", "m.inter").replace("pred", "m.pred").replace("truth", "m.truth")}, 0) AS maski, m.inter AS maskx, m.uni AS masku,
             gr.iou AS greedyi, gr.inter AS greedyx, gr.uni AS greedyu
      FROM m JOIN gr ON gr.prediction_id = m.prediction_id AND gr.class = m.class JOIN keys k ON k.prediction_id = m.prediction_id JOIN s ON s.prediction_id = m.prediction_id WHERE s.task = 'unified'),
pc AS (SELECT {by}, class, count(*) FILTER (p AND th) AS tp, count(*) FILTER (p AND NOT th) AS fp, count(*) FILTER (NOT p AND th) AS fn FROM d GROUP BY {by}, class),
oc AS (SELECT {by}, class, {", ".join(map(overlap, measures))} FROM d GROUP BY {by}, class),
oa AS (SELECT {by}, {", ".join(map(overlap, measures))} FROM d GROUP BY {by}),
om AS (SELECT {by}, {", ".join(map(means, measures))} FROM oc GROUP BY {by}),
ow AS (SELECT * FROM oa JOIN om USING ({by})),
gl AS (SELECT prediction_id, [max(CASE WHEN class = '1' THEN iou END), max(CASE WHEN class = '2' THEN iou END), max(CASE WHEN class = '3' THEN iou END), max(CASE WHEN class = '4' THEN iou END)] AS ious FROM rgr GROUP BY 1),
sk AS (SELECT {", ".join(f"k.{c}" for c in columns)}, s.task AS own_task, s.json_valid, s.schema_valid, s.v, s.sample, {", ".join(f"p{i}, t{i}" for i in range(1, 5))}, [coalesce(x >= 0.25, false) FOR x IN coalesce(gl.ious, [NULL, NULL, NULL, NULL])] AS gated
       FROM s JOIN keys k ON k.prediction_id = s.prediction_id LEFT JOIN gl ON gl.prediction_id = s.prediction_id),
rc AS ({rule_counts}),
gc AS (SELECT {by}, rule, gtp AS tp, tp + fp - gtp AS fp, tp + fn - gtp AS fn FROM rc),
vi AS (SELECT {by}, rm.class AS rule, count(*) AS n, count(*) FILTER ({_MIOU} IS NULL) AS tn, sum(coalesce({_MIOU}, 0)) AS si, sum(inter) AS i, sum(uni) AS u FROM rm JOIN keys k ON k.prediction_id = rm.prediction_id GROUP BY {by}, rule),
va AS (SELECT {by}, sum(si) / sum(n) AS violation_iou_tn0_all, (sum(si) + sum(tn)) / sum(n) AS violation_iou_tn1_all, {_ratio("sum(i)", "sum(u)")} AS violation_iou_micro_all, sum(si / n) / 4 AS violation_iou_macro_tn0_all, sum((si + tn) / n) / 4 AS violation_iou_macro_tn1_all FROM vi GROUP BY {by}),
rs AS (SELECT {by}, rf.class AS rule, {_gram_f1("pr", "tr")} AS score FROM rf JOIN keys k ON k.prediction_id = rf.prediction_id),
ra AS (SELECT {by}, avg(score) AS reason_score_all FROM rs GROUP BY {by}),
rb AS (SELECT {by}, sum(x) / 4 AS reason_score_macro FROM (SELECT {by}, rule, avg(score) AS x FROM rs GROUP BY {by}, rule) GROUP BY {by}),
st AS (SELECT {by}, count(*) AS answers, count(*) FILTER (json_valid) / count(*) AS json_rate, count(*) FILTER (schema_valid) / count(*) AS schema_rate FROM sk GROUP BY {by}),
cp AS (SELECT {by}, {_CAPTION.replace("task", "own_task")} AS p, {_TRUE_CAPTION} AS t FROM sk WHERE own_task = 'unified'),
cw AS (SELECT {by}, avg({_word_count("p")}) AS words_avg, min({_word_count("p")}) AS words_min, max({_word_count("p")}) AS words_max, avg({_gram_f1("p", "t")}) AS ngram_f1 FROM cp GROUP BY {by}),
every AS ({unpivot("st", ["answers", "json_rate", "schema_rate"])} UNION ALL {averages("pc", "presence")} UNION ALL {unpivot("ow", wide)} UNION ALL {averages("rc", "violation")} UNION ALL {averages("gc", "gated")}
  UNION ALL {unpivot("va", [f"violation_iou_{x}_all" for x in ("tn0", "tn1", "micro", "macro_tn0", "macro_tn1")])} UNION ALL {unpivot("ra", ["reason_score_all"])} UNION ALL {unpivot("rb", ["reason_score_macro"])} UNION ALL {unpivot("cw", ["words_avg", "words_min", "words_max", "ngram_f1"])})"""


ORACLE["c7_full_evaluation"] = evaluation_sql("SELECT prediction_id, task AS k_task FROM s", ("k_task",)) + " SELECT k_task AS task, metric, round(value, 6) AS value FROM every"
ORACLE["c8_dual_pass"] = (
    evaluation_sql("SELECT prediction_id, task AS k_task, 'strict' AS k_pass FROM s UNION ALL SELECT prediction_id, task, 'valid' FROM s WHERE schema_valid", ("k_task", "k_pass"))
    + " SELECT k_task AS task, k_pass AS pass, metric, round(value, 6) AS value FROM every"
)
MODEL_VALUES = evaluation_sql("SELECT s.prediction_id, r.model_name AS k_run FROM s JOIN model_run r USING (run_id)", ("k_run",))

_FAULT = (
    "CASE WHEN NOT json_valid THEN 'json_parse_error' WHEN json_type(v) <> 'OBJECT' THEN 'schema_validation_error:object_type'"
    " WHEN task = 'unified' AND json_type(v->'$.caption') IS NULL THEN 'schema_validation_error:caption_missing' WHEN task = 'unified' AND json_type(v->'$.caption') <> 'VARCHAR' THEN 'schema_validation_error:caption_type' "
    + " ".join(f"WHEN NOT {_rule_ok(r)} THEN 'schema_validation_error:{r}_shape'" for r in RULES)
    + " "
    + " ".join(f"WHEN task = 'unified' AND json_type(v->'$.{c}') IS NOT NULL AND NOT {_box_list(f'$.{c}')} THEN 'schema_validation_error:{c}_shape'" for c in CLASSES)
    + " END"
)
ORACLE["c7_failures"] = f"""WITH {_PARSED}, x AS (SELECT prediction_id, raw_output, {_FAULT} AS fault FROM j)
SELECT prediction_id, split_part(fault, ':', 1) AS error_type, nullif(split_part(fault, ':', 2), '') AS detail, raw_output FROM x WHERE fault IS NOT NULL"""
ORACLE["a33_failure_reasons"] = f"WITH {_PARSED}, x AS (SELECT split_part({_FAULT}, ':', 1) AS reason FROM j) SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 10"
_OPENED = "(?is)```(?:json)?(.*)$"
ORACLE["a30_t26_failure_categories"] = f"""WITH {_PARSED},
x AS (SELECT json_valid, {_FAULT} AS fault, CASE WHEN regexp_matches(coalesce(raw_output, ''), '{_FENCE}') THEN body WHEN regexp_matches(coalesce(raw_output, ''), '{_OPENED}') THEN regexp_extract(raw_output, '{_OPENED}', 1) ELSE coalesce(raw_output, '') END AS t0 FROM j),
y AS (SELECT *, regexp_replace(t0, '^\\s+|\\s+$', '', 'g') AS t FROM x),
z AS (SELECT CASE WHEN fault IS NULL THEN 'valid' WHEN NOT json_valid THEN CASE WHEN len(replace(t, '{{', '')) < len(replace(t, '}}', '')) OR len(replace(t, '[', '')) < len(replace(t, ']', '')) OR len(t) > 3500 THEN 'truncated' ELSE 'other' END ELSE split_part(fault, ':', 2) END AS category FROM y)
SELECT category, count(*) AS n FROM z GROUP BY category"""
ORACLE["b7_greedy_iou"] = f"WITH RECURSIVE {_PARSED}, {_CLASS_FACTS}, {_GREEDY} SELECT prediction_id, class, round(iou, 6) AS iou, round(inter, 6) AS inter, round(uni, 6) AS uni FROM gr"

_ONE = evaluation_sql("SELECT prediction_id, 1 AS k_all FROM s", ("k_all",))
_WIDE = [f"{m}_{x}" for m in ("mask", "greedy") for x in ("tn0", "tn1", "micro", "exist", "exist_micro")]
_MACRO = [f"{m}_macro_{x}" for m in ("mask", "greedy") for x in ("tn0", "tn1", "exist")]
ORACLE["a5_a8_grounding_iou"] = (
    f"{_ONE} SELECT class, {', '.join(f'round({c}, 6) AS {c}' for c in _WIDE)}, {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in _MACRO)} FROM oc UNION ALL SELECT 'all', {', '.join(f'round({c}, 6)' for c in _WIDE)}, {', '.join(f'round({c}, 6)' for c in _MACRO)} FROM ow"
)
ORACLE["a13_iou_conditioned"] = f"""{_ONE}, k AS (SELECT *, {_PRF} FROM (SELECT rule, tp, fp, fn FROM gc UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM gc))
SELECT rule, tp, fp, fn, {_R6} FROM k UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM k WHERE rule <> 'micro'"""
ORACLE["a15_reasoning"] = f"""{_ONE} SELECT rule, count(*) AS pairs, round(avg(score), 6) AS score FROM rs GROUP BY rule UNION ALL SELECT 'all', count(*), round(avg(score), 6) FROM rs
UNION ALL SELECT 'macro', (SELECT count(*) FROM rs), round(reason_score_macro, 6) FROM rb"""
ORACLE["x1_caption_ngram_f1"] = f"{_ONE} SELECT round(ngram_f1, 6) AS ngram_f1 FROM cw"


def _renamed(sql: str, prefix: str, facts: str) -> str:
    """The CTEs of _MASK or _GREEDY over other facts, under other names."""
    for name in ("x", "cells", "hit", "m", "gr", "g"):
        sql = sql.replace(f"\n{name} AS (", f"\n{prefix}{name} AS (").replace(f"FROM {name})", f"FROM {prefix}{name})").replace(f"FROM {name} WHERE", f"FROM {prefix}{name} WHERE").replace(f"JOIN {name} h", f"JOIN {prefix}{name} h")
    return sql.replace("FROM f)", f"FROM {facts})").replace("FROM f\n", f"FROM {facts}\n").replace("FROM f LEFT", f"FROM {facts} f LEFT")


_SAID = " UNION ALL ".join(
    f"SELECT prediction_id, '{i + 1}' AS class, {_clean(_scaled(f'$.{r}.bounding_box'))} AS pred, {_clean(f'coalesce(sample.{r}.bounding_box, [])')} AS truth, coalesce(v->>'$.{r}.reason', '') AS pr, coalesce(sample.{r}.reason, '') AS tr FROM s WHERE {_p(r)} AND {_t(r)}"
    for i, r in enumerate(RULES)
)
_ALL_BOXES = f"""list_concat(CASE WHEN task = 'unified' THEN flatten([{", ".join(f"coalesce(from_json(v->'$.{c}', '[[\"DOUBLE\"]]'), [])" for c in CLASSES)}]) ELSE [] END,
  flatten([{", ".join(f"coalesce(from_json(v->'$.{r}.bounding_box', '[[\"DOUBLE\"]]'), [])" for r in RULES)}]))"""
_OWN = "v->>'$.caption'"
_SAID_CAPTION = f"CASE WHEN trim({_OWN}) <> '' AND trim(coalesce(sample.image_caption, '')) <> '' THEN {_gram_f1(_OWN, 'sample.image_caption')} * {_length_factor(_OWN, 'sample.image_caption', CAPTION_FLOOR)} ELSE 0 END"
_COMPONENTS = f"""WITH RECURSIVE {_PARSED}, {_CLASS_FACTS}, {_MASK}, {_GREEDY}, rf AS ({_SAID}), {_renamed(_MASK, "r", "rf")},
cg AS (SELECT prediction_id, sum(coalesce({_MIOU}, {NOTHING_THERE})) / 3 AS x FROM m GROUP BY 1),
gg AS (SELECT prediction_id, sum(iou) / 3 AS x FROM gr GROUP BY 1),
vg AS (SELECT prediction_id, avg(coalesce({_MIOU}, 0)) AS x FROM rm GROUP BY 1),
re AS (SELECT prediction_id, avg({_gram_f1("pr", "tr")} * {_length_factor("pr", "tr", REASON_FLOOR)}) AS x FROM rf WHERE trim(pr) <> '' AND trim(tr) <> '' GROUP BY 1),
k AS (SELECT s.*, {_TPFN(_p, _t)} AS tp, {_TPFN(_p, _not(_t))} AS fp, {_TPFN(_not(_p), _t)} AS fn FROM s),
c AS (SELECT k.prediction_id, task, json_valid, schema_valid, tp, fp, fn, gg.x AS greedy, CASE WHEN schema_valid AND task = 'unified' THEN {_gram_f1("v->>'$.caption'", "coalesce(sample.image_caption, '')")} ELSE 0 END AS grams,
  CASE WHEN schema_valid THEN 1.0 ELSE 0.0 END AS r_format, CASE WHEN schema_valid AND task = 'unified' THEN {_SAID_CAPTION} ELSE 0 END AS r_caption, CASE WHEN schema_valid THEN cg.x ELSE 0 END AS r_grounding,
  CASE WHEN NOT schema_valid THEN 0.0 WHEN tp + fp + fn = 0 THEN {NOTHING_THERE} WHEN tp > 0 THEN 5.0 * tp / (5.0 * tp + 4.0 * fn + fp) ELSE 0.0 END AS r_violation_id,
  CASE WHEN schema_valid THEN coalesce(vg.x, 0) ELSE 0 END AS r_violation_grounding, CASE WHEN schema_valid THEN coalesce(re.x, 0) ELSE 0 END AS r_reasoning,
  CASE WHEN schema_valid AND coalesce(list_max([len([y FOR y IN bx IF y = b]) FOR b IN list_distinct(bx)]), 0) > {REPETITION_OVER} THEN 1.0 ELSE 0.0 END AS repetition
  FROM (SELECT *, CASE WHEN schema_valid THEN {_ALL_BOXES} ELSE [] END AS bx FROM k) k JOIN cg USING (prediction_id) JOIN gg USING (prediction_id) LEFT JOIN vg USING (prediction_id) LEFT JOIN re USING (prediction_id)),
w AS (SELECT *, ({" + ".join(f"{x} * r_{n}" for n, x in WEIGHTS.items())}) * CASE WHEN repetition > 0 THEN {REPETITION_FACTOR} ELSE 1 END AS total FROM c)"""
_NAMES = [f"r_{n}" for n in WEIGHTS]
ORACLE["r8_r9_reward_breakdown"] = f"{_COMPONENTS} SELECT prediction_id, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in [*_NAMES, 'repetition', 'total'])} FROM w"
ORACLE["r8_reward_means"] = f"{_COMPONENTS} SELECT task, count(*) AS answers, {', '.join(f'round(avg({n}), 6) AS {n}' for n in [*_NAMES, 'repetition', 'total'])} FROM w GROUP BY task"
ORACLE["r11_task_rewards"] = f"{_COMPONENTS} SELECT prediction_id, {', '.join(f'round(CAST(r_{n} AS DOUBLE), 6) AS r_{n}' for n in ('format', 'violation_id', 'violation_grounding', 'reasoning'))}, round(CAST(0.1 * r_format + 0.4 * r_violation_id + 0.3 * r_violation_grounding + 0.2 * r_reasoning AS DOUBLE), 6) AS weighted FROM c WHERE task = 'violations_only'"
ORACLE["r12_legacy_rewards"] = f"""{_COMPONENTS} SELECT prediction_id, CASE WHEN json_valid THEN 1.0::DOUBLE ELSE 0.0 END AS r_json, round(CAST(grams AS DOUBLE), 6) AS r_caption,
  round(CAST(CASE WHEN NOT schema_valid THEN 0 WHEN tp + fp + fn = 0 THEN 1 WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0 END AS DOUBLE), 6) AS r_rules, round(CASE WHEN schema_valid THEN greedy ELSE 0 END, 6) AS r_boxes FROM c"""
RULE_SCORES = f"{_COMPONENTS}, o AS (SELECT c.prediction_id, s.image_id, s.run_id, r_violation_id FROM c JOIN s USING (prediction_id))"
TEXT_WORDS = f"""WITH {_PARSED}, t AS (SELECT 'truth' AS origin, 'caption' AS kind, sample.image_caption AS x FROM s UNION ALL SELECT 'answer', 'caption', CASE WHEN schema_valid AND task = 'unified' THEN v->>'$.caption' END FROM s
  {" ".join(f"UNION ALL SELECT 'truth', 'reason', coalesce(sample.{r}.reason, '') FROM s WHERE t{i} UNION ALL SELECT 'answer', 'reason', coalesce(v->>'$.{r}.reason', '') FROM s WHERE p{i}" for i, r in enumerate(RULES, 1))}),
u AS (SELECT origin, kind, {_word_count("x")} AS n FROM t WHERE x IS NOT NULL)"""
_words_of = lambda c, n: f"[array_to_string({c}[i:i + {n - 1}], ' ') FOR i IN range(1, len({c}) - {n - 2})]"
_STRATA = evaluation_sql(" UNION ALL ".join(f"SELECT prediction_id, '{m}' AS k_field, sample.{m} AS k_stratum FROM s WHERE sample.{m} IS NOT NULL" for m in METADATA), ("k_field", "k_stratum"))
ORACLE["a17_stratified_suite"] = _STRATA + " SELECT k_field AS field, k_stratum AS stratum, metric, round(value, 6) AS value FROM every"


def paper_sql(names: list[str]) -> str:
    return _STRATA + f" SELECT k_field AS field, k_stratum AS stratum, {', '.join(f"round(max(CASE WHEN metric = '{n}' THEN value END), 6) AS {n}" for n in names)} FROM every GROUP BY ALL"


def _consensus_sql(pred: str, truth: str, kept: str) -> str:
    return f"""WITH {_PARSED},
t AS (SELECT prediction_id, {_tokens(pred)} AS p, {_tokens(truth)} AS r FROM s WHERE {kept}),
pg AS ({" UNION ALL ".join(f"SELECT prediction_id, {n} AS n, unnest({_words_of('p', n)}) AS g FROM t" for n in range(1, 5))}),
rg AS ({" UNION ALL ".join(f"SELECT prediction_id, {n} AS n, unnest({_words_of('r', n)}) AS g FROM t" for n in range(1, 5))}),
pc AS (SELECT prediction_id, n, g, count(*) AS p FROM pg GROUP BY ALL), rc AS (SELECT prediction_id, n, g, count(*) AS r FROM rg GROUP BY ALL),
df AS (SELECT n, g, count(*) AS df FROM rc GROUP BY n, g),
b AS (SELECT coalesce(pc.prediction_id, rc.prediction_id) AS prediction_id, coalesce(pc.n, rc.n) AS n, coalesce(pc.g, rc.g) AS g, coalesce(p, 0) AS p, coalesce(r, 0) AS r
      FROM pc FULL JOIN rc ON pc.prediction_id = rc.prediction_id AND pc.n = rc.n AND pc.g = rc.g),
w AS (SELECT b.*, ln((SELECT CAST(count(*) AS DOUBLE) FROM t)) - ln(greatest(coalesce(df, 1), 1)) AS w FROM b LEFT JOIN df USING (n, g)),
u AS (SELECT prediction_id, n, sum(least(p, r) * w * r * w) AS dot, sqrt(sum(pow(p * w, 2))) AS np, sqrt(sum(pow(r * w, 2))) AS nr FROM w GROUP BY prediction_id, n),
c AS (SELECT prediction_id, sum(CASE WHEN np > 0 AND nr > 0 THEN dot / (np * nr) ELSE 0 END) AS x FROM u GROUP BY prediction_id)
SELECT t.prediction_id, round(2.5 * coalesce(x, 0) * exp(-pow(len(p) - len(r), 2) / 72.0), 6) AS score FROM t LEFT JOIN c USING (prediction_id)"""


ORACLE["x7_caption_consensus"] = _consensus_sql(_OWN, "coalesce(sample.image_caption, '')", "schema_valid AND task = 'unified'")
ORACLE["x10_caption_suite"] = f"""SELECT 'caption_' || metric AS metric, round(value, 6) AS value FROM ({_ONE} SELECT metric, value FROM every WHERE metric IN ('words_avg', 'words_min', 'words_max', 'ngram_f1'))
UNION ALL SELECT 'caption_ciderd', round(avg(score), 6) FROM ({_consensus_sql(_CAPTION, _TRUE_CAPTION, "task = 'unified'").replace("round(2.5", "(2.5").replace("72.0), 6)", "72.0))")})"""
