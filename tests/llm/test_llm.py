"""The llm operators against brute force, exact round trips and edge cases."""

import json
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("girder.llm")
from girder.llm import answers, cooccurrence, mixing, overlap, sampling, subjects, tokenizing, truncation  # noqa: E402

# p2 and p6
PROMPT = 'Look at the photo and report on safety. Answer with one JSON block only. Shape: {"caption":"text","excavator":[[xmin, ymin, xmax, ymax]]}'
NULLS = '{"rule_1_violation": null, "rule_2_violation": null, "rule_3_violation": null, "rule_4_violation": null}'


def found(text, lang="en"):
    return answers.defects(answers.read(text), PROMPT, lang)


@pytest.mark.parametrize(
    ("text", "defect"),
    [
        (None, "empty"), ("", "empty"), (" ​ ", "empty"), ("```json\n```", "empty"), ("<json></json>", "empty"), ("null", "empty"), ("```json\nnull\n```", "empty"), ('""', "empty"), ("[{}]", "empty"), ("{ }", "empty"),
        ("I'm sorry, but I cannot comply with this instruction.", "refusal"), ('{"caption": "I won’t judge whether the persons follow the rules."}', "refusal"), ("Dabei kann ich nicht helfen.", "refusal"), ("Prefiero no dar un juicio.", ["refusal", "other_language"]),
        ("Sorry for the delay. " + NULLS, None), ("I cannot see every corner, but this is my reading:\n" + NULLS, None), (NULLS, None), ("Nothing else needs attention.", None),
        (PROMPT, "copied_prompt"), (PROMPT.upper(), "copied_prompt"), ("> " + PROMPT.replace("safety", "now"), "copied_prompt"), ("Look at the photo and report on safety.\n\n" + NULLS, None),
        ('{"caption":"text","excavator":[[xmin, ymin, xmax, ymax]]}', "copied_prompt"),
        ('{"caption": "Der Boden ist trocken und die Absperrung wirkt stabil, neben der Rampe steht ein Kran."}', "other_language"), ('{"caption": "The ground is dry and a barrier runs by the ramp “Helmpflicht und die Sicherheit”."}', None),
        ('{"caption": "Строительная площадка."}', "other_language"),
    ],
)
def test_defect_rules(text, defect):
    assert found(text) == (defect if isinstance(defect, list) else [defect] if defect else [])


DECLINING = [
    "Unfortunately the picture can not be judged by me, so there is no report.", "I'm afraid I am not in a position to evaluate what is going on here.", "We do not offer opinions about people at work.",
    "Sorry, the attachment could not be opened.", "No image was attached, please upload it again.", "I refuse to answer.", "I don't feel able to rate this scene. You should ask a certified inspector.",
    "Ich bin nicht in der Lage, dieses Foto zu beurteilen.", "Leider konnte das Bild nicht geöffnet werden.", "Dazu gebe ich keine Auskunft.", "Ohne Ortsbesichtigung kann ich das nicht bewerten.",
    "No estoy en condiciones de valorar esta escena.", "La imagen no se pudo abrir, envíela otra vez por favor.", "Je ne suis pas en mesure d'évaluer cette photo.", "L'image n'a pas pu être ouverte.",
    "Non posso valutare questa immagine.", "A imagem não foi carregada.", "Não posso avaliar as pessoas desta foto.", "Ik kan deze foto niet beoordelen.", "Nie mogę ocenić tego zdjęcia.",
    "I cannot help with this request. " * 20, "I am sorry. " + "A picture of a site holds people who have not agreed to be rated by me, and I will not judge their work. " * 8,
]
ASSESSING = [
    "The picture shows a worker without a helmet. A guard can not be seen behind the scaffold.", "No harness is visible in the picture. The guard rail is missing on the left.", "Auf dem Foto ist kein Helm zu sehen. Der Kran steht still.",
    "En la foto no se ve ningún arnés. La grúa está parada.", "Aucun garde-corps n'est visible sur la photo.", "Nella foto non si vede nessuna imbracatura, la gru è ferma.", "Op de foto is geen helm te zien.", "Na zdjęciu nie widać kasku.",
    "Sorry for the delay. The trench has no edge protection and two workers stand close to it; the ladder is not tied.", "I cannot judge the far side. Rule 2 is broken: a welder has no harness.",
    "I can't describe everything. " + "Two workers carry planks past the crane and a dumper waits by the gate. " * 6,
]


@pytest.mark.parametrize(("texts", "refusal"), [(DECLINING, True), (ASSESSING, False)])
def test_refusals_by_structure(texts, refusal):
    assert [x for x in texts if ("refusal" in answers.defects(answers.read(x), None, None)) != refusal] == []


def test_every_rule_fires_by_itself():
    assert answers.defects(answers.read("Dabei kann ich nicht helfen, weil das die Sicherheit der Leute auf dem Bild betrifft."), None, "en") == ["refusal", "other_language"]


@pytest.mark.parametrize(
    ("text", "lang", "other"),
    [
        ("Рабочий стоит без каски у края котлована.", "ru", None), ("Рабочий стоит без каски у края котлована.", "en", "cyrillic"), ("Рабочий стоит без каски у края котлована.", "RU-ru", None), ("The worker is near the edge of the pit.", "ru", "latin"),
        ("作業員が掘削機の近くに立っています。", "ja", None), ("作業員が掘削機の近くに立っています。", "ar", "cjk"), ("Arbetaren står utan hjälm vid kanten av gropen.", "sv", None), ("العامل يقف بدون خوذة", "ar", None), ("العامل يقف بدون خوذة", "de", "arabic"),
    ],
)
def test_scripts_follow_the_expected_language(text, lang, other):
    assert answers.language_of(text, lang) == other


@pytest.mark.parametrize("text", ["[" + " " * 500 + "]", "```json\n[" + "[], " * 150 + "null]\n```", '["' + " " * 600 + '"]', "<json>" + "\u200b" * 400 + "</json>"])
def test_long_empty_values(text):
    assert found(text) == ["empty"]
    assert found(text.replace("[", '[{"a": 1}, ', 1) if "[" in text else text + "x") != ["empty"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet='{}[]":,abc \n`\\\'', max_size=60))
@example("{{}}")
def test_reading_never_raises(text):
    reading = answers.read(text)
    answers.ending(reading)
    answers.defects(reading, PROMPT, "en")
    assert reading.state in ("empty", "open", "closed", "prose")


@pytest.mark.parametrize(
    ("text", "kind", "whole"),
    [
        ('{"caption": "a b c.", "x": 1}', "object", True), ('{"caption": "a b c.", "x', "object", False), ('{"caption": "a b c", "x": 1}', "caption", None), ("The rules are kept.", "prose", True), ("The rules are ke", "prose", None),
        ("The rules are kept...", "prose", None), ('```json\n{"a": [1, 2]}', "object", True), ('{"a": [1, 2', "object", False), ("{'a': 'it', 'b': 'x",  "object", False), ('{"a": 1}\n```\nLet me know', "tail", None), ("a [cut]", "prose", None),
    ],
)
def test_endings(text, kind, whole):
    end = answers.ending(answers.read(text))
    assert (end.kind, end.whole) == (kind, whole)


def test_limits_are_found():
    r = np.random.default_rng(1)
    lengths = np.exp(r.normal(6, 0.4, 4000)).astype(int)
    rows = [(n, 0) for n in lengths[:3000]] + [(min(n, 480), int(n > 480)) for n in lengths[3000:]]
    pdf = pd.DataFrame(rows, columns=["length", "unstopped"]).assign(n=1)
    out = truncation.limits_of(pdf)
    assert list(out["length"]) == [480] and out["posterior"].iloc[0] > 0.9
    assert truncation.limits_of(pdf.iloc[:0]).empty


def judged(spark, rows):
    df = spark.createDataFrame(rows, "id BIGINT, source STRING, raw_output STRING, prompt STRING, lang STRING, chars INT")
    return {r["id"]: r for r in truncation.judged(truncation.examined(df, "id"), "id").collect()}


def test_truncation(spark):
    words = ["kept", "fine", "safe", "good"]
    rows = [(i, "a" if i % 2 else None, f"The rules are {words[i % 4]}" + "." * (i % 5 > 0), PROMPT, "en", 1) for i in range(400)]
    rows += [(900, "a", "The rules ar", PROMPT, "en", 1), (901, "a", '{"caption": "a b', PROMPT, "en", 1), (902, "a", None, None, None, 1), (903, None, "I cannot comply", PROMPT, "en", 1)]
    rows += [(1000 + i, "b", ("word " * 40)[:100], PROMPT, "en", 1) for i in range(9)]
    got = judged(spark, rows)
    assert {i for i, r in got.items() if r["truncated"]} == {900, 901, 903, *range(1000, 1009)}
    assert got[902]["defects"] == ["empty"] and got[903]["defects"] == ["refusal"] and len(got) == len(rows)
    assert got[901]["evidence"] == "object" and got[900]["evidence"] == "ending" and got[902]["evidence"] is None
    assert judged(spark, []) == {}


def test_limits_in_characters_have_no_echo_in_bytes(spark):
    r = random.Random(4)
    words = ["kept", "fine", "safe", "dry", "über", "loose"]
    text = lambda n: " ".join(f"{r.choice(words)}{r.randrange(99)}" for _ in range(n))
    rows = [(i, "a", text(r.randrange(10, 80)) + " all is fine.", PROMPT, "en", 1) for i in range(600)] + [(1000 + i, "a", text(60)[:200], PROMPT, "en", 1) for i in range(200)]
    rows += [(2000 + i, "a", "Nothing was found on", PROMPT, "en", 1) for i in range(40)]  # a repeated text is no limit
    df = spark.createDataFrame(rows, "id BIGINT, source STRING, raw_output STRING, prompt STRING, lang STRING, chars INT")
    found = [(x["measure"], x["length"]) for x in truncation.limits(truncation.examined(df, "id")).collect()]
    assert found == [("chars", 200)]


# p3
def test_overlaps_equal_brute_force(spark):
    r = random.Random(5)
    nouns = [f"noun{i}" for i in range(400)]
    make = lambda: ". ".join(" ".join(r.choice(nouns) for _ in range(9)) for _ in range(5)) + "."
    rows = [(i, r.choice(["train", "val", "test"]), f"{i:07}", make(), 1) for i in range(250)]
    for i in range(60):
        words = rows[i][3].split(" ")
        for _ in range(r.choice([0, 2, 4])):
            words[r.randrange(len(words))] = r.choice(nouns)
        sentences = " ".join(words).split(". ")
        r.shuffle(sentences)
        rows.append((1000 + i, r.choice(["train", "test"]), f"{2000 + i}", ". ".join(sentences).upper(), 1))
    rows += [(3000, "train", "IMG_0000007.jpg", None, 1), (3001, "val", " 7", "", 1), (3002, None, "7", rows[0][3], 1), (3003, "val", None, "  ", 1)]
    rows.append(rows[0])  # sent again under the same id
    df = spark.createDataFrame(rows, "id BIGINT, split STRING, image STRING, caption STRING, canon INT")
    got = {tuple(x) for x in overlap.split_overlaps(df, "id", "split", "image", "caption").collect()}
    canon = {x[0]: "\n".join(map(" ".join, overlap.canonical(x[3] or ""))) for x in rows}
    number = lambda s: int("".join(c for c in s if c.isdigit())) if s else None
    want = {
        (e[0], t[0]) for e in rows if e[1] in ("val", "test") for t in rows
        if t[1] == "train" and ((number(e[2]) is not None and number(e[2]) == number(t[2])) or (canon[e[0]] and canon[t[0]] and overlap.same_wording(canon[e[0]], canon[t[0]])))
    }
    assert got == want and len(want) > 20
    counts = {x["eval_id"]: x["pairs"] for x in overlap.overlap_counts(df, "id", "split", "image", "caption").collect()}
    assert counts == Counter(e for e, _ in want)
    assert overlap.split_overlaps(df.limit(0), "id", "split", "image", "caption").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=64, max_size=64), min_size=1, max_size=40), st.integers(1, 45))
def test_added_bit_rows(rows, least):
    packed = [np.packbits(np.array(r), bitorder="little").view(np.uint64) for r in rows]
    got = np.unpackbits(overlap.at_least(packed, least).view(np.uint8), bitorder="little").astype(bool)
    assert (got == (np.array(rows).sum(axis=0) >= least)).all()


@pytest.mark.parametrize("codes", [1 << 16, 50])
def test_the_prefix_filter_misses_nothing(monkeypatch, codes):
    """All lengths from one word, a small vocabulary, blocks that end anywhere, and codes that many words share."""
    for name, value in (("CODES", codes), ("ROW_BITS", 100), ("TOGETHER", 7)):
        monkeypatch.setattr(overlap, name, value)
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30]))) for _ in range(500)]
    rows = [overlap.code_row(t, {}) for t in texts]
    side = lambda ids: overlap.pa.table({"class_id": ids, "words": [len(rows[i]) for i in ids], "codes": [rows[i].tobytes() for i in ids]})
    out = overlap.possible_pairs(side(list(range(200))), side(list(range(200, 500)))).to_pydict()
    want = {(e, t) for e in range(200) for t in range(200, 500) if overlap.same_wording(texts[e], texts[t])}
    got = set(zip(out["eval_class"], out["train_class"], strict=True))
    assert want <= got and len(want) > 50 and (codes == 50 or got == want)
    assert overlap.possible_pairs(side([0]), side([1]).slice(1)).num_rows == 0


def test_a_hot_group_of_near_copies_is_found(spark):
    base = "The lime barrier runs by two skips near the far column while five painters rest against the wall today"
    rows = [(i, "train" if i % 2 else "test", str(i), f"{base} extra{i}.", 1) for i in range(120)] + [(500 + i, "test", str(500 + i), f"other{i} words{i} stand{i} here{i} alone{i}.", 1) for i in range(120)]
    df = spark.createDataFrame(rows, "id BIGINT, split STRING, image STRING, caption STRING, canon INT")
    assert overlap.split_overlaps(df, "id", "split", "image", "caption").count() == 60 * 60


def edited(r, words, share, name):
    """`words` with `share` of them changed to words nobody else has, at scattered places."""
    out = list(words)
    for at in r.sample(range(len(out)), int(share * len(out))):
        out[at] = f"{name}x{at}"
    return out


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_a_large_group_of_edited_copies_is_found(spark, share):
    r = random.Random(8)
    base = [f"w{i}" for i in range(124)]
    captions = [edited(r, base, share * r.choice([0, 0.5, 1]), f"copy{i}") for i in range(80)] + [[f"o{i}n{k}" for k in range(124)] for i in range(300)]
    rows = [(i, "train" if i % 2 else "test", None, " ".join(c), 1) for i, c in enumerate(captions)]
    df = spark.createDataFrame(rows, "id BIGINT, split STRING, image STRING, caption STRING, canon INT")
    got = {tuple(x) for x in overlap.split_overlaps(df, "id", "split", "image", "caption").collect()}
    want = {(e[0], t[0]) for e in rows[:80] for t in rows[:80] if e[1] == "test" and t[1] == "train" and overlap.same_wording(e[3], t[3])}
    assert got == want and len(want) > 500


@pytest.mark.parametrize(("copies", "changed"), [(200, 2), (200, 4), (200, 8), (30, 4), (30, 8)])
def test_groups_of_short_captions_from_a_small_vocabulary(spark, copies, changed):
    r = random.Random(11)
    draw = lambda n: [f"v{r.randrange(800)}" for _ in range(n)]
    base, captions = draw(40), []
    for _ in range(copies):
        own = list(base)
        for at in r.sample(range(40), changed):
            own[at] = draw(1)[0]
        captions.append(own)
    captions += [draw(40) for _ in range(1000)]
    rows = [(i, "train" if i % 2 else "test", None, " ".join(c), 1) for i, c in enumerate(captions)]
    got = {tuple(x) for x in overlap.split_overlaps(spark.createDataFrame(rows, "id BIGINT, split STRING, image STRING, caption STRING, canon INT"), "id", "split", "image", "caption").collect()}
    assert got == {(e[0], t[0]) for e in rows for t in rows if e[1] == "test" and t[1] == "train" and overlap.same_wording(e[3], t[3])}


def test_scattered_edits_of_ordinary_captions_are_found(spark):
    r = random.Random(9)
    phrases = [[f"p{i}w{k}" for k in range(12)] for i in range(40)]  # all captions draw on these, so most of their word pairs are common
    captions = [[w for p in r.sample(phrases, 9) for w in p] + [f"own{i}n{k}" for k in range(16)] for i in range(200)]
    rows = [(i, "train", None, " ".join(c), 1) for i, c in enumerate(captions)]
    shares = (0.05, 0.1, 0.15, 0.2, 0.24)
    rows += [(1000 * (k + 1) + i, "val", None, " ".join(edited(r, captions[i], s, f"e{k}n{i}")), 1) for k, s in enumerate(shares) for i in range(40)]
    df = spark.createDataFrame(rows, "id BIGINT, split STRING, image STRING, caption STRING, canon INT")
    got = {tuple(x) for x in overlap.split_overlaps(df, "id", "split", "image", "caption").collect()}
    assert {(1000 * (k + 1) + i, i) for k in range(len(shares)) for i in range(40)} <= got
    assert got == {(e[0], t[0]) for e in rows[200:] for t in rows[:200] if overlap.same_wording(e[3], t[3])}


@pytest.mark.parametrize("other", ["THE  WALL, is: wet!", "Ｔｈｅ ｗａｌｌ ｉｓ ｗｅｔ", "The wаll is wеt", "The wall​ is wet", "The wáll is wet"])
def test_canonical_forms(other):
    words = [w for s in overlap.canonical(other) for w in s]
    assert words == ["the", "wall", "is", "wet"]


# p4
def test_sample_is_the_apportionment(spark):
    r = random.Random(2)
    rows = [(i, r.choice("aaaaab") if i % 50 else None, i % 2, 5) for i in range(2000)] + [(5000, "c", 0, 5)]
    df = spark.createDataFrame(rows, "id BIGINT, kind STRING, flag INT, share INT")
    targets = [("a", 0, 40, 5), ("a", 1, 20, 5), ("b", 0, 20, 5), ("b", 1, 10, 5), ("c", 0, 10, 3), ("z", 0, 5, 2)]
    t = spark.createDataFrame(targets, "kind STRING, flag INT, share BIGINT, min_rows BIGINT")
    plan = sampling.SamplePlan("id", ("kind", "flag"), 200)
    got = sampling.proportional_sample(df, t, plan).collect()
    have = Counter((x[1], x[2]) for x in rows)
    seats = sorted(((0 if k <= m else 1, (k - 0.5) / s, kind, flag) for kind, flag, s, m in targets for k in range(1, have[kind, flag] + 1)))[:200]
    assert Counter((x["kind"], x["flag"]) for x in got) == Counter((k, f) for *_, k, f in seats) and len({x["id"] for x in got}) == 200
    assert sorted(map(tuple, sampling.proportional_sample(df, t, plan).collect())) == sorted(map(tuple, got))
    report = {(x["kind"], x["flag"]): x for x in sampling.sample_report(df, t, plan).collect()}
    assert report["c", 0]["short"] == max(3, 200 * 10 // 105) - 1 and report["z", 0]["available"] == 0 and report["a", 0]["short"] == 0
    assert sampling.proportional_sample(df.limit(0), t, plan).count() == 0 and sampling.proportional_sample(df, t.limit(0), plan).count() == 0


def test_short_cells_come_from_the_draw(spark, monkeypatch):
    from girder.llm import queries

    cells = [("a", 0)] * 200 + [("a", 1)] * 97 + [("b", 0)] * 3
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "sample_id BIGINT, illumination STRING, rule_4 BIGINT")
    targets = spark.createDataFrame([("a", 0, 500, 5), ("a", 1, 300, 50), ("b", 0, 100, 1), ("b", 1, 10, 2)], "illumination STRING, rule_4 BIGINT, share BIGINT, min_rows BIGINT")
    needed = {("a", 0): 150, ("a", 1): 90, ("b", 0): 30, ("b", 1): 3}
    monkeypatch.setattr(queries, "_cells", lambda *_: (rows, targets, sampling.SamplePlan("sample_id", ("illumination", "rule_4"), 30)))
    drawn, draw = [], sampling.proportional_sample
    monkeypatch.setattr(sampling, "proportional_sample", lambda *a: drawn.append(draw(*a)) or drawn[-1])
    got = {tuple(x) for x in queries.p4_found(spark, "").collect()}
    taken = Counter((x["illumination"], x["rule_4"]) for x in drawn[-1].collect())
    assert got == {("b", 0), ("b", 1)} == {c for c in needed if taken[c] < needed[c]} and taken["b", 0] == 3


# p5
@pytest.mark.parametrize("heavy", [0, 3, 1000])
def test_pairs_equal_brute_force(spark, heavy):
    r = random.Random(4)
    items = [f"i{int(r.paretovariate(0.7)) % 300}" for _ in range(4000)]
    baskets = [(i, [r.choice(items) for _ in range(r.randrange(9))] + [None] * (i % 3 == 0)) for i in range(300)] + [(999, None)]
    got = {(x["item_a"], x["item_b"]): x for x in cooccurrence.pair_counts(spark.createDataFrame(baskets, "baskets INT, items ARRAY<STRING>"), "items", heavy).collect()}
    want, single = Counter(), Counter()
    for _, b in baskets:
        own = sorted({x for x in b or [] if x is not None})
        single.update(own)
        want.update((a, c) for i, a in enumerate(own) for c in own[i + 1 :])
    assert {k: v["joint"] for k, v in got.items()} == dict(want)
    k, v = next(iter(got.items()))
    assert v["rows_a"] == single[k[0]] and v["lift"] == pytest.approx(v["joint"] * 301 / (single[k[0]] * single[k[1]]))
    assert cooccurrence.pair_counts(spark.createDataFrame([], "items ARRAY<STRING>"), "items").count() == 0


# p8
@pytest.fixture(scope="module")
def encoder():
    return tokenizing.Encoder(tokenizing.read_ranks())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizing.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="abz'sdtrelvm \n\t 　.,!<|>09éß中“_-", max_size=900))
def test_encoding_is_exact(encoder, reference, text):
    assert encoder.encode(text) == reference(text)
    assert "".join(encoder.fragments(text)) == text


def test_long_runs_and_odd_texts(spark, encoder, reference):
    r = random.Random(1)
    texts = ["", None, " ", "<|endoftext|>", "x" * 3000, "".join(r.choice("abcxyzQZ'_-9!") for _ in range(5000)), "\r\n\r\n a", "\U0001f477‍♀️" * 400, "a b " * 20_000]
    for t in texts:
        assert encoder.encode(t) == (reference(t) if t else [])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").withColumn("ids", F.lit(1))
    got = {x["doc_id"]: x["ids"] for x in tokenizing.encoded(df, ["doc_id"], "text").collect()}
    assert got == {i: encoder.encode(t) for i, t in enumerate(texts)}
    assert {x["doc_id"]: x["tokens"] for x in tokenizing.token_counts(df, ["doc_id"], "text").collect()} == {k: len(v) for k, v in got.items()}
    assert tokenizing.encoded(df.limit(0), ["doc_id"], "text").count() == 0


# p9
def test_mix(spark):
    r = random.Random(3)
    docs = [(i, r.choices(["big", "mid", "small", None], [60, 30, 5, 5])[0], r.choice([0, 50, 100, 300])) for i in range(3000)]
    sizes = spark.createDataFrame(docs, "doc_id BIGINT, source STRING, tokens BIGINT")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("gone", 0.1, 2), ("none", 0.0, 1)], "source STRING, weight DOUBLE, max_repeats BIGINT")
    plan = mixing.MixPlan(block_tokens=200, seats_per_shard=100)
    used, report = mixing.mixture(sizes, targets, plan)
    rows = used.collect()
    repeats = Counter(x["doc_id"] for x in rows)
    limit = {"big": 1, "mid": 2, "small": 3}
    assert all(repeats[x["doc_id"]] <= limit[x["source"]] and x["use_no"] <= limit[x["source"]] and x["tokens"] > 0 for x in rows)
    assert max(Counter((x["doc_id"], x["use_no"]) for x in rows).values()) == 1 and len({x["shard"] for x in rows}) > 1
    shares = {x["source"]: x["share"] for x in report.collect()}
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert shares[s] == pytest.approx(w / 0.9, abs=0.02)
    assert shares["gone"] == 0 and sum(shares.values()) == pytest.approx(1)
    more = mixing.mixture(sizes, targets, mixing.MixPlan(block_tokens=200, total_tokens=10**9))[1].collect()
    assert {x["source"]: x["tokens"] for x in more if x["source"] in limit} == {x["source"]: x["capacity"] for x in more if x["source"] in limit}
    empty, nothing = mixing.mixture(sizes.limit(0), targets, plan)
    assert empty.count() == 0 and nothing.agg(F.sum("tokens")).first()[0] == 0


# p10
def test_subjects_on_held_out_documents(spark):
    r = random.Random(6)
    terms = {"law": ["court bundle", "tribunal ruling", "permit condition"], "sport": ["cup draw", "relay team", "goalkeeper"], "finance": ["unpaid invoice", "hire rate", "budget line"]}
    frames = ["It was noted that the {} came up again.", "We agreed that the {} is open.", "Compared with last week, the {} was discussed."]
    neutral = ["Please reply to the usual address.", "Nothing else was raised.", "The next issue follows in two weeks."]
    docs, truth, labels = [], {}, []
    for i in range(400):
        own = r.sample(sorted(terms), r.choice([0, 1, 1, 2]))
        lines = [r.choice(frames).format(r.choice(terms[s])) for s in own for _ in range(4)] + [r.choice(neutral) for _ in range(3)]
        r.shuffle(lines)
        docs.append((i, " ".join(lines), "s" if i % 3 else None, i % 7, 1))
        truth[i] = set(own)
        if own and i < 200:
            labels.append((i, own[0] if r.random() > 0.05 else r.choice(sorted(terms)), "r"))
    docs += [(1000, None, None, None, 1), (1001, "", "s", 1, 1), (1002, "   \n", "s", 1, 1), (1003, "7 7 7", "s", 1, 1)]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING, site_id BIGINT, subject INT")
    a = spark.createDataFrame([(s, "x") for s in terms], "subject STRING, description STRING")
    la = spark.createDataFrame(labels, "doc_id BIGINT, subject STRING, rater STRING")
    got: dict = {}
    for x in subjects.assigned(d, la, a).collect():
        got.setdefault(x["doc_id"], set()).add(x["subject"])
    right = sum(got.get(i, set()) == truth[i] for i in range(200, 400))
    assert right >= 160 and not {1000, 1001, 1002, 1003} & got.keys()
    assert subjects.assigned(d.limit(0), la, a).count() == 0


def test_sentences():
    text = "# Note 5\n\nNo. 7 on the list, the sump, is dry. One more thing!\n- sump: cracked along the crest, as the record shows We agreed.\n```json\n{\"a\": 1}\n```\n\n[3] Second part here"
    spoken = lambda text: [n for section in subjects.sentences(text) if (n := sum(len(subjects.words_of(s)) > 1 for s in section))]
    assert spoken(text) == [4, 1]
    assert spoken(None) == [] and spoken("12 34 56") == []


def test_lexicon_votes_are_the_sums_of_its_table():
    parts = {"en": ({"the": 0, "wall": 1, "the wall": 2, "wet": 3}, np.array([[0, 0, 1.0], [0, 3, 0], [0, 2.5, 0], [1, 0, 0]])), "de": ({"die": 0, "wand": 1}, np.array([[0, 0, 2.0], [0, 0, 4.0]]))}
    lexicon = subjects.Lexicon(["a", "b"], parts)
    assert lexicon.votes([["the", "wall", "is"], ["die", "wand"], ["wall"], [], ["the", "unseen"]]) == [(1, 4.5), (2, 6.0), (-1, 0.0), (-1, 0.0), (2, 1.0)]
    assert subjects.language(["the", "die", "und"]) == "de" and subjects.language(["x"]) == ""


def test_query_names():
    from girder.llm import queries

    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 10)} | {"p8_ids", "p9_mix"} <= set(queries.QUERIES) and set(queries.ORACLE) <= set(queries.QUERIES)
    assert json.dumps(sorted(queries.ORACLE))
