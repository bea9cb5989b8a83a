"""p10: the subject areas a document deals with, by labelling functions and an accuracy-learning model.

A lexicon per language is learned from a bounded sample of labelled documents: an EM over their
sentences, whose subjects are latent (a label says only that the document deals with a subject, and
some are wrong).
Then every sentence of every document gets votes: the lexicon, sure and unsure; the section it stands
in; the source and the address (site) of its document. A latent-class model learns from the counts of
all vote patterns of the corpus how accurate each function is; the posterior of a pattern gives the
subject of its sentences, and a document has the subjects of at least a fifth of its sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .answers import FUNCTION_WORDS

#: Bounds of the lexicon's training sample: documents, taken in the order of a hash, and characters of one of them.
MOST_LABELLED, LONGEST_LABELLED = 20_000, 100_000
#: Sentences whose scores are summed at once, and sentences whose votes a task remembers.
AT_ONCE, REMEMBERED = 4_096, 200_000
SHARE = 0.2
#: Log odds between the two best subjects from which a lexicon vote is certain, sure, or a vote at all.
CERTAIN, SURE, UNSURE = 8.0, 4.0, 1.0
ABSTAIN, NOTHING = -1, 0  # votes; subjects are numbered from 1 in alphabetical order
_LANGUAGES = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
VOTERS = ("certain", "sure", "unsure", "section", "source_vote", "address_vote")

#: Share of sentences without a subject that the lexicon's model supposes in every document.
NO_SUBJECT = 0.3
#: Accuracies the model starts from, by voter, and how many votes a class this start is worth.
FIRST_ACCURACY, PRIOR_VOTES = (0.995, 0.95, 0.6, 0.6, 0.3, 0.2), 50.0

_BLOCK = re.compile(r"```.*?(?:```|$)|<[^<>]{1,60}>|^[ \t]*\{[^\n]*\}[ \t]*$", re.S | re.M)
_HEADING = re.compile(r"^\s*#.*$", re.M)
_LINE = re.compile(r"[\r\n]+|(?<=[.!?。！？])[\s\u200b]+|\s(?=-\s)")
_ITEM_END = re.compile(r"(?<=[a-z0-9)])\s+(?=[A-Z][a-z]*\s[a-z])")
_SECTION = re.compile(r"(?:\r?\n[ \t]*){2,}")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def words_of(piece: str) -> list[str]:
    return _WORD.findall(piece.casefold().replace("’", "'"))


def sentences(text: str | None) -> list[list[str]]:
    """The sentences and list lines of each section; headings and blocks of code are none.

    Pieces without two words are no sentences either; words_of decides that for the caller, who needs the words.
    """
    if not text:
        return []
    out = []
    for section in _SECTION.split(_HEADING.sub("", _BLOCK.sub(" ", text))):
        pieces = []
        for piece in _LINE.split(section):
            if piece.startswith("- ") and ":" in piece:
                pieces += _ITEM_END.split(piece, maxsplit=1)
            else:
                pieces.append(piece)
        kept = [p for p in pieces if len(p) > 2]
        if kept:
            out.append(kept)
    return out


def features(words: list[str]) -> list[str]:
    """Words and pairs of neighbouring words, without numbers."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


_SPOKEN_IN: dict[str, list[int]] = {}
for _number, _own in enumerate(_LANGUAGES.values()):
    for _w in _own:
        _SPOKEN_IN.setdefault(_w, []).append(_number)
_NAMES = list(_LANGUAGES)


def language(words: list[str]) -> str:
    """The language with most function words in the sentence, the first of equals, '' if it has none."""
    scores = [0] * len(_NAMES)
    for w in words:
        for number in _SPOKEN_IN.get(w, ()):
            scores[number] += 1
    most = max(scores)
    return _NAMES[scores.index(most)] if most else ""


class Lexicon:
    """Log probabilities of features under 'no subject' (column 0) and each subject, all languages in one table.

    A word has one number, a pair the numbers of its words; the rows of a language's features are found by
    these numbers, so no text is put together for a vote.
    """

    def __init__(self, subjects: list[str], parts: dict[str, tuple[dict[str, int], np.ndarray]]) -> None:
        self.subjects = subjects
        self.table = np.vstack([np.zeros((0, len(subjects) + 1)), *[table for _, table in parts.values()]])
        self.word_number: dict[str, int] = {}
        self.rows: dict[str, dict[int, int]] = {}
        first = 0
        for lang, (index, table) in parts.items():
            rows = self.rows[lang] = {}
            for feature, row in index.items():
                numbers = [self.word_number.setdefault(w, len(self.word_number) + 1) for w in feature.split(" ")]
                rows[numbers[0] if len(numbers) == 1 else numbers[0] << 32 | numbers[1]] = first + row
            first += len(table)

    def rows_of(self, words: list[str]) -> list[int]:
        rows = self.rows.get(language(words))
        if not rows:
            return []
        number = self.word_number.get
        own = [number(w, 0) for w in words]
        keys = own + [a << 32 | b for a, b in zip(own, own[1:], strict=False) if a and b]
        return [r for k in keys if (r := rows.get(k)) is not None]

    def votes(self, spoken: list[list[str]]) -> list[tuple[int, float]]:
        """Of each sentence (its words) the likeliest column and its lead over the next; one without known features abstains."""
        out = [(ABSTAIN, 0.0)] * len(spoken)
        for start in range(0, len(spoken), AT_ONCE):
            rows = [self.rows_of(words) for words in spoken[start : start + AT_ONCE]]
            known = [i for i, r in enumerate(rows) if r]
            if not known:
                continue
            starts = np.cumsum([0, *[len(rows[i]) for i in known[:-1]]])
            scores = np.add.reduceat(self.table[list(chain.from_iterable(rows))], starts, axis=0)
            best = scores.argmax(axis=1)
            first = scores[np.arange(len(known)), best]
            scores[np.arange(len(known)), best] = -np.inf
            for i, b, lead in zip(known, best.tolist(), (first - scores.max(axis=1)).tolist(), strict=True):
                out[start + i] = (b, lead)
        return out


def learn_lexicon(texts: list[str | None], labels: list[set[str]], subjects: list[str]) -> Lexicon:
    """The lexicon of each language, from its sentences alone, so that no subject can stand for a language."""
    spoken: dict[str, dict[int, list[list[str]]]] = {}
    for d, text in enumerate(texts):
        for words in (words_of(s) for section in sentences(text) for s in section):
            if len(words) > 1:
                spoken.setdefault(language(words), {}).setdefault(d, []).append(features(words))
    return Lexicon(subjects, {lang: _learn_part(list(docs.values()), [labels[d] for d in docs], subjects) for lang, docs in sorted(spoken.items())})


def _learn_part(docs: list[list[list[str]]], labels: list[set[str]], subjects: list[str], rounds: int = 25) -> tuple[dict[str, int], np.ndarray]:
    """EM of a naive-Bayes mixture over sentences; documents' mixing shares have priors from their labels."""
    seen = Counter(f for d in docs for s in d for f in set(s))
    kept = [f for f, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= 2]
    index = {f: i for i, f in enumerate(kept)}
    k = len(subjects) + 1
    column = {s: i + 1 for i, s in enumerate(subjects)}
    doc_of, flat, sizes = [], [], []
    for d, own in enumerate(docs):
        for s in own:
            ids = [index[f] for f in s if f in index]
            doc_of.append(d)
            flat += ids
            sizes.append(len(ids))
    if not flat:
        return {}, np.zeros((0, k))
    prior = np.full((len(docs), k), 0.05)
    for d, own in enumerate(labels):
        for s in own:
            if s in column:
                prior[d, column[s]] = 3.0
    doc, cell, sentence = np.array(doc_of), np.array(flat), np.repeat(np.arange(len(sizes)), sizes)
    share = _with_none(prior)
    responsibility = _first_guess(share[doc], cell, sentence, len(kept))
    for _ in range(rounds):
        counts = np.zeros((len(kept), k))
        for c in range(k):
            counts[:, c] = np.bincount(cell, responsibility[sentence, c], len(kept))
        total = counts.sum(axis=1, keepdims=True) / counts.sum()
        theta = counts + 30.0 * total + 0.01  # shrunk to the overall frequency, so that shared words say nothing
        log_theta = np.log(theta / theta.sum(axis=0))
        score = np.zeros((len(sizes), k))
        for c in range(k):
            score[:, c] = np.bincount(sentence, log_theta[cell, c], len(sizes))
        score += np.log(share[doc])
        score -= score.max(axis=1, keepdims=True)
        responsibility = np.exp(score)
        responsibility /= responsibility.sum(axis=1, keepdims=True)
        share = prior.copy()
        for c in range(k):
            share[:, c] += np.bincount(doc, responsibility[:, c], len(docs))
        share = _with_none(share)
    return index, log_theta


def _first_guess(share: np.ndarray, cell: np.ndarray, sentence: np.ndarray, size: int) -> np.ndarray:
    """Responsibilities to start from: a sentence none of whose features leans to a subject likely has none."""
    k = share.shape[1]
    counts = np.stack([np.bincount(cell, share[sentence, c], size) for c in range(1, k)], axis=1)
    overall = counts.sum(axis=0) / counts.sum()
    lean = (counts + 5.0 * overall) / (counts.sum(axis=1, keepdims=True) + 5.0) / overall
    most = np.zeros(len(share))
    np.maximum.at(most, sentence, lean.max(axis=1)[cell])
    none = np.where(most < 2.0, 0.9, 0.1)[:, None]
    return np.hstack([none, share[:, 1:] / share[:, 1:].sum(axis=1, keepdims=True) * (1 - none)])


def _with_none(weights: np.ndarray) -> np.ndarray:
    """Mixing shares of the subjects by weight, beside a fixed share of sentences without subject."""
    share = weights.copy()
    share[:, 0] = 0.0
    share *= (1 - NO_SUBJECT) / share.sum(axis=1, keepdims=True)
    share[:, 0] = NO_SUBJECT
    return share


def voted(votes: list[list[tuple[int, float]]]) -> list[tuple[int, int, int, int]]:
    """(certain, sure, unsure, section) votes of each sentence from the lexicon's votes by section.

    The section votes for the subject that most of its other sentences are sure of, if any.
    """
    out = []
    for section in votes:
        tally = Counter(v for v, lead in section if v > NOTHING and lead >= SURE)
        for v, lead in section:
            certain = v if lead >= CERTAIN else ABSTAIN
            sure = v if SURE <= lead < CERTAIN else ABSTAIN
            unsure = v if UNSURE <= lead < SURE else ABSTAIN
            others = tally if v <= NOTHING or lead < SURE else tally - Counter([v])
            top = others.most_common(2)
            around = top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1]) else ABSTAIN
            out.append((certain, sure, unsure, around))
    return out


def sentence_votes(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, source, address and the distinct votes of its sentences with their counts.

    Null, empty and blank texts have no sentences and give no row. A sentence that a task has seen before
    is not read again while it is remembered.
    """
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the training sample
    kind = pa.list_(pa.struct([("certain", pa.int32()), ("sure", pa.int32()), ("unsure", pa.int32()), ("section", pa.int32()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        known: dict[str, tuple[int, float] | None] = {}  # None: no sentence
        for batch in batches:
            read = [sentences(text) for text in batch.column(3).to_pylist()]
            if len(known) > REMEMBERED:
                known = {}
            new = list({s: None for sections in read for section in sections for s in section if s not in known})
            spoken = [words_of(s) for s in new]
            known.update(zip(new, (v if len(w) > 1 else None for v, w in zip(lex.votes(spoken), spoken, strict=True)), strict=True))
            rows = []
            for sections in read:
                votes = [[v for s in section if (v := known[s]) is not None] for section in sections]
                rows.append([{"certain": a, "sure": b, "unsure": c, "section": d, "n": n} for (a, b, c, d), n in Counter(voted(votes)).items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, kind)], ["doc_id", "source", "address", "votes"])

    kept = documents.select("doc_id", "source", F.col("site_id").cast("string").alias("address"), "text")
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, source STRING, address STRING, votes ARRAY<STRUCT<certain INT, sure INT, unsure INT, section INT, n BIGINT>>"
    return kept.mapInArrow(run, schema).select("doc_id", "source", "address", F.inline("votes"))


def usual_subject(votes: DataFrame, by: str, out: str) -> DataFrame:
    """(by, out): the subject of most sure sentences per value, where it has a quarter of them; null values have none."""
    voted_for = F.greatest("certain", "sure")
    counts = votes.where((voted_for > NOTHING) & F.col(by).isNotNull()).groupBy(by, voted_for.alias("subject")).agg(F.sum("n").alias("n"))
    top = counts.groupBy(by).agg(F.max_by("subject", F.struct("n", F.negative("subject"))).alias(out), F.max("n").alias("most"), F.sum("n").alias("all"))
    return top.where("most * 4 >= all").select(by, out)


def learn_accuracies(patterns: np.ndarray, counts: np.ndarray, classes: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """EM of a latent-class model over vote patterns: (posterior of each pattern, accuracy of each voter).

    Each voter has for each class its chances of each vote (an abstention says nothing), so a function
    that can't vote for 'no subject', as the section, is not taken as wrong there. The chances start
    from FIRST_ACCURACY and keep a prior of that shape worth PRIOR_VOTES a class.
    """
    voters = patterns.shape[1]
    prior = []
    for v in range(voters):
        shape = np.full((classes, classes), (1 - FIRST_ACCURACY[v]) / (classes - 1))
        np.fill_diagonal(shape, FIRST_ACCURACY[v])
        prior.append(shape * PRIOR_VOTES)
    chances = [p / p.sum(axis=1, keepdims=True) for p in prior]
    share = np.full(classes, 1.0 / classes)
    rows_of = [np.flatnonzero(patterns[:, v] != ABSTAIN) for v in range(voters)]
    posterior = np.zeros((len(patterns), classes))
    for _ in range(rounds):
        log = np.tile(np.log(share), (len(patterns), 1))
        for v, rows in enumerate(rows_of):
            log[rows] += np.log(chances[v][:, patterns[rows, v]]).T
        log -= log.max(axis=1, keepdims=True)
        posterior = np.exp(log)
        posterior /= posterior.sum(axis=1, keepdims=True)
        weight = posterior * counts[:, None]
        share = (weight.sum(axis=0) + 1.0) / (weight.sum() + classes)
        for v, rows in enumerate(rows_of):
            votes = prior[v].copy()
            np.add.at(votes.T, patterns[rows, v], weight[rows])
            chances[v] = votes / votes.sum(axis=1, keepdims=True)
    return posterior, np.array([share @ np.diag(c) for c in chances])


@dataclass
class Model:
    """votes of all sentences, the distinct vote patterns with their posteriors, and the accuracy of each voter."""

    votes: DataFrame
    patterns: np.ndarray
    posterior: np.ndarray
    accuracies: dict[str, float]
    subjects: list[str]


def learned(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> Model:
    """The lexicon from a bounded sample of labelled documents; everything else from all sentences of all documents."""
    subjects = sorted(r["subject"] for r in areas.where("subject is not null").select("subject").distinct().collect())  # the fixed list of areas
    known = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    usable = documents.where(F.length("text") <= LONGEST_LABELLED).select("doc_id", "text")
    sample = usable.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).collect()
    lexicon = learn_lexicon([r["text"] for r in sample], [set(r["subjects"]) for r in sample], subjects)
    votes = cut_lineage(sentence_votes(documents, lexicon))
    with_all = votes.join(usual_subject(votes, "source", "source_vote"), "source", "left").join(usual_subject(votes, "address", "address_vote"), "address", "left")
    with_all = with_all.na.fill(ABSTAIN, ["source_vote", "address_vote"])
    # at most (subjects + 2) to the power of the voters, whatever the corpus
    table = with_all.groupBy(*VOTERS).agg(F.sum("n").alias("n")).collect()
    patterns = np.array([[r[v] for v in VOTERS] for r in table], int).reshape(-1, len(VOTERS))
    posterior, accuracies = learn_accuracies(patterns, np.array([r["n"] for r in table], float), len(subjects) + 1)
    return Model(with_all, patterns, posterior, dict(zip(VOTERS, map(float, accuracies), strict=True)), subjects)


def voter_accuracies(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(voter, accuracy): how often each labelling function is right where it votes, as the model learned it."""
    return documents.sparkSession.createDataFrame(list(learned(documents, labels, areas).accuracies.items()), "voter STRING, accuracy DOUBLE")


def assigned(documents: DataFrame, labels: DataFrame, areas: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, sentences, all_sentences) of the subjects with at least `share` of a document's sentences.

    Repeated doc_ids are taken as one document. Labels of unknown subjects are ignored; without any label
    no sentence gets a sure vote and nothing is assigned.
    """
    spark = documents.sparkSession
    model = learned(documents, labels, areas)
    names = [None, *model.subjects]
    spoken = (model.patterns[:, :3] > NOTHING).any(axis=1)  # a section alone gives no subject
    decided = [(*map(int, p), names[q.argmax()] if ok and q.max() >= 0.5 else None) for p, q, ok in zip(model.patterns, model.posterior, spoken, strict=True)]
    subject_of = spark.createDataFrame(decided, ", ".join(f"{v} INT" for v in VOTERS) + ", subject STRING")
    by_subject = model.votes.join(F.broadcast(subject_of), list(VOTERS)).groupBy("doc_id", "subject").agg(F.sum("n").alias("sentences"))
    of_document = Window.partitionBy("doc_id")
    return (
        by_subject.withColumn("all_sentences", F.sum("sentences").over(of_document))
        .where(F.col("subject").isNotNull() & (F.col("sentences") >= F.lit(share) * F.col("all_sentences")))
    )
