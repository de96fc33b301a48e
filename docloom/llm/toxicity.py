"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < 2 share one weight per word; grade k or less has probability
sigmoid(threshold_k - w.x), with ordered thresholds. x marks which words a text holds
and which word beginnings stand in at least one, two or four different words, for inflected
insults; a long text does not thin out a bad word. An L1 penalty drives features without
evidence to zero, which keeps the model small and long clean texts clean.

The model is fitted on the driver from ``MAX_TRAIN`` labelled documents at most, taken
in the order of a hash of their id; that sample is the only bounded thing. Every document
is scored.

Grades from ``labels`` (doc_id, quality, toxic), the only ones the tables tell apart: 0 a
good text, 1 a poor but harmless one, 2 a toxic one. Labels with null id or null toxic are
left out; null quality counts as good; of several labels of one document the highest grade
counts. Null and empty texts have no words and get the severity of no evidence; with fewer
than two grades among the labels the model has no weights and everything is grade 0.
Repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import arrow_function
from docloom.llm.words import letter_words

GRADES = 3
#: Labelled documents used for fitting, at most.
MAX_TRAIN = 6_000
#: A word must stand in so many of them to get a weight.
MIN_DOCS = 5
#: L1 penalty of a word, in standard errors of its gradient if it meant nothing.
ERRORS = 4.0
SWEEPS = 20
RIDGE = 1e-4
#: Bytes of the word beginnings that count as features, and how many words share them.
BEGINNINGS = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)
#: Probability of the highest grade from which a document counts as toxic.
REJECT = 0.5


@dataclass
class Model:
    #: (word or beginning, level): weight; level 0 marks a whole word.
    weights: dict[tuple[bytes, int], float]
    thresholds: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = {w: x for (w, level), x in self.weights.items() if level == 0}
        starts = {w for w, level in self.weights if level}
        out = []
        for text in texts:
            own = set(letter_words(text))
            parts = [words[w] for w in words.keys() & own]
            if starts:
                shared = Counter(w[:k] for w in own for k in BEGINNINGS if len(w) > k and w[:k] in starts)
                parts += [self.weights.get((w, level), 0.0) for w, n in shared.items() for level in LEVELS if n >= level]
            out.append(math.fsum(parts))  # whatever the order of the set
        return np.array(out, float)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..., one column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@arrow_function(pa.list_(pa.binary()))
def _word_set(text: pa.Array) -> pa.Array:
    return pa.array([sorted(set(letter_words(t))) for t in text.to_pylist()], pa.list_(pa.binary()))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade), one row per labelled document."""
    grade = F.when(F.col("toxic") > 0, 2).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(0)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return known.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.max("grade").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, max_train: int = MAX_TRAIN, n_grades: int = GRADES) -> Model:
    """A model from at most ``max_train`` rows of ``grades`` (doc_id, grade from 0 up)."""
    sample = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"])
    rows = texts.select("grade", _word_set("text").alias("words")).toArrow()
    grade = rows.column("grade").to_numpy().astype(np.int64)
    words = rows.column("words").combine_chunks()
    words = words if isinstance(words, pa.ListArray) else words.chunk(0) if words.num_chunks else pa.array([], pa.list_(pa.binary()))
    coded = words.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    row = np.repeat(np.arange(len(words), dtype=np.int32), words.value_lengths().fill_null(0).to_numpy())
    names, row, col = _features(vocabulary, row, coded.indices.to_numpy())
    weights, thresholds = _fit(row, col, grade, len(names), n_grades)
    return Model({names[k]: float(weights[k]) for k in np.nonzero(weights)[0]}, thresholds)


def _features(vocabulary: list[bytes], row: np.ndarray, code: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Feature names and the (row, feature) pairs of all features in ``MIN_DOCS`` rows or more."""
    names, rows, cols = [], [], []

    def keep(labels: list, r: np.ndarray, c: np.ndarray) -> None:
        kept = np.nonzero(np.bincount(c, minlength=len(labels)) >= MIN_DOCS)[0]
        place = np.full(len(labels), -1, np.int32)
        place[kept] = np.arange(len(kept)) + len(names)
        use = place[c] >= 0
        names.extend(labels[k] for k in kept)
        rows.append(r[use])
        cols.append(place[c[use]])

    keep([(w, 0) for w in vocabulary], row, code)
    for size in BEGINNINGS:
        ids: dict[bytes, int] = {}
        start_of = np.array([ids.setdefault(w[:size], len(ids)) if len(w) > size else -1 for w in vocabulary], np.int32)
        starts = start_of[code] if len(vocabulary) else code
        whole = starts >= 0
        pair, n = np.unique(row[whole].astype(np.int64) * max(len(ids), 1) + starts[whole], return_counts=True)
        for level in LEVELS:
            at = pair[n >= level]
            keep([(w, level) for w in ids], at // max(len(ids), 1), at % max(len(ids), 1))
    return names, np.concatenate(rows), np.concatenate(cols)


def _fit(row: np.ndarray, col: np.ndarray, grade: np.ndarray, width: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps feature by feature on the mean negative log-likelihood plus L1."""
    n, top = len(grade), n_grades - 1
    if n == 0 or len(set(grade.tolist())) < 2:
        return np.zeros(width), np.full(top, np.inf)
    above = np.clip([(grade > k).mean() for k in range(top)], 1e-4, 1 - 1e-4)
    thresholds, weights, score = np.sort(-np.log(above / (1 - above))), np.zeros(width), np.zeros(n)
    frequency, toxic = np.bincount(col, minlength=width) / n, (grade == top).mean()
    penalty = ERRORS * np.sqrt(frequency * toxic * (1 - toxic) / n)
    order = np.argsort(col, kind="stable")
    by_feature, bounds = row[order], np.concatenate([[0], np.cumsum(np.bincount(col, minlength=width))])

    def slopes(at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slope and curvature of the loss by the score; the slope's parts by upper and lower threshold."""
        cut, g = np.concatenate([[-np.inf], thresholds, [np.inf]]), grade[at]
        high, low = _sigmoid(cut[g + 1] - score[at]), _sigmoid(cut[g] - score[at])
        bend_high, bend_low = high * (1 - high), low * (1 - low)
        chance = np.maximum(high - low, 1e-9)
        return (bend_high - bend_low) / chance, bend_high + bend_low, bend_high / chance, bend_low / chance

    # the penalty chooses the features; then those are fitted again without it, and only a slight ridge
    for sweep in range(2 * SWEEPS):
        if sweep == SWEEPS:
            penalty = np.where(weights != 0, 0.0, np.inf)
        for _ in range(3):
            _, _, up, down = slopes(slice(None))
            for k in range(top):
                at = _sigmoid(thresholds[k] - score)
                bend = (at * (1 - at))[(grade == k) | (grade == k + 1)].sum()
                step = (up[grade == k].sum() - down[grade == k + 1].sum()) / (bend + 1e-9)
                thresholds[k] += np.clip(step, -0.5, 0.5)
            thresholds.sort()
        gradient = np.bincount(col, weights=slopes(slice(None))[0][row], minlength=width) / n
        for j in np.nonzero((np.abs(gradient) > penalty) | (weights != 0))[0]:
            at = by_feature[bounds[j] : bounds[j + 1]]
            slope, bend, _, _ = slopes(at)
            g, h = slope.sum() / n + RIDGE * weights[j], bend.sum() / n + RIDGE
            target = h * weights[j] - g
            new = np.sign(target) * max(abs(target) - penalty[j], 0) / h
            change = float(np.clip(new - weights[j], -1, 1))
            weights[j] += change
            score[at] += change
    return weights, thresholds


_JUDGED = "severity double, grade int, p_toxic double"


def judge(spark, model: Model) -> object:
    """A column function of the text: struct of expected severity, likeliest grade, P(highest grade)."""
    shipped = spark.sparkContext.broadcast((model.weights, model.thresholds))  # words of the bounded sample

    @F.arrow_udf(_JUDGED)
    def judged(text: pa.Array) -> pa.Array:
        model = Model(*shipped.value)
        above = model.above(score := model.scores(text.to_pylist()))
        edges = np.hstack([np.ones((len(score), 1)), above, np.zeros((len(score), 1))])
        grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
        columns = [pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, -1])]
        return pa.StructArray.from_arrays(columns, ["severity", "grade", "p_toxic"])

    return judged


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected severity, likeliest grade, P(highest grade), toxic; one row per row of ``docs``."""
    judged = judge(docs.sparkSession, fit(docs, graded(labels)))
    out = docs.select("doc_id", judged("text").alias("judged"))
    return out.select("doc_id", "judged.*", (F.col("judged.p_toxic") >= REJECT).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not toxic, columns unchanged."""
    judged = judge(docs.sparkSession, fit(docs, graded(labels)))
    return docs.where(judged("text")["p_toxic"] < REJECT)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return severity(docs, labels)
