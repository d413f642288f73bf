"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model has one weight for each feature and ordered thresholds t1 < t2 < ...:
P(grade >= k) = sigmoid(w.x - t_k), so all thresholds share the weights.  x is
sparse: a feature is a whole word or the beginning of one, its value how many of
50 words of the text have it, 2 at most; a shorter text counts as 50 words.
Weights are not negative: no word makes a text less severe.  The output is the
expected grade, the sum of P(grade >= k).

Fitting uses at most ``rows`` labelled rows, a bounded sample chosen by a hash
of doc_id and text; rows that repeat a doc_id and its text count once.  The
vocabulary is every feature that sets toxic rows apart clearly.  Scoring covers every
row and whole texts, without a shuffle.

Null and empty texts have no words, so the model's base rate; null labels are
left out of fitting; with no labelled toxic row, or no other, all grades are 0.
Repeated rows are scored each; an empty table gives no rows; further columns
stay out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, small_batches, texts

WORD = re.compile(r"\w+").findall
#: Lengths of the beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Words in which a feature is counted, and the largest value.
PER, MOST = 50, 2.0
#: Standard deviations by which a feature must set toxic rows apart.
SIGMAS = 4.0
#: Remembered words of one worker.
MEMORY = 300_000


def features(word: str) -> list[str]:
    """The whole word, marked, and its beginnings."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def values(words: list[str], known: Mapping[str, Sequence[str]]) -> dict[str, float]:
    """Values of the features that ``known`` gives for the words."""
    per = PER / max(len(words), PER)
    return {f: min(n * per, MOST) for f, n in Counter(chain.from_iterable(map(known.__getitem__, words))).items()}


class Known(dict):
    """word -> those of its features that are in ``vocabulary``."""

    def __init__(self, vocabulary: Iterable[str]):
        self.vocabulary = frozenset(vocabulary)

    def __missing__(self, word: str) -> tuple[str, ...]:
        out = tuple(f for f in features(word) if f in self.vocabulary)
        if len(self) < MEMORY:
            self[word] = out
        return out


class Model:
    """Weights of features, and ascending thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds, self.known = weights, np.asarray(thresholds, float), Known(weights)

    def __reduce__(self):
        return Model, (self.weights, self.thresholds.tolist())

    def expected(self, text: str) -> tuple[float, float]:
        """Expected grade, and P(grade >= 1)."""
        found = values(WORD(text.lower()), self.known)
        odds = sum(self.weights[f] * found[f] for f in sorted(found)) - self.thresholds
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return round(float(p.sum()), 6), round(float(p[0]), 6)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int, penalty: float = 0.01, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds; entries (rows, columns, values) of the sparse matrix, one grade 0, 1, ... for each row.

    Gradient descent with momentum and a step size for each coordinate (Adam) on
    the mean loss of the questions whether grade >= k; thresholds stay ordered
    because the logarithms of their distances are what is optimised, and weights
    below 0 are set to 0.
    """
    levels, n = int(grade.max()), len(grade)
    above = np.stack([grade >= k for k in range(1, levels + 1)], 1).astype(float)
    share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log(1 / share - 1))
    params = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:width], np.exp(params[width + 1 :])
        t = params[width] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(rows, w[columns] * values, minlength=n)
        miss = (1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30))) - above) / n
        gw = np.bincount(columns, miss.sum(1)[rows] * values, minlength=width) + penalty * w / n
        later = np.cumsum(-miss.sum(0)[::-1])[::-1]
        grad = np.concatenate([gw, later[:1], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params -= 0.3 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        params[:width] = np.maximum(params[:width], 0)
    return params[:width], params[width] + np.concatenate([[0], np.cumsum(np.exp(params[width + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, grade: str = "grade", rows: int = 10_000, min_rows: int = 5) -> Model:
    """Model from ``labels`` (doc_id, ``grade``), of which ``rows`` at most are used, and the texts of ``docs``."""
    never = Model({}, [30.0])
    sample = labels.filter(F.col(grade).isNotNull()).select("doc_id", F.col(grade).cast("int").alias("grade")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows)
    # at most ``rows`` rows; an id may have many texts, so the bound holds again after the join
    met = bounded(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").distinct()
    known = met.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "grade").limit(rows).repartition(8).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {True: Counter(), False: Counter()}
            for text, g in zip(texts(batch.column("text")), batch.column("grade").to_pylist()):
                seen[g > 0].update({f for w in set(WORD(text.lower())) for f in features(w)})
            every = sorted(seen[True].keys() | seen[False].keys())
            yield pa.record_batch([pa.array(every, pa.string()), *(pa.array([seen[k][f] for f in every], pa.int64()) for k in (True, False))], ["feature", "bad", "good"])

    try:
        totals = known.agg(F.count_if(F.col("grade") > 0).alias("bad"), F.count_if(F.col("grade") == 0).alias("good")).first()
        if not totals.bad or not totals.good:
            return never
        each = known.select("text", "grade").mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        share = (F.col("bad") + F.col("good")) / (totals.bad + totals.good)
        apart = (F.col("bad") / totals.bad - F.col("good") / totals.good) / F.sqrt(share * (1 - share) + 1e-12)
        # of a word's beginnings that occur in the same rows, the shortest is enough
        rows_of_both = (totals.bad * totals.good / (totals.bad + totals.good)) ** 0.5
        ranked = each.filter(F.col("bad") + F.col("good") >= min_rows).filter(apart * rows_of_both > SIGMAS).orderBy(F.desc(apart), "feature").collect()  # words of ``rows`` texts at most
        counts = {r.feature: (r.bad, r.good) for r in ranked}
        shorter = lambda f: (f[:n] for n in BEGINNINGS if n < len(f))
        vocabulary = [f for f in counts if not any(counts.get(g) == counts[f] for g in shorter(f))]
        if not vocabulary:
            return never
        known_words, place = Known(vocabulary), {f: i for i, f in enumerate(vocabulary)}

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted((place[f], x) for f, x in values(WORD(t.lower()), known_words).items()) for t in texts(batch.column("text"))]
                columns = [pa.array([[e[k] for e in own] for own in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.float64()))]
                yield pa.record_batch([batch.column("doc_id"), batch.column("grade"), *columns], ["doc_id", "grade", "i", "x"])

        lines = known.mapInArrow(vectors, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, i array<int>, x array<double>").orderBy("doc_id", "grade", "i", "x").collect()  # ``rows`` at most
    finally:
        known.unpersist()
    at = np.repeat(np.arange(len(lines)), [len(r.i) for r in lines])
    columns, numbers = np.array([k for r in lines for k in r.i], np.int64), np.array([x for r in lines for x in r.x], float)
    weights, thresholds = fit_ordinal(at, columns, numbers, np.array([r.grade for r in lines]), len(vocabulary))
    return Model({f: float(x) for f, x in zip(vocabulary, weights) if abs(x) > 1e-3}, thresholds.tolist())


def score(docs: DataFrame, model: Model, reject: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: doc_id (and ``keep``), severity (the expected grade), p_toxic, toxic (p_toxic >= ``reject``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            both = [shared.value.expected(t) for t in texts(batch.column("text"))]
            new = [pa.array([b[0] for b in both], pa.float64()), pa.array([b[1] for b in both], pa.float64()), pa.array([b[1] >= reject for b in both], pa.bool_())]
            yield pa.record_batch([*(batch.column(c) for c in given), *new], [*given, "severity", "p_toxic", "toxic"])

    given = list(dict.fromkeys(["doc_id", "text", *keep]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in given) + ", severity double, p_toxic double, toxic boolean"
    return bounded(docs).select(*given).mapInArrow(run, schema)
