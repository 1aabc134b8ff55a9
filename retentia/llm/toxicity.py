"""Toxicity classifier with counterfactual regularisation.

Labelled texts are turned into sets of features (words and their beginnings).
Each text with an identity term also gets counterfactuals, in which the term is
swapped for others of its kind; the fit penalises the squared change of the
logit between the two.  Group mentions that merely coincide with abuse in the
labels thus lose their weight, and neutral mentions stay below the threshold.

The model is a logistic regression over ``FEATURES`` features, chosen by the
significance of their log odds over the sample, fitted on a bounded sample:
about ``FIT_ROWS`` labelled rows per class (all, if fewer), never held-out ones.

Defined results: a null or empty text has the score of a text without features;
labels that are null are not learnt from; of conflicting labels of one doc_id
the higher counts; without both classes every score is 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import letters

FIT_ROWS, FEATURES = 6000, 3000
#: Least |z| of a feature's log odds, strength of the counterfactual penalty and of the L2 penalty.
LEAST_Z, SWAP_PENALTY, L2 = 2.5, 1.0, 1e-4
MEMO_WORDS = 200_000
PREFIXES = (4, 5, 6)

#: Terms of one kind that are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("american", "mexican", "chinese", "french", "german", "indian"),
    ("immigrant", "refugee", "native", "foreigner"), ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young"), ("elderly", "teenage"),
)
_OTHERS = {t: [x for x in kind if x != t] for kind in IDENTITY_TERMS for t in kind}


def features(word: str) -> list[str]:
    """A word (``=word``) and its beginnings (``word*``)."""
    return [f"={word}", *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def counterfactuals(words: set[str]) -> list[set[str]]:
    """The text's words with its identity terms swapped: the first and the last alternative of each."""
    terms = [w for w in words if w in _OTHERS]
    if not terms:
        return []
    return [(words - set(terms)) | {_OTHERS[t][k] for t in terms} for k in (0, -1)]


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias
        self.index = {f: i for i, f in enumerate(names)}


class Scorer(dict):
    """Word -> indices of its features in the model; a memory of two generations."""

    def __init__(self, model: Model):
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.old.get(word)
        if out is None:
            find = self.model.index.get
            out = tuple([i for f in features(word) if (i := find(f)) is not None])
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def indices(self, words: set[str]) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, words)))

    def score(self, text: str | None) -> float:
        logit = self.model.bias + float(self.model.weights[self.indices(set(letters.words(text)))].sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def _weights(rows: list[tuple[int, list[int], list[list[int]]]], n: int, swap_penalty: float):
    """Logistic regression with an L2 and a counterfactual penalty, by Adam over the whole sample."""
    y = np.array([r[0] for r in rows], np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    feature = np.array([f for r in rows for f in r[1]], np.int64)
    swaps = [(r[1], c) for r in rows for c in r[2]]
    # x - x' of each counterfactual: +1 for features lost, -1 for features won.
    entries = [(k, f, s) for k, (a, b) in enumerate(swaps) for f, s in
               [*((f, 1.0) for f in set(a) - set(b)), *((f, -1.0) for f in set(b) - set(a))]]
    pair, where, sign = (np.array(x) for x in zip(*entries)) if entries else (np.empty(0, np.int64),) * 3
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both classes weigh the same
    prior = np.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))
    w, bias = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, 401):
        logit = np.bincount(doc, w[feature], len(y)) + bias
        error = (1 / (1 + np.exp(-logit)) - y) * each
        g = np.bincount(feature, error[doc], n) + L2 * w
        if len(pair):
            change = np.bincount(pair, w[where] * sign, len(swaps))
            g += np.bincount(where, change[pair] * sign, n) * 2 * swap_penalty / len(swaps)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias + min(0.0, 0.25 * prior)


def fit(docs: DataFrame, labels: DataFrame, swap_penalty: float = SWAP_PENALTY) -> Model:
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isNotNull() & ~letters.held_out(F.col("label_id")))
    usable = usable.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    if len(sizes) < 2:
        return Model([], np.empty(0), -1000.0)
    chosen = F.lit(False)
    for y, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == y) & letters.share(n, FIT_ROWS, "label_id"))
    sample = docs.select("doc_id", "text").join(
        F.broadcast(usable.where(chosen)), F.col("doc_id") == F.col("label_id")).select("text", "toxic")  # about 2 * FIT_ROWS ids

    def count(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch.column(0), batch.column(1)):
                y = y.as_py()
                counts.update((y, f) for f in {f for w in set(letters.words(text.as_py())) for f in features(w)})
            if counts:
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[1] for k in counts], pa.string()), pa.array([n * k[0] for k, n in counts.items()], pa.int64()),
                    pa.array([n * (1 - k[0]) for k, n in counts.items()], pa.int64())], names=["f", "bad", "good"])

    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (F.lit(bad) - F.col("bad") + 0.5)) - F.log(
        (F.col("good") + 0.5) / (F.lit(good) - F.col("good") + 0.5))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = (sample.mapInArrow(count, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
            .where("bad + good >= 3").withColumn("z", F.abs(odds / spread)).where(F.col("z") >= LEAST_Z)
            .orderBy(F.desc("z"), "f").limit(FEATURES).select("f").collect())
    own = [f for w in _OTHERS for f in features(w)]  # identity terms are always looked at
    names = sorted({r["f"] for r in best} | set(own))
    empty = Model(names, np.zeros(len(names)), 0.0)

    def reduce(batches):
        scorer = Scorer(empty)
        for batch in batches:
            rows = []
            for text, y in zip(batch.column(0), batch.column(1)):
                words = set(letters.words(text.as_py()))
                rows.append((y.as_py(), scorer.indices(words), [scorer.indices(c) for c in counterfactuals(words)]))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))], names=["y", "x", "swapped"])

    got = sample.mapInArrow(reduce, "y int, x array<int>, swapped array<array<int>>").toArrow()  # at most ~2 * FIT_ROWS rows
    rows = sorted(zip(*(got[c].to_pylist() for c in ("y", "x", "swapped"))))
    if not bad or not good:
        return Model([], np.empty(0), -1000.0)
    weights, bias = _weights(rows, len(names), swap_penalty)
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(found, pa.float64()),
                pa.array([int(x >= 0.5) for x in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), letters.held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
