"""Toxicity as severity grades: cumulative-link ordinal regression over words and word beginnings.

P(grade <= k) = sigmoid(theta_k - w.x): all thresholds share the weights ``w`` and are ordered. The
model is fitted on a bounded sample of labelled rows; scoring covers every row. Every word is a feature, by
a hash into ``DIMS`` places; how far a feature's odds differ between the classes of the sample, in standard
errors and less ``SHRINK`` of them, is its value where it occurs, so that noise has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import as_bytes, few, split_words

#: Word beginnings that count as features beside the words, in bytes, and places that features are hashed into.
BEGINNINGS, DIMS = (4, 6), 1 << 18
#: Most labelled rows of a class that the model is fitted on, and standard errors that noise may reach.
MOST_ROWS, SHRINK = 1500, 1.5


def features_of(word: bytes) -> list[int]:
    """Places of the word itself, and of its beginnings marked by a trailing dash."""
    import xxhash

    return [xxhash.xxh32_intdigest(x) % DIMS for x in (word, *(word[:n] + b"-" for n in BEGINNINGS if len(word) >= n))]


@dataclass
class OrdinalModel:
    weights: np.ndarray  # of a feature that occurs, by place
    thresholds: list[float]  # ascending, one fewer than grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Of each grade, by row."""
        below = 1 / (1 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - score[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)

    def scorer(self):
        """Gives a text's w.x; words seen before cost one lookup."""
        memo: dict[bytes, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: bytes | None) -> float:
            hits: set[int] = set()
            if len(memo) > 50_000:
                memo.clear()
            for word in set(split_words(text)):
                known = memo.get(word)
                if known is None:
                    known = memo[word] = tuple(f for f in features_of(word) if weights[f])
                if known:
                    hits.update(known)
            return float(weights[np.sort(np.fromiter(hits, dtype=np.int64, count=len(hits)))].sum())

        return score


def fit_ordinal(owner: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-4, rounds: int = 200, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean log loss plus ``l2`` / 2 of the squared weights; row ``owner`` has ``value`` in ``column``."""
    n, w = len(grades), np.zeros(n_features)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 0.01, 0.99)
    theta = np.log(share / (1 - share))
    raw = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])  # first, then logs of the steps up
    at = np.concatenate([w, raw])
    m, v = np.zeros_like(at), np.zeros_like(at)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        w, raw = at[:n_features], at[n_features:]
        steps = np.exp(raw[1:])
        theta = raw[0] + np.concatenate([[0], np.cumsum(steps)])
        score = np.bincount(owner, weights=w[column] * value, minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        up, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        up, low = np.where(grades == n_grades - 1, 1.0, up), np.where(grades == 0, 0.0, low)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g_score = (d_up - d_low) / n
        g_theta = np.bincount(grades, weights=-d_up, minlength=n_grades)[: n_grades - 1] / n + np.bincount(grades, weights=d_low, minlength=n_grades)[1:] / n
        g_raw = np.concatenate([[g_theta.sum()], steps * np.cumsum(g_theta[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(column, weights=g_score[owner] * value, minlength=n_features) + l2 * w, g_raw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, raw = at[:n_features], at[n_features:]
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_rows: int) -> DataFrame:
    """At most ``most_rows`` labelled ids of each class, those with the least hash: ``id_col``, ``text_col``, ``y``.

    An id that is labelled both ways is toxic; of several texts of an id the least one counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        of_class = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(5), id_col), id_col).limit(most_rows)
        chosen = of_class if chosen is None else chosen.unionAll(of_class)
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # 2 * most_rows ids at most
    return found.groupBy(id_col).agg(F.min(text_col).alias(text_col), F.first("y").alias("y"))


def telling(owner: np.ndarray, place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The value of each place: the log odds ratio of its occurrence in the two classes in standard errors, less ``SHRINK``, by magnitude."""
    n1 = np.bincount(place[y[owner] == 1], minlength=DIMS) + 0.5
    n0 = np.bincount(place[y[owner] == 0], minlength=DIMS) + 0.5
    odds = np.log(n1 / ((y == 1).sum() + 1 - n1)) - np.log(n0 / ((y == 0).sum() + 1 - n0))
    return np.maximum(np.abs(odds) / np.sqrt(1 / n1 + 1 / n0) - SHRINK, 0) / 2


def fit_rows(owner: np.ndarray, place: np.ndarray, y: np.ndarray, grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """A model of ``grades`` from rows of feature places; ``y`` says which rows are toxic."""
    value = telling(owner, place, y)
    some = value[place] > 0
    used, column = np.unique(place[some], return_inverse=True)
    w, theta = fit_ordinal(owner[some], column, value[place[some]], grades, len(used), n_grades)
    weights = np.zeros(DIMS)
    weights[used] = w * value[used]
    return OrdinalModel(weights, theta.tolist())


def severity(owner: np.ndarray, place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2: a toxic row is severe if a model of the other half's labels scores it above the median toxic row."""
    half = np.zeros(len(y), dtype=int)
    for c in (0, 1):
        half[y == c] = np.arange((y == c).sum()) % 2
    score = np.zeros(len(y))
    for h in (0, 1):
        learns = half != h
        number = np.cumsum(learns) - 1
        mine = learns[owner]
        model = fit_rows(number[owner[mine]], place[mine], y[learns], y[learns], 2) if len(set(y[learns])) == 2 else OrdinalModel(np.zeros(DIMS), [0.0])
        score = np.where(learns, score, np.bincount(owner, weights=model.weights[place], minlength=len(y)) - model.thresholds[0])
    return y + ((y == 1) & (score > np.median(score[y == 1])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> OrdinalModel:
    """Fits three grades: 0 clean, 1 mild, 2 severe.

    The labels only say toxic or not. How severe a toxic row is comes from models that have not seen it: one
    fitted on each half of the sample grades the other half's toxic rows, of which those above the median are
    severe. Without rows of both classes the model has no weights and rejects nothing.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, most_rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = [sorted({f for w in set(split_words(text)) for f in features_of(w)}) for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, type=pa.list_(pa.int32()))], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    data = sample.select(id_col, text_col, "y").mapInArrow(gather, f"id {kind}, y int, x array<int>").toArrow()  # 2 * most_rows rows, DIMS numbers at most
    data = data.take(pc.sort_indices(data.column("id")))
    y, x = data.column("y").to_numpy().astype(np.int64), data.column("x").combine_chunks()
    if len(set(y.tolist())) < 2:
        return OrdinalModel(np.zeros(DIMS), [40.0, 41.0])
    owner, place = np.repeat(np.arange(len(y)), np.diff(x.offsets.to_numpy())), x.flatten().to_numpy().astype(np.int64)
    return fit_rows(owner, place, y, severity(owner, place, y), 3)


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, ``p_toxic`` (of any grade above 0), ``expected_severity`` (mean grade), ``grade`` (most likely), ``rejected``; a row for every row.

    Null and empty texts have no features: they get the thresholds' own probabilities. Rows stay where
    they are, so repeated rows and null ids do too; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in few(batches):
            p = model.probabilities(np.array([score(t) for t in as_bytes(batch.column(1))], dtype=float))
            toxic, mean = 1 - p[:, 0], p @ np.arange(p.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(toxic), pa.array(mean), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic >= threshold)], names=[id_col, "p_toxic", "expected_severity", "grade", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, p_toxic double, expected_severity double, grade int, rejected boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in few(batches):
            p = model.probabilities(np.array([score(t) for t in as_bytes(batch.column(at))], dtype=float))
            yield batch.filter(pa.array(1 - p[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)
