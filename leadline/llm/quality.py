"""Quality scores of whole texts by Naive Bayes support vectors.

Features are indicators of word n-grams (one and two words) and of n-grams of word shapes (one to three;
a shape has runs of lower-case letters, capitals and digits as one sign each, other signs as they are,
and a word equal to the one before it is a shape of its own), hashed to 2**18 places. Each indicator is
scaled by its class log-count ratio; a linear model with hinge loss is fitted to these by dual coordinate
descent and mixed with its mean weight; a logistic curve over cross-validated margins turns margins into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import fold_of, id_type, session, text_rows
from leadline.llm.words import _SPACE, STRETCH, _power, _stretches, grams, hash_words, mix, text_bytes

PLACES_BITS = 18
#: Labelled rows that a fit takes at most, those with the least hash of their id.
MOST_ROWS = 8000
SMOOTHING, COST, MIX, ROUNDS, FOLDS = 1.0, 1.0, 0.25, 30, 3

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_SHAPE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_SAME = np.uint64(0x6C62272E07BB0142)


def _shapes(data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each word's shape; the words are data[s:e] with hashes h."""
    if not len(s):
        return np.empty(0, np.uint64)
    cls = _CLASS[data]
    kept = np.ones(len(data), bool)
    kept[1:] = cls[1:] != cls[:-1]
    kept[s] = True
    kept &= ~_SPACE[data]
    at = np.cumsum(kept)
    power, inverse = _power(len(data) + 1)
    total = np.cumsum(np.where(kept, _SHAPE_VALUES[cls] * power[at], np.uint64(0)))
    out = total[e - 1]
    out[s > 0] -= total[s[s > 0] - 1]
    return mix(out * inverse[at[s]])


def features_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted places of each text's indicators."""
    data, offsets = text_bytes(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= STRETCH:
            hi += 1
        a, b = int(offsets[lo]), int(offsets[hi])
        words, shapes = [], []
        if b - a <= STRETCH:
            s, e, h = hash_words(data[a:b], offsets[lo:hi] - a)
            words, shapes, to = h, _shapes(data[a:b], s, e, h), np.searchsorted(s, offsets[lo : hi + 1] - a)
        else:
            for x, y in _stretches(data, a, b):
                s, e, h = hash_words(data[x:y], np.zeros(1, np.int64))
                words.append(h)
                shapes.append(_shapes(data[x:y], s, e, h))
            words, shapes = np.concatenate(words), np.concatenate(shapes)
            to = np.array([0, len(words)])
        if len(words):
            same = np.zeros(len(words), bool)
            same[1:] = words[1:] == words[:-1]
            same[to[:-1][to[:-1] < len(words)]] = False
            shapes = np.where(same, _SAME, shapes)
        sets = [(g >> np.uint64(64 - PLACES_BITS), t) for g, t in (_salted(words, to, 1, 1), _salted(words, to, 2, 2), _salted(shapes, to, 1, 3), _salted(shapes, to, 2, 4), _salted(shapes, to, 3, 5))]
        for d in range(hi - lo):
            yield np.unique(np.concatenate([g[t[d] : t[d + 1]] for g, t in sets])).astype(np.int32)
        lo = hi


def _salted(h: np.ndarray, to: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    g, t = grams(h, to, size)
    return mix(g ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)), t


@dataclass
class Classifier:
    """Weights by place, and the logistic curve over margins."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / np.sqrt(len(x) + 1) + self.bias)

    def score(self, x: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -500, 500))))


def log_count_ratios(xs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    sums = {k: np.full(1 << PLACES_BITS, SMOOTHING) for k in (1, -1)}
    for x, c in zip(xs, y, strict=True):
        sums[int(c)][x] += 1  # a row's places are distinct
    return np.log(sums[1] / sums[1].sum()) - np.log(sums[-1] / sums[-1].sum())


def dual_coordinate_descent(xs: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS, tolerance: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss over rows x with the given value at each place.

    Rows have length sqrt(places + 1) divided out, and a constant feature. One dual variable at a time, held
    between 0 and the cost, takes its exact minimum; the primal weights follow. These are kept times the
    values, so that a row needs no more than its places.
    """
    weighted, bias, a = np.zeros(len(values)), 0.0, np.zeros(len(xs))
    squares = values * values
    scale = np.array([1 / np.sqrt(len(x) + 1) for x in xs])
    length = np.array([squares[x].sum() for x in xs]) * scale * scale + 1
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(xs)):
            x = xs[i]
            gradient = y[i] * (weighted[x].sum() * scale[i] + bias) - 1
            if a[i] == 0 and gradient >= 0 or a[i] == cost and gradient <= 0:
                continue
            worst = max(worst, abs(gradient))
            new = min(cost, max(0.0, a[i] - gradient / length[i]))
            step = (new - a[i]) * y[i]
            a[i] = new
            weighted[x] += step * scale[i] * squares[x]
            bias += step
        if worst < tolerance:
            break
    return np.divide(weighted, values, out=np.zeros(len(values)), where=values != 0), bias


def _fit_weights(xs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    r = log_count_ratios(xs, y)
    w, bias = dual_coordinate_descent(xs, r, y)
    return ((1 - MIX) * np.abs(w).mean() + MIX * w) * r, bias


def fit(xs: list[np.ndarray], labels: np.ndarray) -> Classifier:
    """Fits to places and labels (1 good, 0 not). With fewer than two classes every score is the share of label 1."""
    y = np.where(labels > 0, 1, -1)
    share = (np.sum(y > 0) + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Classifier(np.zeros(1 << PLACES_BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    part = np.arange(len(y)) % FOLDS
    margins, known = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):
        inside = np.flatnonzero(part != k)
        if len(set(y[inside].tolist())) == 2:
            c = Classifier(*_fit_weights([xs[i] for i in inside], y[inside]), 1.0, 0.0)
            for i in np.flatnonzero(part == k):
                margins[i], known[i] = c.margin(xs[i]), True
    slope, offset = _logistic(margins[known], y[known]) if known.any() else (1.0, 0.0)
    return Classifier(*_fit_weights(xs, y), slope, offset)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, targets drawn in a little, by Newton steps."""
    up, down = np.sum(y > 0), np.sum(y < 0)
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([m, np.ones(len(m))], axis=1)
    b = np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (t - p))
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0]), 0.0), float(b[1])


def train(docs: DataFrame, labels: DataFrame, learn: str = "fold != 0", folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Classifier:
    """A classifier from labelled rows whose fold = crc32(id as text) mod folds meets the condition.

    At most ``most_rows`` labelled ids are taken, those with the least hash. An id with several labels has
    their majority (1 on a tie); null labels and ids are left out.
    """
    session(docs)
    given = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("label")).filter("doc_id is not null and label is not null")
    given = given.withColumn("fold", fold_of("doc_id", folds)).filter(learn).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    taken = F.broadcast(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    rows = text_rows(docs, id_col, text_col).join(taken, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [x.tobytes() for x in features_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(places, pa.binary())], ["doc_id", "label", "places"])

    got = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id string, label int, places binary").toArrow()
    ids, xs = got.column("doc_id").to_pylist(), [np.frombuffer(v.as_buffer(), np.int32) for v in got.column("places")]
    order = sorted(range(len(xs)), key=lambda i: (ids[i], xs[i].tobytes()))
    return fit([xs[i] for i in order], got.column("label").to_numpy()[order])


def quality_scores(docs: DataFrame, classifier: Classifier, threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out boolean (fold 0), score double in 0 to 1, predicted int (1 where score >= threshold).

    One row for each input row, in any order. A null or empty text has no features and gets the curve's
    value at the bias; a very long one is taken whole, in stretches; a null id is not held out; repeated rows get
    equal scores; an empty table gives an empty one; other columns, whatever they are called, are not read.
    """
    session(docs)
    rows = text_rows(docs, id_col, text_col).withColumn("held_out", F.coalesce(fold_of("doc_id", folds) == 0, F.lit(False)))
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for batch in batches:
            score = [c.score(x) for x in features_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {id_type(rows)}, held_out boolean, score double, predicted int")


def good_texts(docs: DataFrame, classifier: Classifier, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold; nothing is shuffled.

    Null and empty texts have the score of no features, very long ones are taken whole; null ids are as good as others,
    repeated rows have one fate, an empty table gives an empty one; columns of any other name are passed on.
    """
    session(docs)
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for batch in batches:
            keep = [c.score(x) >= threshold for x in features_of(batch.column(text_col))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
