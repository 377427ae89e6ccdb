"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of code points (white space as one blank), present or not. The log ratio of
each feature's smoothed frequency among toxic and other labelled texts scales it, and a logistic
regression with a squared penalty is fitted to the scaled features until its gradient vanishes. A feature counts if its ratio differs from 0 by more than `SIGNIFICANT` standard errors; others are
noise, of which the fit would make weights (figures in the README). The model is fitted to at most `SAMPLE` labelled rows of
each class, taken by hash of their ids; its size is `2 ** BITS` numbers whatever the data. Scoring
reads each text once, whole; a very long text is a slice of its own.

Labels, language, source and ids are never features. Edge cases: a null text is an empty one and gets
the score of the intercept; without labelled rows of both classes every score is the share
of toxic ones (0 without labels) clipped to [0.01, 0.69]; labelled rows without a
document, null labels and labels other than 0 and 1 are left out; several labels of one
document count as toxic if any is; rows that share a labelled id are all fitted to. An empty table gives no rows. Carried columns with an output's name give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import settled

BITS = 20
LENGTHS = (3, 4, 5, 6)
#: Labelled rows of each class that the model is fitted to, at most.
SAMPLE = 4000
#: Standard errors by which a feature's log-count ratio differs from 0.
SIGNIFICANT = 3.0
THRESHOLD = 0.7
#: Runs of features whose counts are added up apart.
PARTS = 64
#: Strength of the squared penalty, most steps of the fit, largest entry of its last gradient, and mass of the smoothing.
PENALTY, STEPS, FLAT, SMOOTHING = 1e-4, 500, 1e-7, 0.5
#: Entries of texts that the fit looks at at once.
ENTRIES = 1 << 19
#: Text bytes that a Python worker looks at at once.
SLICE_BYTES = 1 << 20


def gram_features(raw: np.ndarray, offsets: np.ndarray, lengths=LENGTHS, bits: int = BITS):
    """For each n: (document, feature) of every n-gram of code points inside a document."""
    lead = (raw & 0xC0) != 0x80
    points = X.prefix(lead)[offsets]
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) != points[-1]:  # not UTF-8: bytes are the characters
        codes, points = raw.astype(np.uint32), offsets
    codes = np.where((codes == 32) | ((codes >= 9) & (codes <= 13)), 32, codes)
    # A blank before and after each text, so that first and last words are words.
    n = len(points) - 1
    padded = np.full(len(codes) + 2 * n, 32, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(points))
    padded[np.arange(len(codes)) + 2 * doc + 1] = codes
    whole = np.repeat(np.arange(n, dtype=np.int32), np.diff(points) + 2)
    mixed = X.mix(padded.astype(np.uint64) + np.uint64(1))
    for k in lengths:
        m = len(padded) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[i : i + m]
        own = whole[:m] == whole[k - 1 :]
        yield whole[:m][own], (X.mix(h[own]) >> np.uint64(64 - bits)).astype(np.uint32)


def distinct_features(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None, bits: int = BITS):
    """Distinct (document, feature) pairs in order; only features with `wanted` set."""
    found = [np.zeros(0, np.uint64)]
    for doc, feature in gram_features(raw, offsets, bits=bits):
        if wanted is not None:
            take = wanted[feature]
            doc, feature = doc[take], feature[take]
        found.append(doc.astype(np.uint64) << np.uint64(32) | feature)
    pairs = np.sort(np.concatenate(found))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def ordered_by_hash(column: Column) -> list[Column]:
    return [F.xxhash64(column), column]


def sample_rows(labelled: DataFrame, id_column: str, label: str, size: int) -> DataFrame:
    """At most `size` ids of each class, by hash; `labelled` has ids and labels."""
    one = labelled.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label).cast("int").alias("y"))
    parts = [one.where(F.col("y") == y).orderBy(*ordered_by_hash(F.col(id_column))).limit(size) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


class Model:
    """Weights of the features present, and an intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.bias = bias
        self.wanted = weights != 0
        self.weights = weights.astype(np.float32)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = distinct_features(raw, offsets, self.wanted)
        total = np.bincount(doc, self.weights[feature], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def ratios(with_1: np.ndarray, with_0: np.ndarray, n_1: int, n_0: int) -> np.ndarray:
    """Log-count ratios of features by the numbers of texts of each class that have them; 0 where they say nothing beyond noise."""
    p, q = with_1 + SMOOTHING, with_0 + SMOOTHING
    ratio = np.log(p / (n_1 + 2 * SMOOTHING)) - np.log(q / (n_0 + 2 * SMOOTHING))
    ratio[np.abs(ratio) < SIGNIFICANT * np.sqrt(1 / p + 1 / q)] = 0
    return ratio


def least(loss, start: np.ndarray, memory: int = 8) -> np.ndarray:
    """Where a convex function is least, by limited-memory quasi-Newton steps; `loss` returns value and gradient."""
    w, (value, slope) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() <= FLAT:
            break
        back, shares = slope.copy(), []
        for s, y in reversed(moves):
            shares.append(s @ back / (s @ y))
            back -= shares[-1] * y
        back *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / np.abs(slope).sum()
        for (s, y), share in zip(moves, reversed(shares), strict=True):
            back += s * (share - y @ back / (s @ y))
        size, fall = 1.0, float(slope @ back)
        while True:
            there = w - size * back
            new, new_slope = loss(there)
            if new <= value - 1e-4 * size * fall or size < 1e-10:
                break
            size /= 2
        s, y = there - w, new_slope - slope
        if s @ y > 1e-16:
            moves = [*moves, (s, y)][-memory:]
        w, value, slope = there, new, new_slope
    return w


def fit(texts: list[bytes], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept. `texts`: the places among the features that each text has, as bytes of `kind(len(ratio))`; the list is emptied; `ratio`: the features' log-count ratios. Each class weighs the same."""
    n = len(y)
    prior = float(np.clip(y.mean(), 0.01, 0.69)) if n else 0.01
    if not n or y.min() == y.max() or not len(ratio):
        return np.zeros(len(ratio)), float(np.log(prior / (1 - prior)))
    # One array of two or four bytes an entry, text by text.
    width = np.dtype(kind(len(ratio))).itemsize
    ends = np.cumsum([len(t) // width for t in texts])
    at, starts = np.empty(ends[-1], kind(len(ratio))), np.append(0, ends[:-1])
    for i in range(n):
        at[starts[i] : ends[i]] = np.frombuffer(texts[i], at.dtype)
        texts[i] = b""
    some = np.flatnonzero(ends > starts)
    runs = np.split(some, np.flatnonzero(np.diff(starts[some] // ENTRIES)) + 1) if len(some) else []  # texts whose entries are looked at together
    own = ratio

    def sums(values: np.ndarray) -> np.ndarray:
        """Of each text the sum of the values of its features."""
        out = np.zeros(n)
        for run in runs:
            out[run] = np.add.reduceat(values[at[starts[run[0]] : ends[run[-1]]]], starts[run] - starts[run[0]])
        return out

    own = own / np.sqrt(max(float(np.median(sums(own * own))), 1e-9))  # a text's features have a length of about 1
    balance = np.where(y == 1, 0.5 / np.count_nonzero(y == 1), 0.5 / np.count_nonzero(y == 0))
    sign = np.where(y == 1, 1.0, -1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * (sums(own * w[:-1]) + w[-1])
        error, slope = -balance * sign / (1 + np.exp(np.clip(margin, -500, 500))), np.zeros(len(own))
        for run in runs:
            slope += np.bincount(at[starts[run[0]] : ends[run[-1]]], np.repeat(error[run], ends[run] - starts[run]), len(own))
        return float((balance * np.logaddexp(0, -margin)).sum() + PENALTY / 2 * (w[:-1] @ w[:-1])), np.append(own * slope + PENALTY * w[:-1], error.sum())

    w = least(loss, np.zeros(len(own) + 1))
    return w[:-1] * own, float(w[-1])


def kind(features: int) -> str:
    """The smallest type of a feature's place among so many."""
    return "<u2" if features <= 1 << 16 else "<u4"


def class_counts(rows: DataFrame, text: str) -> DataFrame:
    """Texts of each class with each feature: (part, counts of class 1, of class 0), in `PARTS` runs of features."""
    size = 1 << BITS

    def run(batches):
        counts = np.zeros((2, size), np.int32)
        for part, raw, offsets in X.slices(batches, text, SLICE_BYTES):
            doc, feature = distinct_features(raw, offsets)
            y = part.column("y").to_numpy()[doc]
            for k in (0, 1):
                counts[k] += np.bincount(feature[y == k], minlength=size).astype(np.int32)
        if counts.any():
            cut = counts.reshape(2, PARTS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PARTS), pa.int32()), *[pa.array([cut[k, i].tobytes() for i in range(PARTS)], pa.binary()) for k in (1, 0)]], ["part", "with_1", "with_0"]
            )

    def add(table: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column(c).to_pylist()) for c in ("with_1", "with_0")]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "with_1": [total[0].tobytes()], "with_0": [total[1].tobytes()]})

    schema = "part int, with_1 binary, with_0 binary"
    return rows.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema)


def train(documents: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "toxic", size: int = SAMPLE) -> Model:
    """Fits a model to a sample of at most 2 * `size` labelled documents.

    To the driver come 2 ** BITS counts of either class, and of each of the at most 2 * `size` texts those features that differ between the classes, two bytes each (four if there are more than 65,536).
    """
    chosen = settled(sample_rows(labels.select(id_column, label), id_column, label, size))
    number = {r[0]: r[1] for r in chosen.groupBy("y").count().collect()}
    rows = documents.select(id_column, text).join(F.broadcast(chosen), id_column)
    parts = {r[0]: (np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int64)) for r in class_counts(rows, text).collect()}
    empty = np.zeros((1 << BITS) // PARTS, np.int64)
    with_1, with_0 = (np.concatenate([parts.get(i, (empty, empty))[k] for i in range(PARTS)]) for k in (0, 1))
    ratio = ratios(with_1, with_0, number.get(1, 0), number.get(0, 0))
    used = np.flatnonzero(ratio)
    wanted, place = ratio != 0, np.zeros(1 << BITS, kind(len(used)))
    place[used] = np.arange(len(used))

    def run(batches):
        for part, raw, offsets in X.slices(batches, text, SLICE_BYTES):
            doc, feature = distinct_features(raw, offsets, wanted)
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            values = place[feature]
            blobs = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(blobs, pa.binary())], ["y", "features"])

    got = [(r[0], bytes(r[1])) for r in rows.mapInArrow(run, "y int, features binary").collect()]
    got.sort()  # the same model whatever order rows arrive in
    labels_, texts = np.array([y for y, _ in got], np.int64), [t for _, t in got]
    del got
    weights = np.zeros(1 << BITS)
    weights[used], bias = fit(texts, labels_, ratio[used])
    return Model(weights, bias)


def score_toxicity(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep` of each row with `score` (0 to 1) and `predicted`."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 5 MB at BITS = 20

    def run(raw, offsets):
        scores = shared.value.scores(raw, offsets)
        return [scores, (scores >= threshold).astype(np.int32)]

    return X.map_texts(df, text, [("score", "double"), ("predicted", "int")], run, keep, SLICE_BYTES)
