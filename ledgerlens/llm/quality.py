"""Quality classifier: naive Bayes features in a linear support vector machine.

A document is the set of its hashed byte n-grams (case kept) and of one
indicator for how often a word repeats the one before.  Each indicator is
scaled by the log-count ratio of its n-gram between the classes, the vector
is scaled to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent.  Margins become scores through a logistic curve fitted on
rows of the sample that the machine did not see.

Fitting takes at most ``SAMPLE_ROWS`` labelled rows (see ``training_sample``).
Their features are computed by Spark tasks, at most 2^BITS numbers a row, and
one task fits; the model is two arrays of 2^BITS numbers, sent to the tasks
that score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fold
from ledgerlens.llm.labelled import training_sample

SAMPLE_ROWS = 6_000
BITS = 18
ORDERS = (2, 4)
FOLDS = 5            # a document is held out if its fold is 0
_BLOCK = 1 << 19     # bytes hashed at a time


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` bytes from every position on, BITS wide."""
    n = len(data) - order + 1
    h = np.full(n, 0x9E3779B97F4A7C15 * order % (1 << 64), dtype=np.uint64)
    for k in range(order):
        h = (h ^ data[k:k + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _repeats(b: bytes) -> int:
    """Indicator numbers 0-3 for the share of words that repeat the word before:
    none, once or up to 2 %, up to 10 %, more."""
    found = b.split()
    again = sum(x == y for x, y in zip(found, found[1:]))
    return 0 if not again else 1 if again <= max(1, 0.02 * len(found)) else 2 if again <= 0.1 * len(found) else 3


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row starts, features): each text's distinct indicators, in CSR form."""
    place = np.zeros(1 << BITS, dtype=np.int64)
    rows: list[np.ndarray] = []

    def distinct(f: np.ndarray) -> np.ndarray:
        at = np.arange(len(f))
        place[f] = at                             # of equal numbers one is left standing
        return f[place[f] == at]

    def add(parts: list[np.ndarray], b: bytes) -> None:
        if b:
            parts.append(np.array([_repeats(b)], dtype=np.int64))
        rows.append(distinct(np.concatenate(parts)).astype(np.int32) if parts else np.zeros(0, np.int32))

    def flush(group: list[bytes]) -> None:
        data = np.frombuffer(b"".join(group), dtype=np.uint8).astype(np.uint64)
        grams = [_grams(data, n) if len(data) >= n else np.zeros(0, np.int64) for n in ORDERS]
        at = 0
        for b in group:
            add([g[at:at + len(b) - n + 1] for n, g in zip(ORDERS, grams) if len(b) >= n], b)
            at += len(b)

    group, held = [], 0
    for text in texts:
        b = (text or "").encode("utf-8", "surrogatepass")
        if held + len(b) > _BLOCK and group:
            flush(group)
            group, held = [], 0
        if len(b) <= _BLOCK:
            group.append(b)
            held += len(b)
            continue
        parts = []                                # one long text, piece by piece
        for i in range(0, len(b), _BLOCK):
            piece = np.frombuffer(b[i:i + _BLOCK + max(ORDERS) - 1], dtype=np.uint8).astype(np.uint64)
            parts.append(distinct(np.concatenate([_grams(piece, n) for n in ORDERS if len(piece) >= n] or [np.zeros(0, np.int64)])))
        add(parts, b)
    if group:
        flush(group)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64), flat


def _slices(texts: list[str], size: int = _BLOCK) -> Iterator[list[str]]:
    """The texts in runs of about ``size`` characters, at least one text each."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


@dataclass
class NbSvm:
    weights: np.ndarray      # of an indicator: log-count ratio times the machine's weight
    ratios: np.ndarray       # for the vector's length
    bias: float
    slope: float
    offset: float

    def margins(self, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        dot = np.bincount(row, self.weights[flat], minlength=len(starts) - 1)
        length = np.sqrt(np.bincount(row, self.ratios[flat] ** 2, minlength=len(starts) - 1))
        return dot / np.maximum(length, 1e-9) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scored in slices: the indicators of a whole batch would be many times its text."""
        z = [self.slope * self.margins(*features(part)) + self.offset for part in _slices(texts)]
        return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros(0), -35, 35)))


def log_count_ratios(starts, flat, y, alpha: float = 1.0) -> np.ndarray:
    """log of (count of the n-gram in class 1, smoothed and normed) over class 0's."""
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    p = alpha + np.bincount(flat, y[row] == 1, minlength=1 << BITS)
    q = alpha + np.bincount(flat, y[row] == 0, minlength=1 << BITS)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(starts, flat, values, y, cost: float = 1.0, passes: int = 15, seed: int = 0):
    """Hinge-loss machine without constraint on the bias, which is a constant feature."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(y))
    sign = np.where(y == 1, 1.0, -1.0)
    upper = np.where(y == 1, cost * len(y) / max(1, 2 * (y == 1).sum()), cost * len(y) / max(1, 2 * (y == 0).sum()))
    square = np.array([np.dot(values[a:b], values[a:b]) for a, b in zip(starts[:-1], starts[1:])]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, x = flat[starts[i]:starts[i + 1]], values[starts[i]:starts[i + 1]]
            gradient = sign[i] * (np.dot(w[f], x) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * x                  # features of a row are distinct
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels (Newton,
    lightly regularised; classes weighted alike)."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    x = np.stack([margin, np.ones_like(margin)])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -35, 35)))
        gradient = x @ (weight * (p - y)) + 0.1 * (theta - [1.0, 0.0])
        hessian = (x * (weight * p * (1 - p))) @ x.T + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit_arrays(starts: np.ndarray, flat: np.ndarray, y: np.ndarray) -> NbSvm:
    """Model of rows in CSR form; without both classes, a constant one."""
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        odds = np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))
        return NbSvm(np.zeros(1 << BITS), np.ones(1 << BITS), 0.0, 1.0, float(odds))

    def machine(rows):
        pick = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in rows]) if len(rows) else np.zeros(0, np.int64)
        s = np.concatenate(([0], np.cumsum(np.diff(starts)[rows])))
        f = flat[pick]
        r = log_count_ratios(s, f, y[rows])
        row = np.repeat(np.arange(len(rows)), np.diff(s))
        length = np.sqrt(np.bincount(row, r[f] ** 2, minlength=len(rows)))
        w, bias = dual_coordinate_descent(s, f, r[f] / np.maximum(length, 1e-9)[row], y[rows])
        return NbSvm(w * r, r, bias, 1.0, 0.0)

    # Margins of unseen rows, for the logistic curve.
    part = np.arange(len(y)) % 4 == 0
    rest = np.nonzero(~part)[0]
    if len(np.unique(y[rest])) == 2 and len(np.unique(y[part])) == 2:
        unseen = machine(rest)
        slope, offset = _logistic(unseen.margins(starts, flat)[part], y[part])
    else:
        slope, offset = 2.0, 0.0
    model = machine(np.arange(len(y)))
    model.slope, model.offset = slope, offset
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = SAMPLE_ROWS,
        doc_id: str = "doc_id", text: str = "text") -> NbSvm:
    """Model fitted by one task on at most ``rows`` labelled documents; only
    its 2 x 2^BITS numbers reach the driver."""
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for part in _slices(list(b["text"])):
                starts, flat = features(part)
                found += [flat[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "features": found})

    def learn(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id", key=lambda ids: ids.map(lambda i: (len(i), i)))
        found = [np.frombuffer(x, dtype=np.int32) for x in sample["features"]]
        starts = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
        m = fit_arrays(starts, np.concatenate(found), sample["label"].to_numpy(dtype=np.int64))
        return pd.DataFrame([{"weights": m.weights.astype(np.float32).tobytes(), "ratios": m.ratios.astype(np.float32).tobytes(),
                              "rest": [m.bias, m.slope, m.offset]}])

    sample = training_sample(docs, labels, label, allowed, rows, doc_id, text)
    got = (sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label")
           .mapInPandas(sets, "doc_id string, label int, features binary")
           .groupBy().applyInPandas(learn, "weights binary, ratios binary, rest array<double>").first())
    if got is None:                                  # no labelled row at all
        return fit_arrays(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    return NbSvm(np.frombuffer(got["weights"], np.float32), np.frombuffer(got["ratios"], np.float32), *got["rest"])


def scorer(model: NbSvm):
    """Column function: the score of a text column, batch by batch."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(list(texts)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS,
                   threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Fitted on labelled rows outside fold 0 only.  Empty and null texts score
    what the model gives a document without n-grams; repeated rows each get
    their row; no usable labels give every row the constant 0.5; an empty
    table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, label, fold(F.col("doc_id"), FOLDS) != 0, rows, doc_id, text)
    return (docs.select(F.col(doc_id).alias("doc_id"), scorer(model)(F.col(text)).alias("score"))
            .select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
