"""A quality classifier learned from trusted positives and unlabelled documents.

Every document becomes a short vector of text statistics. A linear model with logistic loss
minimises the non-negative unbiased risk

    prior * E_pos[loss(g)] + max(0, E_all[loss(-g)] - prior * E_pos[loss(-g)])

where the class prior is estimated from the labelled rows. Positives and unlabelled rows are
all of the corpus: each step is one pass that returns sums of fixed size from every task.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import mapped, whole_texts
from tablewright.operators.sizes import broadcast_if_small
from tablewright.session import written

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, 4)
_CLASS[list(b" \t\n\x0b\x0c\r")] = 0
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(97, 123))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[list(_MARKS)] = 5
_CLASS[list(b".,;:")] = 6
FEATURES = 26 + len(_MARKS)


def text_statistics(data: bytes) -> np.ndarray:
    """Shares of characters, words, endings and repeats in one text; all zero for an empty one."""
    out = np.zeros(FEATURES, np.float32)
    words = data.split()
    if not words:
        return out
    n, k = len(data), len(words)
    cells = np.frombuffer(data, np.uint8)
    by_byte = np.bincount(cells, minlength=256)
    kind = _CLASS[cells]
    shares = np.bincount(_CLASS, weights=by_byte, minlength=7) / n
    white = kind == 0
    ends = np.flatnonzero(~white & np.append(white[1:], True))
    starts = np.flatnonzero(~white & np.append(True, white[:-1]))
    sizes = ends - starts + 1
    last = np.bincount(kind[ends], minlength=7) / k
    first = np.bincount(kind[starts], minlength=7) / k
    counts = Counter(words)
    lines = data.split(b"\n")
    some = by_byte[by_byte > 0] / n
    out[:7] = shares
    out[7:13] = last[1:]
    out[13:16] = first[[1, 2, 5]]
    out[16] = len(counts) / k
    out[17] = sum(map(eq, words, words[1:])) / k
    out[18] = counts.most_common(1)[0][1] / k
    out[19] = (sizes == 1).mean()
    out[20] = math.log1p(sizes.mean())
    out[21] = math.log1p(sizes.std())
    out[22] = len(zlib.compress(data, 1)) / n
    out[23] = -(some * np.log2(some)).sum() / 8
    out[24] = 1 - len(set(lines)) / len(lines)
    out[25] = math.log1p(k) / 10
    out[26:] = np.sqrt(by_byte[list(_MARKS)] / n)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its whole text as float32 bytes."""

    def run(batches):
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                yield doc, text_statistics(text).tobytes()

    return mapped(whole_texts(docs), run, "doc_id long, x binary")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant's
    prior: float

    def inputs(self, raw: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), FEATURES).astype(float)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([x, np.ones((len(x), 1))])

    def score(self, raw: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(raw) @ self.weights, -500, 500)))


def _sums(df: DataFrame, of) -> np.ndarray:
    """The sum of the fixed-size vectors that ``of`` makes of each batch."""

    def run(batches):
        total = None
        for b in batches:
            if len(b["x"]):
                part = of(b)
                total = part if total is None else total + part
        if total is not None:
            yield (total.astype(float).tobytes(),)

    parts = [np.frombuffer(r[0]) for r in mapped(df, run, "sums binary").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(1)


def fit(rows: DataFrame, prior: float | None = None, decay: float = 1e-3, steps: int = 12) -> Model:
    """A model from ``rows`` (x, positive): true for trusted positives, false for documents
    labelled otherwise, null for documents without label.

    All rows make up the unlabelled sample. ``prior`` defaults to the labelled rows' share of
    positives, with one of each kind added. Without any row, or without a positive, the model
    scores every text with the prior. Steps are damped Newton steps on sums from all tasks.
    """

    def moments(b):
        x = np.frombuffer(b"".join(b["x"]), np.float32).reshape(-1, FEATURES).astype(float)
        known = [p for p in b["positive"] if p is not None]
        return np.concatenate([[len(x), sum(known), len(known)], x.sum(0), (x * x).sum(0)])

    total = _sums(rows, moments)
    if len(total) == 1:
        total = np.zeros(3 + 2 * FEATURES)
    n, positives, known = total[:3]
    prior = (positives + 1) / (known + 2) if prior is None else prior
    mean = total[3:3 + FEATURES] / max(n, 1)
    scale = np.sqrt(np.maximum(total[3 + FEATURES:] / max(n, 1) - mean**2, 1e-8))
    size = FEATURES + 1
    model = Model(mean, scale, np.append(np.zeros(FEATURES), math.log(prior / (1 - prior))), prior)
    if not positives:
        return model
    last, weights, damp = math.inf, model.weights, 1.0
    step = np.zeros(size)
    for _ in range(steps):
        trial = Model(mean, scale, weights + damp * step, prior)

        def slopes(b, at=trial):
            x = at.inputs(b["x"])
            g = x @ at.weights
            s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            p = np.array([v is True for v in b["positive"]])
            plus, minus = np.logaddexp(0, -g), np.logaddexp(0, g)  # losses as a positive, as a negative
            return np.concatenate([
                [plus[p].sum(), minus[p].sum(), minus.sum()],
                ((s - 1)[:, None] * x)[p].sum(0), (s[:, None] * x)[p].sum(0), (s[:, None] * x).sum(0),
                ((x * (s * (1 - s))[:, None]).T @ x).ravel(),
            ])

        v = _sums(rows, slopes)
        negative = v[2] / n - prior * v[1] / positives
        risk = prior * v[0] / positives + max(0.0, negative) + decay / 2 * (trial.weights[:-1] ** 2).sum()
        if risk > last + 1e-9:
            damp /= 4
            if damp < 1e-3:
                break
            continue
        better, last, weights = last - risk, risk, trial.weights
        if better < 1e-6:
            break
        at_plus, at_minus, at_all = (v[3 + i * size:3 + (i + 1) * size] for i in range(3))
        slope = prior * at_plus / positives
        if negative >= 0:
            slope = slope + at_all / n - prior * at_minus / positives
        ridge = np.append(np.full(FEATURES, decay), 0.0)
        curve = v[3 + 3 * size:].reshape(size, size) / n + np.diag(ridge + 1e-6)
        step, damp = -np.linalg.solve(curve, slope + ridge * weights), 1.0
    return Model(mean, scale, weights, prior)


def quality_scores(docs: DataFrame, labels: DataFrame, trusted: Column, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, trusted, score (0 to 1, higher is better) and predicted (0 or 1).

    ``labels`` has doc_id and quality (1 good, 0 bad, null none); ``trusted``, a column of
    doc_id, says from which rows to learn, both labels and unlabelled texts. Several labels of
    a document count as the smallest. Null and empty texts have statistics of zero and get a
    score like any other. An empty table gives no rows.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("positive"))
    x = written(features(docs), "quality-features").withColumn("trusted", trusted)
    model = fit(written(x.filter("trusted").join(broadcast_if_small(marks), "doc_id", "left").select("x", "positive"), "quality-rows"))

    def run(batches):
        for b in batches:
            if len(b["x"]):
                yield from zip(b["doc_id"], b["trusted"], (s := model.score(b["x"])).tolist(), (s >= threshold).astype(int).tolist())

    return mapped(x, run, "doc_id long, trusted boolean, score double, predicted int")
