"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the distinct words of a text and the beginnings of its longer words. Severity grades are ordered: 0
clean, 1 mild, 2 moderate, 3 severe. The labels carry a binary ``toxic`` flag only, so toxic training rows are graded
by terciles of how many strongly indicative features they hold, where what is indicative is learned from the other
half of the rows: no row's grade comes from a list that the row itself helped to choose. P(y <= k) = sigmoid(theta_k -
w.x) with one weight vector shared across the ordered thresholds; the output is the expected severity and the grade
probabilities.

Fitting uses about ``max_rows`` labelled documents (a documented bound, chosen by a hash of the id); scoring covers every document and its whole text.

Cases: null or empty texts have no features and get the intercept-only probabilities; labels that are null
or whose document is missing are not used; repeated rows are scored one by one; with no labels at all, or
with labels of one class only, every document has severity 0; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import hash_sample, pieces

GRADES = 4
#: Bytes of the beginnings of words that are features of their own.
STEMS = (5, 7)
#: Training rows that hold a feature at least.
LEAST_ROWS = 3
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> set[bytes]:
    """Distinct words: ASCII letters lower-cased, ASCII punctuation and white space separate."""
    return set((text or b"").translate(_CLEAN).split())


def features(found: set[bytes]) -> set[bytes]:
    """Words and, marked by an asterisk, which no word holds, the beginnings of longer ones."""
    return found.union(*({w[:k] + b"*" for w in found if len(w) > k} for k in STEMS))


@dataclass
class OrdinalModel:
    """Shared weights by feature and the ordered thresholds."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (40.0, 50.0, 60.0)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """One row of grade probabilities per score."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - np.array(self.thresholds), -60, 60)))
        return np.diff(np.column_stack([np.zeros(len(score)), below, np.ones(len(score))]), axis=1)

    def score(self, text: bytes | None) -> float:
        return sum(map(self.weights.__getitem__, self.weights.keys() & features(words(text))))


def indicative(texts: list[set[bytes]], toxic: np.ndarray, max_features: int, least_rows: int = LEAST_ROWS) -> dict[bytes, float]:
    """The ``max_features`` words whose presence says most about the label, with their log-odds."""
    seen: dict[bytes, list[int]] = {}
    for found, y in zip(texts, toxic):
        for w in found:
            seen.setdefault(w, [0, 0])[y] += 1
    pos, neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    rated = []
    for w, (n0, n1) in seen.items():
        if n0 + n1 >= least_rows:
            p1, p0 = (n1 + 0.5) / (pos + 1), (n0 + 0.5) / (neg + 1)
            odds = np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))
            rated.append((abs(odds) / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)), w, odds))
    rated.sort(key=lambda x: (-x[0], x[1]))
    return {w: float(o) for _, w, o in rated[:max_features]}


def grades(texts: list[set[bytes]], toxic: np.ndarray, max_features: int) -> np.ndarray:
    """0 for clean rows; toxic rows 1..3 by terciles of their number of features that are strongly indicative among
    the rows of the other half (odd and even ones)."""
    half, hits = np.arange(len(texts)) % 2, np.zeros(len(texts))
    for k in (0, 1):
        other = np.flatnonzero(half != k)
        strong = {w for w, o in indicative([texts[i] for i in other], toxic[other], max_features).items() if o > 2}
        hits[half == k] = [len(strong & texts[i]) for i in np.flatnonzero(half == k)]
    lo, hi = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (hits > lo) + (hits > hi), 0)


def fit(texts: list[set[bytes]], toxic: np.ndarray, max_features: int = 800, steps: int = 400, rate: float = 0.05, l2: float = 3e-5) -> OrdinalModel:
    """Fit by Adam on the full (bounded) sample; thresholds stay ordered as sums of exponentials."""
    toxic = np.asarray(toxic, np.int64)
    if not len(texts) or not toxic.any() or toxic.all():
        return OrdinalModel()
    odds = indicative(texts, toxic, max_features)
    index = {w: j for j, w in enumerate(odds)}
    y = grades(texts, toxic, max_features)
    x = np.zeros((len(texts), len(index)), np.float32)
    for i, t in enumerate(texts):
        x[i, [index[w] for w in t & index.keys()]] = 1
    share = np.cumsum(np.bincount(y, minlength=GRADES))[:-1] / len(y)
    first = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    par = np.concatenate([np.zeros(len(index)), theta])
    m, v = np.zeros_like(par), np.zeros_like(par)
    rows = np.arange(len(y))
    for step in range(1, steps + 1):
        w, cuts = par[: len(index)], np.cumsum(np.concatenate([par[len(index) :][:1], np.exp(par[len(index) + 1 :])]))
        below = 1 / (1 + np.exp(np.clip((x @ w)[:, None] - cuts, -60, 60)))
        full = np.column_stack([np.zeros(len(y)), below, np.ones(len(y))])
        p = np.maximum(full[rows, y + 1] - full[rows, y], 1e-9)
        slope = full * (1 - full)  # derivative of the sigmoid; zero at both outer borders
        up, down = slope[rows, y + 1] / p, slope[rows, y] / p
        d_score = (up - down) / len(y)  # of the mean negative log-likelihood
        d_cut = np.zeros((len(y), GRADES + 1))
        d_cut[rows, y + 1] -= up / len(y)
        d_cut[rows, y] += down / len(y)
        d_cut = d_cut[:, 1:-1].sum(0)
        d_par = np.exp(par[len(index) + 1 :]) * np.cumsum(d_cut[::-1])[::-1][1:]
        grad = np.concatenate([x.T @ d_score + l2 * w, [d_cut.sum()], d_par])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        par = par - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = np.cumsum(np.concatenate([par[len(index) :][:1], np.exp(par[len(index) + 1 :])]))
    return OrdinalModel({w: float(par[j]) for w, j in index.items()}, tuple(map(float, cuts)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_features: int = 800, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on about ``max_rows`` labelled documents. Executors reduce texts to their distinct words."""
    sample = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "toxic")
    sample = hash_sample(sample, max_rows, sample.count(), id_col)
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(text_col, F.col("toxic").cast("int").alias("toxic"))

    def run(batches):
        for b in pieces(batches, 0):
            found = [b" ".join(sorted(words(t))) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], names=["words", "toxic"])

    got = sorted((bytes(r.words), r.toxic) for r in rows.mapInArrow(run, "words binary, toxic int").collect())
    # what fewer rows hold is never chosen; without it, and with one object for each feature, the sets are small
    seen: Counter = Counter()
    for w, _ in got:
        seen.update(features(set(w.split())))
    frequent = {f: f for f, n in seen.items() if n >= LEAST_ROWS}
    del seen
    texts = [{frequent[f] for f in features(set(w.split())) if f in frequent} for w, _ in got]
    return fit(texts, np.array([int(y > 0) for _, y in got], np.int64), max_features)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, expected_severity, p_clean, p_mild, p_moderate, p_severe, toxic`` for every row; toxic is
    a probability of at least one half of any grade above clean. The model, bounded by ``max_features``
    words, is sent to each task; no shuffle."""
    source = docs.select(id_col, text_col)
    names = ["p_clean", "p_mild", "p_moderate", "p_severe"]
    schema = T.StructType(
        [source.schema[id_col], T.StructField("expected_severity", T.DoubleType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
        + [T.StructField("toxic", T.BooleanType())]
    )

    def run(batches):
        for b in pieces(batches, 1):
            s = np.array([model.score(t) for t in b.column(1).cast(pa.binary()).to_pylist()], float)
            p = model.probabilities(s)
            cols = [b.column(0), pa.array(p @ np.arange(GRADES)), *(pa.array(c) for c in p.T), pa.array(p[:, 0] <= 0.5)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that the model does not call toxic; decided in place, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in pieces(batches, at):
            s = np.array([model.score(t) for t in b.column(at).cast(pa.binary()).to_pylist()], float)
            yield b.filter(pa.array(model.probabilities(s)[:, 0] > 0.5))

    return docs.mapInArrow(run, docs.schema)
