"""A text classifier for a few classes: counted features, then multinomial logistic regression.

Features are hashed words and coarse measures of style.  In how many labelled texts of each class a
feature occurs is counted on all tasks; the ``CHOSEN`` features at most whose share in some class
differs from that in the rest by more than chance (``MIN_Z`` standard errors) enter the regression,
which the driver fits on the bounded sample's chosen features.  ``FEATURES`` and ``CHOSEN`` are the size of
the model, the same for every corpus; scoring reads all words of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.session import Workspace

FEATURES = 1 << 20
CHOSEN = 4096
MIN_Z = 4.0

_STYLE = 4096  # features that stand for style
_COUNT = _STYLE - 1  # not a feature: counts documents


def _style(found: W.Words, n: int) -> np.ndarray:
    """(row, feature) of style: shares of marks, capitals and repeated words, in coarse steps."""
    first = found.offsets[:-1]
    size = np.maximum(np.diff(found.offsets), 1)
    prefix = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    share = lambda mask: (lambda p: (p[found.offsets[1:]] - p[first]) / size)(prefix(mask))
    data = found.data
    marks = np.isin(data, np.frombuffer(b"|#$%&*<>{}[]^~=_\\", np.uint8))
    shares = [share(marks), share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(data == 33)]
    counts = np.maximum(found.per_doc, 1)
    distinct = np.zeros(n)
    if len(found.hash):
        pair = W.mix(found.hash ^ W.mix(found.doc.astype(np.uint64)))
        _, where = np.unique(pair, return_index=True)
        distinct = np.bincount(found.doc[where], minlength=n)
    steps = [np.digitize(s, [0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6]) for s in shares]
    steps.append(np.digitize(distinct / counts, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7]))
    steps.append(np.minimum(np.log2(counts + 1).astype(int) // 2, 15))
    return np.stack([k * 64 + s for k, s in enumerate(steps)], axis=1).reshape(-1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every text, each pair once."""
    found = W.split(texts, W.ALPHANUMERIC)
    n = len(texts)
    words = _STYLE + (found.hash % np.uint64(FEATURES - _STYLE)).astype(np.int64)
    style = _style(found, n)
    row = np.concatenate([found.doc, np.repeat(np.arange(n), len(style) // max(n, 1))])
    pair = np.unique(row * FEATURES + np.concatenate([words, style]))
    return pair // FEATURES, pair % FEATURES


def chosen_features(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``chosen``) of the chosen features of every text."""
    row, feature = features(texts)
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
    own = chosen[place] == feature
    return row[own], place[own]


class Classifier:
    """Weights of the chosen features for each class but the first, whose logit is 0."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, base: np.ndarray, prior: np.ndarray, rows: int):
        self.chosen, self.weights, self.base, self.prior, self.rows = chosen, weights, base, prior, rows

    def logits(self, texts: pa.Array) -> np.ndarray:
        """(classes - 1, texts), held between -30 and 30."""
        row, place = chosen_features(texts, self.chosen)
        out = [b + np.bincount(row, w[place], minlength=len(texts)) for w, b in zip(self.weights, self.base, strict=True)]
        return np.clip(np.stack(out), -30, 30)

    def ratios(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood ratios against the first class: logits without the classes' shares in the sample."""
        return self.logits(texts) - np.log(self.prior[1:] / self.prior[0])[:, None] if self.rows else self.logits(texts)

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        """(classes, texts)."""
        e = np.exp(np.vstack([np.zeros(len(texts)), self.logits(texts)]))
        return e / e.sum(axis=0)


def _logistic(row: np.ndarray, place: np.ndarray, cls: np.ndarray, size: int, classes: int, steps: int = 200, ridge: float = 2.0):
    """Multinomial logistic regression on binary features by Adam on the whole sample."""
    n, others = len(cls), classes - 1
    w = np.zeros((others, size + 1))
    if not n:
        return w[:, :size], w[:, size]
    target = np.stack([cls == k + 1 for k in range(others)]).astype(float)
    w[:, size] = np.log((target.sum(axis=1) + 1) / ((cls == 0).sum() + 1))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        logits = np.stack([w[k, size] + np.bincount(row, w[k, place], minlength=n) for k in range(others)])
        top = np.maximum(logits.max(axis=0), 0)
        e = np.exp(logits - top)
        error = e / (e.sum(axis=0) + np.exp(-top)) - target
        slope = [np.r_[np.bincount(place, error[k][row], minlength=size) + ridge * w[k, :size], error[k].sum()] for k in range(others)]
        gradient = np.stack(slope) / n
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w -= 0.15 * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return w[:, :size], w[:, size]


def fit(docs: DataFrame, marked: DataFrame, classes: int, key: str, text: str, rows: int) -> Classifier:
    """Fit on the documents that ``marked`` (key, _class) names, at most ``rows``: those of smallest hash."""
    marked = marked.orderBy(F.xxhash64(key), key).limit(rows)
    names = [f"c{k}" for k in range(classes)]

    def count(batches):
        # Counts of each task, one row a feature.
        total = np.zeros((classes, FEATURES), np.int32)
        for batch in W.pieces(batches, text):
            row, feature = features(batch.column(text))
            own = batch.column("_class").to_numpy()
            for k in range(classes):
                np.add.at(total[k], feature[own[row] == k], 1)
                total[k, _COUNT] += int((own == k).sum())
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(t[used]) for t in total)], ["feature", *names])

    work = Workspace(docs.sparkSession, "training")
    labelled = work.save(docs.select(key, text).join(F.broadcast(marked), key).select(text, "_class"), "labelled")
    counts = labelled.mapInArrow(count, ", ".join(["feature long", *(f"{n} int" for n in names)]))
    # A feature seen in fewer than five documents is no evidence.
    totals = counts.groupBy("feature").agg(*(F.sum(n).alias(n) for n in names)).where(f"{' + '.join(names)} >= 5 or feature = {_COUNT}")
    got = totals.toArrow()
    seen = np.stack([got.column(n).to_numpy() for n in names]).astype(float)
    ids = got.column("feature").to_numpy()
    n = seen[:, ids == _COUNT].sum(axis=1)
    z = np.zeros(len(ids))
    for k in range(classes):
        rest = n.sum() - n[k]
        if n[k] and rest:
            pooled = seen.sum(axis=0) / n.sum()
            error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n[k] + 1 / rest))
            z = np.maximum(z, np.abs(seen[k] / n[k] - (seen.sum(axis=0) - seen[k]) / rest) / error)
    z[ids == _COUNT] = 0
    best = np.lexsort((ids, -z))[:CHOSEN]
    chosen = np.sort(ids[best[z[best] > MIN_Z]])

    def pick(batches):
        for batch in W.pieces(batches, text):
            row, place = chosen_features(batch.column(text), chosen)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_class"), lists], ["class", "places"])

    sample = labelled.mapInArrow(pick, "class int, places array<int>").toArrow()
    work.drop(labelled)
    lists = sample.column("places").combine_chunks()
    cls = sample.column("class").to_numpy()
    row = np.repeat(np.arange(len(cls)), np.diff(lists.offsets.to_numpy()))
    weights, base = _logistic(row, lists.flatten().to_numpy(), cls, len(chosen), classes)
    return Classifier(chosen, weights, base, (n + 1) / (n.sum() + classes), len(cls))
