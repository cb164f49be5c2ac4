"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

Words are runs of letters and digits and runs of other visible characters, so marks are words of their own; a text is
the shares of its hashed words and word pairs (a word twice in a row is one and the same pair, whichever word it is). The fit sees
at most `sample` labelled rows, chosen in the order of a hash of their ids: the executors count the features of their whole texts, and the
driver gathers the counts. Scoring is a sparse dot product
in numpy on the texts' bytes, one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel
from .common import held_out_rows, labelled_features, prepare_workers, slices

BITS, SHARE = 20, 10.0
_MARKS = kernel.NOT_SPACE & ~kernel.ALNUM
_TWICE = np.uint64(0x5851F42D4C957F2D)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, a value for each occurrence, and where each text's begin."""
    a, b = kernel.word_spans(buf, off, kernel.ALNUM), kernel.word_spans(buf, off, _MARKS)
    starts, ends = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(starts)
    starts, ends = starts[order], ends[order]
    words = kernel.span_hashes(buf, starts, ends, lower=True)
    first = np.searchsorted(starts, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    same = text[1:] == text[:-1]
    left, right = words[:-1][same], words[1:][same]
    pairs = np.where(left == right, _TWICE, kernel.mix(left * np.uint64(3) + right * np.uint64(0x9E3779B97F4A7C15)))
    found, owner = np.concatenate([words, pairs]), np.concatenate([text, text[:-1][same]])
    order = np.argsort(owner, kind="stable")
    return (kernel.mix(found[order]) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(off)))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        found, begins = features(buf, off)
        sums = np.zeros(len(found) + 1)
        np.cumsum(self.weights[found], out=sums[1:])
        n = np.diff(begins)
        return 1 / (1 + np.exp(-(self.bias + SHARE * (sums[begins[1:]] - sums[begins[:-1]]) / np.maximum(n, 1))))


def feature_counts(column: pa.Array) -> list[pa.Array]:
    """The distinct features of each text and how often it has them."""
    found, counts = [], []
    for _, _, buf, off in slices(column):
        every, begins = features(buf, off)
        for i, j in zip(begins[:-1], begins[1:]):
            at, count = np.unique(every[i:j], return_counts=True)
            found.append(at.astype(np.int32))
            counts.append(count.astype(np.int32))
    return [pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]


def train(counted: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, rounds: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.1) -> QualityModel:
    """FTRL-proximal over the texts' features and counts in order; without rows every score is 0.5."""
    bits = 1 << BITS
    z, n, w = np.zeros(bits + 1), np.zeros(bits + 1), np.zeros(bits + 1)  # the last one is the bias
    rows = [(np.append(at, bits), np.append(SHARE * count / max(count.sum(), 1), 1.0)) for at, count in counted]
    for _ in range(rounds):
        for (at, x), label in zip(rows, y):
            own_z, own_n = z[at], n[at]
            own_w = np.where(np.abs(own_z) <= l1, 0.0, -(own_z - np.sign(own_z) * l1) / ((beta + np.sqrt(own_n)) / alpha + l2))
            own_w[-1] = -own_z[-1] / ((beta + np.sqrt(own_n[-1])) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(own_w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / alpha
            z[at] = own_z + g - sigma * own_w
            n[at] = own_n + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    bias = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha + l2)
    return QualityModel(w[:-1].astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 6000) -> QualityModel:
    """A model of at most `sample` rows of labels (doc_id, quality) that aren't held out."""
    rows, y = labelled_features(docs, labels, "quality", sample, feature_counts, "at array<int>, count array<int>")
    return train([(at.values.to_numpy(), count.values.to_numpy()) for at, count in zip(rows.column("at"), rows.column("count"))], y)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    A null text is an empty one; both get the score of a text without words. Repeated rows give repeated rows; a null doc_id
    stays null and isn't held out; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    sent = spark.sparkContext.broadcast(model)  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.score(buf, off) for _, _, buf, off in slices(b.column(1))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held_out_rows(b.column(0)), pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
