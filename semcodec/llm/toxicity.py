"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams with its ends marked (n from LEAST to MOST, and the whole word), hashed to a fixed number of
embeddings; its vector is their mean. A text is the mean of its words' vectors, times SCALE, and its score is the linear softmax's share of label 1.
Embeddings and softmax are fitted together, so unseen misspellings share most n-grams, and their vectors, with the words that they stand for.

The fit sees at most `sample` labelled rows: the executors count the words of their whole texts, and the driver gathers the counts. Only
n-grams whose share of toxic texts is off by more than chance (`strength` standard deviations) get an embedding; the others stand at the origin, which
is what keeps a few toxic words visible in the mean of a long text (README.md has figures). As the softmax is linear, the model reduces after
fitting to one number for each n-gram bucket, so scoring averages numbers of hashed n-grams over the text's bytes, in numpy, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel
from .common import held_out_rows, labelled_features, prepare_workers, slices

LEAST, MOST, BUCKET_BITS, DIMENSIONS = 3, 6, 18, 4
#: Factor of the mean of a text's word vectors.
SCALE = 100.0
#: What a fit takes at once: words when their n-grams are made, n-grams of texts when they are counted.
WORDS_AT_ONCE, GRAMS_AT_ONCE = 20_000, 1 << 20
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if kernel.ALNUM[b] else 32 for b in range(256))


def subwords(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, the word of each, and where each text's words begin.

    Works on UTF-8 bytes with A-Z lower-cased; an n-gram is a run of n bytes, so accented letters count as two.
    """
    starts, ends, first = kernel.word_spans(buf, off, kernel.ALNUM)
    length = ends - starts
    whole = kernel.span_hashes(buf, starts, ends, lower=True)
    buckets, words = [whole], [np.arange(len(starts))]
    for n in range(LEAST, MOST + 1):
        count = np.maximum(length - n + 1, 0)
        word = np.repeat(np.arange(len(starts)), count)
        begin = np.cumsum(count) - count
        at = np.arange(len(word)) - np.repeat(begin, count)
        a = starts[word] + at
        code = kernel.span_hashes(buf, a, a + n, lower=True)
        place = (at == 0).astype(np.uint64) + np.uint64(2) * (at == count[word] - 1).astype(np.uint64)
        buckets.append(code * np.uint64(4) + place)
        words.append(word)
    found = kernel.mix(np.concatenate(buckets)) >> np.uint64(64 - BUCKET_BITS)
    return found.astype(np.int64), np.concatenate(words), first


@dataclass
class Toxicity:
    """value: a number for each bucket, of which a text's mean of means is the softmax's difference of logits; bias: what is added to it."""

    value: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        bucket, word, first = subwords(buf, off)
        n = int(first[-1])
        words = np.bincount(word, self.value[bucket], n) / np.maximum(np.bincount(word, minlength=n), 1)
        sums = np.zeros(n + 1)
        np.cumsum(words, out=sums[1:])
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * mean, -700, 700)))


def _adam(rounds: int, rate: float, values: list[np.ndarray], gradient) -> None:
    """Fits `values` in place."""
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for t in range(1, rounds + 1):
        for v, g, (m, s) in zip(values, gradient(), state):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)


def word_counts(column: pa.Array) -> list[pa.Array]:
    """The distinct words of each text, A-Z lower-cased and joined by spaces, and how often it has them."""
    found = [Counter((x.as_py() or "").encode().translate(_WORD_BYTES).split()) for x in column]
    return [pa.array([b" ".join(x) for x in found], pa.binary()), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]


class Bags:
    """Distinct words of the texts of a fit, the n-grams of each, and which texts have them.

    bags: each text's distinct words, as word_counts() gives them; counts: their numbers, end to end.
    """

    def __init__(self, bags: list[bytes], counts: np.ndarray):
        number: dict[bytes, int] = {}
        own = [np.array([number.setdefault(w, len(number)) for w in bag.split()], np.int32) for bag in bags]
        self.texts, self.words = len(bags), len(number)
        self.word_of = np.concatenate(own) if own else np.zeros(0, np.int32)
        self.text_of = np.repeat(np.arange(self.texts, dtype=np.int32), [len(x) for x in own])
        self.times = counts.astype(np.float32)
        every, grams, sizes = list(number), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(every), WORDS_AT_ONCE):
            part = b" ".join(every[lo : lo + WORDS_AT_ONCE])
            bucket, word, first = subwords(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
            grams.append(bucket[np.argsort(word, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(word, minlength=first[-1]))
        self.gram, self.size = np.concatenate(grams), np.concatenate(sizes)

    def texts_with(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many texts, and how many of label 1, have an n-gram of each bucket; GRAMS_AT_ONCE n-grams of whole texts at a time."""
        begins, ends = np.cumsum(self.size) - self.size, np.searchsorted(self.text_of, np.arange(self.texts), "right")
        held = np.append(0, np.cumsum(self.size[self.word_of]))[ends]  # n-grams up to each text's end
        every, toxic, lo = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64), 0
        while lo < self.texts:
            hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + GRAMS_AT_ONCE, "right")))
            some = slice(ends[lo - 1] if lo else 0, ends[hi - 1])
            word, count = self.word_of[some], self.size[self.word_of[some]]
            at = np.arange(count.sum()) + np.repeat(begins[word] - np.cumsum(count) + count, count)
            pairs = np.unique(np.repeat(self.text_of[some].astype(np.int64), count) << BUCKET_BITS | self.gram[at])
            bucket = pairs & ((1 << BUCKET_BITS) - 1)
            every += np.bincount(bucket, minlength=1 << BUCKET_BITS)
            toxic += np.bincount(bucket[y[pairs >> BUCKET_BITS] == 1], minlength=1 << BUCKET_BITS)
            lo = hi
        return every, toxic


def train(bags: list[bytes], counts: np.ndarray, y: np.ndarray, *, rounds: int = 100, rate: float = 0.05, ridge: float = 3e-4, strength: float = 3.0, least: int = 4, seed: int = 3) -> Toxicity:
    """Fits embeddings and softmax; without both labels every score is the share of label 1.

    bags, counts: as for Bags. Embeddings are for n-grams that `least` texts or more have.
    """
    share = float(np.mean(y)) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Toxicity(np.zeros(1 << BUCKET_BITS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    own = Bags(bags, counts)
    every, toxic = own.texts_with(y)
    off_chance = (toxic - share * every) / np.sqrt(share * (1 - share) * every + 1e-9)
    told = (np.abs(off_chance) >= strength) & (every >= least)

    # from here on: words with such an n-gram, and those n-grams
    fits = np.flatnonzero(told[own.gram])
    fit_words, word = np.unique(np.repeat(np.arange(own.words, dtype=np.int32), own.size)[fits], return_inverse=True)
    buckets, gram = np.unique(own.gram[fits], return_inverse=True)
    number = np.full(own.words, -1)
    number[fit_words] = np.arange(len(fit_words))
    here = number[own.word_of] >= 0
    word_of, text_of, times = number[own.word_of[here]], own.text_of[here], own.times[here].astype(np.float64)
    n_grams = own.size[fit_words].astype(np.float64)
    scale = SCALE / np.maximum(np.bincount(own.text_of, own.times, own.texts), 1)

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (DIMENSIONS, len(buckets)))
    softmax = rng.normal(0, 1.0, (DIMENSIONS, 2))
    bias = np.log(np.array([1 - share, share]))
    one_hot = np.stack([1 - y, y], axis=1).astype(np.float64)
    sums = lambda at, values, n: np.stack([np.bincount(at, v, n) for v in values])

    def gradient():
        words = sums(word, table[:, gram], len(fit_words)) / n_grams
        means = sums(text_of, words[:, word_of] * times, own.texts) * scale
        logits = means.T @ softmax + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (p - one_hot) / len(y)
        d_words = sums(word_of, (softmax @ miss.T * scale)[:, text_of] * times, len(fit_words)) / n_grams
        return [sums(gram, d_words[:, word], len(buckets)) + ridge * table, means @ miss, miss.sum(axis=0)]

    _adam(rounds, rate, [table, softmax, bias], gradient)
    value = np.zeros(1 << BUCKET_BITS)
    value[buckets] = (softmax[:, 1] - softmax[:, 0]) @ table
    return Toxicity(value, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 4000) -> Toxicity:
    """A model of at most `sample` rows of labels (doc_id, toxic) that aren't held out."""
    rows, y = labelled_features(docs, labels, "toxic", sample, word_counts, "bag binary, count array<int>")
    return train(rows.column("bag").to_pylist(), rows.column("count").combine_chunks().flatten().to_numpy(), y)


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    A null text is an empty one; both get the score of a text without words. Repeated rows give repeated rows; a null doc_id
    stays null and isn't held out; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    sent = spark.sparkContext.broadcast(model)  # 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.score(buf, off) for _, _, buf, off in slices(b.column(1), 1 << 18)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held_out_rows(b.column(0)), pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
