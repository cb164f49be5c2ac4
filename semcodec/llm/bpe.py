"""Byte-level BPE encoding and decoding.

A text is cut into words by the vocabulary's pattern; a word is encoded by merging, again and again, the leftmost of the
adjacent pieces with the least rank, over its bytes. Decoding concatenates the tokens' bytes.

There are two forms of that fold with one result. `word_ids` is made of Spark's higher-order functions: it folds ranked merges over
the bytes of a column of distinct words, with the ranks as a literal (an array of small maps, in which the map of a piece is found by the
piece's CRC, so a lookup doesn't depend on the vocabulary's size). `encode` does the same within a Python worker, in numpy for all words of a
batch at once that the worker hasn't seen lately, and puts whole texts together in the same pass without a shuffle; README.md says why the
query takes that one. A word of any length is merged in time n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers
from .tokens import load_ranks, white_space_of_unicode

SLOTS = 1 << 16
#: Words, and space-separated pieces of texts, that a worker remembers, if they have SHORT bytes at most; longer words are merged with a heap.
REMEMBERED, SHORT = 300_000, 64
_NONE = (1 << 31) - 1


def rank_table(ranks: dict[bytes, int], slots: int = SLOTS) -> Column:
    """The ranks as an array of maps; a byte is the character of the same number."""
    maps: list[dict[str, int]] = [{} for _ in range(slots)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        maps[zlib.crc32(text.encode()) % slots][text] = rank
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), "array<map<string,int>>")


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _merged(word: Column, table: Column, slots: int) -> Column:
    """The ids of a word given as a string of one character for each byte."""
    rank = lambda piece: _let(piece, lambda p: F.coalesce(F.get(table, (F.crc32(p.cast("binary")) % slots).cast("int"))[p], F.lit(_NONE)))
    at = lambda pieces, i: F.get(pieces, i)
    start = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)))
    ranks = lambda pieces: F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, i: rank(F.concat(at(pieces, i), p)))

    def merge(s: Column, i: Column) -> Column:  # i: index of the left piece, from 0
        pieces, found, n = s["pieces"], s["ranks"], F.size(s["pieces"])
        new = F.concat(at(pieces, i), at(pieces, i + 1))
        before = F.when(i > 0, F.array(rank(F.concat(at(pieces, i - 1), new)))).otherwise(F.array().cast("array<int>"))
        after = F.when(i + 2 < n, F.array(rank(F.concat(new, at(pieces, i + 2))))).otherwise(F.array().cast("array<int>"))
        return F.struct(
            F.concat(F.slice(pieces, F.lit(1), i), F.array(new), F.slice(pieces, i + 3, n)).alias("pieces"),
            F.concat(F.slice(found, F.lit(1), F.greatest(i - 1, F.lit(0))), before, after, F.slice(found, i + 3, n)).alias("ranks"),
        )

    def step(s: Column, _: Column) -> Column:
        least = F.array_min(s["ranks"])
        return F.when(F.coalesce(least, F.lit(_NONE)) == _NONE, s).otherwise(_let((F.array_position(s["ranks"], least) - 1).cast("int"), lambda i: merge(s, i)))

    first = _let(start, lambda pieces: F.struct(pieces.alias("pieces"), ranks(pieces).alias("ranks")))
    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), first, step, lambda s: s["pieces"])
    return F.transform(folded, rank)


def word_ids(words: DataFrame, ranks: dict[bytes, int], slots: int = SLOTS) -> DataFrame:
    """words (word binary) -> the distinct words with their ids: array<int>; an empty word has none, a null one null."""
    text = F.decode("word", "ISO-8859-1")
    ids = F.when(F.length("word") == 0, F.array().cast("array<int>")).otherwise(_merged(text, rank_table(ranks, slots), slots))
    return words.select("word").distinct().select("word", F.when(F.col("word").isNotNull(), ids).alias("ids"))


class Merges:
    """Merges the bytes of many words at once: in each step, the leftmost pair of least rank of every word."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}  # every way to put a token together from two
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([k])] for k in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers; words have a byte at least."""
        size = np.array([len(w) for w in words], np.int64)
        token = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word, first = np.repeat(np.arange(len(words)), size), np.zeros(len(token), bool)
        first[np.cumsum(size) - size] = True
        last = np.append(first[1:], True)
        rank = np.full(len(token), _NONE)
        pairs = np.flatnonzero(~last)
        rank[pairs] = self.rank(token[pairs], token[pairs + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            starts = np.flatnonzero(first)
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            live = least >> 32 < _NONE
            keep = np.repeat(live, np.diff(starts, append=len(rank)))
            if not live.all():
                done.append((word[~keep], token[~keep]))
            at = least[live] & 0xFFFFFFFF  # the left one of the pair
            token[at], last[at] = rank[at], last[at + 1]
            right = np.minimum(at + 2, len(token) - 1)
            rank[at] = np.where(last[at], _NONE, self.rank(token[at], token[right]))
            left = at[~first[at]]
            rank[left - 1] = self.rank(token[left - 1], token[left])
            keep[at + 1] = False
            word, token, rank, first, last = word[keep], token[keep], rank[keep], first[keep], last[keep]
        word, token = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        ids, ends = token[order].astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [ids[a:z] for a, z in zip([0, *ends.tolist()], ends.tolist())]

    def encode_long(self, word: bytes) -> bytes:
        """The same for one word of any length, with a heap of pairs."""
        n, rank = len(word), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that begins at a place; where the piece before it begins
        found = [rank(word[i : i + 2], _NONE) for i in range(n - 1)] + [_NONE]  # of that piece and the next
        heap = [(r, i) for i, r in enumerate(found) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if found[i] != r:
                continue  # merged since
            found[end[i]] = _NONE
            k = end[i] = end[end[i]]
            if k < n:
                before[k] = i
            for a, z in ((i, end[k] if k < n else None), (before[i], k)):
                if a >= 0:
                    found[a] = _NONE if z is None else rank(word[a:z], _NONE)
                    if found[a] < _NONE:
                        heapq.heappush(heap, (found[a], a))
        ids, i = array("I"), 0
        while i < n:
            ids.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return ids.tobytes()


class WordEncoder(dict):
    """Ids of words as little-endian unsigned 32-bit integers, of those that learn() was given last."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.merges = ranks, Merges(ranks)

    def learn(self, words: set[str]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        short: list[str] = []
        for word in words.difference(self):
            raw = word.encode()
            if raw in self.ranks:
                self[word] = array("I", [self.ranks[raw]]).tobytes()
            elif len(raw) > SHORT:
                self[word] = self.merges.encode_long(raw)
            else:
                short.append(word)
        self.update(zip(short, self.merges.encode([w.encode() for w in short])))

    def forget_long(self, words: set[str]) -> None:
        for word in words:
            if len(word) > SHORT:
                del self[word]


class PieceEncoder(dict):
    """Maps texts to their ids.

    A pattern splits a text into words before they are merged, and a single space between two other characters always begins a new word
    together with what follows. So a text may be cut before each such space and the pieces encoded one by one, which
    are few and recur. A text with other white space beside a space is encoded whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.words = WordEncoder(ranks)
        self.split = regex.compile(white_space_of_unicode(pattern)).findall

    def _of(self, texts: list[str]) -> list[bytes]:
        # a space and letters are one word; of other letters than these the pattern decides
        split = [[t] if t[1:].isalpha() and t[0] == " " and max(t) < "\u0250" else self.split(t) for t in texts]
        words = set().union(*split)
        self.words.learn(words)
        out = [b"".join(map(self.words.__getitem__, own)) for own in split]
        self.words.forget_long(words)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
        cut = [text.split(" ") for text in texts]
        new = set().union(*cut).difference(self)
        fit = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        self.update(dict.fromkeys(new.difference(fit)))
        self.update(zip(fit, self._of([" " + p for p in fit])))
        out: list[bytes | None] = []
        heads = self._of([pieces[0] for pieces in cut])
        for pieces, head in zip(cut, heads):
            rest = list(map(self.__getitem__, pieces[1:]))
            out.append(None if None in rest or pieces[0][-1:].isspace() else head + b"".join(rest))
        whole = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(whole, self._of([texts[k] for k in whole])):
            out[k] = x
        for p in new:
            if len(p) > SHORT:
                del self[p]
        return out


class Codec:
    """Encodes texts to ids and ids to bytes by ranks and a pattern for words."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = PieceEncoder(ranks, pattern)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.pieces.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def worker_codec(path: str, pattern: str) -> Codec:
    """The codec that a Python worker keeps from task to task."""
    return Codec(path, pattern)


def _run(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = codec.encode([x or "" for x in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])]
                if with_ids:
                    columns.append(pa.array([array("I", x).tolist() for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the bytes that they decode to. A
    null text is an empty one; repeated rows give repeated rows; a null doc_id stays null; other columns are ignored.
    """
    prepare_workers(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_run(ranks_path, pattern, with_ids), schema)


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """rows (doc_id, ids array<int>) -> doc_id, bytes: the tokens' bytes, concatenated; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else b"".join(map(tokens.__getitem__, x)) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    prepare_workers(rows.sparkSession)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}
