"""Upper bounds of the scores of queries with blocks of sequences, by inverted lists in memory, and the scores of the pairs that a bound leaves.

A block has BLOCK tokens, so memory is bounded; no pair becomes a row before its score is known to be needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernel

#: Tokens of a block of sequences, and of a batch of pairs that are aligned.
BLOCK, BATCH = 1 << 20, 1 << 19
#: Most that a pair of tokens scores in twentieths: of one address (or linked by an edge), of one category, of one domain; and what each adds to the next.
CAPS = (20, 9, 6)
ADDED = (CAPS[0] - CAPS[1], CAPS[1] - CAPS[2], CAPS[2])
#: Lists of more than one in DENSE of a block's sequences are kept as a row of flags.
DENSE = 8


def _posted(tokens: pa.Array, level: int, edges: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, token, key) for each token and key of the level: address, category or domain.

    Without edges a key is numbered by its occurrences in the sequence, so that keys in common are multisets in common. With edges the addresses that they lead to are keys of level 0, too.
    """
    flat, begins = kernel.lists(tokens)
    row, token = np.repeat(np.arange(len(tokens)), np.diff(begins)), np.arange(len(flat))
    key = np.asarray(flat.field("addr").cast(pa.int64())) >> 8 * level
    if edges:
        if level == 0:
            to, first = kernel.lists(flat.field("related"))
            own = np.repeat(token, np.diff(first))
            row, token, key = np.concatenate([row, row[own]]), np.concatenate([token, own]), np.concatenate([key, np.asarray(to.field("addr").cast(pa.int64()))])
        return row, token, key << 24
    order = np.lexsort((token, row, key))
    r, k = row[order], key[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])[: len(r)]
    at = np.arange(len(r))
    times = np.empty(len(r), np.int64)
    times[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return row, token, key << 24 | times


class Lists:
    """Inverted lists of a block of sequences, which are numbered in order of their lengths."""

    def __init__(self, tokens: pa.Array, edges: bool):
        size = np.diff(kernel.lists(tokens)[1])
        self.order = np.argsort(size, kind="stable")
        self.size, self.levels = size[self.order], []
        place = np.empty(len(size), np.int64)
        place[self.order] = np.arange(len(size))
        for level in range(3):
            row, _, key = _posted(tokens, level, edges)
            row = place[row]
            order = np.lexsort((row, key))
            row, key = row[order], key[order]
            if edges:  # once for a sequence
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])[: len(row)]
                row, key = row[new], key[new]
            keys, first = np.unique(key, return_index=True)
            ends = np.append(first, len(key))
            dense = {}
            for k in np.flatnonzero(np.diff(ends) * DENSE > len(size)).tolist():
                dense[k] = np.zeros(len(size), np.uint8)
                dense[k][row[ends[k] : ends[k + 1]]] = ADDED[level]
            self.levels.append((keys, ends, row.astype(np.int32), dense))


class Asked:
    """Queries (tokens), with their keys."""

    def __init__(self, tokens: pa.Array, edges: bool):
        self.tokens, self.edges = tokens, edges
        self.size = np.diff(kernel.lists(tokens)[1])
        self.levels = []
        for level in range(3):
            row, token, key = _posted(tokens, level, edges)
            order = np.lexsort((key, token))
            self.levels.append((np.searchsorted(row[order], np.arange(len(tokens) + 1)), token[order], key[order]))

    def bounds(self, lists: Lists, queries: range) -> Iterator[tuple[int, np.ndarray]]:
        """For each query: what it may score with each sequence of the block in twentieths, summed over the tokens; 0 without a domain in common."""
        met = []
        for (keys, ends, row, dense), (first, token, key) in zip(lists.levels, self.levels):
            lo, hi = first[queries.start], first[queries.stop]
            at = np.searchsorted(keys, key[lo:hi])
            here = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == key[lo:hi]) if len(keys) else np.zeros(0, np.int64)
            met.append((np.searchsorted(here + lo, first[queries.start : queries.stop + 1]), at[here].tolist(), token[here + lo].tolist(), ends.tolist(), row, dense))
        for n, q in enumerate(queries):
            total = np.zeros(len(lists.size), np.uint16 if self.size[q] * CAPS[0] < 1 << 16 else np.int64)
            if self.edges:
                self._with_edges(total, met, n)
            else:
                for added, (first, found, _, ends, row, dense) in zip(ADDED, met):
                    for k in found[first[n] : first[n + 1]]:
                        if k in dense:
                            total += dense[k]
                        else:
                            total[row[ends[k] : ends[k + 1]]] += added  # a list has no sequence twice
            yield q, total

    def _with_edges(self, total: np.ndarray, met: list, n: int) -> None:
        """A token linked by an edge counts as one of the same category and domain; so a token that shares a key of a level shares those of the next."""
        reached: dict[int, np.ndarray] = {}
        domains = np.zeros(len(total), bool)
        for level, (first, found, token, ends, row, _) in enumerate(met):
            lists: dict[int, list] = {t: [own] for t, own in reached.items()}
            for k, t in zip(found[first[n] : first[n + 1]], token[first[n] : first[n + 1]]):
                lists.setdefault(t, []).append(row[ends[k] : ends[k + 1]])
                if level == 2:
                    domains[row[ends[k] : ends[k + 1]]] = True
            reached = {t: np.unique(np.concatenate(own)) for t, own in lists.items()}
            for own in reached.values():
                total[own] += ADDED[level]
        total[~domains] = 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (key, tokens) in blocks of BLOCK tokens; a longer sequence is a block of its own."""
    held, tokens = [], 0
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK - tokens, "right"))) if not held else int(np.searchsorted(ends, before + BLOCK - tokens, "right"))
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
                tokens += int(ends[hi - 1] - before)
            if hi < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, tokens = [], 0
            lo = hi
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _batches(pairs: Iterator[tuple[int, np.ndarray]], asked: Asked, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query and many places as (queries, places) of BATCH tokens, about."""
    queries, places, tokens = [], [], 0
    for q, at in pairs:
        while len(at):
            ends = np.cumsum(size[at] + asked.size[q])
            n = max(1, int(np.searchsorted(ends, BATCH - tokens, "right")))
            queries.append(np.full(min(n, len(at)), q))
            places.append(at[:n])
            tokens += int(ends[min(n, len(at)) - 1])
            at = at[n:]
            if tokens >= BATCH or len(at):
                yield np.concatenate(queries), np.concatenate(places)
                queries, places, tokens = [], [], 0
    if queries:
        yield np.concatenate(queries), np.concatenate(places)


def scan(sent, profile, edges: bool, most: int | None = None):
    """For mapInArrow over classes (key, tokens); sent: a table (qkey, tokens, least) of queries.

    most given: (at, score) of so many pairs of each query with the greatest bounds in each block; at: the query's place. Else (qkey, key, score) of all pairs that score `least`.
    """

    def chosen(asked: Asked, lists: Lists, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for lo in range(0, len(least), 1024):
            for q, total in asked.bounds(lists, range(lo, min(lo + 1024, len(least)))):
                m = asked.size[q]
                needed = CAPS[0] * least[q]
                able = np.flatnonzero(total >= max(1, min(math.ceil(needed * m - 1e-6), CAPS[0] * int(m) + 1)))
                bound = np.minimum(total[able], CAPS[0] * np.minimum(m, lists.size[able])) / np.maximum(m, lists.size[able])
                if most is None or len(able) <= most:
                    yield q, able[bound >= needed - 1e-6]
                else:
                    yield q, able[np.argpartition(-bound, most)[:most]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        own = _whole(table.column("tokens"))
        asked, least, qkey = Asked(own, edges), table.column("least").to_numpy(), _whole(table.column("qkey"))
        for block in _blocks(batches):
            key, tokens = _whole(block.column(0)), _whole(block.column(1))
            lists = Lists(tokens, edges)
            for q, at in _batches(chosen(asked, lists, least), asked, lists.size):
                rows = lists.order[at]
                score = kernel.scores(own.take(pa.array(q)), tokens.take(pa.array(rows)), [profile] * len(q), False)
                if most is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(score)], ["at", "score"])
                else:
                    keep = score >= least[q]
                    yield pa.RecordBatch.from_arrays([qkey.take(pa.array(q[keep])), key.take(pa.array(rows[keep])), pa.array(score[keep])], ["qkey", "key", "score"])

    return run
