"""Greedy alignment of many pairs of sequences at once, of any length, on Arrow columns.

A batch's distinct tokens (address, shade, edges) are found first and each two of them scored once. Pairs of like lengths are then padded to one block, and
their conflicts settled together: step i gives the i-th token of every first sequence the best unused token of its second one, the first of equals.
Results are those of align.align(). What a block and a table of scores may hold is bounded; larger batches are halved, a larger pair is scored some rows at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.constants import CODE_DOMAINS

#: Cells of a table of scores, and of a block of padded pairs.
CELLS = 1 << 21
MATCH = pa.struct([("score", pa.float64()), ("matches", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("score", pa.float64())]))), ("unmatched_a", pa.list_(pa.int32())), ("unmatched_b", pa.list_(pa.int32()))])


def hierarchy(a: np.ndarray, shade_a: np.ndarray, b: np.ndarray, shade_b: np.ndarray) -> np.ndarray:
    near = 1 - np.abs(shade_a - shade_b) / 255.0
    return np.where(a == b, 0.75 + 0.25 * near, np.where(a >> 8 == b >> 8, 0.40 + 0.05 * near, np.where(a >> 16 == b >> 16, 0.25 + 0.05 * near, 0.0)))


def lists(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, end to end, and where each list begins (and the last ends); a null is an empty list."""
    return col.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def token_scores(a: np.ndarray, shade_a: np.ndarray, b: np.ndarray, shade_b: np.ndarray, code_aware: bool) -> np.ndarray:
    """Scores of tokens without edges."""
    score = hierarchy(a, shade_a, b, shade_b)
    if code_aware:
        low, high = CODE_DOMAINS
        score = np.where((a >> 16 >= low) & (a >> 16 <= high), np.minimum(1.0, 1.5 * score), score)
    return score


class Tokens:
    """The tokens of a column of sequences, end to end: which of the distinct (addr, shade, edges) each is, and those."""

    def __init__(self, col: pa.Array):
        flat, self.begins = lists(col)
        self.size = np.diff(self.begins)
        addr, shade = (np.asarray(flat.field(c).cast(pa.int64())) for c in ("addr", "shade"))
        names = [f.name for f in flat.type]
        self.words = flat.field("word") if "word" in names else None
        edges, kind = np.zeros(len(flat), np.int64), [()]
        if "related" in names:
            own, first = lists(flat.field("related"))
            to, weight, types = np.asarray(own.field("addr").cast(pa.int64())), np.asarray(own.field("weight").cast(pa.int64())), own.field("type").to_pylist()
            seen = {(): 0}
            for k in np.flatnonzero(np.diff(first)).tolist():
                own = slice(first[k], first[k + 1])
                key = tuple(zip(to[own].tolist(), weight[own].tolist(), types[own]))
                edges[k] = seen.setdefault(key, len(seen))
            kind = list(seen)
        distinct, at, self.of = np.unique(edges << 40 | addr << 8 | shade, return_index=True, return_inverse=True)
        self.addr, self.shade, self.edges = addr[at], shade[at], [kind[k] for k in edges[at]]


def class_scores(a: Tokens, own: np.ndarray, b: Tokens, other: np.ndarray, p, code_aware: bool) -> np.ndarray:
    """align.pair_score() of each of a's distinct tokens `own` with each of b's `other`."""
    x, xs, y, ys = a.addr[own], a.shade[own], b.addr[other], b.shade[other]
    score = token_scores(x[:, None], xs[:, None], y[None, :], ys[None, :], code_aware)
    mine, theirs = [a.edges[k] for k in own.tolist()], [b.edges[k] for k in other.tolist()]
    if not any(mine) and not any(theirs):
        return score
    related, anti = np.zeros_like(score), np.zeros_like(score)
    for edges, from_shade, to, to_shade, best, opposite in ((mine, xs, y, ys, related, anti), (theirs, ys, x, xs, related.T, anti.T)):
        for i, listed in enumerate(edges):
            for addr, weight, kind in listed:
                if kind == "ANTONYM":
                    np.maximum(opposite[i], np.where(to == addr, weight / 255.0 * p.antonym, 0.0), out=opposite[i])
                elif addr >> 16 & 255 != 255:
                    hit = weight / 255.0 * p.weight(kind) * p.multiplier
                    rest = hit * p.hierarchy * hierarchy(np.int64(addr), from_shade[i], to, to_shade) if p.hierarchy > 0 else 0.0
                    np.maximum(best[i], np.where(to == addr, hit, rest), out=best[i])
    at: dict[int, list[tuple[int, int, str]]] = {}
    usable = lambda listed: [r for r in listed if r[2] != "ANTONYM" and r[0] >> 16 & 255 != 255]
    for j, listed in enumerate(theirs):
        for addr, weight, kind in usable(listed):
            at.setdefault(addr, []).append((j, weight, kind))
    for i, listed in enumerate(mine):
        for addr, weight, kind in usable(listed):
            for j, w, k in at.get(addr, ()):
                related[i, j] = max(related[i, j], min(weight, w) / 255.0 * min(p.weight(kind), p.weight(k)) * 0.65 * p.multiplier)
    return np.maximum(0.0, np.where(score >= 0.75, score, np.maximum(score, related)) - anti)


def _edges(t: Tokens, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The edges of t's distinct tokens `own`, end to end: how many each has, and their addresses, weights and types."""
    listed = [t.edges[k] for k in own.tolist()]
    flat = [r for edges in listed for r in edges]
    return np.array([len(edges) for edges in listed], np.int64), np.array([r[0] for r in flat], np.int64), np.array([r[1] for r in flat], np.float64), [r[2] for r in flat]


def cell_scores(a: Tokens, x: np.ndarray, b: Tokens, y: np.ndarray, p, code_aware: bool) -> np.ndarray:
    """class_scores() of single cells: of a's distinct token x[k] with b's y[k]. Time and memory go with the cells and their edges; common neighbours are met by address."""
    own, i = np.unique(x, return_inverse=True)
    other, j = np.unique(y, return_inverse=True)
    sides = []
    for t, some in ((a, own), (b, other)):
        n, to, weight, kinds = _edges(t, some)
        usable = np.array([k != "ANTONYM" for k in kinds], bool)
        share = np.array([p.weight(k) for k in kinds], np.float64)
        sides.append((n, np.concatenate([[0], np.cumsum(n)]), to, weight, usable & (to >> 16 & 255 != 255), ~usable, share))
    out, per = np.empty(len(x)), sides[0][0][i] + sides[1][0][j] + 1
    chunk = np.cumsum(per) // CELLS
    for c in np.split(np.arange(len(x)), np.flatnonzero(np.diff(chunk)) + 1) if len(x) else ():
        addr, shade = (a.addr[x[c]], b.addr[y[c]]), (a.shade[x[c]], b.shade[y[c]])
        score = token_scores(addr[0], shade[0], addr[1], shade[1], code_aware)
        related, anti, met = np.zeros(len(c)), np.zeros(len(c)), []
        for (n, first, to, weight, usable, opposite, share), at, other_side in ((sides[0], i[c], 1), (sides[1], j[c], 0)):
            cell = np.repeat(np.arange(len(c)), n[at])
            edge = np.arange(len(cell)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + np.repeat(first[at], n[at])
            same = to[edge] == addr[other_side][cell]
            bad = opposite[edge] & same
            np.maximum.at(anti, cell[bad], weight[edge[bad]] / 255.0 * p.antonym)
            cell, edge, same = cell[usable[edge]], edge[usable[edge]], same[usable[edge]]
            hit = weight[edge] / 255.0 * share[edge] * p.multiplier
            rest = hit * p.hierarchy * hierarchy(to[edge], shade[1 - other_side][cell], addr[other_side][cell], shade[other_side][cell]) if p.hierarchy > 0 else 0.0
            np.maximum.at(related, cell, np.where(same, hit, rest))
            met.append((cell << 32 | to[edge], weight[edge], share[edge]))
        (mine, w, s), (theirs, v, r) = met
        order = np.argsort(theirs, kind="stable")
        low, high = np.searchsorted(theirs[order], mine, "left"), np.searchsorted(theirs[order], mine, "right")
        n = high - low
        k = np.repeat(np.arange(len(mine)), n)
        at = order[np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        np.maximum.at(related, mine[k] >> 32, np.minimum(w[k], v[at]) / 255.0 * np.minimum(s[k], r[at]) * 0.65 * p.multiplier)
        out[c] = np.maximum(0.0, np.where(score >= 0.75, score, np.maximum(score, related)) - anti)
    return out


def _taken(scores, n_a: np.ndarray, n_b: np.ndarray, code_aware: bool) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a block: the place in b that each place of a takes (or -1), and its score. scores(i, k): the scores of places i to k of a, padded with 0."""
    long, wide = int(n_a.max(initial=0)), int(n_b.max(initial=0))
    pairs = np.arange(len(n_a))
    free = np.ones((len(n_a), max(wide, 1)), bool)
    to, got = np.full((len(n_a), long), -1), np.zeros((len(n_a), long))
    step = max(1, CELLS // max(1, len(n_a) * wide))
    for lo in range(0, long if wide else 0, step):
        part = scores(lo, min(lo + step, long))
        if code_aware:
            i, j = np.arange(lo, lo + part.shape[1])[None, :, None], np.arange(wide)[None, None, :]
            apart = np.abs(i / np.maximum(n_a, 1)[:, None, None] - j / np.maximum(n_b, 1)[:, None, None])
            part = np.where(part > 0, part + 0.05 * (1 - apart), part)
        for k in range(part.shape[1]):
            row = np.where(free, part[:, k], 0.0)
            j = row.argmax(axis=1)
            best = row[pairs, j]
            hit = best > 0
            to[hit, lo + k], got[hit, lo + k] = j[hit], best[hit]
            free[pairs[hit], j[hit]] = False
    return to, got


def _overlap(a: Tokens, b: Tokens, rows: np.ndarray, symmetric: bool) -> np.ndarray:
    """Share of a's distinct words that b has, or of both sides' words; 0 where a side has none."""
    out = np.zeros(len(rows))
    if a.words is None or b.words is None:
        return out
    low = pc.utf8_lower(pa.concat_arrays([a.words.fill_null(""), b.words.fill_null("")])).dictionary_encode()
    none = low.dictionary.index("").as_py() if len(low.dictionary) else -1
    code = np.asarray(low.indices)
    for k, r in enumerate(rows.tolist()):
        x = set(code[a.begins[r] : a.begins[r + 1]].tolist()) - {none}
        y = set(code[len(a.words) + b.begins[r] : len(a.words) + b.begins[r + 1]].tolist()) - {none}
        if x and y:
            out[k] = 2 * len(x & y) / (len(x) + len(y)) if symmetric else len(x & y) / len(x)
    return out


def _finished(total: np.ndarray, a: Tokens, b: Tokens, rows: np.ndarray, p) -> np.ndarray:
    n_a, n_b = a.size[rows], b.size[rows]
    if not p.coverage:
        return total / np.maximum(np.maximum(n_a, n_b), 1)
    base = np.minimum(1.0, 2 * total / np.maximum(n_a + n_b, 1) if p.symmetric else total / np.maximum(n_a, 1))
    if p.lexical > 0:
        base = (1 - p.lexical) * base + p.lexical * _overlap(a, b, rows, p.symmetric)
    return np.where(n_a > 0, base, 0.0)


def _run(a: Tokens, b: Tokens, rows: np.ndarray, p, code_aware: bool, out: list) -> None:
    """Appends (rows, scores, places taken, scores of those) for blocks of rows (sorted by their lengths)."""
    if not len(rows):
        return
    n_a, n_b = a.size[rows], b.size[rows]
    flat = lambda t: np.concatenate([np.arange(t.begins[r], t.begins[r + 1]) for r in rows.tolist()])
    own, x = np.unique(a.of[flat(a)], return_inverse=True)
    other, y = np.unique(b.of[flat(b)], return_inverse=True)
    block, table_cells = len(rows) * int(n_a.max()) * int(n_b.max()), len(own) * len(other)
    plain = not any(a.edges[k] for k in own.tolist()) and not any(b.edges[k] for k in other.tolist())
    if len(rows) > 1 and block > CELLS:
        _run(a, b, rows[: len(rows) // 2], p, code_aware, out)
        _run(a, b, rows[len(rows) // 2 :], p, code_aware, out)
        return

    def padded(of: np.ndarray, n: np.ndarray) -> np.ndarray:
        filled = np.full((len(n), int(n.max(initial=0))), -1)
        filled[np.arange(filled.shape[1])[None, :] < n[:, None]] = of
        return filled

    x, y = padded(x, n_a), padded(y, n_b)
    if plain and table_cells > block:  # few tokens of the batch are alike
        near = (y >= 0)[:, None, :] & (x >= 0)[:, :, None]
        scores = lambda lo, hi: np.where(near[:, lo:hi], token_scores(a.addr[own][x[:, lo:hi, None]], a.shade[own][x[:, lo:hi, None]], b.addr[other][y[:, None, :]], b.shade[other][y[:, None, :]], code_aware), 0.0)
    elif table_cells > block:  # the same with edges: only what the pairs need, not every token with every other one
        def scores(lo: int, hi: int) -> np.ndarray:
            u, v = np.broadcast_arrays(x[:, lo:hi, None], y[:, None, :])
            near = (u >= 0) & (v >= 0)
            cells, at = np.unique(u[near] * len(other) + v[near], return_inverse=True)
            part = np.zeros(u.shape)
            part[near] = cell_scores(a, own[cells // len(other)], b, other[cells % len(other)], p, code_aware)[at]
            return part
    elif table_cells <= CELLS:
        table = np.zeros((len(own) + 1, len(other) + 1))  # a last row and column for the padding
        table[:-1, :-1] = class_scores(a, own, b, other, p, code_aware)
        scores = lambda lo, hi: table[x[:, lo:hi, None], y[:, None, :]]
    else:  # one pair
        scores = lambda lo, hi: class_scores(a, own[x[0, lo:hi]], b, other, p, code_aware)[None][:, :, y[0]]
    to, got = _taken(scores, n_a, n_b, code_aware)
    total = np.zeros(len(rows))
    for k in range(got.shape[1]):  # in order, as a fold adds them up
        total += got[:, k]
    out.append((rows, _finished(total, a, b, rows, p), to, got))


def _blocks(a: pa.Array, b: pa.Array, profiles: list, code_aware: bool) -> tuple[Tokens, Tokens, list]:
    """profiles: of each pair, equal ones being one object."""
    a, b = Tokens(a), Tokens(b)
    out: list = []
    name = np.array([id(p) for p in profiles])
    for p in {id(p): p for p in profiles}.values():
        rows = np.flatnonzero(name == id(p))
        order = rows[np.lexsort((b.size[rows], a.size[rows]))]
        # blocks of rows that are alike in length: cut where the padding would more than double a side
        at = 0
        while at < len(order):
            most_a, most_b = 2 * a.size[order[at]] + 4, 2 * max(1, b.size[order[at]]) + 4
            fits = (a.size[order[at:]] <= most_a) & (b.size[order[at:]] <= most_b)
            end = at + (int(np.argmin(fits)) if not fits.all() else len(fits))
            _run(a, b, order[at:end], p, code_aware, out)
            at = end
    return a, b, out


def scores(a: pa.Array, b: pa.Array, profiles: list, code_aware: bool) -> np.ndarray:
    """The score of each pair of sequences."""
    _, _, blocks = _blocks(a, b, profiles, code_aware)
    out = np.zeros(len(a))
    for rows, score, _, _ in blocks:
        out[rows] = score
    return out


def matches(a: pa.Array, b: pa.Array, profiles: list, code_aware: bool) -> pa.Array:
    """MATCH of each pair of sequences."""
    x, y, blocks = _blocks(a, b, profiles, code_aware)
    out: list = [None] * len(a)
    for rows, score, to, got in blocks:
        for k, r in enumerate(rows.tolist()):
            own = to[k, : x.size[r]]
            hit = np.flatnonzero(own >= 0)
            left = np.ones(y.size[r], bool)
            left[own[hit]] = False
            found = [{"i": i, "j": j, "score": s} for i, j, s in zip(hit.tolist(), own[hit].tolist(), got[k, hit].tolist())]
            out[r] = {"score": float(score[k]), "matches": found, "unmatched_a": np.flatnonzero(own < 0).tolist(), "unmatched_b": np.flatnonzero(left).tolist()}
    return pa.array(out, MATCH)
