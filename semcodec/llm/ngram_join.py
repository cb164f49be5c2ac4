"""Jaccard self-join of n-gram sets with prefix trees.

A text is the set of its word n-grams. The grams of a set stand in one global order, the commonest first (by the counts of a
fixed-size table of hashed grams; any common order is exact). Texts with one and the same set are one class, and only classes are compared.

1. Lists. Two sets of similarity 0.9 differ by a tenth of either's grams at most, so they share one of each other's n // 10 + 1 last (rarest) grams. Classes
   are listed under those, and by bands of set size, as sets that differ more in size aren't similar. Of lists with the same members one stays.
2. Long lists. Each class goes to one of its long lists, in parts of bounded size that also hold the list's first member, and is settled there.
   That links the members of large groups of copies without their pairs. Lists that then are within one component are done.
3. The others are settled between the members outside the list's largest component and all its members, in blocks of bounded size: first by the last 2 * (n // 10) + 1
   grams alone, of which similar sets share more than half; what finds a partner there comes again with its full set.

Every comparison is made in a prefix tree: the sets of a task are stored in a trie whose nodes are runs of EDGE grams, so sets with the same beginning share the
overlaps counted for it. A probe goes down level by level with its overlap so far and leaves a subtree as soon as what is left of the
probe and of the longest set below can't make up what is missing. Up to 64 probes go down together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import drop, materialize, passing, prepare_workers, slices
from .components import components
from .minhash import text_shingles

WIDTH = 3
#: Entries of the table of gram counts: its size doesn't depend on the data.
COUNT_BITS = 20
#: Members of a list from which on it is long; grams of a node; grams of one side of a task.
LONG, EDGE, BLOCK = 24, 16, 1 << 19
#: Bands of set sizes: sets of similarity 0.9 are in one band or in two neighbouring ones.
_BAND = math.log(1.112)


def needed(a, b):
    """Grams that sets of a and b grams share if 100 * |both| >= 90 * |either|."""
    return -(-9 * (a + b) // 19)


def _order(counts: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """How common a gram is, as far as the table tells: by its highest bits."""
    bits = 8 * grams.dtype.itemsize
    return counts[(grams >> np.array(bits - COUNT_BITS, grams.dtype)).astype(np.int64)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for b in batches:
        for _, _, buf, off in slices(b.column(0)):
            grams, _ = text_shingles(buf, off, WIDTH)
            total += np.bincount((grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["slot", "n"])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How many texts have the grams of each slot: 8 MB, whatever the input."""
    found = docs.select("text").mapInArrow(_count_grams, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return table


def _digest(grams: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.sha256(grams.tobytes()).digest()[:16], np.int64)
    return int(a), int(b)


def _sketch(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in slices(b.column(1)):
                grams, begins = text_shingles(buf, off, WIDTH)
                text = np.repeat(np.arange(hi - lo), np.diff(begins))
                rarest = grams[np.lexsort((grams, _order(counts.value, grams), text))]
                rows = []
                for i, j in zip(begins[:-1], begins[1:]):
                    n, own = j - i, rarest[i:j]
                    rows.append((n, *_digest(grams[i:j]), own[: 2 * (n // 10) + 1].tobytes() if n else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *columns], ["doc_id", "n", "f1", "f2", "rarest"])

    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, id, n): a list for each of the rarest grams and the bands of set sizes that the set may meet others in."""
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            n = part.column(1).to_numpy()
            many = n // 10 + 1
            grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64)[:m] for x, m in zip(part.column(2), many)])
            band = np.repeat((np.log(n) / _BAND).astype(np.uint64), many)
            name = np.concatenate([kernel.mix(grams + (band + np.uint64(k)) * kernel._PLACE[0]) for k in (0, 1)])
            ids, sizes = (np.tile(np.repeat(x, many), 2) for x in (part.column(0).to_numpy(), n))
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids), pa.array(sizes)], ["list", "id", "n"])


class Trie:
    """Sets of grams (ranks in the global order, rising) in lists; probes of a list meet the sets of that list only.

    n: a set's size; what is stored or probed may be a part of it, its last grams. Then a pair is told when the parts share as many
    as those of sets with the needed overlap must.
    """

    def __init__(self, lists: np.ndarray, n: np.ndarray, sets: list[np.ndarray], stored: np.ndarray):
        self.lists, self.n, self.sets = lists, n, sets
        self.length = np.array([len(x) for x in sets], np.int64)
        top = int(lists.max(initial=-1)) + 1  # a root for each list
        nodes: dict[tuple[int, bytes], int] = {}
        parent, chunk, level, path_node, path_row, ends = [-1] * top, [np.zeros(0, np.int64)] * top, [-1] * top, [], [], []
        for r in stored.tolist():
            at, own = int(lists[r]), sets[r]
            raw = own.tobytes()
            path_node.append(at)
            path_row.append(r)
            for k in range(0, len(raw), 8 * EDGE):
                key = (at, raw[k : k + 8 * EDGE])
                at = nodes.get(key, -1)
                if at < 0:
                    at = nodes[key] = len(parent)
                    parent.append(key[0])
                    chunk.append(own[k // 8 : k // 8 + EDGE])
                    level.append(k // 8)
                path_node.append(at)
                path_row.append(r)
            ends.append(at)
        count = len(parent)
        self.grams = np.concatenate(chunk) if count else np.zeros(0, np.int64)
        self.size = np.array([len(c) for c in chunk], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.end = np.array(level, np.int64) + self.size
        at, row = np.array(path_node, np.int64), np.array(path_row, np.int64)
        self.least, self.most, self.longest, self.gap = (np.full(count, v, np.int64) for v in (1 << 62, 0, 0, 0))
        np.minimum.at(self.least, at, n[row])
        np.maximum.at(self.most, at, n[row])
        np.maximum.at(self.longest, at, self.length[row])
        np.maximum.at(self.gap, at, (n - self.length)[row])
        self.children, self.child_at = self._grouped(np.array(parent, np.int64), count)
        self.rows, self.row_at = self._grouped(np.array(ends, np.int64), count)
        self.rows = stored[self.rows]
        self.grams_known = max(int(x[-1]) for x in sets) + 1 if len(sets) else 0

    @staticmethod
    def _grouped(of: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(of, kind="stable")
        return order, np.searchsorted(of[order], np.arange(count + 1))

    @staticmethod
    def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)

    def probe(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, row) of at most 64 probes and the stored rows of their lists that they are similar enough to (or may be, for parts); a row doesn't meet itself."""
        mark = np.zeros(self.grams_known, np.uint64)
        for k, r in enumerate(probes.tolist()):
            mark[self.sets[r]] |= np.uint64(1 << k)
        keys = np.concatenate([self.sets[r] + k * self.grams_known for k, r in enumerate(probes.tolist())])
        ends = np.cumsum(self.length[probes])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        p, node, overlap = np.arange(len(probes)), self.lists[probes], np.zeros(len(probes), np.int64)
        n, gap = self.n[probes], (self.n - self.length)[probes]
        while len(p):
            many = self.child_at[node + 1] - self.child_at[node]
            child = self.children[self._spread(self.child_at[node], many)]
            p, overlap = np.repeat(p, many), np.repeat(overlap, many)
            fits = (10 * self.most[child] >= 9 * n[p]) & (9 * self.least[child] <= 10 * n[p])
            p, child, overlap = p[fits], child[fits], overlap[fits]
            if not len(p):
                break
            size = self.size[child]
            grams = self.grams[self._spread(self.first[child], size)]
            hits = mark[grams] >> np.repeat(p, size).astype(np.uint64) & np.uint64(1)
            overlap = overlap + np.add.reduceat(hits.astype(np.int64), np.cumsum(size) - size)
            ending = self.row_at[child + 1] - self.row_at[child]
            row = self.rows[self._spread(self.row_at[child], ending)]
            q, own = np.repeat(p, ending), np.repeat(overlap, ending)
            good = (own >= needed(n[q], self.n[row]) - np.maximum(gap[q], self.n[row] - self.length[row])) & (probes[q] != row)
            found.append((probes[q[good]], row[good]))
            left = ends[p] - np.searchsorted(keys, p * self.grams_known + self.grams[self.first[child] + size - 1], "right")
            left = np.minimum(left, self.longest[child] - self.end[child])
            least = np.maximum(self.least[child], -(-9 * n[p] // 10))
            going = overlap + left >= needed(n[p], least) - np.maximum(gap[p], self.gap[child])
            p, node, overlap = p[going], child[going], overlap[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _ranked(rows: list[np.ndarray], counts: np.ndarray) -> list[np.ndarray]:
    """The sets with their grams as ranks in the global order, the commonest first."""
    every = np.concatenate(rows)
    grams, at = np.unique(every, return_inverse=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -_order(counts, grams)))] = np.arange(len(grams))
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    ranks = rank[at]
    ranks = ranks[np.lexsort((ranks, owner))]
    return np.split(ranks, np.cumsum([len(x) for x in rows])[:-1])


#: What a row is in a task: stored only, a probe only, or both.
STORED, PROBE, BOTH = 0, 1, 2


def _task(rows: pa.Table, counts: np.ndarray, width) -> tuple[Trie, np.ndarray, np.ndarray]:
    lists = np.unique(rows.column("list").to_numpy(), return_inverse=True)[1]
    side = rows.column("side").to_numpy()
    sets = _ranked([np.frombuffer(x.as_buffer(), width) for x in rows.column("grams")], counts)
    trie = Trie(lists, rows.column("n").to_numpy().astype(np.int64), sets, np.flatnonzero(side != PROBE))
    return trie, lists, side


def _partners(counts):
    """Rows (list, id) of those that find a partner with another label by a part of their grams."""

    def run(rows: pa.Table) -> pa.Table:
        trie, _, side = _task(rows, counts.value, np.uint32)
        label = rows.column("label").to_numpy()
        probes, told = np.flatnonzero(side != STORED), np.zeros(len(side), bool)
        for k in range(0, len(probes), 64):
            x, y = trie.probe(probes[k : k + 64])
            apart = label[x] != label[y]
            told[x[apart]] = told[y[apart]] = True
        return rows.select(["list", "id"]).filter(pa.array(told))

    return run


def _settled(counts):
    """A spanning forest of the links between members of different labels."""

    def run(rows: pa.Table) -> pa.Table:
        trie, lists, side = _task(rows, counts.value, np.uint64)
        ids = rows.column("id").to_numpy()
        names, own = np.unique(rows.column("label").to_numpy(), return_inverse=True)
        root = np.arange(len(names))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        waiting = side != STORED
        a: list[int] = []
        b: list[int] = []
        alone = True  # first one of each list, which in a group of copies is like most others
        while waiting.any():
            now = np.array([find(x) for x in range(len(names))])[own]
            # members of a list's largest component needn't look for others, who will look for them; a probe that isn't stored has only itself to do it
            key, at, many = np.unique(lists * len(names) + now, return_inverse=True, return_counts=True)
            best = np.zeros(lists.max() + 1, np.int64)
            np.maximum.at(best, key // len(names), many)
            largest = np.zeros(len(best), np.int64)
            top = np.flatnonzero(many == best[key // len(names)])
            largest[key[top] // len(names)] = key[top] % len(names)
            pending = np.flatnonzero(waiting & ((side == PROBE) | (now != largest[lists]) | (best[lists] == 1)))
            if not len(pending):
                break
            if alone:
                pending = pending[np.unique(lists[pending], return_index=True)[1]]
            for k in range(0, len(pending) if alone else min(len(pending), 64), 64):
                probes = pending[k : k + 64]
                x, y = trie.probe(probes)
                waiting[probes] = False
                for i, j in zip(x.tolist(), y.tolist()):
                    r, s = find(own[i]), find(own[j])
                    if r != s:
                        root[max(r, s)] = min(r, s)
                        a.append(ids[i])
                        b.append(ids[j])
            alone = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(keep, batches):
            for lo, hi, buf, off in slices(b.column(1)):
                grams, begins = text_shingles(buf, off, WIDTH)
                rows = [(*_digest(grams[i:j]), grams[i:j].tobytes()) for i, j in zip(begins[:-1], begins[1:])]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *columns], ["first", "f1", "f2", "grams"])

    return run


def _full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, grams) of the classes of ids (id), from their texts, which stay where they are read."""
    meant = materialize(classes.select("id", "first", "f1", "f2").join(ids.select("id").distinct(), "id"), "meant")
    rows, keep = passing(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id", meant, "first")
    found = rows.mapInArrow(_sets(keep), "first long, f1 long, f2 long, grams binary")
    return materialize(found.join(meant, ["first", "f1", "f2"]).select("id", "grams").dropDuplicates(["id"]), "sets")


def _once(rows: DataFrame) -> DataFrame:
    """Rows (list, id, ...) of one of the lists with the same members."""
    names = rows.groupBy("list").agg(F.count("*").alias("c"), *[F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)])
    one = materialize(names.groupBy("c", "h0", "h1").agg(F.min("list").alias("list")).where("c > 1").select("list", "c"), "lists")
    return materialize(rows.join(one, "list"), "shared")


def _unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (list, id, n) of the lists that hold several components of labels (id, label), with label and outside: not in the list's largest component."""
    rows = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    per = rows.groupBy("list", "label").agg(F.count("*").alias("many"))
    top = per.groupBy("list").agg(F.max(F.struct("many", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("list", F.col("top.label").alias("most"))
    return materialize(rows.join(top, "list").select("list", "id", "n", "label", (F.col("label") != F.col("most")).alias("outside")), "unsettled")


def _blocks(rows: DataFrame, size: str) -> DataFrame:
    """rows (list, id, n, label, outside, ...) as (task, big, i, j, side, ...): several short lists in a task, a long one's outside members x all members in blocks."""
    sizes = rows.groupBy("list").agg(F.sum(F.expr(size)).alias("all"), F.sum(F.when(F.col("outside"), F.expr(size)).otherwise(0)).alias("some"))
    sizes = materialize(sizes.withColumn("nb", F.ceil(F.col("all") / BLOCK)).withColumn("na", F.ceil(F.col("some") / BLOCK)), "sizes")
    tasks = max(1, -(-(sizes.where("nb = 1").agg(F.sum("all")).first()[0] or 0) // BLOCK), rows.sparkSession.sparkContext.defaultParallelism)
    each = rows.join(sizes.select("list", "na", "nb"), "list")
    zero = F.lit(0).cast("long")
    short = each.where("nb = 1").select("*", F.pmod(F.xxhash64("list"), F.lit(tasks)).alias("task"), zero.alias("i"), zero.alias("j"), F.when(F.col("outside"), BOTH).otherwise(STORED).alias("side"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    long = each.where("nb > 1")
    probes = long.where("outside").select("*", F.col("list").alias("task"), own("na").alias("i"), every("nb").alias("j"), F.lit(PROBE).alias("side"))
    members = long.select("*", F.col("list").alias("task"), every("na").alias("i"), own("nb").alias("j"), F.lit(STORED).alias("side"))
    return short.unionByName(probes).unionByName(members).withColumn("big", F.col("nb") > 1).drop("na", "nb", "outside")


_TASK = ("big", "task", "i", "j")


def _long_links(shared: DataFrame, classes: DataFrame, docs: DataFrame, counts) -> DataFrame:
    """Links (a, b) within parts of the long lists, each class in one of its lists."""
    own = shared.where(F.col("c") > LONG).groupBy("id", "n").agg(F.max(F.struct("c", "list")).alias("pick")).select("id", "n", "pick.list")
    own = materialize(own, "picks")
    lists = materialize(own.groupBy("list").agg(F.min("id").alias("hub"), F.min_by("n", "id").alias("hub_n"), F.ceil(F.sum("n") / BLOCK).alias("parts")), "hubs")
    zero = F.lit(0).cast("long")
    rest = own.join(lists, "list").where("id <> hub").select("list", F.pmod(F.xxhash64("id"), "parts").alias("i"), "id", "n")
    hubs = lists.select("list", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"), F.col("hub").alias("id"), F.col("hub_n").alias("n"))
    tasks = hubs.unionByName(rest).join(_full_sets(docs, classes, own), "id")
    tasks = tasks.select("list", "i", "id", "n", F.col("id").alias("label"), F.lit(BOTH).alias("side"), "grams")
    return materialize(tasks.groupBy("list", "i").applyInArrow(_settled(counts), "a long, b long"), "links")


def _joined(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select("id", F.col("component").alias("label"))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams cut to their highest 32 bits: that two grams look alike only adds a candidate."""
    for b in batches:
        cut = [(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.binary())], ["id", "grams"])


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    A-Z are lower-cased; words are runs of other characters than [\\x20\\x09-\\x0D]. A text's set holds its distinct runs of WIDTH words, with fewer words all of them
    as one. Documents whose sets have 100 * |both| >= 90 * |either| are linked; component_id is the least doc_id that links lead to, itself included. A null or
    empty text, or one without words, has no grams and no links. Rows that repeat a doc_id are judged each by its text; a null doc_id is linked with nothing and its
    component_id is null. Whole texts of any length are read. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(gram_counts(docs))
    key = ["f1", "f2", "n"]
    seen = materialize(docs.mapInArrow(_sketch(counts), "doc_id long, n long, f1 long, f2 long, rarest binary"), "seen")
    classes = seen.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("rarest").alias("rarest"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    posted = materialize(classes.select("id", "n", "rarest").mapInArrow(_post, "list long, id long, n long"), "posted")
    # two members of incomparable sizes aren't similar
    lists = materialize(posted.groupBy("list").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).where("c > 2 or (c = 2 and 10 * least >= 9 * most)").select("list"), "counts")
    shared = _once(posted.join(lists, "list"))
    drop(posted, lists)

    links = _long_links(shared, classes, docs, counts) if not shared.where(F.col("c") > LONG).isEmpty() else spark.createDataFrame([], "a long, b long")
    rows = _unsettled(shared.select("list", "id", "n"), _joined(links))
    parts = materialize(classes.select("id", "rarest").mapInArrow(_short, "id long, grams binary"), "parts")
    found = _blocks(rows, "2 * (n div 10) + 1").join(parts, "id").groupBy(*_TASK).applyInArrow(_partners(counts), "list long, id long")
    found = _once(materialize(found.distinct(), "partners"))
    last = materialize(rows.join(found.select("list", "id"), ["list", "id"]), "last")
    more = _blocks(last, "n").join(_full_sets(docs, classes, last), "id").groupBy(*_TASK).applyInArrow(_settled(counts), "a long, b long")
    labels = _joined(links.unionByName(materialize(more, "links")))
    drop(shared, parts)

    own = classes.join(labels, "id", "left").select(*key, "first", F.coalesce("label", "id").alias("label"))
    least = own.groupBy("label").agg(F.min("first").alias("component_id"))
    out = seen.drop("rarest").join(own.join(least, "label").select(*key, "component_id"), key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
