"""Near-duplicates by an inverted join on MinHash signature coordinates.

A text is the set of its word shingles; K coordinates of a signature agree for two sets with the probability of their
Jaccard similarity. Texts with one and the same set are one class, and only classes are compared.

1. Every class has K (coordinate, value) tokens. Tokens are ordered by how many classes have them, rarest first, with
   the counts of a fixed-size table of hashed tokens (any order common to all classes is exact). Two
   classes with T of K tokens in common share at least L of their first K - T + L tokens (prefix), so only
   those are posted.
2. Short lists give their pairs, and those with L collisions or more are candidates. Candidates with T equal
   coordinates are confirmed on full shingle sets: 100 * |both| >= 75 * |either|.
3. Lists longer than LONG are skipped there. Their classes are first held against the list's hub, its class with the
   commonest tokens, and confirmed as above; that links the members of large groups of copies without their pairs.
   In very long lists, what a hub leaves apart gets a hub of its own, as long as that links a quarter of it.
   Where a long list then still has several components, the members outside its largest one are counted against
   all members, in blocks of bounded bytes, by merging the members' shingle lists; a block gives a spanning forest of its links.
   Of lists with the same members (documents that share a passage share many coordinates) only one is settled so.

With K = 64, T = 32 a pair of similarity 0.75 has fewer than T equal coordinates with a probability of 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import drop, materialize, passing, prepare_workers, slices
from .components import components

WIDTH, PERCENT = 5, 75
K, T, L, LONG = 64, 32, 3, 24
#: Entries of the table of token counts: its size doesn't depend on the data.
COUNT_BITS = 20
_FACTORS = np.random.default_rng(99).integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A long list gets another hub if the last one left at most WORTH of what was outside its largest component, and that and the list are so
#: long that settling them by blocks would take more than MANY pairs.
WORTH, MANY = 0.75, 10_000_000


def text_shingles(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin; fewer words: all as one shingle."""
    starts, ends, first = kernel.word_spans(buf, off, kernel.NOT_SPACE)
    words = kernel.span_hashes(buf, starts, ends, lower=True)
    found, _, begins = kernel.windows(words, first, width)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), np.diff(begins))
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        sums = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            here = n[short] > k
            sums[here] += words[first[short[here]] + k] * kernel._PLACE[k + width]
        found, text = np.concatenate([found, kernel.mix(sums)]), np.concatenate([text, short])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    found, text = found[new], text[new]
    return found, np.searchsorted(text, np.arange(len(n) + 1))


def signatures(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """K 32-bit coordinates for each set (sets without shingles are left out)."""
    at = begins[:-1][np.diff(begins) > 0]
    out = np.empty((len(at), K), np.uint32)
    for k in range(K if len(at) else 0):
        out[:, k] = np.minimum.reduceat(found * _FACTORS[k], at) >> np.uint64(32)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, off in slices(b.column(1)):
            found, begins = text_shingles(buf, off)
            n = np.diff(begins)
            full = n > 0
            raw, at = memoryview(found.tobytes()), 8 * begins  # equal sets have equal digests of all their shingles, in order
            names = np.frombuffer(b"".join(hashlib.sha256(raw[i:j]).digest()[:16] for i, j in zip(at[:-1], at[1:])), np.int64).reshape(-1, 2)
            sums = [pa.array(names[:, 0]), pa.array(names[:, 1])]
            sig = np.zeros((len(n), K), np.uint32)
            sig[full] = signatures(found, begins)
            rows = [pa.array([row.tobytes() if f else None for row, f in zip(x, full)], pa.binary()) for x in (sig, sig.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), *sums, *rows], ["doc_id", "n", "f1", "f2", "sig", "low"])


def _tokens(sig: np.ndarray) -> np.ndarray:
    """48-bit names of coordinate values; that two values share a name only adds a candidate."""
    return kernel.mix(sig.astype(np.uint64) * np.uint64(K) + np.arange(K, dtype=np.uint64)) >> np.uint64(16)


def _signature_rows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), np.uint32).reshape(len(col), K)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for b in batches:
        total += np.bincount((_tokens(_signature_rows(b.column(0))) >> np.uint64(48 - COUNT_BITS)).astype(np.int64).ravel(), minlength=len(total))
    at = np.flatnonzero(total)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["slot", "n"])


def _post(counts):
    keep = K - T + L

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                tokens = _tokens(_signature_rows(part.column(1)))
                seen = table[(tokens >> np.uint64(48 - COUNT_BITS)).astype(np.int64)]
                order = np.lexsort((tokens, seen), axis=1)[:, :keep]
                weight = np.repeat((8 * np.log2(1 + seen.sum(axis=1))).astype(np.int16), keep)
                yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(tokens, order, 1).ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), keep)), pa.array(weight)], ["token", "id", "weight"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(k)), np.uint8).reshape(-1, K) for k in (2, 3))
        same = (x == y).sum(axis=1) >= T
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(same))


def _sets(keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(keep, batches):
            for lo, hi, buf, off in slices(b.column(1)):
                found, begins = text_shingles(buf, off)
                rows = [found[i:j].tobytes() for i, j in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["id", "set"])

    return run


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents of ids (id), and of a few more; the texts stay where they are read."""
    rows, keep = passing(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id", ids, "id")
    return rows.mapInArrow(_sets(keep), "id long, set binary")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those whose sets are similar enough; classes: (id, low); docs: (doc_id, text).

    The count of equal coordinates takes the lowest byte of each, which never misses an equal one.
    """
    sig = classes.select("id", "low")
    close = pairs.join(sig.select(F.col("id").alias("a"), F.col("low").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("low").alias("sb")), "b")
    close = materialize(close.select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long"), "close")
    sets = materialize(shingle_sets(docs, close.select(F.col("a").alias("id")).union(close.select("b"))), "sets")
    full = close.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
    links = materialize(full.select("a", "b", "xa", "xb").mapInArrow(_similar, "a long, b long"), "links")
    drop(close, sets)
    return links


def _blocked(rows):
    """Links between the strays of one block and the members of another, as a spanning forest of what isn't linked yet."""
    side = np.asarray(rows.column("stray"))
    ids, label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
    member = np.flatnonzero(~side)
    sizes = np.array([len(sets[i]) for i in member])
    shingles, owner = np.concatenate([sets[i] for i in member]), np.repeat(np.arange(len(member)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    root = {x: x for x in label.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i in np.flatnonzero(side):
        own = sets[i]
        lo, hi = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        both = np.bincount(owner[at], minlength=len(member))
        for k in np.flatnonzero(100 * both >= PERCENT * (len(own) + sizes - both)):
            x, y = find(label[i]), find(label[member[k]])
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(ids[i])
                b.append(ids[member[k]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


#: Shingles of one side of a block.
BLOCK = 1 << 20


def _unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (token, id, weight, label, outside) of lists (token, id, weight) that hold several components of labels (id, label); outside: not in the list's largest one."""
    rows = lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    per = rows.groupBy("token", "label").agg(F.count("*").alias("n"))
    top = per.groupBy("token").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("token", F.col("top.label").alias("most"))
    return materialize(rows.join(top, "token").select("token", "id", "weight", "label", (F.col("label") != F.col("most")).alias("outside")), "unsettled")


def _long_list_links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links within the lists of _unsettled() rows, on full sets."""
    names = rows.groupBy("token").agg(F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("g")).alias("members"))
    once = names.groupBy("members").agg(F.min("token").alias("token"))
    rows = materialize(rows.join(once, "token", "left_semi").select("token", "id", "label", "outside"), "once")
    sets = materialize(shingle_sets(docs, rows.select("id")).withColumn("n", F.expr("length(set) div 8")), "sets")
    sized = rows.join(sets.select("id", "n"), "id")
    blocks = materialize(sized.groupBy("token").agg(F.ceil(F.sum("n") / BLOCK).alias("nb"), F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / BLOCK).alias("na")), "blocks")
    each = rows.join(blocks, "token")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    strays = each.where("outside").select("token", own("na").alias("i"), every("nb").alias("j"), "id", "label", F.lit(True).alias("stray"))
    members = each.select("token", every("na").alias("i"), own("nb").alias("j"), "id", "label", F.lit(False).alias("stray"))
    tasks = strays.unionByName(members).join(sets.select("id", "set"), "id")
    links = materialize(tasks.groupBy("token", "i", "j").applyInArrow(_blocked, "a long, b long"), "more")
    drop(rows, sets, blocks)
    return links


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's hub, the row with the greatest weight of those that may be hubs, and its rows of other labels; rows: (token, id, weight, label, outside)."""
    hubs = materialize(rows.where("outside").groupBy("token").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"), "label")).alias("hub")).select("token", (-F.col("hub.id")).alias("hub"), F.col("hub.label").alias("own")), "hubs")
    return rows.join(hubs, "token").where("label <> own").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))


def _joined(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label) of links (a, b) and what labels (id, label) hold together already."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if labels is not None:
        edges = edges.union(labels.where("id <> label").select("id", "label"))
    return components(edges).select("id", F.col("component").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; words are runs of other characters than [\\x20\\x09-\\x0D]. A null or empty text, or one without words, has
    no shingles and no links. component_id is the least doc_id that a document is linked with, itself included; kept
    is true for that one. Rows that repeat a doc_id are one document, of which one row is kept; a null doc_id is linked
    with nothing and kept. Other columns are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    docs = docs.select("doc_id", "text")
    seen = materialize(docs.mapInArrow(_sketch, "doc_id long, n long, f1 long, f2 long, sig binary, low binary"), "signatures")
    key = ["f1", "f2", "n"]
    classes = seen.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("id"), F.max("sig").alias("sig"), F.max("low").alias("low"))
    classes = materialize(classes, "classes")

    counted = classes.select("sig").mapInArrow(_count_tokens, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    counts = spark.sparkContext.broadcast(table)  # 8 MB, whatever the input

    posted = materialize(classes.select("id", "sig").mapInArrow(_post(counts), "token long, id long, weight short"), "postings")
    # a table of its own, so that the join's two sides are dealt apart and a token of very many documents can be split
    lists = materialize(posted.groupBy("token").agg(F.count("*").cast("int").alias("c")).where("c > 1"), "counts")
    shared = materialize(posted.join(lists, "token"), "lists")
    drop(posted, lists)

    short = shared.where(F.col("c") <= LONG).select("token", "id")
    pairs = short.withColumnRenamed("id", "a").join(short.withColumnRenamed("id", "b"), "token").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= L).select("a", "b")
    long = shared.where(F.col("c") > LONG)
    stars = _stars(long.select("token", "id", "weight", F.col("id").alias("label"), F.lit(True).alias("outside")))
    labels = _joined(confirm(pairs.union(stars).distinct(), classes, docs))
    rows, before = _unsettled(long.select("token", "id", "weight"), labels), long.select("token", F.col("c").alias("was")).distinct()
    while True:
        left = rows.groupBy("token").agg(F.count_if("outside").alias("left"), F.count("*").alias("all")).where(F.col("left") * F.col("all") > MANY)
        worth = materialize(left.join(before, "token").where(F.col("left") <= WORTH * F.col("was")).select("token", F.col("left").alias("was")), "worth")
        if worth.isEmpty():
            break
        labels = _joined(confirm(_stars(rows.join(worth.select("token"), "token", "left_semi")).distinct(), classes, docs), labels)
        last, rows, before = rows, _unsettled(rows.select("token", "id", "weight"), labels), worth
        drop(last)
    if not rows.isEmpty():
        labels = _joined(_long_list_links(rows, docs), labels)
    drop(rows, shared)

    least = classes.join(labels, "id", "left").select(*key, F.coalesce("label", "id").alias("component_id"))
    out = seen.join(least, key, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.withColumn("alone", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))  # rows without an id don't meet in one task
    first = Window.partitionBy("doc_id", "alone").orderBy(F.desc("n"), "f1", "f2")
    once = F.col("doc_id").isNull() | (F.row_number().over(first) == 1)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), (once & F.col("doc_id").eqNullSafe(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))).alias("kept"))
