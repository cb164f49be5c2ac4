"""Source divergence audit: how far the sources of a language are apart in the use of its terms, and by which terms.

The sum of the absolute differences of two sources' rates over all terms is split by how many sources have a term. With p for a
source's rate of a term and b for the rate of a term that it doesn't have, the sum over V terms is

    V |b - b'| + over the terms of the one (|p - b'| - |b - b'|) + over the terms of the other (|b - p'| - |b - b'|)
               + over the terms of both (|p - p'| - |p - b'| - |b - p'| + |b - b'|).

The first row needs only how often a source has each rate (a histogram). The second one is heavy or light: terms that many sources have
(HEAVY of them or more) fill dense tiles of sources x terms; rare terms are lists of postings, of which pairs are corrected. All partial sums are
whole numbers, so their sum is exact. Tiles are made of blocks of sources and of terms, so none grows with the input; a tile
gives one row for each pair of sources, which is the size of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTES_OF_TEXT, materialize, prepare_workers, text_parts

#: Documents of a language that a kept term is in; what is added to each count; a rate is a share of SCALE.
LEAST_DOCUMENTS, ADDED, SCALE = 30, 5, 1_000_000_000
#: Ranks of a source's own terms.
TOP = 50
#: Share of a language's sources that a heavy term is in.
HEAVY = 0.5
#: Sources of a block, and postings of a block of sources in a tile, on average.
SOURCES, POSTINGS = 256, 1 << 16
#: Counts that a task holds before it sends them on.
HELD = 300_000

#: Bytes of terms (letters and all that isn't ASCII), A-Z lower-cased; others are blanks.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, documents, n), summed over what a task can hold; the empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (documents, n) in held.items():
            terms = list(n)
            for lo in range(0, len(terms), 1 << 15):
                part = terms[lo : lo + (1 << 15)]
                columns = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([documents[t] for t in part], pa.int64()), pa.array([n[t] for t in part], pa.int64())], ["lang", "source", "term", "documents", "n"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            documents, n = held.setdefault((lang, source), (Counter(), Counter()))
            documents[b""] = n[b""] = 0
            seen: set[bytes] = set()
            for part in text_parts(text.as_py().translate(TERM_BYTES), BYTES_OF_TEXT):
                terms = part.split()
                n.update(terms)
                seen.update(terms)
            documents.update(seen)
        if sum(len(n) for _, n in held.values()) > HELD:
            yield from rows()
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, documents, n) of docs (lang, source, text): in how many documents and how often; a row with an empty term for each (lang, source)."""
    prepare_workers(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    return rows.mapInArrow(_counts, "lang string, source string, term string, documents long, n long").groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))


def _rate(n: Column, all_n: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (all_n + ADDED * terms)), exactly; null without terms."""
    over = (all_n + ADDED * terms).cast("decimal(20,0)")
    above = (n + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, over) + 1


def _dense(p: np.ndarray, b: np.ndarray, group: np.ndarray, term: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Corrections for all pairs of left x right groups, from a full matrix of groups x terms."""
    full = np.repeat(b[:, None], term.max() + 1, axis=1)
    full[group, term] = p
    other, base = full[right], b[right][:, None]
    return np.stack([(abs(full[g] - other) - abs(full[g] - base) - abs(b[g] - other) + abs(b[g] - base)).sum(axis=1) for g in left])


def _sparse(p: np.ndarray, b: np.ndarray, group: np.ndarray, term: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: int = 1 << 20) -> np.ndarray:
    """The same from the postings: pairs of one left and one right posting of a term, some at a time."""
    place = np.full(len(b), -1)
    out = np.zeros((len(left), len(right)), np.int64)
    place[right] = np.arange(len(right))
    at = np.flatnonzero(place[group] >= 0)
    at = at[np.argsort(term[at], kind="stable")]
    column = place[group[at]]
    place[:] = -1
    place[left] = np.arange(len(left))
    own = np.flatnonzero(place[group] >= 0)
    lo, hi = np.searchsorted(term[at], term[own], "left"), np.searchsorted(term[at], term[own], "right")
    ends = np.cumsum(hi - lo)
    first = 0
    while first < len(own):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + pairs, "right")))
        n = (hi - lo)[first:last]
        x = np.repeat(own[first:last], n)
        k = np.arange(n.sum()) + np.repeat(lo[first:last] - np.cumsum(n) + n, n)
        px, bx, py, by = p[x], b[group[x]], p[at[k]], b[group[at[k]]]
        np.add.at(out, (place[group[x]], column[k]), abs(px - py) - abs(px - by) - abs(bx - py) + abs(bx - by))
        first = last
    return out


def _bases(p: np.ndarray, weight: np.ndarray, b: np.ndarray, group: np.ndarray, terms: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the terms of one group or of none of a pair add; p and weight: how many terms of a group have a rate."""
    apart = abs(b[left][:, None] - b[right][None, :])
    out = terms * apart
    for side, other, turned in ((left, right, False), (right, left, True)):
        for k, g in enumerate(side):
            own = group == g
            rates, n = p[own], weight[own]
            order = np.argsort(rates)
            rates, n = rates[order], n[order]
            below, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * rates)])
            x = b[other]
            at = np.searchsorted(rates, x)
            found = (x * below[at] - sums[at]) + (sums[-1] - sums[at] - x * (below[-1] - below[at])) - below[-1] * abs(b[g] - x)
            if turned:
                out[:, k] += found
            else:
                out[k] += found
    return out


#: Kinds of tiles.
BASES, DENSE, SPARSE = 0, 1, 2


def _tile(rows: pa.Table) -> pa.Table:
    """Rows (lang, source, other, value) for the pairs of sources of two blocks."""
    kind, i, j = (rows.column(c)[0].as_py() for c in ("kind", "i", "j"))
    sources = rows.column("source").combine_chunks().dictionary_encode()
    group, names = sources.indices.to_numpy(zero_copy_only=False), sources.dictionary
    _, first = np.unique(group, return_index=True)
    b, block = (rows.column(c).to_numpy()[first] for c in ("b", "block"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    there = np.asarray(rows.column("p").is_valid())
    p, group = rows.column("p").fill_null(0).to_numpy()[there], group[there]
    if kind == BASES:
        found = _bases(p, rows.column("weight").fill_null(0).to_numpy()[there], b, group, rows.column("terms")[0].as_py(), left, right)
    elif len(left) and len(right):
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[there]
        found = (_dense if kind == DENSE else _sparse)(p, b, group, term, left, right)
    else:
        found = np.zeros((len(left), len(right)), np.int64)
    place = np.argsort(np.argsort(np.array(names.to_pylist(), object)))  # within a block a pair stands under its first name, in all tiles alike
    x, y = np.nonzero(place[left][:, None] < place[right][None, :]) if i == j else np.nonzero(np.ones(found.shape, bool))
    x, y, value = left[x], right[y], found[x, y]
    return pa.table({"lang": pa.repeat(rows.column("lang")[0], len(x)), "source": names.take(pa.array(x)), "other": names.take(pa.array(y)), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, heavy: float = HEAVY, sources: int = SOURCES, postings: int = POSTINGS) -> DataFrame:
    """docs (lang, source, text) -> lang, source, part, item, value, rank.

    Terms are runs of letters and of what isn't ASCII, A-Z lower-cased. A language keeps the terms that at least `least_documents` of its
    documents have. Part `pair`: item is each other source of the language, value the sum of the differences of their rates. Part `term`:
    the `top` kept terms that the source has at a higher rate than its language, value the difference. Ranks go by value, the largest first, then by item.

    A null text, lang or source is an empty one; a source with documents but without kept terms has its pairs. Each row is a document, repeated ones too.
    Whole texts of any length are read. An empty table gives an empty table; other columns are ignored.
    """
    per = materialize(term_counts(docs), "counts")
    terms = per.where("term <> ''").groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("lang_n"), F.count("*").alias("having"))
    kept = materialize(terms.where(F.col("documents") >= least_documents).drop("documents"), "kept")
    found = materialize(per.where("term <> ''").drop("documents").join(kept, ["lang", "term"]), "postings")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("all_n"))
    sizes = per.where("term = ''").groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = per.where("term = ''").select("lang", "source").join(sizes, "lang").join(own, ["lang", "source"], "left").fillna(0, ["terms", "own_n"])
    blocks = F.ceil(F.col("sources") / sources)
    groups = groups.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block"), F.coalesce(_rate(F.lit(0), F.col("own_n"), F.nullif("terms", F.lit(0))), F.lit(0)).alias("b"))
    groups = materialize(groups, "groups")
    rates = found.join(groups, ["lang", "source"]).withColumn("p", _rate(F.col("n"), F.col("own_n"), F.col("terms")))

    q = _rate(F.col("lang_n"), F.col("all_n"), F.col("terms"))
    order = lambda value, item: Window.partitionBy("lang", "source").orderBy(F.desc(value), item)
    above = rates.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    above = above.withColumn("rank", F.row_number().over(order("value", "item"))).where(F.col("rank") <= top)

    columns = ["lang", "source", "block", "blocks", "b", "terms"]
    bases = rates.groupBy(*columns, "p").agg(F.count("*").alias("weight")).unionByName(groups.select(*columns), allowMissingColumns=True)
    bases = bases.select(*columns, F.lit(BASES).alias("kind"), F.lit(0).cast("long").alias("k"), "p", "weight", F.lit("").alias("term"))
    is_heavy = F.col("having") >= heavy * F.col("sources")
    kind = F.when(is_heavy, DENSE).otherwise(SPARSE)
    many = rates.groupBy("lang", kind.alias("kind")).agg(F.ceil(F.count("*") / (F.first("blocks") * postings)).alias("parts"))
    both = rates.where("having > 1").withColumn("kind", kind).join(many, ["lang", "kind"])
    both = both.select(*columns, "kind", F.pmod(F.xxhash64("term"), "parts").alias("k"), "p", F.lit(1).cast("long").alias("weight"), "term")
    dealt = bases.unionByName(both).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    sums = dealt.groupBy("lang", "kind", "k", "i", "j").applyInArrow(_tile, "lang string, source string, other string, value long").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order("value", "item")))
    return pairs.unionByName(above)
