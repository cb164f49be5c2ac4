"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut from the end into full pieces; each document then has one piece that may be
shorter. Pieces go to sequences as sequential best-fit in order of falling length would place them, but in bulk
steps, one for each length: all pieces of the length are matched with the open sequences, sorted by gap. Lengths and gaps are
whole numbers up to the sequence length, so a step sweeps runs of sequences with equal contents from the smallest gap that fits
(the successor of the length) upwards; pieces that meet in a run are told apart by rank, the run's gap is
updated, and what found no gap opens new sequences. A step reads only how many pieces have a length, so the sweep is over
counts (at most one for each length, whatever the input) and gives a table of rank intervals; ranks, places and
sequence numbers of the pieces themselves are worked out by the executors.

Ranks within a length are made in two parts, so that a length that a third of all pieces have is spread over many tasks:
the rank within a bucket of ids, plus the sum of the counts of the buckets before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare_workers
from .tokens import worker_encoder

SEQUENCE, END_ID = 2048, 0
#: Pieces of one length that a bucket holds on average at most.
BUCKET = 1_000


def _pieces(path: str, sequence: int, end_id: int, added: tuple[tuple[str, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, added)
        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = encoder.encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    begins = [0, *range(n % sequence or sequence, n, sequence)]
                    rows += [(doc, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(begins, [*begins[1:], n]))]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, ranks_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32; a null text is an empty one, of end_id alone.

    added: tokens beside those of the ranks file, and their ids (tokens.added_tokens).
    """
    prepare_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(ranks_path, sequence, end_id, added), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], sequence: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, sequence number, pieces of this length in each sequence, offset) by length and first rank.

    A row holds for the ranks up to the next row's: rank r goes to sequence number + (r - first) // pieces, at offset +
    (r - first) % pieces * length.
    """
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, how many), sorted
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, (length, -1, -1))
            if at < len(gaps):
                gap, first, many = gaps.pop(at)
            else:
                per = sequence // length
                gap, first, many = sequence, opened, -(-left // per)
                opened += many
            per = gap // length
            full, rest = divmod(min(left, many * per), per)
            out.append((length, rank, first, per, sequence - gap))
            placed = full * per + rest
            left, rank = left - placed, rank + placed
            used = full + (rest > 0)
            for size, start, n in ((gap - per * length, first, full), (gap - rest * length, first + full, int(rest > 0)), (gap, first + used, many - used)):
                if n and size:
                    insort(gaps, (size, start, n))
    return out


def pack(pieces: DataFrame, sequence: int = SEQUENCE, number: str | None = None) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset; lengths are 1 to `sequence`.

    Equal lengths are ranked by doc_id, piece and whatever else tells rows apart. Reads pieces twice: give a written table. number: a column of it
    that tells all rows apart, by which they are dealt (else rows of one doc_id and piece stay together); it isn't returned.
    """
    prepare_workers(pieces.sparkSession)
    total = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length: at most `sequence`
    buckets = np.ones(sequence + 1, np.int64)  # by length
    for r in total:
        buckets[r["length"]] = -(-r["n"] // BUCKET)
    rows = np.array(plan({r["length"]: r["n"] for r in total}, sequence), np.int64).reshape(-1, 5)
    begins = np.searchsorted(rows[:, 0] * -1, -np.arange(sequence + 2))  # rows fall by length
    ends = np.searchsorted(rows[:, 0] * -1, -np.arange(sequence + 2), "right")

    own = F.element_at(F.array(*[F.lit(int(n)) for n in buckets[1:]]), F.col("length").cast("int"))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(number or F.struct("doc_id", "piece")), own))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", *[c for c in pieces.columns if c not in ("doc_id", "piece", "length")])
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = spread.withColumn("rank", F.row_number().over(order) - 1).join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = [c for c in pieces.columns if c != number]
    ranked = ranked.select(*names, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for size in np.unique(length):
                here = length == size
                at[here] = begins[size] + np.searchsorted(rows[begins[size] : ends[size], 1], rank[here], "right") - 1
            _, first, number, per, offset = rows[at].T
            k = rank - first
            columns = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number + k // per), pa.array(offset + k % per * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != number) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, ranks_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    Repeated rows are packed each on its own; a null doc_id stays null; an empty table gives an empty table; other columns
    are ignored. A text is split at `added` tokens first.
    """
    pieces = token_pieces(docs, ranks_path, sequence, end_id, added).withColumn("number", F.monotonically_increasing_id())
    return pack(materialize(pieces, "pieces"), sequence, "number")
