"""Exact deduplication by deterministic block naming.

Texts are equal when they agree once the characters [\\x20\\x09-\\x0D] are deleted. All texts are compared without
hashing: the normalised text is cut into blocks of fixed size, equal blocks get
one integer name (the smallest place where the block stands), then adjacent names are paired and the pairs named in
the same way, until each document has one name. Two documents have one name exactly if their texts are equal.

Every naming step is a group-by that is combined before it is shuffled, and an equi-join in which the rows of a block that
stands in a third of all documents are dealt over many tasks (common.summed).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, prepare_workers, summed

#: Bytes of a block, as a power of two; and places that a row's blocks may take.
BLOCK_BYTES = 2048
_SPACES = b" \t\n\x0b\x0c\r"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_chars, size, digest, tag = [], [], [], []
        for text in batch.column(1):
            raw = text.as_py() or b""
            body = raw.translate(None, _SPACES)
            found = hashlib.sha256(body)
            n_chars.append(len(raw.decode("utf-8", "replace")))
            size.append(len(body))
            digest.append(found.hexdigest())
            tag.append(int.from_bytes(found.digest()[:8], "big", signed=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_chars, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(tag, pa.int64())], ["doc_id", "n_chars", "size", "text_sha256", "tag"])


def _blocks(block_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tags, numbers, parts = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = (text.as_py() or b"").translate(None, _SPACES)
                pieces = [body[k : k + block_bytes] for k in range(0, max(len(body), 1), block_bytes)]
                rows += [row] * len(pieces)
                tags += [int.from_bytes(hashlib.sha256(body).digest()[:8], "big", signed=True)] * len(pieces)
                numbers += range(len(pieces))
                parts += [zlib.compress(x, 1) for x in pieces]  # without loss, so equal exactly if the blocks are; it is what is shuffled
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(tags, pa.int64()), pa.array(numbers, pa.int64()), pa.array(parts, pa.binary())], ["rid", "tag", "k", "part"])

    return cut


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows (rid, tag, k) with the name of their key: the least (rid, tag, k) where that key stands."""
    named = summed(rows, key, ["rid", "tag", "k"], name=F.min(F.struct("rid", "tag", "k")))
    return named.select("rid", "tag", "k", F.col("name.rid").alias("n1"), F.col("name.tag").alias("n2"), F.col("name.k").alias("n3"))


def block_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, tag, n1, n2, n3) for texts (rid, text): the three integers are a text's name.

    tag tells apart rows of one rid. The number of levels is the logarithm of the longest text's blocks. A text
    that is down to one name is paired with "nothing" at each further level, which no longer text can be.
    """
    prepare_workers(texts.sparkSession)
    parts = texts.withColumn("text", F.col("text").cast("binary")).mapInArrow(_blocks(block_bytes), "rid long, tag long, k long, part binary")
    level = materialize(_named(parts, ["part"]), "names")
    most = level.agg(F.max("k")).first()[0] or 0
    while most > 0:
        odd, name = F.col("k") % 2 == 1, F.struct("n1", "n2", "n3")
        pairs = level.groupBy("rid", "tag", F.floor(F.col("k") / 2).alias("k")).agg(F.max(F.when(~odd, name)).alias("a"), F.max(F.when(odd, name)).alias("b"))
        nothing = F.struct(*[F.lit(-1).cast("long").alias(c) for c in ("n1", "n2", "n3")])
        pairs = pairs.withColumn("b", F.coalesce("b", nothing))
        keys = [f"{side}{c}" for side in "ab" for c in ("n1", "n2", "n3")]
        pairs = pairs.select("rid", "tag", "k", *[F.col(f"{c[0]}.{c[1:]}").alias(c) for c in keys])
        below, level, most = level, materialize(_named(pairs, keys), "names"), most // 2
        drop(below)
    return level.select("rid", "tag", "n1", "n2", "n3").distinct()


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the row with the most code points in the original text, then the smallest doc_id, stays. A null or
    empty text, and one of white space only, is the empty text; those are equal. Rows that repeat a doc_id count as
    rows of their own; where such rows are the best of their group, one of them stays. A null doc_id sorts
    after all others. Other columns are ignored. An empty table gives an empty table.
    """
    prepare_workers(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    seen = docs.mapInArrow(_digests, "doc_id long, n_chars long, size long, text_sha256 string, tag long")
    seen = materialize(seen.withColumn("rid", F.coalesce("doc_id", F.lit(-1))).withColumn("row", F.monotonically_increasing_id()), "digests")
    members = seen.groupBy("rid", "tag").agg(F.count("*").alias("m"), F.max("n_chars").alias("best"), F.max(F.struct("n_chars", "row"))["row"].alias("best_row"), F.max("doc_id").alias("member"))
    members = materialize(members, "members")
    names = block_names(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("rid"), "text"), block_bytes)
    named = members.join(names, ["rid", "tag"])
    first = F.min(F.struct((-F.col("best")).alias("best"), F.col("member").isNull().alias("none"), "member"))
    info = summed(named, ["n1", "n2", "n3"], ["rid", "tag"], group_size=F.sum("m"), first=first).select("rid", "tag", "best_row", "group_size", F.col("first.member").alias("first_id"), (-F.col("first.best")).alias("first_chars"))
    out = seen.join(info, ["rid", "tag"])
    best = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_chars") == F.col("first_chars")) & (F.col("row") == F.col("best_row"))
    return out.select("doc_id", F.col("first_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), best.alias("kept"), "text_sha256", "n_chars")
