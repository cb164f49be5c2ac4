"""What the operators share: the shared folder, Arrow batches in bounded slices, the held-out rule."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import root as shared_root
from ..plans.shared import workers_see_package

#: Bytes of text that a numpy kernel takes at once (a longer single text is taken alone).
SLICE_BYTES = 1 << 20

def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: A table has at most a file for each BYTES_PER_FILE of the files that it is worked out of, or FILES_PER_CORE for each core if that is more.
BYTES_PER_FILE, FILES_PER_CORE = 8 << 20, 4
_scope: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


#: Rows of the batches in which texts go to Python workers, where the session doesn't say how many: a batch is held several times over.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def prepare_workers(spark: SparkSession) -> None:
    """Workers see this package, and get batches of BATCH_ROWS unless the session has a setting of its own."""
    workers_see_package(spark)
    if spark.conf.get(BATCH_KEY, None) in (None, "10000"):
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def compact(df: DataFrame) -> DataFrame:
    """df in no more partitions than are worth a file each, going by the bytes of the files that it reads; so small inputs don't become very many tiny files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.coalesce(min(max(-(-size // BYTES_PER_FILE), FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism), (1 << 31) - 1))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and any executor can reread it.

    The files go with drop(), at the end of the temporary_tables() block in which they were written, or else when the session's JVM exits.
    """
    spark = df.sparkSession
    root = f"{shared_root(spark)}/semcodec-{uuid.uuid4().hex}"
    compact(df).write.parquet(f"{root}/{label}")
    where, files = _place(spark, root)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(f"{root}/{label}")
    out._semcodec_root = root
    if (tables := _scope.get()) is not None:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize(): only once everything that is worked out of them has been written itself."""
    for table in tables:
        where, files = _place(table.sparkSession, table._semcodec_root)
        files.delete(where, True)


@contextmanager
def temporary_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What materialize() writes within the block goes at its end, but for tables given to the block's function."""
    tables: list[DataFrame] = []
    token = _scope.set(tables)

    def keep(table: DataFrame) -> DataFrame:
        tables.remove(table)
        return table

    try:
        yield keep
    finally:
        _scope.reset(token)
        drop(*tables)


def columns(rows: DataFrame) -> list[Column]:
    """rows' columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores in front until none of columns is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Ids up to which rows without them are found with a broadcast join (8 bytes each).
BROADCAST_IDS = 1_000_000


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose `key` isn't among ids (one column of numbers); what may be few ids is sent to the rows, more than BROADCAST_IDS shuffle both."""
    ids = materialize(ids.toDF(key), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti").select(*columns(rows))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column of numbers that tells its rows apart: doc_id, where it does that.

    Else docs with another column: doc_id where no other row has it; rows without a doc_id, and all rows of one that is repeated, get numbers
    above all doc_ids (which must be under 2^62 then). Such docs are written once, so that the numbers stay.
    """
    many = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    if many.isEmpty():
        return docs, "doc_id"
    name = unused("row", docs.columns)
    odd = unused("odd", docs.columns)
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    told = docs.join(many.where("doc_id is not null").withColumn(odd, F.lit(True)), "doc_id", "left")
    fresh = F.lit(max(top, 0) + 1) + F.monotonically_increasing_id()
    number = F.when(F.col(odd).isNull() & F.col("doc_id").isNotNull(), F.col("doc_id").cast("long")).otherwise(fresh)
    return materialize(told.select(*columns(docs), number.alias(name)), "numbered"), name


#: Keys that summed() deals over several tasks, at most.
HOT_KEYS = 4000


def summed(rows: DataFrame, key: list[str], spread: list[str], meets: Column | None = None, **sums: Column) -> DataFrame:
    """rows (those for which meets is true, if given) with sums (aggregates) over all rows of the same key; no key may be null.

    The aggregate is combined before it is shuffled, but each row must meet the sums of its key: a join in which a key that a third of all rows
    have would fall to one task. So the HOT_KEYS commonest hashes of keys are counted first (that many numbers on the driver, whatever the input). A key
    with more than the mean of those gets as many parts as it has such means; `spread` deals its rows over them, and its sums are repeated for each part. All
    other keys have one part, of at most one HOT_KEYS-th of the rows. A hash that two keys share gives both of them parts; the join is on the keys.
    """
    spark = rows.sparkSession
    code, part, parts = (unused(c, rows.columns) for c in ("code", "part", "parts"))
    coded = (rows if meets is None else rows.where(meets)).withColumn(code, F.xxhash64(*key))
    top = coded.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code).limit(HOT_KEYS).toArrow()
    n = top.column("n").to_numpy()
    share = max(1, int(n.sum()) // HOT_KEYS)
    hot = spark.createDataFrame(pa.table({code: top.column(code).to_numpy()[n > share], parts: -(-n[n > share] // share)}), f"{code} long, {parts} long")
    dealt = coded.join(F.broadcast(hot), code, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*spread), F.col(parts)), F.lit(0)))
    names = rows.groupBy(*key).agg(*[c.alias(name) for name, c in sums.items()]).withColumn(code, F.xxhash64(*key)).join(F.broadcast(hot), code, "left")
    names = names.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(parts), F.lit(1)) - 1)))
    return dealt.drop(code, parts).join(names.drop(code, parts), [*key, part]).drop(part)


def held_out(doc_id: Column | str) -> Column:
    """True for rows that no label may be learned from: crc32(doc_id as text) mod 4 is 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def held_out_rows(ids: pa.Array) -> list[bool]:
    return [x is not None and zlib.crc32(str(x).encode()) % 4 == 2 for x in ids.to_pylist()]


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, limit: int, extract: Callable[[pa.Array], list[pa.Array]], fields: str) -> tuple[pa.Table, np.ndarray]:
    """Features and 0/1 labels of at most `limit` labelled rows that aren't held out, chosen in the order of a hash of doc_id.

    The executors turn whole texts into features (extract: a column of texts -> the columns of `fields`); the driver gathers those only.
    Rows without text, id or label are left out. Of rows that repeat an id, the one whose text has the least hash counts. The rows come in the order of doc_id.
    """
    prepare_workers(docs.sparkSession)
    some = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    some = some.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(F.col("doc_id").alias("_id"), "text").where("text is not null").join(F.broadcast(some), "_id")  # at most `limit` rows of two numbers
    rows = rows.select(F.col("_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "_y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                columns = extract(part.column(3))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], ["_id", "_hash", "_y", *(x.split()[0] for x in fields.split(", "))])

    names = [x.split()[0] for x in fields.split(", ")]
    each = rows.mapInArrow(run, f"_id long, _hash long, _y int, {fields}").groupBy("_id", "_y").agg(F.min_by(F.struct(*names), "_hash").alias("x"))
    found = each.select("_id", "_y", *[f"x.{n}" for n in names]).toArrow().sort_by("_id")
    return found, found.column("_y").to_numpy().astype(np.int64)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, extract: Callable[[pa.Array], list[pa.Array]], fields: str) -> DataFrame:
    """(_id, _y, features) of all labelled rows that aren't held out, by the rules of labelled_features(); only features are shuffled."""
    prepare_workers(docs.sparkSession)
    some = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    some = materialize(some.groupBy("_id").agg(F.max("_y").alias("_y")), "labelled")
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    rows, keep = passing(texts, "_id", some, "_id")
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(keep, batches):
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *extract(part.column(2))], ["_id", "_hash", *names])

    each = rows.mapInArrow(run, f"_id long, _hash long, {fields}").join(some, "_id").groupBy("_id", "_y").agg(F.min_by(F.struct(*names), "_hash").alias("x"))
    return each.select("_id", "_y", *[f"x.{n}" for n in names])


#: Bits of a filter for each id, if they fit in FILTER_BITS_MOST (32 MB), and the least for which one is worth its while.
FILTER_BITS_EACH, FILTER_BITS_MOST, FILTER_BITS_LEAST = 32, 1 << 28, 4


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A map of `bits` bits (a multiple of 2^15) in which those of slots (slot) are set; the executors put it together in pieces of 4 KB."""
    parts = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    for bucket, own in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        table[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(own, np.uint8)
    return table


def passing(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """rows with a last column, and what a worker does with a batch of them: it leaves the rows of the ids, and some 3 % of the others (more where ids are so many that they get fewer bits).

    So texts that aren't meant needn't be shuffled. The filter is a bitmap of hashed ids, put together by the executors in pieces of 4 KB and
    sent to them. For more ids than that, rows are joined with ids instead.
    """
    many = ids.count()
    bits = min(1 << max(15, (FILTER_BITS_EACH * many - 1).bit_length()), FILTER_BITS_MOST)
    if bits < FILTER_BITS_LEAST * many:
        return rows.join(ids.select(F.col(id_column).alias(column)).distinct(), column, "left_semi").select(*rows.columns, F.lit(0).alias("_slot")), lambda batch: batch.drop_columns(["_slot"])
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)).cast("int")
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(ids.select(slot(id_column).alias("slot")), bits))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column("_slot").to_numpy()
        return batch.filter(pa.array(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)).drop_columns(["_slot"])

    return rows.select("*", slot(column).alias("_slot")), keep


#: Bytes of a text that are taken apart at once.
BYTES_OF_TEXT = 1 << 20


def text_parts(text: bytes, size: int = BYTES_OF_TEXT) -> Iterator[bytes]:
    """text, cut at blanks into parts of about `size` bytes (longer where a part has no blank)."""
    lo = 0
    while len(text) - lo > size:
        hi = text.find(b" ", lo + size)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:] if lo else text


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and each text's offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=n + 1 + col.offset)[col.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `budget` bytes."""
    buf, off = text_buffers(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + budget, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
