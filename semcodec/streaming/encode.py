"""Encoding of streams: stateless, so each micro-batch is the batch operator on new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import codec, text
from ..operators import lexicon
from ..operators.encode import described, encode


def encode_stream(source: DataFrame, dictionary: DataFrame, path: str, checkpoint: str, id_column: str = "doc_id", column: str = "text", *, once: bool = False) -> StreamingQuery:
    """Encodes new rows (id, text) as they come and appends them as Parquet; ids are unique within a micro-batch.

    A micro-batch that is repeated after a failure is written to its own folder again, so its rows stand once.
    """

    def write(batch: DataFrame, number: int) -> None:
        described(encode(batch, dictionary, id_column, column)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def count_stream(source: DataFrame, dictionary: DataFrame, path: str, checkpoint: str, column: str, time: str, *, window: str = "1 hour", late: str = "1 hour", once: bool = False) -> StreamingQuery:
    """Appends (start, address, n): how often each address comes in each window of event time, once rows later than `late` are past."""
    words = source.select(F.col(time).alias("_t"), F.explode(text.tokenize(F.col(column))).alias("word")).withWatermark("_t", late)
    known = lexicon.looked_up(words, "word", dictionary, "auto").where("addr is not null")
    counts = known.groupBy(F.window("_t", window).alias("w"), codec.address_text(F.col("addr")).alias("address")).agg(F.count("*").alias("n"))
    writer = counts.select("w.start", "address", "n").writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_once(start: Callable[..., StreamingQuery], *args, **options) -> None:
    start(*args, once=True, **options).awaitTermination()
