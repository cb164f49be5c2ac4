"""Writers for dictionaries, sequences and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec


#: Words of a file of a written dictionary, on average.
WORDS_OF_A_FILE = 10_000


def dictionary_json(dictionary: DataFrame, path: str, previous: DataFrame | None = None) -> None:
    """A folder of files of entries and code_entries, as readers.dictionary_json() reads them; each holds a range of the words, sorted.

    previous: a dictionary whose relations words without any take over. Parquet is the form for work, this one for exchange.
    """
    if previous is not None:
        old = previous.where(F.size("related") > 0).select("kind", "word", F.col("related").alias("_old"))
        kept = F.when(F.size("related") > 0, F.col("related")).otherwise(F.coalesce("_old", "related"))
        dictionary = dictionary.join(old, ["kind", "word"], "left").withColumn("related", kept).drop("_old")
    a = F.col("addr")
    directions = F.array(F.lit(""), F.lit("OUT"), F.lit("IN"))
    edges = F.transform("related", lambda r: F.array(r["type"], codec.address_text(r["addr"]), r["weight"].cast("string"), F.get(directions, r["direction"])))
    shade = F.struct(F.col("polarity").alias("p"), F.col("formality").alias("f"), F.col("intensity").alias("i"))
    entry = F.struct(codec.domain_code(a).alias("d"), codec.category_of(a).alias("c"), codec.concept_of(a).alias("n"), shade.alias("s"), F.col("synset").alias("syn"), edges.alias("trel"))
    files = max(1, -(-dictionary.count() // WORDS_OF_A_FILE))
    rows = dictionary.select("kind", "word", entry.alias("e"), F.pmod(F.crc32(F.substring("word", 1, 2)), F.lit(files)).alias("file"))
    own = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("word", "e")))))
    body = rows.groupBy("file").agg(own("text").alias("entries"), own("code").alias("code_entries"))
    body.select("file", F.to_json(F.struct("entries", "code_entries")).alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def sequences(encoded: DataFrame, path: str, version: int = 3) -> None:
    """Parquet with the binary form beside the other columns."""
    encoded.withColumn("binary", codec.to_binary(F.col("tokens"), version)).drop("tokens").write.mode("overwrite").parquet(path)


def report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
