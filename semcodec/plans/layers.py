"""Content-addressed layers, and the build of a dictionary from them.

A layer is a Parquet table in a folder named by its input's hash; reading one of another version or hash is a miss. It is written to a folder of its own
and renamed, with a note of its files' lengths, its rows and their hash; what doesn't agree with the note (a part cut off or missing) is a miss.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, lexicon
from . import shared

VERSION = 1
#: What is noted of a layer; Spark doesn't read files of such names.
NOTE = "_layer.json"


def rows_hash(rows: DataFrame) -> str:
    """16 hexadecimal digits of a hash of all rows, whatever their order or partitions."""
    each = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    parts = [F.sum(F.conv(F.substring(each, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return rows.agg(F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16).alias("h")).first()[0]


@dataclass
class LayerCache:
    spark: SparkSession
    root: str

    def path(self, layer: str, key: str) -> str:
        return f"{self.root.rstrip('/')}/v{VERSION}/{layer}/{key}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _lengths(self, folder: str) -> dict[str, int]:
        fs, where = self._fs(folder)
        return {x.getPath().getName(): x.getLen() for x in fs.listStatus(where) if x.getPath().getName().startswith("part-")}

    def _agrees(self, folder: str, thorough: bool) -> bool:
        fs, where = self._fs(f"{folder}/{NOTE}")
        if not fs.exists(where):
            return False
        try:
            note = json.loads(shared.text_of(self.spark, f"{folder}/{NOTE}"))
            if note["files"] != self._lengths(folder):
                return False
            rows = self.spark.read.parquet(folder)
            return rows.count() == note["rows"] and (not thorough or rows_hash(rows) == note["hash"])
        except Exception:  # whatever can't be read is a miss
            return False

    def read(self, layer: str, key: str, thorough: bool = False) -> DataFrame | None:
        """The layer, if all its files are there at their lengths with the rows noted (thorough: and hash as noted)."""
        folder = self.path(layer, key)
        return self.spark.read.parquet(folder) if self._agrees(folder, thorough) else None

    def write(self, layer: str, key: str, rows: DataFrame) -> DataFrame:
        """Written beside its place and moved there. If another writer was first, theirs stays; a layer that doesn't agree with its note is replaced."""
        folder, own = self.path(layer, key), f"{self.path(layer, key)}-{uuid.uuid4().hex}"
        rows.write.parquet(own)
        written = self.spark.read.schema(rows.schema).parquet(own)
        shared.put(self.spark, f"{own}/{NOTE}", json.dumps({"files": self._lengths(own), "rows": written.count(), "hash": rows_hash(written)}))
        fs, target = self._fs(folder)
        _, source = self._fs(own)
        if fs.exists(target) and not self._agrees(folder, False):
            fs.delete(target, True)
        if not fs.exists(target):
            fs.rename(source, target)  # into the folder, where another writer has just made it
            _, inside = self._fs(f"{folder}/{own.rsplit('/', 1)[1]}")
            fs.delete(inside, True)
        fs.delete(source, True)
        return self.spark.read.parquet(folder)

    def forget(self, layer: str, key: str) -> None:
        fs, where = self._fs(self.path(layer, key))
        fs.delete(where, True)

    def clear(self) -> None:
        fs, where = self._fs(self.root)
        fs.delete(where, True)

    def get_or_build(self, layer: str, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The layer, and whether it was there."""
        found = self.read(layer, key)
        return (found, True) if found is not None else (self.write(layer, key, build()), False)


def sentiment_layer(scores: DataFrame) -> DataFrame:
    """(word, polarity) from (word, sense, positive, negative): the mean of the first three senses."""
    means = scores.where(F.col("sense") <= 3).groupBy("word").agg(F.avg("positive").alias("p"), F.avg("negative").alias("n"))
    return means.select("word", text.polarity_from_scores(F.col("p"), F.col("n")).alias("polarity"))


def formality_layer(frequencies: DataFrame) -> DataFrame:
    return frequencies.select("word", text.formality_from_frequency(F.col("zipf")).alias("formality"), text.is_common(F.col("zipf")).alias("common"))


def merge(seeds: DataFrame, derived: DataFrame | None = None, sentiment: DataFrame | None = None, formality: DataFrame | None = None, irregular: DataFrame | None = None) -> DataFrame:
    """A dictionary: seeds first, then derived words that are common, then irregular forms (word, lemma) of words that are there.

    Variants don't displace entries. Hints come from the layers where those have the word.
    """
    out = seeds.withColumn("_seed", F.lit(True))
    if derived is not None:
        out = out.unionByName(derived.join(seeds.select("kind", "word"), ["kind", "word"], "left_anti").withColumn("_seed", F.lit(False)))
    if formality is not None:
        out = out.join(formality.select("word", F.col("formality").alias("_f"), "common"), "word", "left")
        out = out.where(F.col("_seed") | F.coalesce("common", F.lit(False)) | (F.col("kind") == "code"))
        out = out.withColumn("formality", F.when(F.col("kind") == "text", F.coalesce("_f", "formality")).otherwise(F.col("formality"))).drop("_f", "common")
    if sentiment is not None:
        out = out.join(sentiment.withColumnRenamed("polarity", "_p"), "word", "left")
        out = out.withColumn("polarity", F.when(F.col("kind") == "text", F.coalesce("_p", "polarity")).otherwise(F.col("polarity"))).drop("_p")
    out = out.select(*lexicon.COLUMNS)
    if irregular is not None:
        texts = out.where("kind = 'text'")
        forms = irregular.join(texts.withColumnRenamed("word", "lemma"), "lemma").join(texts.select("word"), "word", "left_anti")
        first = forms.groupBy("word").agg(F.min_by(F.struct("kind", "addr", "polarity", "formality", "intensity", "related"), "lemma").alias("e"))
        out = out.unionByName(first.select("e.kind", "word", "e.addr", "e.polarity", "e.formality", "e.intensity", F.lit("").alias("synset"), "e.related"))
    return out


@dataclass
class Build:
    """The build's settings: seeds, layers to be cached, relation edges.

    invalid: layers to be built anew though they are there ("all" for every one); without a cache, layers are worked out and not kept.
    """

    cache: LayerCache | None
    seeds: DataFrame
    layers: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)
    invalid: tuple[str, ...] = ()
    hits: dict[str, bool] = field(default_factory=dict)

    def layer(self, name: str) -> DataFrame | None:
        if name not in self.layers:
            return None
        source, make = self.layers[name]
        if self.cache is None:
            self.hits[name] = False
            return make(source)
        key = rows_hash(source)
        if name in self.invalid or "all" in self.invalid:
            self.cache.forget(name, key)
        out, self.hits[name] = self.cache.get_or_build(name, key, lambda: make(source))
        return out

    def run(self, irregular: DataFrame | None = None, edges: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
        """The dictionary; its relations are those of edges, else those that a previous dictionary had for the word."""
        out = merge(self.seeds, self.layer("derived"), self.layer("sentiment"), self.layer("formality"), irregular)
        if previous is not None:
            old = previous.where(F.size("related") > 0).select("kind", "word", F.col("related").alias("_old"))
            out = out.join(old, ["kind", "word"], "left").withColumn("related", F.coalesce("_old", "related")).select(*lexicon.COLUMNS)
        return graph.stamp(out, graph.select_top(edges)) if edges is not None else out
