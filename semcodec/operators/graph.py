"""Relation edges between dictionary words: aggregation, distillation, selection, stamping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.constants import GRAPH_POLICY
from ..functions.text import concept_word, plain_word
from ..plans.shared import workers_see_package
from . import vectors as vector_sums

#: Lanes of relation types for a balanced choice, and how many edges each may take first.
LANES = {"lexical": (("SYNONYM", "ANTONYM", "ISA"), 2), "functional": (("PART", "PROPERTY", "USED_FOR", "CAUSES", "ENTAILS", "ROLE"), 1), "associative": (("RELATED", "CONTEXT", "ASSOCIATED", "TOPIC"), 1)}


def aggregate_edges(assertions: DataFrame, dictionary: DataFrame, policy: dict = GRAPH_POLICY) -> DataFrame:
    """(word, type, addr, score) from assertions (rel, src, tgt, weight): both ways, scores summed, edges to the own address dropped.

    Predicates that the policy doesn't name, and words that aren't in the dictionary, are dropped.
    """
    kind = codec.lookup_map({k: v[0] for k, v in policy.items()})
    factor = codec.lookup_map({k: float(v[1]) for k, v in policy.items()})
    rows = assertions.where(F.col("rel").isin(*policy)).select(concept_word(F.col("src")).alias("src"), concept_word(F.col("tgt")).alias("tgt"), codec.relation_type(kind[F.col("rel")]).alias("type"), (F.coalesce("weight", F.lit(1.0)) * factor[F.col("rel")]).alias("score"))
    words = dictionary.where("kind = 'text'").select("word", "addr")
    rows = rows.join(words.select(F.col("word").alias("src"), F.col("addr").alias("src_addr")), "src").join(words.select(F.col("word").alias("tgt"), F.col("addr").alias("tgt_addr")), "tgt")
    both = rows.select(F.col("src").alias("word"), "type", F.col("tgt_addr").alias("addr"), "src_addr", "tgt_addr", "score").unionByName(
        rows.select(F.col("tgt").alias("word"), "type", F.col("src_addr").alias("addr"), "src_addr", "tgt_addr", "score")
    )
    return both.where("src_addr <> tgt_addr").groupBy("word", "type", "addr").agg(F.sum("score").alias("score"))


def unit(vector: Column) -> Column:
    """A vector of length 1, or null for one without length."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def prototypes(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """(key, prototype): the mean of the unit vectors of each key, made a unit vector again."""
    return vector_sums.means(vectors, key, column, as_units=True).select(key, unit(F.col("mean")).alias("prototype"))


def _best(vectors: pa.Array, own_keys: pa.Array, protos: np.ndarray, keys: pa.Array, place: dict, top_k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, prototype, cosine): the top_k prototypes of each vector but its own key's; the first of equals."""
    rows, there = vector_sums.units(vector_sums.matrix(vectors))
    cosine = rows @ protos.T
    own = np.array([place.get(k, -1) for k in own_keys.to_pylist()], np.int64)
    cosine[np.flatnonzero(own >= 0), own[own >= 0]] = -2
    cosine[~there] = -2
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :top_k]
    best = np.take_along_axis(cosine, order, 1)
    at, k = np.nonzero(best >= max(least, -1))
    return at, order[at, k], best[at, k]


def nearest_prototypes(vectors: DataFrame, protos: DataFrame, id_column: str, key: str, *, column: str = "embedding", top_k: int = 4, least: float = 0.28, scale: float = 1.10, most_bytes: int = 256 << 20) -> DataFrame:
    """(id, key, cosine, score): the best prototypes of each vector but its own key's, of cosine `least` or more; smaller keys first among equals. ids are distinct.

    A batch of vectors is one matrix product with all prototypes, which are sent to the executors if they have `most_bytes` at most. More of them are split into
    shards of that size: parts of the vectors meet each shard in a task, and the best of each shard, top_k at most, are merged.
    """
    known = protos.where("prototype is not null").select(F.col(key).alias("_key"), "prototype")
    size = known.agg(F.sum(8 * F.size("prototype"))).first()[0] or 0
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(key).alias("_own"), F.col(column).cast("array<double>").alias("_v"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _key {known.schema['_key'].dataType.simpleString()}, cosine double"
    workers_see_package(vectors.sparkSession)

    def found(table: pa.Table | pa.RecordBatch, matrix: np.ndarray, keys: pa.Array, place: dict) -> Iterator[list]:
        for lo in range(0, table.num_rows, 1000):
            part = table.slice(lo, 1000)
            one = lambda c: x.combine_chunks() if isinstance(x := part.column(c), pa.ChunkedArray) else x  # noqa: E731, B023
            at, k, cosine = _best(one("_v"), one("_own"), matrix, keys, place, top_k, least)
            yield [one("_id").take(pa.array(at)), keys.take(pa.array(k)), pa.array(cosine)]

    if size <= most_bytes:
        table = known.orderBy("_key").toArrow().combine_chunks()
        keys = table.column("_key").combine_chunks() if table.num_rows else table.column("_key")
        sent = rows.sparkSession.sparkContext.broadcast((np.array(table.column("prototype").to_pylist(), np.float64), keys))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, keys = sent.value
            place = {k: n for n, k in enumerate(keys.to_pylist())}
            for b in batches:
                for columns in found(b, matrix, keys, place):
                    yield pa.RecordBatch.from_arrays(columns, ["_id", "_key", "cosine"])

        out = rows.limit(0).select("_id", F.col("_own").alias("_key"), F.lit(0.0).alias("cosine")) if not table.num_rows else rows.mapInArrow(run, schema)
    else:
        shards, zero = -(-size // most_bytes), F.lit(0).cast("long")
        parts = max(1, -(-(rows.agg(F.sum(8 * F.size("_v"))).first()[0] or 0) // most_bytes), rows.sparkSession.sparkContext.defaultParallelism)
        every = lambda n: F.explode(F.sequence(zero, F.lit(n).cast("long") - 1))
        left = rows.withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(parts))).withColumn("shard", every(shards))
        right = known.withColumn("shard", F.pmod(F.xxhash64("_key"), F.lit(shards))).withColumn("part", every(parts))

        def task(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            theirs = theirs.sort_by("_key")
            empty = pa.table({"_id": mine.column("_id").slice(0, 0), "_key": theirs.column("_key").slice(0, 0), "cosine": pa.array([], pa.float64())})
            if not mine.num_rows or not theirs.num_rows:
                return empty
            keys = theirs.column("_key").combine_chunks()
            matrix = np.array(theirs.column("prototype").to_pylist(), np.float64)
            return pa.concat_tables([empty, *(pa.table(dict(zip(empty.column_names, c))) for c in found(mine, matrix, keys, {k: n for n, k in enumerate(keys.to_pylist())}))])

        each = left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInArrow(task, schema)
        best = Window.partitionBy("_id").orderBy(F.desc("cosine"), "_key")
        out = each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top_k)
    return out.select(F.col("_id").alias(id_column), F.col("_key").alias(key), "cosine", (F.col("cosine") * scale).alias("score"))


def associations(adjacency: DataFrame, names: DataFrame, dictionary: DataFrame | None = None, *, kind: str = "ASSOCIATED", least: float = 2.0, scale: float = 0.12, reverse: float = 0.65, top_k: int = 4, fill_only: DataFrame | None = None) -> DataFrame:
    """(word, other, score) from adjacency (src, dst, weight) and names (id, word): forward, and weaker backward; top_k for each word.

    With a dictionary: edges (word, type, addr, score) of type `kind` (ASSOCIATED or TOPIC) between words of it that have different addresses, whose scores are
    summed by address. fill_only: edges (word, ...); words that have some get none here.
    """
    n = lambda c: names.select(F.col("id").alias(c), plain_word(F.col("word")).alias(f"{c}_word"))
    rows = adjacency.where(F.col("weight") >= least).join(n("src"), "src").join(n("dst"), "dst").where("src_word <> '' and dst_word <> '' and src_word <> dst_word")
    target = "other"
    if dictionary is not None:
        target = "addr"
        own = dictionary.where("kind = 'text'")
        for c in ("src", "dst"):
            rows = rows.join(own.select(F.col("word").alias(f"{c}_word"), F.col("addr").alias(f"{c}_addr")), f"{c}_word")
        rows = rows.where("src_addr <> dst_addr")
    end = "word" if dictionary is None else "addr"
    both = rows.select(F.col("src_word").alias("word"), F.col(f"dst_{end}").alias(target), (F.col("weight") * scale).alias("score")).unionByName(
        rows.select(F.col("dst_word").alias("word"), F.col(f"src_{end}").alias(target), (F.col("weight") * scale * reverse).alias("score"))
    )
    if fill_only is not None:
        both = both.join(fill_only.select("word").distinct(), "word", "left_anti")
    sums = both.where("score > 0").groupBy("word", target).agg(F.sum("score").alias("score"))
    best = sums.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), target))).where(F.col("n") <= top_k).drop("n")
    return best if dictionary is None else best.select("word", F.lit(codec.RELATION_ALIASES.get(kind, kind)).alias("type"), "addr", "score")


def select_top(edges: DataFrame, k: int = 4, *, balanced: bool = False) -> DataFrame:
    """edges (word, type, addr, score) -> the k best of each word, with weight 1 to 255 of the word's best; balanced: lanes first."""
    by_score = [F.desc("score"), F.asc("type"), F.asc("addr")]
    rows = edges.withColumn("weight", F.greatest(F.lit(1), F.least(F.lit(255), F.bround(F.col("score") / F.max("score").over(Window.partitionBy("word")) * 255).cast("int"))))
    first = F.lit(1)
    if balanced:
        lane = F.coalesce(*[F.when(F.col("type").isin(*types), F.lit(name)) for name, (types, _) in LANES.items()], F.lit("associative"))
        rows = rows.withColumn("lane", lane).withColumn("in_lane", F.row_number().over(Window.partitionBy("word", "lane").orderBy(*by_score)))
        budget = codec.lookup_map({name: n for name, (_, n) in LANES.items()})
        first = F.when(F.col("in_lane") <= budget[F.col("lane")], 0).otherwise(1)
    rows = rows.withColumn("_first", first).withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("_first", *by_score)))
    return rows.where(F.col("rank") <= k).select("word", "type", "addr", "score", "weight", "rank")


def stamp(dictionary: DataFrame, edges: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """dictionary with `related` of edges (word, type, addr, weight, rank); words without edges take those of their base (word, base), or keep theirs."""
    edge = F.struct("rank", F.col("addr").cast("int").alias("addr"), F.col("weight").cast("int").alias("weight"), "type", F.lit(0).alias("direction"))
    packed = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("r"))
    packed = packed.select("word", F.transform("r", lambda r: F.struct(r["addr"].alias("addr"), r["weight"].alias("weight"), r["type"].alias("type"), r["direction"].alias("direction"))).alias("new"))
    out = dictionary.join(packed, "word", "left")
    if bases is not None:
        base = bases.join(packed.select(F.col("word").alias("base"), F.col("new").alias("from_base")), "base").select("word", "from_base")
        out = out.join(base, "word", "left").withColumn("new", F.coalesce("new", "from_base")).drop("from_base")
    return out.withColumn("related", F.coalesce("new", "related")).select(*dictionary.columns)
