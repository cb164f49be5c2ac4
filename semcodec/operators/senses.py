"""Expansion of seeds over a network of senses: anchors, breadth-first classification, words of the classified senses.

The network comes as tables, so any lexical network can be used: senses (word, synset, sense, first), where sense numbers a word's synsets
and first tells that the word names the synset; edges (synset, neighbor, kind, n), where kind is up, down or derived and n the neighbour's place, as
network() makes them of relations by part of speech.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.constants import SENSE_RELATIONS
from ..plans import shared

UP_DEPTH, DOWN_DEPTH, BRANCHES, SENSES = 30, 6, 12, 3
FALLBACK = "AB000"


def best_synsets(words: DataFrame, senses: DataFrame) -> DataFrame:
    """(word, synset): the first sense that a word names, else its first sense."""
    rows = senses.join(_shuffled(words.select("word").distinct()), "word", "left_semi")
    return rows.groupBy("word").agg(F.min_by("synset", F.struct(~F.col("first"), "sense")).alias("synset"))


def anchors(seeds: DataFrame, senses: DataFrame) -> DataFrame:
    """(synset, addr): every sense of a seed word (word, addr, seq) has its address, that of the first seed of several."""
    return senses.join(_shuffled(seeds), "word").groupBy("synset").agg(F.min_by("addr", "seq").alias("addr"))


def _shuffled(rows: DataFrame) -> DataFrame:
    """rows for a join that shuffles: tables of synsets are many times as large in memory as their files, by which Spark would choose to gather them on the driver and broadcast them."""
    return rows.hint("merge")


def placed(edges: DataFrame) -> DataFrame:
    """edges in the partitions of their neighbours, kept on the executors' disks, so that steps over them shuffle what is looked for only; unpersist it in the end."""
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.where("synset is not null").select("synset", "neighbor", "n").repartition(partitions, "neighbor").persist(StorageLevel.DISK_ONLY)


def step(edges: DataFrame, last: DataFrame) -> DataFrame:
    """(synset, addr) of the synsets next to those of last (synset, addr): the address of the first neighbour."""
    rows = edges.join(_shuffled(last.withColumnRenamed("synset", "neighbor")), "neighbor")
    return rows.groupBy("synset").agg(F.min_by("addr", F.struct("n", "neighbor")).alias("addr"))


def nearest(known: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(synset, addr) of synsets that reach a known one over at most `depth` edges: that of the nearest, over the first neighbour of equals.

    All synsets take a step at once: in each round those next to a classified one are classified, so the rounds are at most `depth`, and
    a result doesn't depend on the order in which synsets are looked at. Edges are partitioned once; a round joins them with the synsets of the round
    before and asks which of those that it reaches are classified already. Nothing is gathered on the driver.
    """
    found = last = known.select("synset", "addr")
    own = placed(edges)
    try:
        for _ in range(depth):
            reached = shared.written(step(own, last))
            before = found.select("synset").join(_shuffled(reached.select("synset")), "synset", "left_semi").distinct()  # as many as were reached at most
            last = shared.written(reached.join(_shuffled(before), "synset", "left_anti"))
            if last.isEmpty():
                break
            found = found.union(last)
    finally:
        own.unpersist()
    return found.join(_shuffled(known.select("synset")), "synset", "left_anti")


def classify(synsets: DataFrame, known: DataFrame, edges: DataFrame, *, blocked: list[str] = (), up: int = UP_DEPTH, down: int = DOWN_DEPTH, branches: int = BRANCHES) -> DataFrame:
    """(synset, addr, how) for all of synsets (synset): anchor, up, down, derived, or the fallback address.

    Upwards first, then downwards over `branches` neighbours of a synset at most, then over one derived form; synsets that are blocked are too general to
    be classified by their neighbours. Where edges have a column branch, it tells a neighbour's place for that limit, else n does.
    """
    out = shared.written(known.select("synset", "addr", F.lit("anchor").alias("how")))
    downward = edges.where((F.col("kind") == "derived") | ((F.col("kind") == "down") & (F.col("branch" if "branch" in edges.columns else "n") < branches)))
    for how, own, depth in (("up", edges.where("kind = 'up'"), up), ("down", downward, down), ("derived", edges.where("kind = 'derived'"), 1)):
        more = nearest(out, own, depth)
        if how != "derived":
            more = more.where(~F.col("synset").isin(*blocked))
        out = shared.written(out.union(more.select("synset", "addr", F.lit(how))))
    rest = synsets.select("synset").distinct().join(_shuffled(out.select("synset")), "synset", "left_anti")
    address = codec.address_from_text(F.lit(FALLBACK))
    return out.union(rest.select("synset", address, F.lit("fallback")))


def words(classified: DataFrame, lemmas: DataFrame, seeds: DataFrame) -> DataFrame:
    """(word, addr, synset, pos, others) of lemmas (synset, word, pos): the address of a seed, else of the word's first synset by name.

    pos: the word's parts of speech in the order of its synsets; others: up to SENSES - 1 other addresses.
    """
    rows = lemmas.join(_shuffled(classified.select("synset", "addr")), "synset")
    own = rows.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("synset", "addr", "pos"))).alias("s"))  # as many as the word has senses
    first = seeds.groupBy("word").agg(F.min_by("addr", "seq").alias("seed"))
    out = own.join(_shuffled(first), "word", "left").withColumn("addr", F.coalesce("seed", F.col("s")[0]["addr"]))
    others = F.slice(F.filter(F.array_distinct(F.transform("s", lambda x: x["addr"])), lambda a: a != F.col("addr")), 1, SENSES - 1)
    return out.select("word", "addr", F.col("s")[0]["synset"].alias("synset"), F.array_distinct(F.transform("s", lambda x: x["pos"])).alias("pos"), others.alias("others"))


def entries(found: DataFrame) -> DataFrame:
    """Dictionary rows of words(), as plans.layers.merge() takes for its derived words."""
    one = F.lit(1)
    return found.select(F.lit("text").alias("kind"), "word", "addr", one.alias("polarity"), one.alias("formality"), one.alias("intensity"), F.col("synset"), F.expr("cast(array() as array<struct<addr:int,weight:int,type:string,direction:int>>)").alias("related"))


def ranked(edges: DataFrame) -> DataFrame:
    """edges (synset, neighbor, kind) numbered by neighbour, for networks without an order of their own."""
    return edges.withColumn("n", F.row_number().over(Window.partitionBy("synset", "kind").orderBy("neighbor")) - 1)


def network(relations: DataFrame, parts: DataFrame) -> DataFrame:
    """edges (synset, neighbor, kind, n, branch) of relations (synset, neighbor, relation) between synsets with parts of speech (synset, pos).

    Which relations lead up, down or to a derived form depends on the part of speech (SENSE_RELATIONS); a relation may do several of these. n: the
    neighbour's place of all of a kind, by the relations' order, then by its place in the relation, or by name where relations have no column place;
    branch: its place in the relation. Synsets without a part of speech, and other relations, have no edges.
    """
    rules = [(p, relation, kind, turn) for kind, of in SENSE_RELATIONS.items() for pos, names in of.items() for p in pos for turn, relation in enumerate(names.split())]
    rules = relations.sparkSession.createDataFrame(rules, "pos string, relation string, kind string, turn int")
    place = F.col("place") if "place" in relations.columns else F.lit(0)
    rows = relations.withColumn("_place", place).join(_shuffled(parts.select("synset", "pos")), "synset").join(F.broadcast(rules), ["pos", "relation"])
    of = Window.partitionBy("synset", "kind")
    rows = rows.withColumn("branch", F.row_number().over(Window.partitionBy("synset", "kind", "turn").orderBy("_place", "neighbor")) - 1)
    return rows.withColumn("n", F.row_number().over(of.orderBy("turn", "_place", "neighbor")) - 1).select("synset", "neighbor", "kind", "n", "branch")
