"""Document fingerprints: commonest addresses, domain histogram, and similarities of those."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..plans import shared
from . import kernel

TOP = 16


def exploded(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return encoded.select(id_column, F.posexplode("tokens").alias("at", "t")).select(id_column, "at", F.col("t.addr").alias("addr"))


def address_counts(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return exploded(encoded, id_column).groupBy(id_column, "addr").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def domain_counts(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return exploded(encoded, id_column).groupBy(id_column, codec.domain_code(F.col("addr")).alias("domain")).agg(F.count("*").alias("n"))


def top_addresses(encoded: DataFrame, k: int = TOP, id_column: str = "doc_id") -> DataFrame:
    """(id, rank, addr, n): the k commonest addresses of each row, the first found of equals first."""
    order = Window.partitionBy(id_column).orderBy(F.desc("n"), "first")
    return address_counts(encoded, id_column).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(id_column, "rank", "addr", "n")


COUNTS = pa.list_(pa.struct([("addr", pa.int32()), ("n", pa.int32())]))


def _counted(addresses: pa.Array) -> pa.Array:
    flat, begins = kernel.lists(addresses)
    row, addr = np.repeat(np.arange(len(addresses)), np.diff(begins)), np.asarray(flat.cast(pa.int64()))
    key, first, n = np.unique(row << 32 | addr, return_index=True, return_counts=True)
    key, n = (x[np.lexsort((first, -n, key >> 32))] for x in (key, n))
    ends = np.searchsorted(key >> 32, np.arange(len(addresses) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int32))], ["addr", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=addresses.is_null())


def counts(tokens: Column) -> Column:
    """(addr, n) of the distinct addresses of a sequence, the commonest first, the first found of equals first; in place, without a row for an address."""
    shared.workers_see_package(SparkSession.active())
    return F.arrow_udf(_counted, "array<struct<addr:int,n:int>>")(F.transform(tokens, lambda t: t["addr"]))


def top(counted: Column, k: int = TOP) -> Column:
    """The k commonest addresses of counts()."""
    found = F.transform(F.slice(counted, 1, k), lambda c: F.struct(codec.address_text(c["addr"]).alias("address"), c["n"].alias("n")))
    return F.coalesce(found, F.expr("cast(array() as array<struct<address:string,n:int>>)"))


def histogram(counted: Column) -> Column:
    """Tokens of each domain, of counts()."""
    code = lambda c: codec.domain_code(c["addr"])
    names = F.array_sort(F.array_distinct(F.transform(counted, code)))
    of = lambda d: F.aggregate(F.filter(counted, lambda c: code(c) == d), F.lit(0), lambda s, c: s + c["n"])
    return F.coalesce(F.map_from_arrays(names, F.transform(names, of)), F.expr("cast(map() as map<string,int>)"))


def fingerprint(encoded: DataFrame, k: int = TOP, id_column: str = "doc_id") -> DataFrame:
    """(id, top, histogram, total, byte_size, fingerprint_bytes), a row for each row of encoded; rows don't meet."""
    out = encoded.select(id_column, F.size("tokens").alias("total"), codec.byte_size(F.col("tokens")).alias("byte_size"), counts(F.col("tokens")).alias("_c"))
    out = out.select(id_column, top(F.col("_c"), k).alias("top"), histogram(F.col("_c")).alias("histogram"), "total", "byte_size")
    return out.withColumn("fingerprint_bytes", 5 * F.size("top") + 3 * F.size("histogram"))


def histogram_cosine(a: Column, b: Column) -> Column:
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.transform(F.map_keys(a), lambda k: (F.coalesce(a[k], F.lit(0)) * F.coalesce(b[k], F.lit(0))).cast("double")))
    norm = lambda m: F.sqrt(total(F.transform(F.map_values(m), lambda v: (v * v).cast("double"))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def top_jaccard(a: Column, b: Column) -> Column:
    """Of the addresses of two tops; both empty: 0."""
    x, y = F.transform(a, lambda t: t["address"]), F.transform(b, lambda t: t["address"])
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column, histogram_weight: float = 0.5) -> Column:
    """Of two structs with top and histogram."""
    return histogram_weight * histogram_cosine(a["histogram"], b["histogram"]) + (1 - histogram_weight) * top_jaccard(a["top"], b["top"])


#: Rows of a list that a task compares with as many others, on average.
PART = 4000


def _least_overlap(s: Column | int, t: Column, threshold: float) -> Column:
    """Addresses in common, at least, of sets of s and t addresses that are `threshold` alike; 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.lit(threshold / (1 + threshold)) * (s + t) - 1e-9).cast("int"))


def _posted(rows: DataFrame, least: Column) -> DataFrame:
    """rows (rep, ordered, size), each under the pairs (x, y) of addresses that stand in front; at: the place of y.

    Sets with `least` addresses or more in common have the first two of those among the first size - least + 2 of either. Where one address in common is enough,
    each address is posted alone as well, as (x, x).
    """
    front = F.slice("ordered", 1, F.col("size") - F.greatest(F.lit(2), least) + 2)
    two = F.flatten(F.transform(front, lambda y, n: F.transform(F.slice("ordered", 1, n), lambda x: F.struct(x.alias("x"), y.alias("y"), n.alias("at")))))
    one = F.slice(F.transform("ordered", lambda x, n: F.struct(x.alias("x"), x.alias("y"), n.alias("at"))), 1, F.when(least == 1, F.col("size")).otherwise(0))
    return rows.select("rep", "ordered", "size", F.explode(F.concat(two, one)).alias("_p")).select("rep", "ordered", "size", "_p.*")


def clone_pairs(encoded: DataFrame, threshold: float, k: int = TOP, id_column: str = "doc_id") -> DataFrame:
    """(a, b, jaccard) of distinct pairs of rows whose tops are at least `threshold` alike, over 0.

    Rows with the same top are one class first. A class is posted under pairs of the rarest addresses of its top (see _posted), once for larger classes to
    meet and once for smaller ones; so two classes meet only if they have two rare addresses in common. They meet at the first
    two that they have in common, if their sizes and what is left behind those allow the threshold. A list of many classes is dealt in parts, each of which
    meets each in a task of its own, so no list is one task.
    """
    sets = top_addresses(encoded, k, id_column).groupBy(id_column).agg(F.array_sort(F.collect_set("addr")).alias("set"))  # k addresses at most
    classes = shared.written(sets.groupBy("set").agg(F.min(id_column).alias("rep")))
    freq = classes.select(F.explode("set").alias("addr")).groupBy("addr").agg(F.count("*").alias("n"))
    ranked = classes.select("rep", "set", F.explode("set").alias("addr")).join(freq, "addr")
    order = F.transform(F.array_sort(F.collect_list(F.struct("n", "addr"))), lambda x: x["addr"])
    ranked = shared.written(ranked.groupBy("rep").agg(order.alias("ordered"))).withColumn("size", F.size("ordered"))
    size = F.col("size")
    small = _posted(ranked, _least_overlap(size, size, threshold))
    large = _posted(ranked, _least_overlap(F.greatest(F.lit(1), F.ceil(F.lit(threshold) * size - 1e-9).cast("int")), size, threshold))
    counts = small.select("x", "y").unionByName(large.select("x", "y")).groupBy("x", "y").agg(F.count("*").alias("c"))
    hot = shared.written(counts.where(F.col("c") > PART).select("x", "y", F.ceil(F.col("c") / PART).alias("parts")))  # a row for PART postings at most
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    own, every = F.pmod(F.xxhash64("rep"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    side = lambda rows, x, mine, other: rows.join(F.broadcast(hot), ["x", "y"], "left").select("x", "y", own.alias(mine), every.alias(other), *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "ordered", "size", "at")])
    both = side(small, "a", "i", "j").join(side(large, "b", "j", "i"), ["x", "y", "i", "j"])
    need, met = _least_overlap(F.col("size_a"), F.col("size_b"), threshold), F.when(F.col("x") == F.col("y"), 1).otherwise(2)
    larger = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("rep_a") < F.col("rep_b")))
    fits = larger & (met == F.least(need, F.lit(2))) & (met + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) - 1 >= need)
    # both orders are the same, so addresses in common before these would be in front of them in both
    first = F.size(F.array_intersect(F.slice("ordered_a", 1, F.col("at_a") + 1), F.slice("ordered_b", 1, F.col("at_b") + 1))) == met
    common = both.where(fits).where(first).select("rep_a", "rep_b", (F.col("size_a") + F.col("size_b")).alias("sizes"), F.size(F.array_intersect("ordered_a", "ordered_b")).alias("n"))
    return common.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), (F.col("n") / (F.col("sizes") - F.col("n"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def class_members(encoded: DataFrame, k: int = TOP, id_column: str = "doc_id") -> DataFrame:
    """(id, rep): the class of each row for clone_pairs()."""
    sets = top_addresses(encoded, k, id_column).groupBy(id_column).agg(F.array_sort(F.collect_set("addr")).alias("set"))
    return sets.join(sets.groupBy("set").agg(F.min(id_column).alias("rep")), "set").select(id_column, "rep")
