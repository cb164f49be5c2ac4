"""Connected components by alternating star contractions, on DataFrames only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, drop, materialize, prepare_workers, summed

#: Nodes that a task holds at once as it puts edges together.
FOREST_NODES = 1 << 18


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars under the least node each, as far as a task sees them; what it has goes out whenever it holds FOREST_NODES."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def stars() -> pa.RecordBatch:
        below = [x for x in root if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(below, pa.int64()), pa.array([root[x] for x in below], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
            if len(root) >= FOREST_NODES:
                yield stars()
                root.clear()
    yield stars()


def _contracted(edges: DataFrame) -> DataFrame:
    return materialize(compact(edges).mapInArrow(_forests, "u long, v long"), "edges")


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge upwards or edges downwards, not both; edges: (u, v), u > v, repeated ones count as one."""
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("up")))
    return ends.groupBy("id").agg(F.min("up").alias("least"), F.max("up").alias("most")).where("least <> most").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = summed(both, ["u"], ["v"], F.expr("v > u"), m=F.min("v"))
    return least.select("v", F.least("u", "m").alias("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = summed(down, ["u"], ["v"], m=F.min("v"))
    return least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id of edges (u, v), the least id that it is linked with, directly or not.

    Each task first puts its edges together as stars, which is all there is to do where edges are few. As long as edges of several tasks meet, each
    round hangs every node's larger neighbours under its least neighbour, then every node under
    the least of its smaller ones; the edges become stars after a number of rounds that is logarithmic in practice.
    Loops, repeated edges and both directions are allowed. A node with a third of all edges has them dealt over many tasks (common.summed).
    """
    prepare_workers(edges.sparkSession)
    now = _contracted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
    while not _only_stars(now):
        last, now = now, _contracted(_small_star(_large_star(now)))
        drop(last)
    stars = now.distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
