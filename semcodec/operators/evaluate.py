"""Ranking, correlation and threshold measures over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import shared
from . import vectors as vector_sums


def _before(rows: DataFrame, order: list[str], weight: str, out: str, by: str | None = None) -> DataFrame:
    """rows with the sum of `weight` over all rows before them in `order`; within each value of `by`, a few numbers.

    A sample sort on all columns of the order deals the rows to as many ranges of like size as the session has shuffle partitions, so rows with one value are
    split by what follows it in the order. A range's rows are summed in order within a task, on top of the sums of the ranges before: a number for
    each range.
    """
    spark = rows.sparkSession
    own = [by] if by else []
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared.written(rows.repartitionByRange(many, *own, *order).withColumn("_range", F.spark_partition_id()))
    sums: dict = {}
    starts = []
    for r in sorted(ranged.groupBy("_range", *own).agg(F.sum(weight).alias("_sum")).collect(), key=lambda r: r["_range"]):
        group = r[by] if by else 0
        starts.append((r["_range"], group, sums.get(group, 0)))
        sums[group] = sums.get(group, 0) + r["_sum"]
    kind = ranged.schema[by].dataType.simpleString() if by else "int"
    known = F.broadcast(spark.createDataFrame(starts, f"_number int, _by {kind}, _start long"))
    placed = ranged.join(known, (F.col("_range") == F.col("_number")) & (F.col(by) if by else F.lit(0)).eqNullSafe(F.col("_by")))
    inside = F.sum(weight).over(Window.partitionBy("_range", *own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn(out, F.coalesce(inside, F.lit(0)) + F.col("_start")).drop("_range", "_number", "_by", "_start")


def _average_rank(rows: DataFrame, column: str, out: str, by: str | None = None) -> DataFrame:
    """rows with the mean rank of each value (within each value of `by`): counts by value first, so that only distinct values are put in order."""
    keys = [column, *([by] if by else [])]
    counts = _before(rows.groupBy(*keys).agg(F.count("*").alias("_n")), [column], "_n", "_before", by)
    ranks = counts.select(*[F.col(c).alias(f"_v{k}") for k, c in enumerate(keys)], (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    same = F.lit(True)
    for k, c in enumerate(keys):
        same = same & rows[c].eqNullSafe(ranks[f"_v{k}"])
    return rows.join(ranks, same).drop(*[f"_v{k}" for k in range(len(keys))])


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho) over rows where both are known; ties take their mean rank."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = _average_rank(_average_rank(known, a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def mean_reciprocal_rank(scores: DataFrame, query: str = "q", candidate: str = "j", score: str = "score", gold: str = "gold") -> DataFrame:
    """(queries, mrr): the rank of each query's gold candidate; of equal scores the higher candidate is ahead.

    A gold candidate's rank is a count of what is ahead of it, so no query's candidates are sorted.
    """
    best = scores.where(F.col(candidate) == F.col(gold)).select(F.col(query).alias("_q"), F.col(score).alias("_s"), F.col(candidate).alias("_j")).distinct()
    ahead = (F.col(score) > F.col("_s")) | ((F.col(score) == F.col("_s")) & (F.col(candidate) > F.col("_j")))
    ranks = scores.join(best, F.col(query) == F.col("_q"), "left").groupBy(query).agg((F.count_if(ahead) + 1).alias("rank"), F.max("_s").isNotNull().alias("found"))
    return ranks.agg(F.count("*").alias("queries"), F.avg(F.when(F.col("found"), 1.0 / F.col("rank")).otherwise(F.lit(0.0))).alias("mrr"))


def f1_sweep(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, tp, fp, fn, f1) for the thresholds .05 to .95: one pass over the rows, with sums by the step a score reaches."""
    step = F.least(F.lit(19), F.floor(F.round(F.col(score) * 20, 9))).cast("int")
    sums = rows.groupBy(step.alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    steps = sums.sparkSession.range(1, 20).select(F.col("id").cast("int").alias("t"))
    total = steps.join(sums, how="cross").groupBy("t").agg(  # 19 by 20 rows
        F.sum(F.when(F.col("s") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s") >= F.col("t"), F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.coalesce("s", F.lit(-1)) < F.col("t"), F.col("pos")).otherwise(0)).alias("fn")
    )
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0))
    return total.select((F.col("t") / 20).alias("threshold"), "tp", "fp", "fn", f1.alias("f1"))


def best_f1(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, f1): the best of the sweep, the lowest threshold of equals."""
    return f1_sweep(rows, score, label).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", (-F.col("threshold")).alias("x"))).alias("b")).select("b.threshold", "b.f1")


def separation(rows: DataFrame, within: Column, score: str = "score") -> DataFrame:
    """(within, across, separation): mean scores of the two kinds of rows."""
    out = rows.agg(F.avg(F.when(within, F.col(score))).alias("within"), F.avg(F.when(~within, F.col(score))).alias("across"))
    return out.withColumn("separation", F.col("within") - F.col("across"))


def pass_rate(rows: DataFrame, passed: Column, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(passed.cast("int")).alias("rate"))


def min_max(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with a column scaled to 0..1; all equal: 0."""
    bounds = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return rows.join(F.broadcast(bounds), how="cross").withColumn(out, F.when(span > 0, (F.col(column) - F.col("_lo")) / span).otherwise(F.lit(0.0))).drop("_lo", "_hi")  # one row


def histogram(rows: DataFrame, column: str, *, bins: int | None = None, low: float = 0.0, high: float = 1.0, digits: int = 2) -> DataFrame:
    """(level, n): by rounded value, or by `bins` equal widths of low..high (values outside fall into the end bins)."""
    level = F.round(column, digits)
    if bins:
        level = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / (high - low) * bins)))
    return rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def quartiles(rows: DataFrame, gold: str, tie: str, a: str) -> DataFrame:
    """(quartile, n, rho): correlation within quarters of the rows by gold; quarter q holds ranks q*n//4 up to (q+1)*n//4."""
    n = rows.count()
    placed = _before(rows.withColumn("_one", F.lit(1)), [gold, tie], "_one", "_at")
    q = F.coalesce(*[F.when(F.col("_at") < (k + 1) * n // 4, F.lit(k)) for k in range(4)])
    own = placed.select(q.alias("quartile"), gold, a).where(F.col(gold).isNotNull() & F.col(a).isNotNull())
    ranked = _average_rank(_average_rank(own, a, "_ra", "quartile"), gold, "_rg", "quartile")
    return ranked.groupBy("quartile").agg(F.count("*").alias("n"), F.corr("_ra", "_rg").alias("rho"))


def extremes(rows: DataFrame, wrong: Column, order: Column, tie: str, n: int = 8) -> DataFrame:
    """The n most telling of the rows that are wrong, for a report."""
    return rows.where(wrong).orderBy(order, tie).limit(n)


def verdict(a: Column, b: Column, margin: float = 0.01) -> Column:
    return F.when(a - b > margin, "WIN").when(b - a > margin, "LOSE").otherwise("TIE")


def category_means(rows: DataFrame, category: str, score: str = "score") -> DataFrame:
    """(category, n, mean)."""
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))


def totals(results: DataFrame, own: str, baseline: str) -> DataFrame:
    """(benchmarks, wins, ties, losses, own, baseline, difference) over rows of one benchmark each."""
    v = verdict(F.col(own), F.col(baseline))
    n = lambda name: F.count_if(v == name)
    return results.agg(F.count("*").alias("benchmarks"), n("WIN").alias("wins"), n("TIE").alias("ties"), n("LOSE").alias("losses"), F.avg(own).alias("own"), F.avg(baseline).alias("baseline"), (F.avg(own) - F.avg(baseline)).alias("difference"))


def mean_vectors(tokens: DataFrame, vectors: DataFrame, id_column: str = "doc_id", word: str = "word", column: str = "embedding") -> DataFrame:
    """(id, vector): the mean of the vectors of a row's words; rows without a known word are left out."""
    rows = tokens.select(id_column, word).join(vectors.select(word, column), word)
    return vector_sums.means(rows, id_column, column).withColumnRenamed("mean", "vector")


def storage_estimate(bytes_per_token: Column, tokens: int = 12, documents: int = 1_000_000) -> Column:
    return bytes_per_token * tokens * documents
