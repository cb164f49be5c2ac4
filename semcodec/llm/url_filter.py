"""URL filters: prefix rules first, then gradient-boosted trees on lexical features; DataFrame functions only.

Hosts and paths are cut from the url by expressions. A rule names a host (and its subdomains) and the beginning of a path; the longest
rule that fits gives the verdict. Urls that no rule fits get the trees' verdict. The trees are trained on labelled urls, by default those that the
rules judge (a bounded number of them): features are put into fixed classes, the rows with the same classes are summed, and the trees grow
on the driver from those sums (at most as many as urls). Scoring is one expression, compiled with the scan, without a shuffle.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: (host, path, verdict): fixed rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: Lexical features and the upper ends of their classes.
FEATURES: dict[str, list[float]] = {
    "length": [20, 30, 35, 40, 45, 50, 60, 80, 120],
    "host_length": [8, 12, 16, 20, 24, 28, 34, 44],
    "depth": [0, 1, 2, 3, 4, 6],
    "labels": [1, 2, 3, 4, 5],
    "digit_ratio": [0, 0.03, 0.06, 0.09, 0.12, 0.2, 0.35],
    "entropy": [2.5, 3.0, 3.25, 3.5, 3.75, 4.0, 4.25, 4.5],
    "parameters": [0, 1, 2, 3, 5],
    "hyphens": [0, 1, 2, 4],
    "suffix_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
}


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without ://, empty."""
    return _lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones the first."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda r: ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
    pick = lambda k: F.coalesce(*[F.when(fits(r), F.lit(k(r))) for r in ordered], F.lit(None).cast("string"))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _features(url: Column, host: Column, path: Column, rate: Column) -> dict[str, Column]:
    length = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    # entropy of the host's characters, from how often each stands there
    n = F.greatest(F.length(host), F.lit(1))
    share = lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / n
    entropy = F.aggregate(F.transform(F.array_distinct(F.filter(F.split(host, ""), lambda c: c != "")), share), F.lit(0.0), lambda a, x: a - x * F.log2(x))
    return {
        "length": length.cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "labels": F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))).cast("double"),
        "digit_ratio": (length - F.length(F.translate(url, "0123456789", ""))) / F.greatest(length, F.lit(1)),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "hyphens": (length - F.length(F.translate(url, "-", ""))).cast("double"),
        "suffix_rate": rate,
    }


def _class_of(value: Column, ends: list[float]) -> Column:
    return F.coalesce(*[F.when(value <= e, F.lit(k)) for k, e in enumerate(ends)], F.lit(len(ends)))


@dataclass
class UrlModel:
    """trees: for each a list of (feature, class) splits by level, and the value of each leaf; suffixes: block rates of host suffixes.

    There are at most as many suffixes as labelled urls that the model is trained from, so their table is broadcast.
    """

    prior: float
    suffixes: dict[str, float] = field(default_factory=dict)
    suffix_default: float = 0.5
    trees: list[tuple[list[tuple[str, int]], list[float]]] = field(default_factory=list)

    def classes(self, rows: DataFrame) -> DataFrame:
        """rows (url, host, path, ...) with a column for each feature's class; in two steps, so that no feature is worked out twice."""
        taken = unused("suffix", rows.columns)
        table = json.dumps([{"s": k, "r": v} for k, v in sorted(self.suffixes.items())])
        known = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(table), "array<struct<s:string,r:double>>")).alias("x")).select(F.col("x.s").alias(taken), F.col("x.r").alias(f"{taken}_known"))
        rows = rows.join(F.broadcast(known), suffix_of(F.col("host")) == F.col(taken), "left").withColumn(f"{taken}_known", F.coalesce(f"{taken}_known", F.lit(self.suffix_default)))
        return self._classes(rows, F.col(f"{taken}_known")).drop(taken, f"{taken}_known")

    @staticmethod
    def _classes(rows: DataFrame, rate: Column) -> DataFrame:
        found = _features(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"), rate)
        return rows.withColumns(found).withColumns({k: _class_of(F.col(k), FEATURES[k]) for k in found})


def _leaf(splits: list[tuple[str, int]]) -> Column:
    """The leaf that a row of classes falls into: a bit for each level."""
    return reduce(lambda a, b: a + b, [F.when(F.col(f) > k, 1 << level).otherwise(0) for level, (f, k) in enumerate(splits)], F.lit(0))


def with_margin(rows: DataFrame, model: UrlModel) -> DataFrame:
    """rows with one column for each feature's class, plus margin."""
    total = F.lit(model.prior)
    for splits, values in model.trees:
        leaf = F.array(*[F.lit(v) for v in values])
        total = total + F.element_at(leaf, _leaf(splits) + 1)
    return rows.withColumn("margin", total)


def boost(rows: list[tuple], n: list[int], blocked: list[int], prior: float, rounds: int, depth: int, rate: float, ridge: float) -> list:
    """Symmetric trees on rows of feature classes that stand for n urls, `blocked` of them blocked; logistic loss, second order."""
    names, margin, trees = list(FEATURES), [prior] * len(rows), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [b - k * q for b, k, q in zip(blocked, n, p)]
        h = [k * q * (1 - q) for k, q in zip(n, p)]
        node, splits = [0] * len(rows), []
        for level in range(depth):
            sums: dict[tuple, list[float]] = {}
            for row, at, a, b in zip(rows, node, g, h):
                for f, k in enumerate(row):
                    cell = sums.setdefault((f, at, k), [0.0, 0.0])
                    cell[0] += a
                    cell[1] += b
            best, chosen = 1e-6, None
            for f, name in enumerate(names):
                for k in range(len(FEATURES[name])):
                    gain = 0.0
                    for at in range(1 << level):
                        sides = [[0.0, 0.0], [0.0, 0.0]]
                        for c in range(len(FEATURES[name]) + 1):
                            a, b = sums.get((f, at, c), (0.0, 0.0))
                            sides[c > k][0] += a
                            sides[c > k][1] += b
                        (ga, ha), (gb, hb) = sides
                        gain += ga * ga / (ha + ridge) + gb * gb / (hb + ridge) - (ga + gb) ** 2 / (ha + hb + ridge)
                    if gain > best:
                        best, chosen = gain, (f, k)
            if chosen is None:
                break
            splits.append(chosen)
            node = [at + ((row[chosen[0]] > chosen[1]) << level) for row, at in zip(rows, node)]
        if not splits:
            break
        ga, ha = [0.0] * (1 << len(splits)), [0.0] * (1 << len(splits))
        for at, a, b in zip(node, g, h):
            ga[at] += a
            ha[at] += b
        values = [round(rate * a / (b + ridge), 9) for a, b in zip(ga, ha)]
        margin = [m + values[at] for m, at in zip(margin, node)]
        trees.append(([(names[f], k) for f, k in splits], values))
    return trees


#: Parts of the labelled urls: in training, a url's suffix has the block rate of the other parts, so that no url tells its own label.
FOLDS = 4


def train(urls: DataFrame, *, limit: int = 50_000, rounds: int = 8, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> UrlModel:
    """Boosted symmetric trees from labelled urls (url, host, path, blocked 0 or 1), at most `limit` different ones by a hash of the url.

    Without urls the model is a constant.
    """
    some = urls.groupBy("url", "host", "path").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")).orderBy(F.xxhash64("url"), "url").limit(limit)
    some = some.select("*", suffix_of(F.col("host")).alias("suffix"), F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).alias("fold")).persist()
    try:
        n, blocked = some.agg(F.sum("n"), F.sum("blocked")).first()
        if not n:
            return UrlModel(0.0)
        share = min(max(blocked / n, 0.01), 0.99)
        smoothed = lambda b, k: (b + 4 * share) / (k + 4)
        whole = some.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_b"))
        part = some.groupBy("suffix", "fold").agg(F.sum("n").alias("own_n"), F.sum("blocked").alias("own_b"))
        rows = some.join(whole, "suffix").join(part, ["suffix", "fold"]).withColumn("others", smoothed(F.col("all_b") - F.col("own_b"), F.col("all_n") - F.col("own_n")))
        table = UrlModel._classes(rows, F.col("others")).groupBy(*FEATURES).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        rows = sorted(tuple(r) for r in table.collect())  # at most `limit` rows of small numbers
        model = UrlModel(math.log(share / (1 - share)), {r["suffix"]: round(smoothed(r["all_b"], r["all_n"]), 6) for r in whole.collect()}, share)  # likewise
        model.trees = boost([r[: len(FEATURES)] for r in rows], [r[-2] for r in rows], [r[-1] for r in rows], model.prior, rounds, depth, rate, ridge)
        return model
    finally:
        some.unpersist()


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(url, host, path, blocked) of the urls that a rule judges: urls labelled with no other source at hand."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("url", host.alias("host"), path.alias("path")).where("url is not null")
    return rows.withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)[1]).where("verdict is not null").select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("blocked"))


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, score.

    score is the trees' probability of block. A null url, or one without ://, has an empty host and path and the trees' verdict. Repeated rows give
    repeated rows; a null page_id stays null; other columns are ignored; an empty table gives an empty table.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = with_margin(model.classes(rows), model)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), (1 / (1 + F.exp(-F.col("margin")))).alias("score"))
