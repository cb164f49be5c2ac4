"""Pair scores and greedy alignment of two sequences, as Columns.

The alignment of one pair is sequential, so `align` is a fold over the first sequence inside one expression: the state holds which
tokens of the second are used, the sum, and the matches. Its time grows faster than the square of the length, so `aligned` and `aligned_score`, which the
operators take, align a batch of pairs together in Arrow columns by the same rules (kernel).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.constants import BASE_SCALE, OTHER_SCALE, PROFILES
from ..plans.shared import workers_see_package
from . import kernel

MATCH = "struct<score:double,matches:array<struct<i:int,j:int,score:double>>,unmatched_a:array<int>,unmatched_b:array<int>>"


@dataclass(frozen=True)
class Profile:
    antonym: float = 0.15
    coverage: bool = False
    symmetric: bool = False
    lexical: float = 0.0
    multiplier: float = 1.0
    hierarchy: float = 0.0
    scale: dict = field(default_factory=dict)

    def weight(self, kind: str) -> float:
        return self.scale.get(kind, BASE_SCALE.get(kind, OTHER_SCALE))


def profile(name: str) -> Profile:
    """A profile by name; default and unknown names give the base profile."""
    return Profile(**PROFILES.get(name, PROFILES["base"]))


def choose_profile(name: str, bridge: bool, code_aware: bool, n_a: int, n_b: int, code_share_b: float) -> str:
    """What an automatic choice takes for two sequences of these lengths."""
    if name in ("base", "default"):
        return "base"
    if name in PROFILES:
        return name
    if not bridge:
        return "base"
    if code_aware or code_share_b >= 0.20 or n_b >= max(12, 3 * n_a):
        return "code_search"
    return "topical" if n_a == n_b == 1 else "sentence"


def profile_name(a: Column, b: Column, bridge: bool = False, code_aware: bool = False) -> Column:
    """choose_profile() for columns of sequences, with no profile named."""
    if not bridge:
        return F.lit("base")
    many = F.size(b) >= F.greatest(F.lit(12), 3 * F.size(a))
    return F.when(F.lit(code_aware) | (code_share(b) >= 0.20) | many, "code_search").when((F.size(a) == 1) & (F.size(b) == 1), "topical").otherwise("sentence")


def code_share(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: codec.is_code(t["addr"]))) / F.size(tokens)).otherwise(F.lit(0.0))


def hierarchy_score(a: Column, b: Column, shade_a: Column, shade_b: Column, code_weight: bool = False) -> Column:
    """How much of two addresses agrees, from the domain down; the shades fill the rest."""
    near = codec.shade_similarity(shade_a, shade_b)
    same = codec.category_of(a) == codec.category_of(b)
    score = F.when(a == b, F.lit(0.75) + F.lit(0.25) * near).when(same, F.lit(0.40) + F.lit(0.05) * near).otherwise(F.lit(0.25) + F.lit(0.05) * near)
    if code_weight:
        score = F.when(codec.is_code(a), F.least(F.lit(1.0), F.lit(1.5) * score)).otherwise(score)
    return F.when(codec.domain_of(a) == codec.domain_of(b), score).otherwise(F.lit(0.0))


def _top(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def relation_score(a: Column, b: Column, p: Profile) -> Column:
    """The best of: an edge of one to the other, an edge near the other (profiles that allow it), a neighbour of both."""
    scale = codec.lookup_map({k: float(p.weight(k)) for k in {*BASE_SCALE, *p.scale}})
    weight = lambda r: F.coalesce(scale[r["type"]], F.lit(OTHER_SCALE))
    usable = lambda t: F.filter(t["related"], lambda r: ~codec.is_null_address(r["addr"]) & (r["type"] != "ANTONYM"))

    def direct(x: Column, y: Column) -> Column:
        def one(r: Column) -> Column:
            hit = r["weight"] / 255.0 * weight(r) * p.multiplier
            if p.hierarchy > 0:
                return F.when(r["addr"] == y["addr"], hit).otherwise(hit * p.hierarchy * hierarchy_score(r["addr"], y["addr"], x["shade"], y["shade"]))
            return F.when(r["addr"] == y["addr"], hit).otherwise(F.lit(0.0))

        return _top(F.transform(usable(x), one))

    def through(r: Column) -> Column:
        return _top(F.transform(usable(b), lambda s: F.when(r["addr"] == s["addr"], F.least(r["weight"], s["weight"]) / 255.0 * F.least(weight(r), weight(s)) * 0.65 * p.multiplier).otherwise(F.lit(0.0))))

    return F.greatest(direct(a, b), direct(b, a), _top(F.transform(usable(a), through)))


def antonym_penalty(a: Column, b: Column, p: Profile) -> Column:
    one = lambda x, y: _top(F.transform(F.filter(x["related"], lambda r: (r["type"] == "ANTONYM") & (r["addr"] == y["addr"])), lambda r: r["weight"] / 255.0 * p.antonym))
    return F.greatest(one(a, b), one(b, a))


def pair_score(a: Column, b: Column, p: Profile, code_aware: bool = False, relations: bool = True) -> Column:
    """Score of two tokens; relations=False: for sequences known to have no edges, a much smaller expression."""
    h = hierarchy_score(a["addr"], b["addr"], a["shade"], b["shade"], code_aware)
    if not relations:
        return F.greatest(F.lit(0.0), h)
    anti = antonym_penalty(a, b, p)
    return F.when(h >= 0.75, F.greatest(F.lit(0.0), h - anti)).otherwise(F.greatest(F.lit(0.0), F.greatest(h, relation_score(a, b, p)) - anti))


def _words(tokens: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.lower(t["word"])), lambda w: w != ""))


def lexical_coverage(a: Column, b: Column) -> Column:
    x, y = _words(a), _words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def lexical_dice(a: Column, b: Column) -> Column:
    x, y = _words(a), _words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.lit(2) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))


def align(a: Column, b: Column, p: Profile | str = "base", *, code_aware: bool = False, bonus: Column | None = None, relations: bool = True) -> Column:
    """MATCH of two sequences: each token of a, in order, takes the unused token of b with the best score over 0, the first of equals."""
    p = profile(p) if isinstance(p, str) else p
    n_a, n_b = F.size(a), F.size(b)
    none = F.expr("cast(array() as array<struct<i:int,j:int,score:double>>)")
    start = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.lit(0.0).alias("total"), none.alias("matches"))

    def scored(i: Column, j: Column) -> Column:
        s = pair_score(F.get(a, i), F.get(b, j), p, code_aware, relations)
        return F.when(s > 0, s + 0.05 * (1 - F.abs(i / n_a - j / n_b))).otherwise(s) if code_aware else s

    def step(state: Column, i: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), n_b - 1), lambda j: ~F.array_contains(state["used"], j))
        best = F.array_max(F.transform(free, lambda j: F.struct(scored(i, j).alias("score"), (-j).alias("j"))))
        taken = lambda x: F.struct(
            F.concat(state["used"], F.array(-x["j"])).alias("used"),
            (state["total"] + x["score"]).alias("total"),
            F.concat(state["matches"], F.array(F.struct(i.cast("int").alias("i"), (-x["j"]).alias("j"), x["score"].alias("score")))).alias("matches"),
        )
        return F.element_at(F.transform(F.array(best), lambda x: F.when(x["score"] > 0, taken(x)).otherwise(state)), 1)

    def ended(state: Column) -> Column:
        t = state["total"]
        if p.coverage:
            base = F.least(F.lit(1.0), F.lit(2) * t / (n_a + n_b)) if p.symmetric else F.least(F.lit(1.0), t / n_a)
            if p.lexical > 0:
                base = (1 - p.lexical) * base + p.lexical * (lexical_dice(a, b) if p.symmetric else lexical_coverage(a, b))
            score = F.when(n_a > 0, base).otherwise(F.lit(0.0))
        else:
            score = F.when((n_a > 0) | (n_b > 0), t / F.greatest(n_a, n_b, F.lit(1))).otherwise(F.lit(0.0))
        if bonus is not None:
            score = F.when(bonus > 0, F.least(F.lit(1.0), score + bonus)).otherwise(score)
        rest = lambda n, side: F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda k: ~F.array_contains(F.transform(state["matches"], lambda m: m[side]), k))
        return F.struct(score.alias("score"), state["matches"].alias("matches"), rest(n_a, "i").alias("unmatched_a"), rest(n_b, "j").alias("unmatched_b"))

    order = F.when((n_a > 0) & (n_b > 0), F.sequence(F.lit(0), n_a - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(order, start, step, ended)


def _profiles(names: pa.Array) -> list[Profile]:
    own = {x: profile(x) for x in names.unique().to_pylist()}
    return [own[x] for x in names.to_pylist()]


def aligned(a: Column, b: Column, p: Profile | str | Column = "base", *, code_aware: bool = False) -> Column:
    """MATCH of two sequences of any length, as align() gives it without a bonus; p: a profile, its name, or a column of names."""
    workers_see_package(SparkSession.active())
    if isinstance(p, Column):
        return F.arrow_udf(lambda x, y, names: kernel.matches(x, y, _profiles(names), code_aware), MATCH)(a, b, p)
    own = profile(p) if isinstance(p, str) else p
    return F.arrow_udf(lambda x, y: kernel.matches(x, y, [own] * len(x), code_aware), MATCH)(a, b)


def aligned_score(a: Column, b: Column, p: Profile | str | Column = "base", *, code_aware: bool = False) -> Column:
    """aligned()'s score alone."""
    workers_see_package(SparkSession.active())
    if isinstance(p, Column):
        return F.arrow_udf(lambda x, y, names: pa.array(kernel.scores(x, y, _profiles(names), code_aware)), "double")(a, b, p)
    own = profile(p) if isinstance(p, str) else p
    return F.arrow_udf(lambda x, y: pa.array(kernel.scores(x, y, [own] * len(x), code_aware)), "double")(a, b)


def compare(pairs: DataFrame, a: str = "tokens_a", b: str = "tokens_b", *, profile_name_: str = "auto", bridge: bool = False, code_aware: bool = False) -> DataFrame:
    """pairs with `result`; an automatic profile is chosen for each row."""
    x, y = F.col(a), F.col(b)
    if profile_name_ in PROFILES or profile_name_ == "default" or not bridge:
        name = profile_name_ if profile_name_ in PROFILES else "base"
        return pairs.withColumn("result", aligned(x, y, name, code_aware=code_aware))
    return pairs.withColumn("result", aligned(x, y, profile_name(x, y, True, code_aware), code_aware=code_aware))


def explain(a: Column, b: Column, result: Column) -> Column:
    """A line for the score and one for each match and each token left over."""
    name = lambda t: F.when(t["word"] != "", t["word"]).otherwise(codec.address_text(t["addr"]))
    lines = F.concat(
        F.array(F.format_string("score %.4f", result["score"])),
        F.transform(result["matches"], lambda m: F.format_string("%s ~ %s %.4f", name(F.get(a, m["i"])), name(F.get(b, m["j"])), m["score"])),
        F.transform(result["unmatched_a"], lambda i: F.concat(F.lit("only a: "), name(F.get(a, i)))),
        F.transform(result["unmatched_b"], lambda j: F.concat(F.lit("only b: "), name(F.get(b, j)))),
    )
    return F.array_join(lines, "\n")


def align_score(pairs: DataFrame, a: str, b: str, p: Profile | str = "base", *, code_aware: bool = False, out: str = "score") -> DataFrame:
    """pairs with the score of two sequences of any length."""
    return pairs.withColumn(out, aligned_score(F.col(a), F.col(b), p, code_aware=code_aware))
