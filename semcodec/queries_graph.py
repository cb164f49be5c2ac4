"""Registered queries over tokens with edges on both sides, binary forms that keep edges, and classes of senses found downwards, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .functions.constants import NULL_ADDRESS, PROFILES, RELATIONS, SENSE_RELATIONS
from .operators import align, senses
from .queries import _dealt, _query, _quoted, _table
from .queries_more import _SCALE_SQL

_Q = 3 << 16


def _edge(addr: Column, weight: Column, kind: Column) -> Column:
    return F.struct(addr.cast("int").alias("addr"), weight.cast("int").alias("weight"), kind.alias("type"), F.lit(0).alias("direction"))


def _sequence(word: str, addr: Column, *edges: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("pos"), F.lit(word).alias("word"), addr.cast("int").alias("addr"), F.lit(85).alias("shade"), F.lit(1).alias("role"), F.lit(0).alias("features"), F.array(*edges).alias("related"))).cast(f"array<{codec.TOKEN}>")


def _kind(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RELATIONS)), (n % len(RELATIONS) + 1).cast("int"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pairs of one-token sequences of different domains: both have an edge to one address, in two parts of three, and one to an address of its own."""
    k = F.col("p_partkey")
    other = F.when(k % 3 == 0, _Q + 5).otherwise(_Q + 2)
    a = _sequence("one", F.lit(5 << 16), _edge(F.lit(_Q + 2), k * 37 % 256, _kind(k)), _edge(F.lit(7 << 16), F.lit(255), F.lit("SYNONYM")))
    b = _sequence("two", F.lit(6 << 16), _edge(other, k * 53 % 256, _kind(F.floor(k / 5))), _edge(F.lit(8 << 16), F.lit(255), F.lit("SYNONYM")))
    return _dealt(_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("k"), a.alias("a"), b.alias("b"))


_KINDS = f"[{_quoted(RELATIONS)}]"


@_query(f"""WITH {_SCALE_SQL}, x AS (SELECT p_partkey AS k, {_KINDS}[p_partkey % {len(RELATIONS)} + 1] AS ta, {_KINDS}[(p_partkey // 5) % {len(RELATIONS)} + 1] AS tb, p_partkey * 37 % 256 AS wa, p_partkey * 53 % 256 AS wb FROM part),
    t AS (SELECT k, a.profile, a.lexical, CASE WHEN ta = 'ANTONYM' OR tb = 'ANTONYM' OR k % 3 = 0 THEN 0::DOUBLE ELSE least(wa, wb) / 255::DOUBLE * least(a.scale, b.scale) * 0.65::DOUBLE * a.multiplier END AS t FROM x JOIN s a ON a.type = ta JOIN s b ON b.type = tb AND b.profile = a.profile)
    SELECT k, profile, round(CASE WHEN lexical > 0 THEN (1 - lexical) * least(1, t) ELSE t END, 6) AS score FROM t""")
def common_neighbours(spark, sf_dir):
    """Two tokens that only an address to which both have an edge brings together, under every profile."""
    rows = _linked(spark, sf_dir).withColumn("profile", F.explode(F.array(*map(F.lit, PROFILES))))
    return rows.select("k", "profile", F.round(align.aligned_score(F.col("a"), F.col("b"), F.col("profile")), 6).alias("score"))


_blank = f"{NULL_ADDRESS:06X}00"


@_query(f"""WITH x AS (SELECT p_partkey AS k, p_partkey * 37 % 256 AS w FROM part) SELECT k, '53530204' || '0001' || '0000' || '{5 << 16:06X}' || '55' || '{_Q + 2:06X}' || upper(format('{{:02x}}', w)) || '{7 << 16:06X}FF' || '{_blank * 2}' AS v2, true AS same FROM x""")
def binary_relations(spark, sf_dir):
    """The binary form that keeps addresses and weights of edges, and what is read back from it."""
    form = codec.to_binary(F.col("a"), 2)
    edges = lambda t: F.to_json(F.transform(t[0]["related"], lambda r: F.struct(r["addr"], r["weight"])))
    return _linked(spark, sf_dir).select("k", F.hex(form).alias("v2"), (edges(codec.from_binary(form)["tokens"]) == edges(F.col("a"))).alias("same"))


def _steps(edges: str, first: str, depth: int, name: str) -> str:
    """Tables of the synsets classified in each step, from those of `first`, and all of them."""
    found, out = [first], []
    for k in range(1, depth + 1):
        known = " UNION ALL ".join(f"SELECT synset, addr FROM {t}" for t in found)
        out.append(f"{name}{k} AS (SELECT e.synset, arg_min(l.addr, {{'n': e.n, 'x': e.neighbor}}) AS addr FROM {edges} e JOIN {found[-1]} l ON l.synset = e.neighbor WHERE e.synset NOT IN (SELECT synset FROM ({known})) GROUP BY 1)")
        found.append(f"{name}{k}")
    return ", ".join(out)


def _all(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT synset, addr FROM {n}" for n in names)


_DOWN = [f"w{k}" for k in range(1, senses.DOWN_DEPTH + 1)]


@_query(f"""WITH c AS (SELECT c_custkey AS k FROM customer), e AS (SELECT k // 20 AS synset, k AS neighbor, 'down' AS kind FROM c WHERE k >= 20 UNION ALL SELECT k, k + 1, 'derived' FROM c WHERE k % 4 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY synset, kind ORDER BY neighbor) - 1 AS n FROM e), a0 AS (SELECT k AS synset, k % 200 AS addr FROM c WHERE k % 17 = 0),
    x AS (SELECT * FROM r WHERE kind = 'derived' OR n < {senses.BRANCHES}), v AS (SELECT * FROM r WHERE kind = 'derived'), {_steps("x", "a0", senses.DOWN_DEPTH, "w")}, b0 AS ({_all(["a0", *_DOWN])}), {_steps("v", "b0", 1, "z")},
    f AS (SELECT synset, addr, 'anchor' AS how FROM a0 UNION ALL SELECT synset, addr, 'down' FROM ({_all(_DOWN)}) UNION ALL SELECT synset, addr, 'derived' FROM z1)
    SELECT how, count(*) AS n, sum(synset)::BIGINT AS synsets, sum(addr)::BIGINT AS addresses FROM f GROUP BY 1""")
def senses_downwards(spark, sf_dir):
    """Senses classified by their narrower ones, up to a number of branches, and by one derived form."""
    k = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    down = k.where("k >= 20").select(name(F.floor(F.col("k") / 20)).alias("synset"), name(F.col("k")).alias("neighbor"), F.lit("down").alias("kind"))
    derived = k.where("k % 4 = 1").select(name(F.col("k")).alias("synset"), name(F.col("k") + 1).alias("neighbor"), F.lit("derived").alias("kind"))
    known = k.where("k % 17 = 0").select(name(F.col("k")).alias("synset"), (F.col("k") % 200).cast("int").alias("addr"))
    found = senses.classify(k.select(name(F.col("k")).alias("synset")), known, senses.ranked(down.union(derived))).where("how <> 'fallback'")
    return found.groupBy("how").agg(F.count("*").alias("n"), F.sum(F.col("synset").cast("long")).alias("synsets"), F.sum(F.col("addr").cast("long")).alias("addresses"))


#: relation: neighbours of a customer k that stands for a synset, as expressions that Spark and SQL share but for the whole division.
_NEIGHBOURS = {"hypernym": ["k DIV 3", "k DIV 5"], "instance_hypernym": ["k DIV 7"], "verb_group": ["k + 1"], "similar": ["k + 2", "k - 2"], "antonym": ["k DIV 2"], "pertainym": ["k + 5", "k + 1"],
               "derived": ["k DIV 4", "k + 9"], "hyponym": ["3 * k + 2", "3 * k", "3 * k + 1"], "instance_hyponym": ["5 * k"], "also": ["k + 11", "k - 13", "k + 3"], "entails": ["k - 1"]}
_SPEECH, _WIDTH, _UP, _DEEP = "nvasr", 2, 2, 1
_RULES = ", ".join(f"('{p}', '{name}', '{kind}', {turn})" for kind, of in SENSE_RELATIONS.items() for pos, names in of.items() for p in pos for turn, name in enumerate(names.split()))
_RELATED = " UNION ALL ".join(f"SELECT k AS synset, {e.replace('DIV', '//')} AS neighbor, '{name}' AS relation FROM p" for name, es in _NEIGHBOURS.items() for e in es)
_UPWARDS, _DOWNWARDS = ([f"{name}{k}" for k in range(1, depth + 1)] for name, depth in (("up", _UP), ("dn", _DEEP)))


@_query(f"""WITH p AS (SELECT c_custkey AS k, '{_SPEECH}'[c_nationkey % 5 + 1] AS pos FROM customer), rel AS ({_RELATED}), rules(pos, relation, kind, turn) AS (VALUES {_RULES}),
    r AS (SELECT synset, neighbor, kind, row_number() OVER (PARTITION BY synset, kind ORDER BY turn, neighbor) - 1 AS n, row_number() OVER (PARTITION BY synset, kind, turn ORDER BY neighbor) - 1 AS branch FROM rel JOIN p ON p.k = synset JOIN rules ON rules.pos = p.pos AND rules.relation = rel.relation),
    u AS (SELECT * FROM r WHERE kind = 'up'), x AS (SELECT * FROM r WHERE kind = 'derived' OR (kind = 'down' AND branch < {_WIDTH})), v AS (SELECT * FROM r WHERE kind = 'derived'),
    a0 AS (SELECT k AS synset, k % 200 AS addr FROM p WHERE k % 597 = 5), {_steps("u", "a0", _UP, "up")}, b0 AS ({_all(["a0", *_UPWARDS])}), {_steps("x", "b0", _DEEP, "dn")}, c0 AS ({_all(["b0", *_DOWNWARDS])}), {_steps("v", "c0", 1, "dv")},
    f AS (SELECT synset, addr, 'anchor' AS how FROM a0 UNION ALL SELECT synset, addr, 'up' FROM ({_all(_UPWARDS)}) UNION ALL SELECT synset, addr, 'down' FROM ({_all(_DOWNWARDS)}) UNION ALL SELECT synset, addr, 'derived' FROM dv1)
    SELECT p.k, pos, coalesce(addr, 4 * 65536) AS addr, coalesce(how, 'fallback') AS how FROM p LEFT JOIN f ON f.synset = p.k""")
def sense_relations(spark, sf_dir):
    """Senses classified over relations that depend on the part of speech: similar, also, antonym, pertainym, verb group, instances, derived."""
    p = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.substring(F.lit(_SPEECH), F.col("c_nationkey").cast("int") % 5 + 1, F.lit(1)).alias("pos"))
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    related = F.array(*[F.struct(F.expr(e).cast("long").alias("to"), F.lit(relation).alias("relation")) for relation, es in _NEIGHBOURS.items() for e in es])
    relations = p.select("k", F.explode(related).alias("e")).where("e.to >= 0").select(name(F.col("k")).alias("synset"), name(F.col("e.to")).alias("neighbor"), "e.relation")
    synsets = p.select(name(F.col("k")).alias("synset"), "pos")
    known = p.where("k % 597 = 5").select(name(F.col("k")).alias("synset"), (F.col("k") % 200).cast("int").alias("addr"))
    found = senses.classify(synsets, known, senses.network(relations, synsets), up=_UP, down=_DEEP, branches=_WIDTH)
    return found.join(synsets.hint("merge"), "synset").select(F.col("synset").cast("long").alias("k"), "pos", "addr", "how")
