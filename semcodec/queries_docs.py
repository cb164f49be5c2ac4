"""Registered queries over whole documents, encoded with a dictionary of their own long words, and the same in SQL.

The words of LONG letters or more are the dictionary; a word's address is read off the first three digits of its md5, so sequences have hundreds of
addresses, many of them in common, and 15 tokens on average.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, text
from .functions.constants import DOMAINS, STOP_WORDS
from .operators import align, encode, fingerprint, lexicon, search
from .plans import shared
from .queries import ORACLE_SQL, QUERIES, _query, _quoted, _table

LONG = 10


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("word"))
    return words.where(F.length("word") >= LONG).distinct()


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = lambda k: F.conv(F.substring(F.md5("word"), k, 1), 16, 10)
    one = F.lit(1)
    return _words(spark, sf_dir).select(
        F.lit("text").alias("kind"), "word", codec.pack(digit(1), digit(2), digit(3)).alias("addr"), one.alias("polarity"), one.alias("formality"), one.alias("intensity"), F.lit("").alias("synset"), F.expr(f"cast(array() as {lexicon.RELATED})").alias("related")
    )


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), _dictionary(spark, sf_dir), context=False)


_WORDS = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{text.PLAIN_WORD.replace(chr(39), chr(39) * 2)}'), lambda x: lower(x)), lambda x: x NOT IN ({_quoted(STOP_WORDS)}))"
_digit = lambda k: f"(strpos('0123456789abcdef', md5(x)[{k}]) - 1)"
_ADDR = f"(65536 * {_digit(1)} + 256 * {_digit(2)} + {_digit(3)})"
_SHADE = "(64 + 16 * least(3, length(x) // 4) + 5)"
_SQL = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT doc_id, list_transform(list_filter(w, lambda x: length(x) >= {LONG}), lambda x: {{'addr': {_ADDR}, 'shade': {_SHADE}}}) AS s FROM d)"""
_NEAR = "(1 - abs(a[i + 1].shade - b[j].shade) / 255::DOUBLE)"
_PAIR = f"""CASE WHEN a[i + 1].addr = b[j].addr THEN 0.75::DOUBLE + 0.25::DOUBLE * {_NEAR} WHEN a[i + 1].addr // 256 = b[j].addr // 256 THEN 0.40::DOUBLE + 0.05::DOUBLE * {_NEAR}
        WHEN a[i + 1].addr // 65536 = b[j].addr // 65536 THEN 0.25::DOUBLE + 0.05::DOUBLE * {_NEAR} ELSE 0::DOUBLE END"""
#: Of pairs p (x, y, a, b): step by step, the best place of b that is left for each token of a.
_GREEDY = f"""g(x, y, a, b, i, used, total) AS (SELECT x, y, a, b, 0::BIGINT, []::BIGINT[], 0::DOUBLE FROM p UNION ALL
        SELECT x, y, a, b, i + 1, CASE WHEN m.score > 0 THEN list_append(used, -m.j) ELSE used END, CASE WHEN m.score > 0 THEN total + m.score ELSE total END
        FROM (SELECT *, list_max(list_transform(list_filter(range(1, len(b) + 1), lambda j: NOT list_contains(used, j)), lambda j: {{'score': {_PAIR}, 'j': -j}})) AS m FROM g WHERE i < len(a)))"""


@_query(f"WITH {_SQL} SELECT doc_id, len(s) AS n_tokens, coalesce(list_sum(list_transform(s, lambda t: t.addr)), 0)::BIGINT AS addr_sum, coalesce(list_sum(list_transform(s, lambda t: t.shade)), 0)::BIGINT AS shade_sum, len(w) - len(s) AS n_unknown FROM d JOIN e USING (doc_id)")
def encode_documents(spark, sf_dir):
    total = lambda c: F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + t[c])
    return _encoded(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), total("addr").alias("addr_sum"), total("shade").alias("shade_sum"), F.size("unknowns").cast("long").alias("n_unknown"))


@_query(f"""WITH RECURSIVE {_SQL}, p AS (SELECT u.doc_id AS x, v.doc_id AS y, u.s AS a, v.s AS b FROM e u JOIN e v ON v.doc_id = u.doc_id + 1 WHERE len(u.s) BETWEEN 12 AND 150 AND len(v.s) BETWEEN 12 AND 150), {_GREEDY}
    SELECT x AS doc_id, len(used) AS n_matches, list_sum(list_transform(range(1, len(used) + 1), lambda k: k * used[k]))::BIGINT AS places, round(total / greatest(len(a), len(b)), 6) AS score FROM g WHERE i = len(a) AND len(used) > 0""")
def align_documents(spark, sf_dir):
    """Documents of 12 to 150 tokens and those behind them: the matches, in order, and the score."""
    rows = shared.written(_encoded(spark, sf_dir).where(F.size("tokens").between(12, 150)).select("doc_id", "tokens"))
    pairs = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("tokens").alias("b")), "doc_id")
    found = align.compare(pairs, "tokens", "b", profile_name_="base")
    places = F.aggregate(F.transform("result.matches", lambda m, k: (k + 1).cast("long") * (m["j"] + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.where(F.size("result.matches") > 0).select("doc_id", F.size("result.matches").cast("long").alias("n_matches"), places.alias("places"), F.round("result.score", 6).alias("score"))


@_query(f"""WITH RECURSIVE {_SQL}, p AS (SELECT u.doc_id AS x, v.doc_id AS y, u.s AS a, v.s AS b FROM e u JOIN e v ON list_has_any(list_transform(u.s, lambda t: t.addr // 65536), list_transform(v.s, lambda t: t.addr // 65536)) WHERE u.doc_id % 50 = 0), {_GREEDY},
    r AS (SELECT x, y, total / greatest(len(a), len(b)) AS score FROM g WHERE i = len(a)), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS rank FROM r)
    SELECT x AS query_id, rank::INTEGER AS rank, y AS seq, round(score, 6) AS score FROM k WHERE rank <= 5""")
def search_documents(spark, sf_dir):
    """The documents most like each one whose id is divisible by 50."""
    rows = shared.written(_encoded(spark, sf_dir).select("doc_id", "tokens"))
    asked = rows.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    return search.search_many(search.build(rows, "doc_id"), asked, top_k=5, relations=False).withColumn("score", F.round("score", 6))


_CLONES = """WITH {0}, t AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(list_transform(s, lambda t: t.addr)) AS addr FROM e), c AS (SELECT doc_id, addr, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c), f AS (SELECT doc_id, list_sort(list(addr)) AS s FROM k WHERE rank <= 16 GROUP BY 1), h AS (SELECT s, min(doc_id) AS rep FROM f GROUP BY 1)
    SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)), 6) AS jaccard FROM h x JOIN h y ON x.rep < y.rep WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)) >= {1}"""


def _clones(threshold: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fingerprint.clone_pairs(_encoded(spark, sf_dir), threshold).withColumn("jaccard", F.round("jaccard", 6))

    return query


for _name, _threshold in (("clone_documents", 0.3), ("close_clone_documents", 0.8)):
    QUERIES[_name], ORACLE_SQL[_name] = _clones(_threshold), _CLONES.format(_SQL, _threshold)

_CODES = "CASE domain " + " ".join(f"WHEN {number} THEN '{code}'" for code, (number, _) in DOMAINS.items() if number < 16) + " ELSE '??' END"
_OWN = f"l AS (SELECT DISTINCT x AS word, {_ADDR} AS addr FROM (SELECT unnest({_WORDS}) AS x FROM documents) WHERE length(x) >= {LONG})"


@_query(f"""WITH {_OWN}, n AS (SELECT addr // 65536 AS domain, addr FROM l) SELECT 'text' AS kind, {_CODES} AS domain, count(*) AS entries, count(DISTINCT (addr // 256) % 256) AS categories, count(DISTINCT addr) AS concepts, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM n GROUP BY {_CODES}""")
def corpus_statistics(spark, sf_dir):
    """Entries, categories and concepts of each domain of the documents' own dictionary."""
    return lexicon.statistics(_dictionary(spark, sf_dir)).withColumn("share", F.round("share", 6))


_PLURAL = "CASE WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' WHEN regexp_matches(w, '[^aeiou]y$') THEN w[:-2] || 'ies' WHEN w LIKE '%f' AND length(w) >= 3 THEN w[:-2] || 'ves' WHEN w LIKE '%fe' THEN w[:-3] || 'ves' ELSE w || 's' END"


@_query(f"""WITH t AS (SELECT DISTINCT x AS w FROM (SELECT unnest({_WORDS}) AS x FROM documents) WHERE length(x) BETWEEN 2 AND 12 AND regexp_matches(x, '^[a-z]+$')),
    d AS (SELECT w, length(w) >= 3 AND regexp_matches(w, '[^aeiou][aeiou][^aeiouwxy]$') AS dbl, regexp_matches(w, '[^aeiou]y$') AS cy FROM t)
    SELECT w AS word, {_PLURAL} AS plural, CASE WHEN w LIKE '%e' THEN w || 'd' WHEN cy THEN w[:-2] || 'ied' WHEN dbl THEN w || w[-1] || 'ed' ELSE w || 'ed' END AS past,
    CASE WHEN w LIKE '%ie' THEN w[:-3] || 'ying' WHEN w LIKE '%e' AND w NOT LIKE '%ee' THEN w[:-2] || 'ing' WHEN dbl THEN w || w[-1] || 'ing' ELSE w || 'ing' END AS gerund FROM d""")
def corpus_morphology(spark, sf_dir):
    """Regular forms of the words of the documents."""
    words = _table(spark, sf_dir, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("word")).where(F.length("word").between(2, 12) & F.col("word").rlike("^[a-z]+$")).distinct()
    w = F.col("word")
    return words.select("word", text.plural(w).alias("plural"), text.past(w).alias("past"), text.gerund(w).alias("gerund"))


_NOUNS = [(code, number) for code, (number, _) in DOMAINS.items() if number < 16 and code not in ("AC", "MV", "QU", "EM", "SN")]


@_query(f"""WITH {_OWN}, n AS (SELECT word AS w, addr FROM l WHERE addr // 65536 IN ({", ".join(str(n) for _, n in _NOUNS)})), p AS (SELECT w, addr, {_PLURAL} AS key FROM n WHERE NOT regexp_matches(w, '(ing|ed|est|ly|ies)$')),
    e AS (SELECT w AS key, w, addr, 0 AS r FROM n UNION ALL SELECT key, w, addr, 1 FROM p) SELECT key, arg_min(w, r || w) AS word, arg_min(addr, r || w) AS addr FROM e GROUP BY 1""")
def corpus_plurals(spark, sf_dir):
    """Words of noun domains of the documents' own dictionary, and their plurals."""
    nouns = _dictionary(spark, sf_dir).where(codec.domain_code(F.col("addr")).isin([code for code, _ in _NOUNS]))
    return lexicon.with_variants(nouns).select("key", "word", "addr")
