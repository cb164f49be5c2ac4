"""The registered queries on the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, text
from .functions.constants import CODE_PATTERNS, DOMAINS, FORMAL, FRAMES, INTENSITY, NEGATIONS, STOP_WORDS
from .operators import align, code, encode, evaluate, fingerprint, graph, lexicon, search

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows over all cores, by a key that few rows have in common: a small file is one split or two, however much work a row is."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _lexicon_sql() -> str:
    first: dict[tuple[str, str], int] = {}
    for kind, word, addr, _ in lexicon.seed_rows(lexicon.SAMPLE):
        first.setdefault((kind, word), addr)
    codes = {n: c for c, (n, _) in DOMAINS.items()}
    rows = ", ".join(f"('{k}', '{w}', {a}, '{codes[a >> 16]}{(a >> 8) & 255:X}{a & 255:02X}', '{codes[a >> 16]}')" for (k, w), a in first.items())
    return f"lex(kind, word, addr, address, domain) AS (VALUES {rows})"


_LEX = _lexicon_sql()
#: Words of part names with their tokens; all of them are dictionary words or unknown, none is inflected.
_PART = f"""{_LEX}, w AS (SELECT p_partkey, unnest(list_zip(regexp_extract_all(lower(p_name), '[a-z'']+'), range(100)), max_depth := 1) AS z FROM part),
    t AS (SELECT p_partkey, z[2] AS pos, z[1] AS word, addr, address, domain, 64 + 16 * least(3, length(word) // 4) + 5 AS shade FROM w JOIN lex ON kind = 'text' AND word = z[1] WHERE z[1] IS NOT NULL AND z[1] NOT IN ({_quoted(STOP_WORDS)}))"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), lexicon.sample(spark), "p_partkey", "p_name")


def _typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_name").alias("text"))
    return encode.encode(rows, lexicon.sample(spark), "p_partkey")


_TYPED = _PART.replace("regexp_extract_all(lower(p_name),", "regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_name),")


@_query(f"WITH {_PART} SELECT address, count(*) AS n FROM t GROUP BY 1")
def address_histogram(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select(F.explode(text.tokenize(F.col("p_name"))).alias("word"))
    found = lexicon.looked_up(words.groupBy("word").agg(F.count("*").alias("k")), "word", lexicon.sample(spark))
    return found.where("addr is not null").groupBy(codec.address_text(F.col("addr")).alias("address")).agg(F.sum("k").alias("n"))


@_query(f"""WITH {_PART} SELECT p.p_partkey, coalesce(n, 0) AS n_tokens, 8 + 32 * coalesce(n, 0) AS byte_size, coalesce(s, '') AS sequence_text
    FROM part p LEFT JOIN (SELECT p_partkey, count(*) AS n, string_agg(address || ':' || upper(format('{{:02x}}', shade)), '·' ORDER BY pos) AS s FROM t GROUP BY 1) x ON p.p_partkey = x.p_partkey""")
def encode_parts(spark, sf_dir):
    rows = encode.described(_parts(spark, sf_dir))
    return rows.select("p_partkey", F.size("tokens").cast("long").alias("n_tokens"), F.col("byte_size").cast("long").alias("byte_size"), "sequence_text")


@_query(f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{text.PLAIN_WORD.replace("'", "''")}'), lambda x: lower(x)) AS l FROM documents)
    SELECT doc_id, len(l) AS n_words, len(list_filter(l, lambda x: x IN ({_quoted(STOP_WORDS)}))) AS n_stop, len(list_distinct(l)) AS n_distinct FROM w""")
def tokenize_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text"), drop_stop_words=False).alias("l"))
    stop = F.size(F.filter("l", text.is_stop_word))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_words"), stop.cast("long").alias("n_stop"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"))


_LEVELS = "CASE " + " ".join(f"WHEN w IN ({_quoted(ws)}) THEN {k}" for k, ws in INTENSITY.items()) + " END"


@_query(f"""WITH y AS (SELECT conv_id, turn, regexp_extract_all(lower(text || '. it is very not slow, hereby hot.'), '[a-z'']+|[.!?]') AS l FROM conversations),
    x AS (SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS w FROM y),
    k AS (SELECT conv_id, turn, pos, w, {_LEVELS} AS level, w IN ('.', '!', '?') AS brk, w IN ({_quoted(NEGATIONS)}) AS neg, w IN ({_quoted(FORMAL)}) AS formal FROM x),
    r AS (SELECT *, level IS NULL AND NOT neg AND NOT brk AS tok,
        count(*) FILTER (level IS NULL AND NOT neg) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run,
        count(*) FILTER (brk) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sent FROM k),
    f AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY conv_id, turn, run ORDER BY pos) AS lv, bool_or(neg) OVER (PARTITION BY conv_id, turn, run ORDER BY pos) AS ng,
        bool_or(formal) OVER (PARTITION BY conv_id, turn, sent ORDER BY pos) AS fm FROM r)
    SELECT conv_id, turn, count(*) AS n_words, count(lv) AS n_raised, count(*) FILTER (ng) AS n_negated, count(*) FILTER (fm) AS n_formal FROM f WHERE tok GROUP BY 1, 2""")
def context_hints(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.scan_context(F.concat("text", F.lit(". it is very not slow, hereby hot."))).alias("l"))
    n = lambda test: F.size(F.filter("l", test)).cast("long")
    out = rows.select("conv_id", "turn", F.size("l").cast("long").alias("n_words"), n(lambda t: t["level"].isNotNull()).alias("n_raised"), n(lambda t: t["negated"]).alias("n_negated"), n(lambda t: t["formal"]).alias("n_formal"))
    return out.groupBy("conv_id", "turn").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_raised", "n_negated", "n_formal")])


@_query(f"""WITH {_LEX}, e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, n, coalesce(a.addr, -1) AS text_addr, coalesce(b.addr, -1) AS code_addr, coalesce(b.addr, a.addr, -1) AS auto_addr FROM e
    LEFT JOIN lex a ON a.kind = 'text' AND a.word = lower(event_type) LEFT JOIN lex b ON b.kind = 'code' AND b.word = lower(event_type)""")
def lookup_modes(spark, sf_dir):
    rows, d = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), lexicon.sample(spark)
    for mode in ("text", "code", "auto"):
        rows = lexicon.looked_up(rows, "event_type", d, mode).withColumn(f"{mode}_addr", F.coalesce("addr", F.lit(-1))).drop("addr")
    return rows


@_query(f"""WITH {_LEX}, q AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS word FROM part)
    SELECT a.word, b.word AS synonym FROM q JOIN lex a ON a.kind = 'text' AND a.word = q.word JOIN lex b ON b.kind = 'text' AND b.addr = a.addr AND b.word <> a.word""")
def synonym_pairs(spark, sf_dir):
    return lexicon.synonyms(lexicon.sample(spark), _table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word")))


@_query(f"""WITH {_LEX} SELECT kind, domain, count(*) AS entries, count(DISTINCT (addr // 256) % 256) AS categories, count(DISTINCT addr) AS concepts, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS share FROM lex GROUP BY 1, 2""")
def dictionary_statistics(spark, sf_dir):
    return lexicon.statistics(lexicon.sample(spark)).withColumn("share", F.round("share", 6))


@_query(f"""WITH {_PART}, n AS (SELECT p_partkey, domain, count(*) AS n FROM t GROUP BY 1, 2) SELECT * FROM n""")
def domain_histogram(spark, sf_dir):
    return fingerprint.domain_counts(_parts(spark, sf_dir), "p_partkey")


@_query(f"""WITH {_TYPED}, c AS (SELECT p_partkey, addr, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, first) AS rank FROM c)
    SELECT p_partkey, rank, addr, n FROM r WHERE rank <= 2""")
def top_addresses(spark, sf_dir):
    return fingerprint.top_addresses(_typed_parts(spark, sf_dir), 2, "p_partkey")


@_query(f"""WITH {_TYPED}, d AS (SELECT p_partkey, domain, count(*) AS n FROM t GROUP BY 1, 2), h AS (SELECT p_partkey, string_agg(domain || '=' || n, ',' ORDER BY domain) AS histogram, count(*) AS k FROM d GROUP BY 1),
    s AS (SELECT p_partkey, count(*) AS total, count(DISTINCT addr) AS a FROM t GROUP BY 1)
    SELECT p.p_partkey, coalesce(total, 0) AS total, coalesce(histogram, '') AS histogram, coalesce(5 * least(a, 16) + 3 * k, 0) AS fingerprint_bytes FROM part p LEFT JOIN s ON s.p_partkey = p.p_partkey LEFT JOIN h ON h.p_partkey = p.p_partkey""")
def fingerprints(spark, sf_dir):
    rows = fingerprint.fingerprint(_typed_parts(spark, sf_dir), 16, "p_partkey")
    hist = F.array_join(F.transform(F.array_sort(F.map_entries("histogram")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("p_partkey", F.col("total").cast("long").alias("total"), hist.alias("histogram"), F.col("fingerprint_bytes").cast("long").alias("fingerprint_bytes"))


@_query(f"""WITH {_TYPED}, c AS (SELECT p_partkey, list_sort(list(DISTINCT addr)) AS s FROM t GROUP BY 1), g AS (SELECT s, min(p_partkey) AS rep FROM c GROUP BY 1)
    SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)), 6) AS jaccard FROM g x JOIN g y ON x.rep < y.rep
    WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)) >= 0.3""")
def clone_pairs(spark, sf_dir):
    return fingerprint.clone_pairs(_typed_parts(spark, sf_dir), 0.3, 16, "p_partkey").withColumn("jaccard", F.round("jaccard", 6))


@_query(f"""WITH {_PART}, b AS (SELECT p_partkey, l.addr, l.domain, 64 + 16 * least(3, length(l.word) // 4) + 5 AS shade FROM part JOIN lex l ON l.kind = 'text' AND l.word = lower(p_type)),
    s AS (SELECT t.p_partkey, t.pos, CASE WHEN t.addr = b.addr THEN 0.75::DOUBLE + 0.25::DOUBLE * (1 - abs(t.shade - b.shade) / 255) WHEN t.addr // 256 = b.addr // 256 THEN 0.40::DOUBLE + 0.05::DOUBLE * (1 - abs(t.shade - b.shade) / 255)
        WHEN t.domain = b.domain THEN 0.25::DOUBLE + 0.05::DOUBLE * (1 - abs(t.shade - b.shade) / 255) ELSE 0::DOUBLE END AS score FROM t JOIN b ON b.p_partkey = t.p_partkey),
    m AS (SELECT p_partkey, coalesce(arg_min(score, pos) FILTER (score > 0), 0) AS best, count(*) AS n FROM s GROUP BY 1)
    SELECT p_partkey, round(best / n, 6) AS score FROM m""")
def align_name_with_type(spark, sf_dir):
    a = _parts(spark, sf_dir).where(F.size("tokens") > 0)
    b = encode.encode(_table(spark, sf_dir, "part").select("p_partkey", "p_type"), lexicon.sample(spark), "p_partkey", "p_type").where(F.size("tokens") > 0).withColumnRenamed("tokens", "b")
    return a.join(b.select("p_partkey", "b"), "p_partkey").select("p_partkey", F.round(align.align(F.col("tokens"), F.col("b"), relations=False)["score"], 6).alias("score"))


@_query(f"""WITH {_PART}, l AS (SELECT p_partkey, list(DISTINCT word) AS ws FROM t GROUP BY 1), q AS (SELECT ['hot', 'plate', 'small'] AS b)
    SELECT p_partkey, round(len(list_intersect(ws, b)) / len(ws), 6) AS coverage, round(2 * len(list_intersect(ws, b)) / (len(ws) + len(b)), 6) AS dice FROM l, q""")
def lexical_overlap(spark, sf_dir):
    q = F.array(*[F.struct(F.lit(w).alias("word")) for w in ("hot", "plate", "small")])
    rows = _parts(spark, sf_dir).where(F.size("tokens") > 0)
    return rows.select("p_partkey", F.round(align.lexical_coverage(F.col("tokens"), q), 6).alias("coverage"), F.round(align.lexical_dice(F.col("tokens"), q), 6).alias("dice"))


_SCORED = """round(CASE WHEN t.addr = q.addr THEN 0.75::DOUBLE + 0.25::DOUBLE * (1 - abs(t.shade - q.shade) / 255) WHEN t.addr // 256 = q.addr // 256 THEN 0.40::DOUBLE + 0.05::DOUBLE * (1 - abs(t.shade - q.shade) / 255)
    WHEN t.addr // 65536 = q.addr // 65536 THEN 0.25::DOUBLE + 0.05::DOUBLE * (1 - abs(t.shade - q.shade) / 255) ELSE 0::DOUBLE END / n, 6)"""


@_query(f"""WITH {_PART}, q AS (SELECT addr, 64 + 16 + 5 AS shade FROM lex WHERE kind = 'text' AND word = 'cold'), n AS (SELECT p_partkey, count(*) AS n FROM t GROUP BY 1),
    s AS (SELECT t.p_partkey, max({_SCORED}) AS score, max(CASE WHEN t.addr // 65536 = q.addr // 65536 THEN 1 END) AS fits FROM t JOIN n ON n.p_partkey = t.p_partkey, q GROUP BY 1)
    SELECT p_partkey, score FROM s WHERE fits = 1 ORDER BY score DESC, p_partkey LIMIT 10""")
def search_top(spark, sf_dir):
    index = search.build(_parts(spark, sf_dir), "p_partkey")
    query = encode.encode(spark.createDataFrame([(0, "cold")], "doc_id long, text string"), lexicon.sample(spark))
    return search.search(index, query, relations=False).select("p_partkey", F.round("score", 6).alias("score"))


@_query(f"""WITH {_PART}, q AS (SELECT word AS query_id, addr, 64 + 16 * least(3, length(word) // 4) + 5 AS shade FROM lex WHERE kind = 'text' AND word IN ('large', 'small', 'medium', 'economy', 'blue')), n AS (SELECT p_partkey, count(*) AS n FROM t GROUP BY 1),
    s AS (SELECT query_id, t.p_partkey AS seq, max({_SCORED}) AS score, max(CASE WHEN t.addr // 65536 = q.addr // 65536 THEN 1 END) AS fits FROM t JOIN n ON n.p_partkey = t.p_partkey, q GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM s WHERE fits = 1) SELECT query_id, rank, seq, score FROM r WHERE rank <= 3""")
def search_batch(spark, sf_dir):
    index = search.build(_parts(spark, sf_dir), "p_partkey")
    asked = encode.encode(spark.createDataFrame([(w, w) for w in ("large", "small", "medium", "economy", "blue")], "query_id string, text string"), lexicon.sample(spark), "query_id")
    return search.search_many(index, asked, top_k=3, relations=False).withColumn("score", F.round("score", 6))


@_query(f"""WITH {_PART} SELECT count(DISTINCT p_partkey) AS n FROM t WHERE domain IN ('SN', 'OB')""")
def domain_prefilter(spark, sf_dir):
    return search.candidates(search.build(_parts(spark, sf_dir), "p_partkey"), ["SN", "OB"], []).agg(F.countDistinct("p_partkey").alias("n"))


@_query("""WITH i AS (SELECT event_id, 'get' || upper(event_type[1]) || event_type[2:] || 'HTTPUrl' || user_id AS name FROM events)
    SELECT event_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Za-z]+|[0-9]+'), lambda p: CASE lower(p) WHEN 'url' THEN 'address' ELSE lower(p) END), ' ') AS parts FROM i""")
def identifier_parts(spark, sf_dir):
    name = F.concat(F.lit("get"), F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"), F.lit("HTTPUrl"), F.col("user_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(text.split_identifier(name), " ").alias("parts"))


_SQL_PATTERNS = ", ".join(f"CASE WHEN regexp_matches(s, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in sorted(CODE_PATTERNS.items()))


@_query(f"WITH h AS (SELECT page_id, lower(regexp_replace(html, '[^\\x00-\\x7F]', ' ', 'g')) AS s FROM pages) SELECT page_id, array_to_string(list_filter([{_SQL_PATTERNS}], lambda x: x IS NOT NULL), ',') AS patterns FROM h")
def page_patterns(spark, sf_dir):
    ascii_only = F.regexp_replace("html", r"[^\x00-\x7F]", " ")
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(text.detect_patterns(ascii_only), ",").alias("patterns"))


_LEXEME_SQL = text.LEXEME.replace("'", "''")


@_query(f"""WITH x AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '[^\\x00-\\x7F]', ' ', 'g'), '{_LEXEME_SQL}')) AS t FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(t, '^(#|//|/\\*)') THEN 'comment' WHEN length(t) > 1 AND t[1] IN ('"', '''') THEN 'string' WHEN regexp_matches(t, '^[0-9]') THEN 'number' WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'identifier' ELSE 'mark' END AS kind,
    count(*) AS n FROM x GROUP BY 1, 2""")
def lexeme_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", r"[^\x00-\x7F]", " ").alias("source"))
    return code.lexemes(rows).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@_query("""WITH j AS (SELECT quality AS a, n_chars AS b FROM labels JOIN documents USING (doc_id)), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM j)
    SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.spearman(rows, "quality", "n_chars").withColumn("rho", F.round("rho", 6))


@_query("""WITH m AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber DESC) AS k FROM m), g AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN 1.0 / k ELSE 0 END) AS r FROM r GROUP BY 1)
    SELECT count(*) AS queries, round(avg(r), 6) AS mrr FROM g""")
def reciprocal_rank(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("s"))
    return evaluate.mean_reciprocal_rank(rows.withColumn("gold", F.lit(1)), "l_orderkey", "l_linenumber", "s").withColumn("mrr", F.round("mrr", 6))


_F1 = """WITH j AS (SELECT quality AS y, least(1, n_chars / 3000) AS s FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest(range(1, 20)) AS k),
    c AS (SELECT k, count(*) FILTER (y = 1 AND round(s * 20, 9) >= k) AS tp, count(*) FILTER (y <> 1 AND round(s * 20, 9) >= k) AS fp, count(*) FILTER (y = 1 AND round(s * 20, 9) < k) AS fn FROM j, t GROUP BY 1),
    f AS (SELECT k / 20 AS threshold, tp, fp, fn, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)"""


def _graded(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("quality").alias("label"), F.least(F.lit(1.0), F.col("n_chars") / 3000).alias("score"))


@_query(_F1 + " SELECT threshold, tp, fp, fn, round(f1, 6) AS f1 FROM f")
def f1_sweep(spark, sf_dir):
    return evaluate.f1_sweep(_graded(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


@_query(_F1 + " SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1")
def best_f1(spark, sf_dir):
    return evaluate.best_f1(_graded(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


@_query("""SELECT round(avg(n_chars) FILTER (toxic = 1), 4) AS within, round(avg(n_chars) FILTER (toxic = 0), 4) AS across, round(avg(n_chars) FILTER (toxic = 1) - avg(n_chars) FILTER (toxic = 0), 4) AS separation FROM labels JOIN documents USING (doc_id)""")
def separation(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.separation(rows, F.col("toxic") == 1, "n_chars").select(*[F.round(c, 4).alias(c) for c in ("within", "across", "separation")])


@_query("SELECT lang, count(*) AS n, round(avg(CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END), 6) AS rate FROM documents GROUP BY 1")
def pass_rates(spark, sf_dir):
    return evaluate.pass_rate(_table(spark, sf_dir, "documents"), F.col("n_chars") >= 1000, ["lang"]).withColumn("rate", F.round("rate", 6))


@_query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS scaled FROM customer")
def min_max(spark, sf_dir):
    return evaluate.min_max(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "scaled").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@_query("SELECT greatest(0, least(9, floor(l_tax / 0.1::DOUBLE * 10)))::BIGINT AS level, count(*) AS n FROM lineitem GROUP BY 1")
def score_histogram(spark, sf_dir):
    return evaluate.histogram(_table(spark, sf_dir, "lineitem").select("l_tax"), "l_tax", bins=10, low=0.0, high=0.1)


@_query("""WITH r AS (SELECT c_acctbal, c_nationkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer),
    q AS (SELECT *, CASE WHEN k < n // 4 THEN 0 WHEN k < 2 * n // 4 THEN 1 WHEN k < 3 * n // 4 THEN 2 ELSE 3 END AS quartile FROM r),
    k AS (SELECT quartile, rank() OVER (PARTITION BY quartile ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY quartile, c_nationkey) - 1) / 2 AS ra, rank() OVER (PARTITION BY quartile ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY quartile, c_acctbal) - 1) / 2 AS rg FROM q)
    SELECT quartile, count(*) AS n, round(corr(ra, rg), 6) AS rho FROM k GROUP BY 1""")
def quartile_correlation(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return evaluate.quartiles(rows, "c_acctbal", "c_custkey", "c_nationkey").withColumn("rho", F.round("rho", 6))


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 8")
def extreme_rows(spark, sf_dir):
    return evaluate.extremes(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, F.col("c_acctbal"), "c_custkey")


_EDGES = f"""{_LEX}, r AS (SELECT lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b, CASE p_size % 3 WHEN 0 THEN 'RELATED' WHEN 1 THEN 'PROPERTY' ELSE 'ANTONYM' END AS type, p_size * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 1.0 END::DOUBLE AS s FROM part),
    j AS (SELECT a, b, x.addr AS xa, y.addr AS ya, type, s FROM r JOIN lex x ON x.kind = 'text' AND x.word = a JOIN lex y ON y.kind = 'text' AND y.word = b WHERE x.addr <> y.addr),
    e AS (SELECT word, type, addr, sum(s) AS score FROM (SELECT a AS word, type, ya AS addr, s FROM j UNION ALL SELECT b, type, xa, s FROM j) GROUP BY 1, 2, 3)"""


def _edges(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    rel = F.when(F.col("p_size") % 3 == 0, "/r/RelatedTo").when(F.col("p_size") % 3 == 1, "/r/HasProperty").otherwise("/r/Antonym")
    uri = lambda k: F.concat(F.lit("/c/en/"), F.get(F.split("p_name", " "), F.lit(k)))
    return graph.aggregate_edges(part.select(rel.alias("rel"), uri(0).alias("src"), uri(1).alias("tgt"), F.col("p_size").cast("double").alias("weight")), lexicon.sample(spark))


@_query(f"WITH {_EDGES} SELECT word, type, addr, round(score, 4) AS score FROM e")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("score", F.round("score", 4))


_TOP = _EDGES + ", e2 AS (SELECT word, type, addr, round(score, 4) AS score FROM e), w AS (SELECT *, greatest(1, least(255, round_even(score / max(score) OVER (PARTITION BY word) * 255, 0)))::INT AS weight FROM e2)"


@_query(f"WITH {_TOP}, k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, type, addr) AS rank FROM w) SELECT word, type, addr, score, weight, rank FROM k WHERE rank <= 4")
def graph_top(spark, sf_dir):
    return graph.select_top(graph_edges(spark, sf_dir))


@_query(f"""WITH {_TOP}, l AS (SELECT *, CASE WHEN type IN ('ANTONYM') THEN 'lexical' WHEN type = 'PROPERTY' THEN 'functional' ELSE 'associative' END AS lane FROM w),
    i AS (SELECT *, row_number() OVER (PARTITION BY word, lane ORDER BY score DESC, type, addr) AS n FROM l), f AS (SELECT *, CASE WHEN n <= CASE lane WHEN 'lexical' THEN 2 ELSE 1 END THEN 0 ELSE 1 END AS late FROM i),
    k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY late, score DESC, type, addr) AS rank FROM f) SELECT word, type, addr, score, weight, rank FROM k WHERE rank <= 4""")
def graph_balanced(spark, sf_dir):
    return graph.select_top(graph_edges(spark, sf_dir), balanced=True)


_UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    p AS (SELECT label, list(x ORDER BY k) AS m FROM (SELECT label, k, avg(v[k]) AS x FROM u, (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS k) GROUP BY 1, 2) GROUP BY 1)"""


@_query(f"WITH {_UNIT}, c AS (SELECT vec_id, p.label, list_cosine_similarity(v, m) AS c FROM u JOIN p ON p.label <> u.label), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS n FROM c WHERE c >= 0.05) SELECT vec_id, label, round(c, 5) AS cosine, round(c * 1.10::DOUBLE, 5) AS score FROM r WHERE n <= 4")
def nearest_prototypes(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    out = graph.nearest_prototypes(rows, graph.prototypes(rows, "label"), "vec_id", "label", least=0.05)
    return out.select("vec_id", "label", F.round("cosine", 5).alias("cosine"), F.round("score", 5).alias("score"))


@_query("""WITH a AS (SELECT 'n' || n_nationkey AS x, 'r' || n_regionkey AS y, n_nationkey % 5 + 1.0 AS w FROM nation WHERE n_nationkey % 5 + 1.0 >= 2), b AS (SELECT x AS word, y AS other, w * 0.12 AS s FROM a UNION ALL SELECT y, x, w * 0.12 * 0.65 FROM a),
    g AS (SELECT word, other, sum(s) AS score FROM b GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, other) AS n FROM g) SELECT word, other, round(score, 6)::DOUBLE AS score FROM k WHERE n <= 4""")
def associations(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    names = nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("word")).union(region.select(F.col("r_regionkey") + 100, F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))
    adjacency = nation.select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"), (F.col("n_nationkey") % 5 + 1.0).alias("weight"))
    return graph.associations(adjacency, names).withColumn("score", F.round("score", 6))


@_query(f"""WITH {_LEX}, t AS (SELECT DISTINCT word AS w FROM lex), v AS (SELECT w, '[aeiou]' AS v FROM t),
    d AS (SELECT w, length(w) >= 3 AND regexp_matches(w, '[^aeiou][aeiou][^aeiouwxy]$') AS dbl, regexp_matches(w, '[^aeiou]y$') AS cy FROM v)
    SELECT w AS word, CASE WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' WHEN cy THEN w[:-2] || 'ies' WHEN w LIKE '%f' AND length(w) >= 3 THEN w[:-2] || 'ves' WHEN w LIKE '%fe' THEN w[:-3] || 'ves' ELSE w || 's' END AS plural,
    CASE WHEN w LIKE '%e' THEN w || 'd' WHEN cy THEN w[:-2] || 'ied' WHEN dbl THEN w || w[-1] || 'ed' ELSE w || 'ed' END AS past,
    CASE WHEN w LIKE '%ie' THEN w[:-3] || 'ying' WHEN w LIKE '%e' AND w NOT LIKE '%ee' THEN w[:-2] || 'ing' WHEN dbl THEN w || w[-1] || 'ing' ELSE w || 'ing' END AS gerund,
    CASE WHEN length(w) NOT BETWEEN 3 AND 8 THEN NULL WHEN cy THEN w[:-2] || 'ier' WHEN w LIKE '%e' THEN w || 'r' WHEN dbl THEN w || w[-1] || 'er' ELSE w || 'er' END AS comparative FROM d WHERE length(w) >= 2""")
def morphology(spark, sf_dir):
    w = F.col("word")
    return lexicon.sample(spark).select("word").distinct().where(F.length("word") >= 2).select("word", text.plural(w).alias("plural"), text.past(w).alias("past"), text.gerund(w).alias("gerund"), text.comparative(w).alias("comparative"))


@_query(f"""WITH {_LEX}, x AS (SELECT word, addr, 0 AS layer FROM lex WHERE kind = 'text' UNION ALL SELECT lower(n_name), 65536 * 6 + n_nationkey, 1 FROM nation UNION ALL VALUES ('hot', 7, 2), ('cold', 8, 1), ('cold', 9, 2))
    SELECT word, arg_max(addr, layer) AS addr FROM x GROUP BY 1""")
def overlay(spark, sf_dir):
    base = lexicon.sample(spark).where("kind = 'text'").select("kind", "word", "addr")
    one = _table(spark, sf_dir, "nation").select(F.lit("text").alias("kind"), F.col("n_name").alias("word"), (F.lit(65536 * 6) + F.col("n_nationkey").cast("int")).alias("addr"))
    one = one.union(spark.createDataFrame([("text", "Cold", 8)], "kind string, word string, addr int"))
    two = spark.createDataFrame([("text", "HOT", 7), ("text", "cold", 9)], "kind string, word string, addr int")
    return lexicon.overlay(base, one, two).select("word", "addr")


@_query("""WITH s AS (SELECT l_orderkey, l_linenumber, (l_linenumber % 4) * 64 + (l_suppkey % 4) * 16 + (l_partkey % 4) * 4 + l_orderkey % 4 AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, upper(format('{:02x}', v)) AS shade, (v // 64)::INT AS intensity, (v % 4)::INT AS polarity, round(1 - abs(v - 85) / 255, 6) AS similarity, ((3 * 64 + (v // 16 % 4) * 16 + least(3, v // 4 % 4 + 1) * 4 + 3 - v % 4))::INT AS changed FROM s""")
def shades(spark, sf_dir):
    part = lambda c: F.col(c) % 4
    v = codec.shade(part("l_linenumber"), part("l_suppkey"), part("l_partkey"), part("l_orderkey"))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    p = codec.shade_parts(F.col("v"))
    changed = codec.in_context(F.col("v"), F.lit(3), F.lit(True), F.lit(True))
    return rows.select("l_orderkey", "l_linenumber", codec.shade_hex(F.col("v")).alias("shade"), p["intensity"].cast("int").alias("intensity"), p["polarity"].cast("int").alias("polarity"), F.round(codec.shade_similarity(F.col("v"), F.lit(85)), 6).alias("similarity"), changed.cast("int").alias("changed"))


@_query(f"""WITH {_PART}, b AS (SELECT p_partkey, count(*) AS n, string_agg(upper(format('{{:06x}}{{:02x}}', addr, shade)), '' ORDER BY pos) AS s FROM t GROUP BY 1)
    SELECT p.p_partkey, '53530100' || upper(format('{{:04x}}', coalesce(n, 0))) || '0000' || coalesce(s, '') AS v1, 8 + 32 * coalesce(n, 0) AS v3_bytes, true AS same FROM part p LEFT JOIN b ON b.p_partkey = p.p_partkey""")
def binary_forms(spark, sf_dir):
    rows = _dealt(_parts(spark, sf_dir), "p_partkey")
    t = F.col("tokens")
    back = codec.from_binary(codec.to_binary(t))["tokens"]
    same = F.to_json(F.transform(back, lambda x: F.struct(x["addr"], x["shade"], x["role"], x["features"]))) == F.to_json(F.transform(t, lambda x: F.struct(x["addr"], x["shade"], x["role"], x["features"])))
    same = same & (F.size(codec.from_text(codec.to_text(t))) == F.size(t))
    return rows.select("p_partkey", F.hex(codec.to_binary(t, 1)).alias("v1"), F.length(codec.to_binary(t)).cast("long").alias("v3_bytes"), same.alias("same"))


_FRAME_SQL = ", ".join("CASE WHEN " + " AND ".join(f"list_has_any(w, [{_quoted(g.split())}])" for g in groups) + f" THEN '{name}' END" for name, _, groups in FRAMES)


@_query(f"""WITH x AS (SELECT p_partkey, string_split(lower(p_name || CASE p_size % 3 WHEN 0 THEN ' open file' WHEN 1 THEN ' binary search tree insert' ELSE ' merge sort' END), ' ') AS w FROM part)
    SELECT p_partkey, array_to_string(list_filter([{_FRAME_SQL}], lambda f: f IS NOT NULL), ',') AS frames FROM x""")
def frames_found(spark, sf_dir):
    more = F.when(F.col("p_size") % 3 == 0, " open file").when(F.col("p_size") % 3 == 1, " binary search tree insert").otherwise(" merge sort")
    words = F.split(F.lower(F.concat("p_name", more)), " ")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(encode.frame_entries(words), lambda t: t["word"]), ",").alias("frames"))


from . import queries_docs, queries_forms, queries_graph, queries_more  # noqa: E402, F401  they register more
