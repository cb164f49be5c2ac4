"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, exact_dedup, licenses, minhash, ngram_join, packing, quality_model, quality_rules, secrets, spelling, tokens, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(url_filter.labelled_by_rules(pages)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the file of ranks holds the vocabulary of byte_bpe_50k.json without its added tokens; with them it gives the same ids
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), added=tokens.added_tokens(_tokenizer("byte_bpe_50k.json")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).withColumn("expressions", F.array_join("expressions", "; "))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest, threshold = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.score_rules(docs, forest, threshold).select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", "anomaly")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


# What SQL can express of operators whose own results hold more: rules, base counts, places and spans, the round trip.


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", F.coalesce("first_word", F.lit(-1)).alias("first_word"), F.coalesce("last_word", F.lit(-1)).alias("last_word"), "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality_rules(spark, sf_dir).select("doc_id", *quality_rules.COUNTS[:5], "base_failed")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spelling(spark, sf_dir).select("word", "root", F.coalesce("form", F.lit("")).alias("form"), "n", "n_near", F.coalesce("form_n", F.lit(-1)).alias("form_n"))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_quality, op3_url_filter, op4_packing, op5_secrets, op6_minhash, op7_toxicity, op8_licenses, op9_quality_rules, op10_exact_dedup, op11_divergence, op12_ngram_join, op13_spelling, url_rules, secret_base_spans, license_phrases, quality_counts, bpe_round_trip, spelling_forms)
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_quoted = lambda text: "'" + text.replace("'", "''") + "'"


def _rule_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    return "CASE " + " ".join(f"WHEN {fits(host, path)} THEN '{host}{path}'" for host, path, _ in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))) + " END"


def _spans_sql(kind: str, rank: int, pattern: str, least: int, group: int) -> str:
    """(doc_id, kind, rank, a, z) of the matches of a pattern whose group is long enough: between matches stand the parts of the split text."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS a,
            unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(v, lambda x: length(x) >= {least})) AS good
        FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, regexp_split_to_array(text, {p}) AS b FROM d WHERE regexp_matches(text, {p}))"""


_PLACES = " || ".join(
    f"list_transform(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: w[i:i + {len(words) - 1}] = {words}), lambda i: {{'at': i - 1, 'label': '{label}'}})" for phrase, label in licenses.PHRASES.items() for words in [phrase.split()]
)

def _nibble_rests() -> list[int]:
    """What the checksum of 32 bits makes of each value of four bits."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: The checksum of a list of values of four bits, the lower half of each byte first.
_CRC = f"xor(list_reduce(nibbles, lambda c, x: xor(({_nibble_rests()}::BIGINT[])[(xor(c, x) & 15) + 1], c >> 4), 4294967295::BIGINT), 4294967295)"

ORACLE_SQL = {
    "op6_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
        x AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * m >= 75 * (na + nb - m)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
        c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON id = doc_id""",
    "url_rules": rf"""
        WITH h AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
        SELECT page_id, host, path, {_rule_sql()} AS rule FROM h""",
    "secret_base_spans": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        s AS ({_spans_sql("assign", 1, secrets.ASSIGN.pattern, secrets.MIN_ASSIGN, 2)} UNION ALL {_spans_sql("access", 2, secrets.ACCESS.pattern, secrets.MIN_ACCESS, 0)} UNION ALL {_spans_sql("hex", 3, secrets.HEX.pattern, secrets.MIN_HEX, 0)}),
        f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS joined FROM s WHERE good GROUP BY 1)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN f USING (doc_id)""",
    "license_phrases": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), f AS (SELECT doc_id, len(w) AS n_words, {_PLACES} AS p FROM d)
        SELECT doc_id, n_words, len(p) AS n_base, coalesce(list_min(list_transform(p, lambda x: x.at)), -1) AS first_word, coalesce(list_max(list_transform(p, lambda x: x.at)), -1) AS last_word, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels FROM f""",
    "quality_counts": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), x AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS l FROM d),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS k FROM x WHERE len(w) >= 5),
        t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
        r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS k FROM t) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
            len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed FROM x LEFT JOIN r USING (doc_id)""",
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "op10_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS body FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256, n_chars FROM g""",
    "op11_divergence": rf"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        k AS (SELECT lang, term, sum(count(*)) OVER (PARTITION BY lang) AS v FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= {divergence.LEAST_DOCUMENTS}),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
        f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        r AS (SELECT *, 1 + ((n + 5)::HUGEINT * 1000000000) // (sum(n) OVER s + 5 * count(*) OVER s) AS p, sum(n) OVER (PARTITION BY lang, term) AS m FROM f WINDOW s AS (PARTITION BY lang, source)),
        l AS (SELECT lang, sum(n) AS all_n, count(DISTINCT term) AS v FROM f GROUP BY 1),
        t AS (SELECT r.lang, source, term AS item, p - (1 + ((m + 5)::HUGEINT * 1000000000) // (all_n + 5 * v)) AS value, n FROM r JOIN l USING (lang)),
        x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        y AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        z AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL SELECT lang, source, 'term' AS part, item, value FROM t WHERE n > 0 AND value > 0)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z) WHERE part = 'pair' OR rank <= {divergence.TOP}""",
    "op12_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
        x AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * m >= 90 * (na + nb - m)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
        c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, len(g) AS n_shingles, component_id FROM s JOIN c ON id = doc_id""",
    "op13_spelling": rf"""
        WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        r AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM d WHERE length(run) >= {spelling.LEAST_LETTERS} GROUP BY 1, 2),
        b AS (SELECT run, n, list_transform(range(len(x)), lambda i: strpos('0123456789ABCDEF', x[i + 2 - 2 * (i % 2)]) - 1) AS nibbles FROM r),
        h AS (SELECT run, n, {_CRC} AS h FROM b),
        c AS (SELECT CASE WHEN h % {spelling.DROP} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY 1 HAVING sum(n) >= {spelling.LEAST_COUNT}),
        cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
        one AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN v b ON a.short = b.word),
        p AS (SELECT word, near, n, near_n FROM one UNION ALL SELECT near, word, near_n, n FROM one UNION ALL SELECT a.word, b.word, a.n, b.n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word),
        q AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.TIMES} * v.n THEN near END AS form, CASE WHEN near_n >= {spelling.TIMES} * v.n THEN near_n END AS form_n FROM v LEFT JOIN q ON q.word = v.word AND k = 1),
        w(word, last) AS (SELECT word, word FROM f UNION ALL SELECT w.word, form FROM w JOIN f ON f.word = w.last WHERE form IS NOT NULL),
        e AS (SELECT w.word, last AS root FROM w JOIN f ON f.word = w.last WHERE form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)""",
}
ORACLE_SQL["spelling_forms"] = f"SELECT word, root, coalesce(form, '') AS form, n, n_near, coalesce(form_n, -1) AS form_n FROM ({ORACLE_SQL['op13_spelling']})"
