"""Registered queries over what the command line prints, for whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.constants import DOMAINS, STOP_WORDS
from .operators import reports
from .queries import _PART, _parts, _query, _quoted
from .queries_docs import _ADDR, _SHADE, _SQL, LONG, _dictionary, _words

_LISTED = """string_agg('{"word":"' || word || '","address":"' || address || '","shade":"' || upper(format('{:02x}', shade)) || '"}', ',' ORDER BY pos)"""


@_query(f"""WITH {_PART}, s AS (SELECT p_partkey, count(*) AS n, string_agg(address || ':' || upper(format('{{:02x}}', shade)), '·' ORDER BY pos) AS s, {_LISTED} AS l, string_agg(upper(format('{{:06x}}{{:02x}}', addr, shade)), '' ORDER BY pos) AS h FROM t GROUP BY 1),
    u AS (SELECT p_partkey, string_agg('"' || z[1] || '"', ',' ORDER BY z[2]) AS u FROM w WHERE z[1] IS NOT NULL AND z[1] NOT IN ({_quoted(STOP_WORDS)}) AND z[1] NOT IN (SELECT word FROM lex WHERE kind = 'text') GROUP BY 1)
    SELECT p.p_partkey, coalesce(s, '') AS sequence, '{{"sequence":"' || coalesce(s, '') || '","byte_size":' || (8 + 32 * coalesce(n, 0))::BIGINT || ',"tokens":[' || coalesce(l, '') || '],"unknowns":[' || coalesce(u, '') || ']}}' AS payload, 16 + 64 * coalesce(n, 0) AS n_hex
    FROM part p LEFT JOIN s ON s.p_partkey = p.p_partkey LEFT JOIN u ON u.p_partkey = p.p_partkey""")
def printed_encodings(spark, sf_dir):
    """Encoded names in each form that the command line prints."""
    rows = _parts(spark, sf_dir)
    return rows.select("p_partkey", reports.form(rows, "text").alias("sequence"), reports.form(rows, "json").alias("payload"), F.length(reports.form(rows, "hex")).cast("long").alias("n_hex"))


_CODE = "CASE addr // 65536 " + " ".join(f"WHEN {n} THEN '{c}'" for c, (n, _) in DOMAINS.items()) + " END"


@_query(f"""WITH {_SQL}, x AS (SELECT DISTINCT unnest(w) AS x FROM d), a AS (SELECT x, {_ADDR} AS addr, {_SHADE} AS shade FROM x WHERE length(x) >= {LONG}), l AS (SELECT addr, list_sort(list(x)) AS l FROM a GROUP BY 1),
    j AS (SELECT x, {_CODE} AS code, addr // 256 % 256 AS category, addr % 256 AS concept, shade, list_filter(l, lambda y: y <> x)[:{reports.SYNONYMS}] AS s FROM a JOIN l USING (addr))
    SELECT x AS word, true AS found, '{{"found":true,"token":"' || x || '","address":"' || code || upper(format('{{:x}}{{:02x}}', category, concept)) || '","domain":"' || code || '","category":' || category || ',"concept":' || concept || ',"shade":"' || upper(format('{{:02x}}', shade)) || '","synonyms":[' || coalesce(array_to_string(list_transform(s, lambda y: '"' || y || '"'), ','), '') || ']}}' AS entry FROM j
    UNION ALL SELECT x || 'zz', false, '{{"found":false,"token":"' || x || 'zz"}}' FROM j WHERE x || 'zz' NOT IN (SELECT x FROM j)""")
def printed_entries(spark, sf_dir):
    """The entry that the command line prints, for every long word of the documents and for as many words that aren't any."""
    words = _words(spark, sf_dir)
    return reports.entries(words.union(words.select(F.concat("word", F.lit("zz")))), _dictionary(spark, sf_dir))
