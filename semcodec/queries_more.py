"""More registered queries: sources and sinks, scalar functions, the dictionary's build, scores of pairs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import codec, text
from .functions.constants import DEFAULT_ROLE, DETACHED, DIRECTIONS, DOMAINS, KEYWORDS, PROFILES, RELATION_ALIASES, RELATIONS, ROLES, STOP_WORDS
from .operators import align, code, encode, evaluate, fingerprint, graph, lexicon, search, senses
from .plans import layers, shared
from .queries import _EDGES, _LEX, _PART, _TOP, _TYPED, _parts, _query, _quoted, _table, _typed_parts, graph_edges
from .sources import readers, writers
from .streaming import encode as streams


def _text_file(rows: DataFrame, line, *order: str, **options) -> str:
    """A folder of files of lines, one for each partition; one file if the lines have an order."""
    path = shared.folder(rows.sparkSession)
    (rows.orderBy(*order).coalesce(1) if order else rows).select(line.alias("value")).write.options(**options).text(path)
    return path


def _lines(*columns):
    return F.concat_ws("\t", *[c.cast("string") for c in columns])


def _cases(column: str, pairs: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in pairs.items()) + f" ELSE {default} END"


# --- sources and sinks --------------------------------------------------------------------------------------------------


@_query(f"""WITH {_TOP}, k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, type, addr) AS rank FROM w), rel AS (SELECT word, count(*) AS n, sum(weight) AS s, min(addr) AS least FROM k WHERE rank <= 4 GROUP BY 1)
    SELECT kind, lex.word, lex.addr, coalesce(n, 0) AS n_related, coalesce(s, 0)::BIGINT AS weights, coalesce(least, -1) AS least FROM lex LEFT JOIN rel ON rel.word = lex.word""")
def dictionary_file(spark, sf_dir):
    """The sample dictionary with relations, written and read back."""
    path = shared.folder(spark)
    writers.dictionary_json(graph.stamp(lexicon.sample(spark), graph.select_top(graph_edges(spark, sf_dir))), path)
    at = lambda c: F.transform("related", lambda r: r[c])
    total = F.aggregate(at("weight"), F.lit(0).cast("long"), lambda s, w: s + w)
    return readers.dictionary_json(spark, path).select("kind", "word", "addr", F.size("related").cast("long").alias("n_related"), total.alias("weights"), F.coalesce(F.array_min(at("addr")), F.lit(-1)).alias("least"))


def _entry_file(spark, path: str, rows: DataFrame) -> None:
    """rows (word, d, c, n) as a dictionary file."""
    shared.put(spark, path, json.dumps({"entries": {r["word"]: {"d": r["d"], "c": r["c"], "n": r["n"]} for r in rows.collect()}}))  # some tens of rows


@_query("""WITH x AS (SELECT lower(n_name) AS word, 'EC' AS d, n_regionkey AS c, n_nationkey AS n, 0 AS layer FROM nation UNION ALL SELECT lower(n_name), 'SP', 1, n_nationkey, 1 FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT lower(r_name), 'SO', 2, r_regionkey, 2 FROM region UNION ALL SELECT lower(n_name), 'TM', 3, n_nationkey, 3 FROM nation WHERE n_nationkey % 7 = 0)
    SELECT word, arg_max(d, layer) || upper(format('{:x}', arg_max(c, layer))) || upper(format('{:02x}', arg_max(n, layer))) AS address FROM x GROUP BY 1""")
def default_dictionary(spark, sf_dir):
    nation, region, folder = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region"), shared.folder(spark)
    rows = lambda t, name, d, c, n: t.select(F.lower(name).alias("word"), F.lit(d).alias("d"), F.lit(c).alias("c") if isinstance(c, int) else F.col(c).alias("c"), F.col(n).alias("n"))
    _entry_file(spark, f"{folder}/{readers.BASE_FILE}", rows(nation, "n_name", "EC", "n_regionkey", "n_nationkey"))
    _entry_file(spark, f"{folder}/{readers.PATCH_FILE}", rows(nation.where("n_regionkey = 1"), "n_name", "SP", 1, "n_nationkey"))
    _entry_file(spark, f"{folder}/extensions/auto/a.json", rows(region, "r_name", "SO", 2, "r_regionkey"))
    _entry_file(spark, f"{folder}/extensions/auto/b.json", rows(nation.where("n_nationkey % 7 = 0"), "n_name", "TM", 3, "n_nationkey"))
    shared.put(spark, f"{folder}/extensions/auto/c.json", "{not json")
    return readers.default_dictionary(spark, folder).select("word", codec.address_text(F.col("addr")).alias("address"))


@_query("""SELECT lower(r_name) AS name, round(r_regionkey / 10, 6) AS antonym, r_regionkey % 2 = 0 AS coverage, false AS symmetric, 0.0::DOUBLE AS lexical, 1.0::DOUBLE AS multiplier, round(0.5 + r_regionkey / 10, 6)::DOUBLE AS synonym, 0.76::DOUBLE AS isa,
    string_agg(lower(n_name), ' ' ORDER BY n_nationkey) AS frame FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""")
def adapter_settings(spark, sf_dir):
    """Profiles and frames of a folder of adapter files."""
    folder = shared.folder(spark)
    names = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    for r in _table(spark, sf_dir, "region").join(names, F.col("r_regionkey") == F.col("n_regionkey")).collect():  # a few settings
        k = r["r_regionkey"]
        body = {"name": r["r_name"].lower(), "profile": {"antonym_penalty": k / 10, "query_coverage": k % 2 == 0, "relation_scale": {"SYN": 0.5 + k / 10}}, "frames": [{"name": r["r_name"], "codon": f"EC00{k}", "groups": [[x["n_name"].title() for x in r["n"]]]}]}
        shared.put(spark, f"{folder}/{k}.json", json.dumps(body))
    profiles, frames = readers.adapter_files(spark, folder)
    by_name = {name.lower(): groups[0] for name, _, groups in frames}
    rows = [(name, round(p.antonym, 6), p.coverage, p.symmetric, p.lexical, p.multiplier, round(p.weight("SYNONYM"), 6), p.weight("ISA"), by_name[name]) for name, p in profiles.items()]
    return spark.createDataFrame(rows, "name string, antonym double, coverage boolean, symmetric boolean, lexical double, multiplier double, synonym double, isa double, frame string")


@_query("SELECT name, CASE name WHEN 'strict' THEN 0.22 WHEN 'sentence' THEN 0.15 WHEN 'topical' THEN 0.08 WHEN 'code_search' THEN 0.08 ELSE 0.15 END::DOUBLE AS antonym, name IN ('sentence', 'code_search') AS coverage FROM (SELECT DISTINCT CASE n_nationkey % 6 WHEN 0 THEN 'strict' WHEN 1 THEN 'sentence' WHEN 2 THEN 'topical' WHEN 3 THEN 'code_search' WHEN 4 THEN 'default' ELSE lower(n_name) END AS name FROM nation)")
def profiles_by_name(spark, sf_dir):
    n = F.col("n_nationkey") % 6
    names = _table(spark, sf_dir, "nation").select(F.when(n == 0, "strict").when(n == 1, "sentence").when(n == 2, "topical").when(n == 3, "code_search").when(n == 4, "default").otherwise(F.lower("n_name")).alias("name")).distinct()
    return spark.createDataFrame([(r["name"], (p := align.profile(r["name"])).antonym, p.coverage) for r in names.collect()], "name string, antonym double, coverage boolean")  # a few names


@_query("SELECT doc_id::VARCHAR AS id, length(text) AS n, source FROM documents")
def corpus_lines(spark, sf_dir):
    docs, path = _table(spark, sf_dir, "documents"), shared.folder(spark)
    docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")).write.json(path)
    found = readers.corpus_jsonl(spark, path).select("id", F.length("content").cast("long").alias("n"))
    return found.join(docs.select(F.col("doc_id").cast("string").alias("id"), "source"), "id")


_FILES = """f AS (SELECT n_nationkey AS k, 'n' || n_nationkey || '.' || CASE n_nationkey % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'TS' WHEN 2 THEN 'rs' WHEN 3 THEN 'cpp' ELSE 'txt' END AS name,
    CASE n_nationkey % 4 WHEN 0 THEN 'def ' || n_name WHEN 1 THEN 'const ' || n_name || ' = 1' WHEN 2 THEN 'import ' || n_name ELSE n_name END AS body FROM nation)"""


@_query(f"""WITH {_FILES} SELECT name, length(body) AS n, coalesce(CASE k % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' WHEN 3 THEN 'cpp' END, '') AS language, CASE WHEN k % 4 = 1 THEN 'javascript' ELSE 'python' END AS guess FROM f""")
def source_files(spark, sf_dir):
    """Whole files with the languages of their names and of what they hold."""
    folder = shared.folder(spark)
    for r in _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 files
        k, name = r
        shared.put(spark, f"{folder}/n{k}.{('py', 'TS', 'rs', 'cpp', 'txt')[k % 5]}", (f"def {name}", f"const {name} = 1", f"import {name}", name)[k % 4])
    rows = readers.text_files(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), "content")
    return rows.select("name", F.length("content").cast("long").alias("n"), F.coalesce(text.language_of(F.col("name")), F.lit("")).alias("language"), text.language_of_source(F.col("content")).alias("guess"))


@_query("""SELECT kind, p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size::DOUBLE AS gold FROM part, (SELECT unnest(['words', 'sentences', 'relatedness']) AS kind)""")
def evaluation_files(spark, sf_dir):
    """Word pairs, sentence pairs and relatedness pairs of tab-separated files."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("a"), F.get(F.split("p_name", " "), F.lit(1)).alias("b"), "p_size")
    key = F.concat("a", F.lit("~"), "p_partkey")
    k = F.col("p_partkey")
    words = readers.word_pairs(spark, _text_file(part, F.when(k == 1, F.concat(F.lit("# note\n"), _lines(key, F.col("b"), F.col("p_size")))).otherwise(_lines(key, F.col("b"), F.col("p_size")))))
    sentences = readers.sentence_pairs(spark, _text_file(part, _lines(F.col("p_size"), key, F.col("b"))))
    related = readers.relatedness_pairs(spark, _text_file(part, F.when(k == 1, F.concat(F.lit("id\ta\tb\tscore\n"), _lines(k, key, F.col("b"), F.col("p_size")))).otherwise(_lines(k, key, F.col("b"), F.col("p_size")))))
    out = words.withColumn("kind", F.lit("words")).union(sentences.withColumn("kind", F.lit("sentences"))).union(related.withColumn("kind", F.lit("relatedness")))
    return out.select("kind", F.substring_index("a", "~", -1).cast("long").alias("k"), F.substring_index("a", "~", 1).alias("a"), "b", "gold")


_CLONES = "c AS (SELECT l.doc_id AS a, b.doc_id AS b, quality AS label FROM labels l JOIN documents x ON x.doc_id = l.doc_id JOIN documents b ON b.doc_id = l.doc_id + 1 WHERE length(x.text) BETWEEN 200 AND 1500 AND length(b.text) BETWEEN 200 AND 1500)"


def _clones(spark, sf_dir, first=None):
    functions = shared.folder(spark)
    _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("idx"), F.col("text").alias("func")).write.json(functions)
    pairs = _text_file(_table(spark, sf_dir, "labels"), _lines(F.col("doc_id"), F.col("doc_id") + 1, F.col("quality")), *(["doc_id"] if first else []))
    return readers.clone_corpus(spark, functions, pairs, first=first)


@_query(f"WITH {_CLONES}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY a) AS k FROM c) SELECT a::VARCHAR AS id_a, b::VARCHAR AS id_b, label FROM r WHERE k <= 15")
def clone_file(spark, sf_dir):
    """The first labelled pairs of each kind in a clone corpus."""
    return _clones(spark, sf_dir, 15).select("id_a", "id_b", "label")


@_query(f"WITH {_CLONES} SELECT label, least(20, count(*)) AS n, least(20, count(*)) AS n_different, least(20, count(*)) AS n_of_corpus FROM c GROUP BY 1")
def balanced_clones(spark, sf_dir):
    """As many pairs of one label as of the other, shuffled; all of them are pairs of the corpus."""
    every = _clones(spark, sf_dir).select("id_a", "id_b", "label")
    some = readers.balanced_pairs(every, 40, seed=5)
    known = every.distinct().withColumn("known", F.lit(1))
    out = some.join(known, ["id_a", "id_b", "label"], "left")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("id_a", "id_b").alias("n_different"), F.sum("known").alias("n_of_corpus"))


_OF_FILE = 1000


@_query(f"""SELECT p_partkey // {_OF_FILE} AS file, row_number() OVER (PARTITION BY p_partkey // {_OF_FILE} ORDER BY p_partkey) - 1 AS j, p_name || ' {{"a\\": "}}' AS doc, p_type AS code FROM part""")
def code_search_file(spark, sf_dir):
    """Records of files that are each one JSON array, over several lines, with braces and quotes in strings and objects within objects."""
    path, k = shared.folder(spark), F.col("p_partkey")
    part = _table(spark, sf_dir, "part").withColumn("file", F.floor(k / _OF_FILE))
    ends = part.groupBy("file").agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))
    record = F.to_json(F.struct(F.concat("p_name", F.lit(' {"a\\": "}')).alias("doc"), F.struct(F.struct(F.lit("}").alias("y")).alias("x")).alias("more"), F.col("p_type").alias("code")))
    line = F.concat(F.when(k == F.col("first"), "[").otherwise(""), record, F.when(k == F.col("last"), "]").otherwise(","))
    lines = part.join(ends, "file").select("file", "p_partkey", line.alias("value")).repartition("file").sortWithinPartitions("file", "p_partkey")
    lines.select("file", "value").write.partitionBy("file").text(path)
    found = readers.json_array(spark, f"{path}/*/", "doc string, code string")
    return found.select(F.regexp_extract("file", "file=([0-9]+)", 1).cast("long").alias("file"), "j", "r.doc", "r.code")


@_query(f"WITH {_EDGES} SELECT word, type, addr, round(score, 4) AS score FROM e")
def assertion_file(spark, sf_dir):
    """Edges summed from a compressed file of assertions, with lines that don't count."""
    part = _table(spark, sf_dir, "part")
    rel = F.when(F.col("p_size") % 3 == 0, "/r/RelatedTo").when(F.col("p_size") % 3 == 1, "/r/HasProperty").otherwise("/r/Antonym")
    uri = lambda k: F.concat(F.lit("/c/en/"), F.get(F.split("p_name", " "), F.lit(k)))
    weight = F.to_json(F.struct(F.col("p_size").cast("double").alias("weight")))
    line = F.concat(_lines(F.lit("/a"), rel, uri(0), uri(1), weight), F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("\nbad line\n"), _lines(F.lit("/a"), F.lit("/r/Other"), uri(0), uri(1), weight), F.lit("\n"), _lines(F.lit("/a"), rel, F.lit("/c/de/hund"), uri(1), weight))).otherwise(""))
    return graph.aggregate_edges(readers.assertions(spark, _text_file(part, line, compression="gzip")), lexicon.sample(spark)).withColumn("score", F.round("score", 4))


@_query("SELECT 'w ' || vec_id AS word, len(embedding) AS n, round(embedding[1]::DOUBLE, 5) AS first, vec_id % 3 = 0 AS asked FROM embeddings")
def vector_file(spark, sf_dir):
    """Vectors of text files, and which of them are there when some words only are asked for."""
    rows = _table(spark, sf_dir, "embeddings")
    word = F.concat(F.lit("/c/en/w_"), F.col("vec_id").cast("string"))
    line = F.concat_ws(" ", word, F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "))
    path = _text_file(rows, F.concat(F.when(F.col("vec_id") == 0, "9 9\nzero 0 0 0\nbad 1 x 2\n").otherwise(""), line))
    words = rows.where("vec_id % 3 = 0").select(F.concat(F.lit("w "), F.col("vec_id").cast("string")).alias("word"))
    some = readers.vector_text(spark, path, words).select("word", F.lit(True).alias("asked"))
    found = readers.vector_text(spark, path).join(some, "word", "left")
    return found.select("word", F.size("embedding").cast("long").alias("n"), F.round(F.col("embedding")[0], 5).alias("first"), F.coalesce("asked", F.lit(False)).alias("asked"))


_ASSOCIATED = f"""{_LEX}, n AS (SELECT row_number() OVER (ORDER BY word) - 1 AS id, word, addr FROM lex WHERE kind = 'text'), a AS (SELECT p_partkey % (SELECT count(*) FROM n) AS src, (p_partkey * 7 + p_size) % (SELECT count(*) FROM n) AS dst, p_size % 6 AS w FROM part),
    j AS (SELECT x.word AS a, x.addr AS xa, y.word AS b, y.addr AS ya, w * 0.12::DOUBLE AS s FROM a JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE w >= 2 AND x.addr <> y.addr),
    g AS (SELECT word, addr, sum(s) AS score FROM (SELECT a AS word, ya AS addr, s FROM j UNION ALL SELECT b, xa, s * 0.65::DOUBLE FROM j) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(score, 9) DESC, addr) AS r FROM g)"""


@_query(f"WITH {_ASSOCIATED} SELECT word, 'ASSOCIATED' AS type, count(*) AS n, round(sum(score), 6) AS score FROM k WHERE r <= 4 AND word NOT IN ('hot', 'cold', 'red') GROUP BY 1")
def association_file(spark, sf_dir):
    """Typed edges from a file of free associations, for words that have no edges yet."""
    words = lexicon.sample(spark).where("kind = 'text'").orderBy("word")
    names = _text_file(words, F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)")), "word")
    n = words.count()
    part = _table(spark, sf_dir, "part")
    adjacency = _text_file(part, _lines(F.col("p_partkey") % n, (F.col("p_partkey") * 7 + F.col("p_size")) % n, F.col("p_size") % 6))
    table, pairs = readers.association_graph(spark, names, adjacency)
    done = words.where("word in ('hot', 'cold', 'red')").select("word")
    edges = graph.associations(pairs, table, lexicon.sample(spark), kind="ASSOC", fill_only=done)
    return edges.groupBy("word", "type").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


_BUILDS = "VALUES ('first', false, 1), ('again', true, 1), ('other source', false, 2), ('invalid', false, 1), ('all invalid', false, 1), ('no cache', false, 1)"


@_query(f"""WITH b(run, hit, source) AS ({_BUILDS}), s AS (SELECT n_nationkey AS k, ((n_nationkey % 5) - 2) / 4 AS p FROM nation)
    SELECT run, hit, count(*) AS n, count(*) FILTER (p >= 0.25) AS positive FROM b JOIN s ON source = 1 OR k % 2 = 0 GROUP BY 1, 2""")
def cached_layers(spark, sf_dir):
    """A layer that is built, found again, and built anew when its source changes or it is said to be invalid."""
    cache = layers.LayerCache(spark, shared.folder(spark))
    score = (F.col("n_nationkey") % 5 - 2) / 4
    scores = _table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word"), F.lit(1).alias("sense"), F.greatest(score, F.lit(0.0)).alias("positive"), F.greatest(-score, F.lit(0.0)).alias("negative"), "n_nationkey")
    out = None
    for run, source, invalid, cached in (("first", scores, (), True), ("again", scores, (), True), ("other source", scores.where("n_nationkey % 2 = 0"), (), True), ("invalid", scores, ("sentiment",), True), ("all invalid", scores, ("all",), True), ("no cache", scores, (), False)):
        build = layers.Build(cache if cached else None, lexicon.sample(spark), {"sentiment": (source, layers.sentiment_layer)}, invalid)
        rows = shared.written(build.layer("sentiment").agg(F.count("*").alias("n"), F.count_if(F.col("polarity") == 3).alias("positive")))
        rows = rows.select(F.lit(run).alias("run"), F.lit(build.hits["sentiment"]).alias("hit"), "n", "positive")
        out = rows if out is None else out.union(rows)
    return out


_SECTIONS = """s AS (SELECT n_name AS name, n_regionkey AS section, avg(c_acctbal) / 10000 AS own, (avg(c_acctbal) + (n_nationkey % 3 - 1) * 150) / 10000 AS baseline FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, n_regionkey, n_nationkey)"""


def _sections(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mean = c.groupBy(F.col("n_name").alias("name"), F.col("n_regionkey").alias("section"), "n_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return mean.select("name", "section", (F.col("m") / 10000).alias("own"), ((F.col("m") + (F.col("n_nationkey") % 3 - 1) * 150) / 10000).alias("baseline"))


@_query(f"WITH {_SECTIONS}, v AS (SELECT *, CASE WHEN own - baseline > 0.01 THEN 'WIN' WHEN baseline - own > 0.01 THEN 'LOSE' ELSE 'TIE' END AS v FROM s) SELECT count(*) AS benchmarks, count(*) FILTER (v = 'WIN') AS wins, count(*) FILTER (v = 'TIE') AS ties, count(*) FILTER (v = 'LOSE') AS losses, round(avg(own), 6) AS own, round(avg(baseline), 6) AS baseline, round(avg(own) - avg(baseline), 6) AS difference FROM v")
def report_totals(spark, sf_dir):
    """Totals over benchmark sections, as a line of JSON that is read back."""
    path = shared.folder(spark)
    writers.report(evaluate.totals(_sections(spark, sf_dir), "own", "baseline"), path)
    rows = spark.read.schema("benchmarks long, wins long, ties long, losses long, own double, baseline double, difference double").json(path)
    return rows.withColumns({c: F.round(c, 6) for c in ("own", "baseline", "difference")})


@_query(f"WITH {_SECTIONS} SELECT section, count(*) AS n, round(avg(own), 6) AS mean FROM s GROUP BY 1")
def section_means(spark, sf_dir):
    return evaluate.category_means(_sections(spark, sf_dir), "section", "own").withColumn("mean", F.round("mean", 6))


@_query("SELECT p_partkey, p_size * 12 * 1000000 AS bytes FROM part")
def storage_estimates(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", evaluate.storage_estimate(F.col("p_size")).cast("long").alias("bytes"))


# --- scalar functions ---------------------------------------------------------------------------------------------------
_RELATION_NAMES = ["syn", "Is_A", "ctx", "zzz", "TOPICAL", "nb", "part_of", "ANTONYM"]
_TYPE_OF = {n: ({r: r for r in RELATIONS} | RELATION_ALIASES).get(n.upper(), "RELATED") for n in _RELATION_NAMES}


@_query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN 255 ELSE l_partkey % 20 END AS d, l_suppkey % 16 AS c, l_orderkey % 256 AS n, l_quantity::INT * 10 - 100 AS w, [{_quoted(_RELATION_NAMES)}][l_partkey % 8 + 1] AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, d = 255 AS nothing, CASE WHEN d < 19 THEN d * 65536 + c * 256 + n ELSE -1 END AS back, CASE WHEN d IN ({", ".join(str(DOMAINS[k][0]) for k, v in ROLES.items() if v == 2)}) THEN 2 WHEN d IN ({", ".join(str(DOMAINS[k][0]) for k, v in ROLES.items() if v == 3)}) THEN 3
        WHEN d IN ({", ".join(str(DOMAINS[k][0]) for k, v in ROLES.items() if v == 4)}) THEN 4 ELSE {DEFAULT_ROLE} END AS role, greatest(0, least(255, w)) AS weight, {_cases("r", _TYPE_OF, "'RELATED'")} AS type FROM x""")
def address_values(spark, sf_dir):
    """Addresses to text and back, null addresses, roles, clamped weights, names of relations."""
    d = F.when(F.col("l_partkey") % 11 == 0, 255).otherwise(F.col("l_partkey") % 20)
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codec.pack(d, F.col("l_suppkey") % 16, F.col("l_orderkey") % 256).alias("a"), (F.col("l_quantity").cast("int") * 10 - 100).alias("w"), F.element_at(F.array(*map(F.lit, _RELATION_NAMES)), (F.col("l_partkey") % 8 + 1).cast("int")).alias("r"))
    a = F.col("a")
    back = F.coalesce(codec.address_from_text(codec.address_text(a)), F.lit(-1))
    return rows.select("l_orderkey", "l_linenumber", codec.is_null_address(a).alias("nothing"), back.alias("back"), codec.role_of(a).alias("role"), codec.clamped_weight(F.col("w")).alias("weight"), codec.relation_type(F.col("r")).alias("type"))


@_query(f"SELECT l_linestatus AS s, l_returnflag AS f, {_cases('upper(d)', DIRECTIONS, '0')} AS direction, count(*) AS n FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'out' WHEN 'N' THEN 'tgt_to_src' ELSE 'other' END AS d FROM lineitem) GROUP BY 1, 2, 3")
def directions(spark, sf_dir):
    name = F.when(F.col("l_returnflag") == "A", "out").when(F.col("l_returnflag") == "N", "tgt_to_src").otherwise("other")
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("f"), codec.relation_direction(name).alias("direction")).agg(F.count("*").alias("n"))


@_query("""WITH x AS (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) || CASE p_partkey % 6 WHEN 0 THEN 'ing' WHEN 1 THEN 'ed' WHEN 2 THEN 'ly' WHEN 3 THEN '' WHEN 4 THEN 'est' ELSE ' two' END AS w FROM part)
    SELECT p_partkey, NOT contains(w, ' ') AND regexp_matches(w, '(ing|ed|est|ly|ies)$') AS inflected, CASE WHEN p_size / 7 >= 5 THEN 0 WHEN p_size / 7 >= 4 THEN 1 WHEN p_size / 7 >= 3 THEN 2 ELSE 3 END AS formality, p_size / 7 >= 2 AS common,
        CASE WHEN p_size % 10 = 9 THEN 1 WHEN (p_size - 25) / 25 <= -0.25 THEN 0 WHEN (p_size - 25) / 25 < 0 THEN 1 WHEN (p_size - 25) / 25 < 0.25 THEN 2 ELSE 3 END AS polarity, trim(lower(regexp_replace(' ' || w || '__X', '[_ ]+', ' ', 'g'))) AS plain FROM x""")
def word_hints(spark, sf_dir):
    """Inflected forms, formality by frequency, polarity by sentiment, words of free associations."""
    k = F.col("p_partkey") % 6
    w = F.concat(F.substring_index("p_name", " ", 1), F.when(k == 0, "ing").when(k == 1, "ed").when(k == 2, "ly").when(k == 3, "").when(k == 4, "est").otherwise(" two"))
    z, s = F.col("p_size") / 7, F.when(F.col("p_size") % 10 != 9, (F.col("p_size") - 25) / 25)
    return _table(spark, sf_dir, "part").select("p_partkey", text.looks_inflected(w).alias("inflected"), text.formality_from_frequency(z).alias("formality"), text.is_common(z).alias("common"), text.polarity_from_scores(s, F.lit(0.0)).alias("polarity"), text.plain_word(F.concat(F.lit(" "), w, F.lit("__X"))).alias("plain"))


@_query("WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type || ' ' || p_name[1:9]), ' ') AS b FROM part), n AS (SELECT p_partkey, len(list_intersect(a, b)) AS n FROM x) SELECT p_partkey, CASE WHEN n = 0 THEN 0 ELSE round(least(0.2, 0.1 + 0.02 * (n - 1)), 6) END::DOUBLE AS bonus FROM n")
def pattern_bonuses(spark, sf_dir):
    a, b = F.split("p_name", " "), F.split(F.lower(F.concat("p_type", F.lit(" "), F.substring("p_name", 1, 9))), " ")
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(text.pattern_bonus(a, b), 6).alias("bonus"))


@_query("SELECT x.vec_id, round(list_cosine_similarity(list_transform(x.embedding, lambda v: v::DOUBLE), list_transform(y.embedding, lambda v: v::DOUBLE)), 5) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def neighbour_cosines(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@_query("WITH t AS (SELECT c_custkey AS doc_id, unnest([c_nationkey, c_custkey, 100000000]) AS w FROM customer), v AS (SELECT vec_id AS w, embedding FROM embeddings), m AS (SELECT doc_id, k, avg(embedding[k]::DOUBLE) AS x FROM t JOIN v USING (w), (SELECT unnest([1, 2, 5]) AS k) GROUP BY 1, 2) SELECT doc_id, round(max(x) FILTER (k = 1), 5) AS x1, round(max(x) FILTER (k = 2), 5) AS x2, round(max(x) FILTER (k = 5), 5) AS x5 FROM m GROUP BY 1")
def mean_vectors(spark, sf_dir):
    """The mean of the vectors of a row's words."""
    words = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("long"), F.lit(100_000_000).cast("long"))).alias("word"))
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), "embedding")
    v = F.col("vector")
    return evaluate.mean_vectors(words, vectors).select("doc_id", F.round(v[0], 5).alias("x1"), F.round(v[1], 5).alias("x2"), F.round(v[4], 5).alias("x5"))


_KEYWORD_SQL = "k(language, word) AS (VALUES " + ", ".join(f"('{lang}', '{w}')" for lang, words in KEYWORDS.items() for w in dict.fromkeys(words.split())) + ")"


@_query(f"""WITH {_KEYWORD_SQL}, w AS (SELECT DISTINCT word FROM k UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT upper(event_type) FROM events UNION SELECT DISTINCT upper(word) FROM k), l AS (SELECT DISTINCT language FROM k UNION SELECT 'cobol')
    SELECT l.language, count(*) AS words, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE k.language = l.language AND (k.word = w.word OR k.word = lower(w.word)))) AS keywords FROM w, l GROUP BY 1""")
def keyword_counts(spark, sf_dir):
    """Which of many words are keywords, for each language."""
    every = sorted({w for words in KEYWORDS.values() for w in words.split()})
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, every))).alias("word"))
    words = fixed.union(fixed.select(F.upper("word"))).union(_table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1))).union(_table(spark, sf_dir, "events").select(F.upper("event_type"))).distinct()
    rows = words.select("word", F.explode(F.array(*map(F.lit, [*KEYWORDS, "cobol"]))).alias("language"))
    return rows.groupBy("language").agg(F.count("*").alias("words"), F.count_if(text.is_keyword(F.col("word"), F.col("language"))).alias("keywords"))


# --- words and code ----------------------------------------------------------------------------------------------------


@_query(f"""WITH {_PART}, u AS (SELECT p_partkey, z[2] AS pos, z[1] AS word FROM w WHERE z[1] IS NOT NULL AND z[1] NOT IN ({_quoted(STOP_WORDS)}) AND z[1] NOT IN (SELECT word FROM lex WHERE kind = 'text'))
    SELECT p.p_partkey, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS unknowns FROM part p LEFT JOIN u ON u.p_partkey = p.p_partkey GROUP BY 1""")
def unknown_tokens(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", F.array_join("unknowns", " ").alias("unknowns"))


@_query(f"WITH {_LEX}, q AS (SELECT p_partkey, upper(split_part(p_name, ' ', 2)) AS word FROM part) SELECT p_partkey, word FROM q WHERE lower(word) IN (SELECT word FROM lex WHERE kind = 'text')")
def known_words(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.upper(F.get(F.split("p_name", " "), F.lit(1))).alias("word"))
    return lexicon.contains(rows, "word", lexicon.sample(spark))


_DETACHED_SQL = "r(n, ending, new) AS (VALUES " + ", ".join(f"({n}, '{end}', '{new}')" for n, (end, new) in enumerate([("", ""), *DETACHED])) + ")"


@_query(f"""WITH {_LEX}, {_DETACHED_SQL}, q AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || CASE p_partkey % 6 WHEN 0 THEN 's' WHEN 1 THEN 'ing' WHEN 2 THEN 'ed' WHEN 3 THEN 'est' WHEN 4 THEN 'zz' ELSE '' END AS asked FROM part),
    c AS (SELECT p_partkey, asked, n, asked[:length(asked) - length(ending)] || new AS tried FROM q, r WHERE ends_with(asked, ending) AND (ending = '' OR length(asked) > length(ending) + 1)),
    f AS (SELECT p_partkey, arg_min(word, n) AS lemma, arg_min(addr, n) AS addr FROM c JOIN lex ON kind = 'text' AND word = tried GROUP BY 1)
    SELECT q.p_partkey, asked, coalesce(lemma, '') AS lemma, coalesce(addr, -1) AS addr FROM q LEFT JOIN f ON f.p_partkey = q.p_partkey""")
def lemmas(spark, sf_dir):
    """Words looked up without their endings."""
    k = F.col("p_partkey") % 6
    ending = F.when(k == 0, "s").when(k == 1, "ing").when(k == 2, "ed").when(k == 3, "est").when(k == 4, "zz").otherwise("")
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower(F.substring_index("p_name", " ", 1)), ending).alias("asked"))
    found = lexicon.lemma_lookup(rows, "asked", lexicon.sample(spark))
    return found.select("p_partkey", "asked", F.coalesce("lemma", F.lit("")).alias("lemma"), F.coalesce("addr", F.lit(-1)).alias("addr"))


_SNIPPET = f"""{_LEX}, x AS (SELECT DISTINCT p_type AS id, lower(split_part(p_type, ' ', 1)) AS w FROM part), m AS (SELECT id, unnest([('if', 1), ('fetch', 0), (w, 0), ('return', 1), ('old', 2), (w, 2), ('class', 1), ('xyz', 0)]) AS z FROM x),
    h AS (SELECT id, z[2] AS how, (SELECT count(*) > 0 FROM lex WHERE lex.word = z[1] AND (z[2] < 2 OR kind = 'text')) AS hit FROM m)"""


def _snippets(spark, sf_dir):
    types = _table(spark, sf_dir, "part").select(F.col("p_type").alias("id"), F.lower(F.substring_index("p_type", " ", 1)).alias("w")).distinct()
    source = F.concat(F.lit("if fetch_"), F.col("w"), F.lit("():  # note\n    return \"old "), F.col("w"), F.lit("\" + 'a' * 12\n  class xyz"))
    return code.encode_code(types.select("id", source.alias("source"), F.lit("python").alias("language")), lexicon.sample(spark), "id")


@_query(f"WITH {_SNIPPET}, c AS (SELECT id, count(*) FILTER (hit AND how = 1) AS s, count(*) FILTER (hit AND how <> 1) AS m FROM h GROUP BY 1) SELECT id, s AS structural, m AS semantic, round(s / (s + m), 6) AS density, s + m AS n_tokens FROM c")
def encode_snippets(spark, sf_dir):
    """Source code: keywords, parts of names and words of strings that the dictionary has, and the share of keywords."""
    plain = F.size(F.filter("tokens", lambda t: t["features"] == 0))
    return _snippets(spark, sf_dir).select("id", F.col("structural_count").alias("structural"), F.col("semantic_count").alias("semantic"), F.round("structural_density", 6).alias("density"), plain.cast("long").alias("n_tokens"))


@_query(f"WITH {_SNIPPET}, c AS (SELECT id, count(*) FILTER (hit) AS n, count(*) FILTER (hit AND how = 1) AS k FROM h GROUP BY 1) SELECT id, round(k / n, 6) >= 0.2 AS heavy, n FROM c")
def code_shares(spark, sf_dir):
    """Whether a fifth of a snippet's keywords and words stands in code domains: here, those that keywords have."""
    own = F.filter("tokens", lambda t: (t["features"] == 0) & ((t["role"] == 2) | ~codec.is_code(t["addr"])))
    rows = _snippets(spark, sf_dir).select("id", F.filter("tokens", lambda t: t["features"] == 0).alias("all"), own.alias("own"))
    share = F.size(F.filter("all", lambda t: t["role"] == 2)) / F.size("all")
    return rows.select("id", (F.round(F.least(share, align.code_share(F.col("all"))), 6) >= 0.2).alias("heavy"), F.size("all").cast("long").alias("n"))


# --- scores of pairs ------------------------------------------------------------------------------------------------------
_SCALE_SQL = "s(profile, type, scale, multiplier, antonym, lexical) AS (VALUES " + ", ".join(f"('{name}', '{r}', {align.profile(name).weight(r)}::DOUBLE, {align.profile(name).multiplier}::DOUBLE, {align.profile(name).antonym}::DOUBLE, {align.profile(name).lexical}::DOUBLE)" for name in PROFILES for r in RELATIONS) + ")"


@_query(f"""WITH {_SCALE_SQL}, x AS (SELECT n_nationkey AS k, [{_quoted(RELATIONS)}][n_nationkey % {len(RELATIONS)} + 1] AS type, (n_nationkey * 37) % 256 AS w, n_nationkey % 4 AS near FROM nation),
    h AS (SELECT *, CASE near WHEN 0 THEN 1.0 WHEN 1 THEN 0.45 WHEN 2 THEN 0.30 ELSE 0.0 END::DOUBLE AS h FROM x JOIN s USING (type)),
    t AS (SELECT *, CASE WHEN type = 'ANTONYM' THEN greatest(0, h - w / 255 * antonym) WHEN h >= 0.75 THEN h ELSE greatest(h, w / 255 * scale * multiplier) END AS t FROM h)
    SELECT k, profile, round(CASE WHEN lexical > 0 THEN (1 - lexical) * least(1, t) ELSE t END, 6) AS score FROM t""")
def relation_scores(spark, sf_dir):
    """Two tokens whose addresses are nearer or farther, one with an edge to the other, under every profile."""
    n = F.col("n_nationkey")
    q = 3 << 16
    own = F.when(n % 4 == 0, q + 2).when(n % 4 == 1, q + 1).when(n % 4 == 2, q + 257).otherwise(5 << 16)
    edge = F.struct(F.lit(q + 2).alias("addr"), (n * 37 % 256).cast("int").alias("weight"), F.element_at(F.array(*map(F.lit, RELATIONS)), (n % len(RELATIONS) + 1).cast("int")).alias("type"), F.lit(0).alias("direction"))
    token = lambda word, addr, edges: F.array(F.struct(F.lit(0).alias("pos"), F.lit(word).alias("word"), addr.alias("addr"), F.lit(85).alias("shade"), F.lit(1).alias("role"), F.lit(0).alias("features"), edges.alias("related"))).cast(f"array<{codec.TOKEN}>")
    rows = _table(spark, sf_dir, "nation").select(n.alias("k"), token("one", own, F.array(edge)).alias("a"), token("two", F.lit(q + 2), F.array().cast(lexicon.RELATED)).alias("b"))
    out = None
    for k, name in enumerate(PROFILES):
        way = align.align(F.col("a"), F.col("b"), name)["score"] if k % 2 else align.aligned_score(F.col("a"), F.col("b"), name)
        one = rows.select("k", F.lit(name).alias("profile"), F.round(way, 6).alias("score"))
        out = one if out is None else out.union(one)
    return out


_NEAR = "CASE WHEN t.addr = b.addr THEN 0.75::DOUBLE + 0.25::DOUBLE * (1 - abs(t.shade - b.shade) / 255) WHEN t.addr // 256 = b.addr // 256 THEN 0.40::DOUBLE + 0.05::DOUBLE * (1 - abs(t.shade - b.shade) / 255) WHEN t.domain = b.domain THEN 0.25::DOUBLE + 0.05::DOUBLE * (1 - abs(t.shade - b.shade) / 255) ELSE 0::DOUBLE END"


@_query(f"""WITH {_PART}, b AS (SELECT p_partkey, l.word, l.addr, l.domain, 64 + 16 * least(3, length(l.word) // 4) + 5 AS shade FROM part JOIN lex l ON l.kind = 'text' AND l.word = lower(p_type)),
    s AS (SELECT t.p_partkey, t.pos, t.word = b.word AS same, t.word, {_NEAR} AS score FROM t JOIN b ON b.p_partkey = t.p_partkey),
    m AS (SELECT p_partkey, coalesce(arg_min(score, pos) FILTER (score > 0), 0) AS best, count(*) AS n, count(DISTINCT word) AS words, max(same::INT) AS same FROM s GROUP BY 1),
    r AS (SELECT p_partkey, CASE WHEN n = 1 THEN 'topical' ELSE 'sentence' END AS profile, CASE WHEN n = 1 THEN best ELSE 0.32::DOUBLE * least(1, 2 * best / (n + 1)) + 0.68::DOUBLE * (2 * same / (words + 1)) END AS score FROM m)
    SELECT p_partkey, profile, round(score, 6) AS score FROM r""")
def compare_names(spark, sf_dir):
    """Texts compared under the profile that is chosen for each pair; the explanation begins with the score."""
    a = _parts(spark, sf_dir).where(F.size("tokens") > 0).withColumnRenamed("tokens", "tokens_a")
    b = encode.encode(_table(spark, sf_dir, "part").select("p_partkey", "p_type"), lexicon.sample(spark), "p_partkey", "p_type").where(F.size("tokens") > 0).withColumnRenamed("tokens", "tokens_b")
    pairs = align.compare(a.select("p_partkey", "tokens_a").join(b.select("p_partkey", "tokens_b"), "p_partkey"), bridge=True)
    said = align.explain(F.col("tokens_a"), F.col("tokens_b"), F.col("result"))
    agrees = F.substring_index(said, "\n", 1) == F.format_string("score %.4f", "result.score")
    score = F.when(agrees, F.round("result.score", 6))
    return pairs.select("p_partkey", align.profile_name(F.col("tokens_a"), F.col("tokens_b"), True).alias("profile"), score.alias("score"))


@_query("SELECT a.r_name AS a_r_name, b.r_name AS b_r_name, a.r_regionkey AS a_r_regionkey, b.r_regionkey AS b_r_regionkey FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def region_pairs(spark, sf_dir):
    return search.all_pairs(_table(spark, sf_dir, "region"), "r_regionkey", ["r_name"])


@_query(f"""WITH {_TYPED}, d AS (SELECT p_partkey, domain, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT p_partkey, sqrt(sum(n * n)) AS norm FROM d GROUP BY 1), s AS (SELECT p_partkey, list(DISTINCT addr) AS s FROM t GROUP BY 1),
    h AS (SELECT x.p_partkey, sum(x.n * y.n) AS dot FROM d x JOIN d y ON y.p_partkey = x.p_partkey + 1 AND y.domain = x.domain GROUP BY 1)
    SELECT x.p_partkey, round(coalesce(dot, 0) / (x.norm * y.norm), 6) AS cosine, round(0.5 * coalesce(dot, 0) / (x.norm * y.norm) + 0.5 * len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) AS similarity
    FROM g x JOIN g y ON y.p_partkey = x.p_partkey + 1 JOIN s a ON a.p_partkey = x.p_partkey JOIN s b ON b.p_partkey = y.p_partkey LEFT JOIN h ON h.p_partkey = x.p_partkey""")
def fingerprint_similarities(spark, sf_dir):
    """Each part's fingerprint against the next one's. The counts that fingerprints follow from are shuffled; no table is gathered on the driver, however small its file is."""
    rows = shared.written(_typed_parts(spark, sf_dir).where(F.size("tokens") > 0).select("p_partkey", fingerprint.counts(F.col("tokens")).alias("c")))
    pairs = rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("c").alias("d")).hint("merge"), "p_partkey")
    pairs = pairs.select("p_partkey", *[F.struct(fingerprint.top(F.col(c), 16).alias("top"), fingerprint.histogram(F.col(c)).alias("histogram")).alias(name) for c, name in (("c", "a"), ("d", "b"))])
    return pairs.select("p_partkey", F.round(fingerprint.histogram_cosine(F.col("a.histogram"), F.col("b.histogram")), 6).alias("cosine"), F.round(fingerprint.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@_query(f"WITH {_TYPED}, c AS (SELECT p_partkey, list_sort(list(DISTINCT addr)) AS s FROM t GROUP BY 1) SELECT p_partkey, min(p_partkey) OVER (PARTITION BY s) AS rep FROM c")
def clone_members(spark, sf_dir):
    """The classes of which clone_pairs has the representatives."""
    return fingerprint.class_members(_typed_parts(spark, sf_dir), 16, "p_partkey")


@_query("SELECT 2 * count(*) AS n, count(DISTINCT p_partkey) AS n_ids FROM part")
def index_size(spark, sf_dir):
    """Rows may be added to an index that has their ids already."""
    index = search.build(_parts(spark, sf_dir), "p_partkey")
    return index.unionByName(index).agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("n_ids"))


@_query("WITH t AS (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) SELECT c_custkey FROM t WHERE c_nationkey / 25 < c_acctbal / 10000 - 0.2 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def underrated_rows(spark, sf_dir):
    """Of the rows rated highest, those whose score is far below: the first ten."""
    top = _table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    return evaluate.extremes(top, F.col("c_nationkey") / 25 < F.col("c_acctbal") / 10000 - 0.2, F.desc("c_acctbal"), "c_custkey", 10).select("c_custkey")


@_query(f"""WITH {_PART}, s AS (SELECT p_partkey, list(DISTINCT addr) AS s FROM t GROUP BY 1) SELECT a.p_partkey, len(list_intersect(a.s, b.s)) AS both, len(list_distinct(a.s || b.s)) AS either, len(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS first_only
    FROM s a JOIN s b ON b.p_partkey = a.p_partkey + 1""")
def address_sets(spark, sf_dir):
    rows = _parts(spark, sf_dir).where(F.size("tokens") > 0).select("p_partkey", F.transform("tokens", lambda t: t["addr"]).alias("a"))
    pairs = rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    n = lambda c: F.size(c).cast("long")
    return pairs.select("p_partkey", n(F.array_intersect("a", "b")).alias("both"), n(F.array_union("a", "b")).alias("either"), n(F.array_except("a", "b")).alias("first_only"))


# --- the dictionary's build -----------------------------------------------------------------------------------------------


@_query("""WITH x AS (SELECT 'text' AS kind, lower(n_name) AS word, 6 * 65536 + n_regionkey * 256 + n_nationkey AS addr, n_regionkey * 100 + n_nationkey AS seq FROM nation UNION ALL SELECT 'text', 'country', 6 * 65536 + n_regionkey * 256 + n_nationkey, n_regionkey * 100 + n_nationkey FROM nation
    UNION ALL SELECT 'code', lower(r_name), 32 * 65536 + r_regionkey, r_regionkey FROM region UNION ALL SELECT 'code', 'zone', 32 * 65536 + r_regionkey, r_regionkey FROM region)
    SELECT kind, word, arg_min(addr, seq) AS addr, CASE kind WHEN 'code' THEN 2 ELSE 1 END AS formality, 1 AS polarity, 1 AS intensity FROM x GROUP BY 1, 2""")
def seed_dictionary(spark, sf_dir):
    """A dictionary of seed files: of a word with several places the first stays; code entries have a shade hint of their own."""
    folder = shared.folder(spark)
    seeds = [(r["n_regionkey"], r["n_nationkey"], [r["n_name"].lower(), "country"]) for r in _table(spark, sf_dir, "nation").orderBy("n_regionkey", "n_nationkey").collect()]  # some tens of seeds
    codes = [(0, r["r_regionkey"], [r["r_name"].lower(), "zone"]) for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    files = [shared.put(spark, f"{folder}/{name}.py", f'"""Seeds."""\n\nSEEDS = {rows!r}\n') for name, rows in (("people", seeds), ("flow", codes))]
    return readers.seed_files(spark, [("PE", files[0])], [("CF", files[1])]).select("kind", "word", "addr", "formality", "polarity", "intensity")


_NOUNS = [c for c in DOMAINS if c not in ("AC", "MV", "QU", "EM", "SN")]


@_query(f"""WITH {_LEX}, n AS (SELECT word, addr FROM lex WHERE kind = 'text' AND domain IN ({_quoted(_NOUNS)})),
    p AS (SELECT word, addr, CASE WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' WHEN regexp_matches(word, '[^aeiou]y$') THEN word[:-2] || 'ies' WHEN word LIKE '%f' AND length(word) >= 3 THEN word[:-2] || 'ves' WHEN word LIKE '%fe' THEN word[:-3] || 'ves' ELSE word || 's' END AS key FROM n WHERE NOT regexp_matches(word, '(ing|ed|est|ly|ies)$')),
    e AS (SELECT word AS key, word, addr, 0 AS r FROM n UNION ALL SELECT key, word, addr, 1 FROM p) SELECT key, arg_min(word, r || word) AS word, arg_min(addr, r || word) AS addr FROM e GROUP BY 1""")
def plural_rows(spark, sf_dir):
    """Nouns and their regular plurals."""
    nouns = lexicon.sample(spark).where((F.col("kind") == "text") & codec.domain_code(F.col("addr")).isin(_NOUNS))
    return lexicon.with_variants(nouns).select("key", "word", "addr")


@_query(f"""WITH {_LEX}, seeds AS (SELECT kind, word, addr FROM lex), d AS (SELECT 'text' AS kind, lower(n_name) AS word, 65536 * 6 + n_nationkey AS addr, n_nationkey AS k FROM nation), f AS (SELECT word, 1 AS formality, true AS common FROM (SELECT DISTINCT word FROM lex WHERE kind = 'text') WHERE length(word) % 2 = 0
        UNION ALL SELECT word, CASE WHEN k % 7 >= 5 THEN 0 WHEN k % 7 >= 4 THEN 1 WHEN k % 7 >= 3 THEN 2 ELSE 3 END, k % 7 >= 2 FROM d),
    m AS (SELECT s.kind, s.word, s.addr, CASE WHEN s.kind = 'code' THEN 2 ELSE coalesce(f.formality, 1) END AS formality FROM seeds s LEFT JOIN f ON f.word = s.word
        UNION ALL SELECT d.kind, d.word, d.addr, f.formality FROM d JOIN f ON f.word = d.word WHERE f.common AND d.word NOT IN (SELECT word FROM seeds WHERE kind = 'text')),
    p AS (SELECT word, CASE WHEN length(word) % 3 = 0 THEN 3 ELSE 0 END AS polarity FROM (SELECT DISTINCT word FROM lex WHERE kind = 'text') WHERE length(word) % 3 < 2),
    q AS (SELECT m.kind, m.word, m.addr, m.formality, CASE WHEN m.kind = 'text' THEN coalesce(p.polarity, 1) ELSE 1 END AS polarity FROM m LEFT JOIN p ON p.word = m.word),
    i AS (SELECT 'text' AS kind, 'saw' AS word, addr, formality, polarity FROM q WHERE kind = 'text' AND word = 'see' UNION ALL SELECT 'text', 'bought', addr, formality, polarity FROM q WHERE kind = 'text' AND word = 'buy')
    SELECT * FROM q UNION ALL SELECT * FROM i""")
def merged_dictionary(spark, sf_dir):
    """Seeds, derived words that are common, hints of layers, irregular forms."""
    seeds, nation = lexicon.sample(spark), _table(spark, sf_dir, "nation")
    derived = nation.select(F.lit("text").alias("kind"), F.lower("n_name").alias("word"), (F.lit(65536 * 6) + F.col("n_nationkey").cast("int")).alias("addr"), F.lit(1).alias("polarity"), F.lit(1).alias("formality"), F.lit(1).alias("intensity"), F.lit("").alias("synset"), F.expr(f"cast(array() as {lexicon.RELATED})").alias("related"))
    words = seeds.where("kind = 'text'").select("word").distinct()
    frequencies = words.where("length(word) % 2 = 0").select("word", F.lit(4.5).alias("zipf")).union(nation.select(F.lower("n_name"), (F.col("n_nationkey") % 7).cast("double")))
    scores = words.where("length(word) % 3 < 2").select("word", F.lit(1).alias("sense"), F.when(F.length("word") % 3 == 0, 0.5).otherwise(0.0).alias("positive"), F.when(F.length("word") % 3 == 0, 0.0).otherwise(0.5).alias("negative"))
    irregular = spark.createDataFrame([("saw", "see"), ("bought", "buy"), ("ate", "eat"), ("hot", "see")], "word string, lemma string")
    return layers.merge(seeds, derived, layers.sentiment_layer(scores), layers.formality_layer(frequencies), irregular).select("kind", "word", "addr", "formality", "polarity")


_BASES = "b(word, base) AS (VALUES ('hats', 'hat'), ('colder', 'cold'), ('plates', 'plate'), ('huger', 'huge'), ('cold', 'hot'))"


@_query(f"""WITH {_TOP}, k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, type, addr) AS rank FROM w), rel AS (SELECT word, string_agg(addr || ':' || weight, ' ' ORDER BY rank) AS related FROM k WHERE rank <= 4 GROUP BY 1), {_BASES},
    d AS (SELECT kind, word FROM lex UNION ALL SELECT 'text', unnest(['hats', 'colder', 'plates', 'huger'])) SELECT kind, d.word, coalesce(u.related, v.related, CASE WHEN d.word = 'tree' THEN '7:9' END, '') AS related FROM d LEFT JOIN rel u ON u.word = d.word LEFT JOIN b ON b.word = d.word LEFT JOIN rel v ON v.word = b.base""")
def stamped_relations(spark, sf_dir):
    """Relations on words, on variants of words that have some, and kept from before where there are none."""
    none = F.expr(f"cast(array() as {lexicon.RELATED})")
    kept = F.array(F.struct(F.lit(7).alias("addr"), F.lit(9).alias("weight"), F.lit("RELATED").alias("type"), F.lit(0).alias("direction"))).cast(lexicon.RELATED)
    more = spark.createDataFrame([(w,) for w in ("hats", "colder", "plates", "huger")], "word string").select(F.lit("text").alias("kind"), "word", F.lit(1).alias("addr"), F.lit(1).alias("polarity"), F.lit(1).alias("formality"), F.lit(1).alias("intensity"), F.lit("").alias("synset"), none.alias("related"))
    base = lexicon.sample(spark).withColumn("related", F.when(F.col("word") == "tree", kept).otherwise(F.col("related")))
    bases = spark.createDataFrame([("hats", "hat"), ("colder", "cold"), ("plates", "plate"), ("huger", "huge"), ("cold", "hot")], "word string, base string")
    out = graph.stamp(base.unionByName(more), graph.select_top(graph_edges(spark, sf_dir)), bases)
    return out.select("kind", "word", F.array_join(F.transform("related", lambda r: F.concat_ws(":", r["addr"].cast("string"), r["weight"].cast("string"))), " ").alias("related"))


_NETWORK = """RECURSIVE s AS (SELECT s_suppkey AS k, 's' || lpad(s_suppkey::VARCHAR, 6, '0') AS synset, s_nationkey AS nation FROM supplier), anchor AS (SELECT k, synset, nation AS addr FROM s WHERE nation < 6),
    up(k, place, depth) AS (SELECT k, k // 3, 1 FROM s WHERE k NOT IN (SELECT k FROM anchor) UNION ALL SELECT up.k, place // 3, depth + 1 FROM up WHERE place > 0 AND place NOT IN (SELECT k FROM anchor) AND depth < 30),
    found AS (SELECT synset, addr, 'anchor' AS how FROM anchor UNION ALL SELECT s.synset, anchor.addr, 'up' FROM up JOIN s ON s.k = up.k JOIN anchor ON anchor.k = up.place WHERE s.k <> 4),
    every AS (SELECT synset, addr, how FROM found UNION ALL SELECT synset, 4 * 65536, 'fallback' FROM s WHERE synset NOT IN (SELECT synset FROM found))"""


def _network(spark, sf_dir):
    """Suppliers as synsets, a third of whose number is what is above them; some nations are seed words."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("synset"), F.col("s_nationkey").alias("nation"))
    name = lambda k: F.concat(F.lit("s"), F.lpad(k.cast("string"), 6, "0"))
    edges = senses.ranked(s.where("k >= 3").select("synset", name(F.floor(F.col("k") / 3)).alias("neighbor"), F.lit("up").alias("kind")))
    words = s.select(F.concat(F.lit("w"), F.col("nation").cast("string")).alias("word"), "synset", F.col("k").alias("sense"), (F.col("k") % 2 == 0).alias("first"))
    seeds = spark.createDataFrame([(f"w{n}", n, n) for n in range(6)], "word string, addr int, seq int")
    known = senses.anchors(seeds, words)
    return s, words, seeds, senses.classify(s, known, edges, blocked=[f"s{4:06}"])


@_query(f"WITH {_NETWORK} SELECT synset, addr, how FROM every")
def sense_classes(spark, sf_dir):
    """Synsets with the address of the nearest seed above them."""
    return _network(spark, sf_dir)[3]


@_query("WITH s AS (SELECT 'w' || s_nationkey AS word, 's' || lpad(s_suppkey::VARCHAR, 6, '0') AS synset, s_suppkey % 2 AS odd, s_suppkey AS k FROM supplier) SELECT word, arg_min(synset, odd * 10000000 + k) AS synset FROM s WHERE word IN ('w0', 'w3', 'w9') GROUP BY 1")
def best_senses(spark, sf_dir):
    words = _network(spark, sf_dir)[1]
    return senses.best_synsets(spark.createDataFrame([("w0",), ("w3",), ("w9",), ("none",)], "word string"), words)


@_query(f"""WITH {_NETWORK}, l AS (SELECT e.synset, e.addr, 'l' || (s.k % 9) AS word, CASE WHEN s.k % 2 = 0 THEN 'n' ELSE 'v' END AS pos FROM every e JOIN s ON s.synset = e.synset),
    f AS (SELECT word, min(synset) AS synset, CASE word WHEN 'l3' THEN 77 ELSE arg_min(addr, synset) END AS addr FROM l GROUP BY 1), p AS (SELECT word, pos, min(synset) AS a FROM l GROUP BY 1, 2), o AS (SELECT l.word, l.addr, min(l.synset) AS a FROM l JOIN f ON f.word = l.word AND f.addr <> l.addr GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY a) AS n FROM o)
    SELECT f.word, f.synset, f.addr, (SELECT string_agg(pos, ' ' ORDER BY a) FROM p WHERE p.word = f.word) AS pos, coalesce((SELECT string_agg(addr::VARCHAR, ' ' ORDER BY n) FROM t WHERE t.word = f.word AND n <= 2), '') AS others FROM f""")
def sense_words(spark, sf_dir):
    """Words of the classified synsets: their address, parts of speech, and up to two other addresses."""
    s, _, _, classified = _network(spark, sf_dir)
    own = s.select("synset", F.concat(F.lit("l"), (F.col("k") % 9).cast("string")).alias("word"), F.when(F.col("k") % 2 == 0, "n").otherwise("v").alias("pos"))
    seeds = spark.createDataFrame([("l3", 77, 0)], "word string, addr int, seq int")
    return senses.words(classified, own, seeds).select("word", "synset", "addr", F.array_join("pos", " ").alias("pos"), F.array_join(F.transform("others", lambda a: a.cast("string")), " ").alias("others"))


# --- streams ----------------------------------------------------------------------------------------------------------------


@_query(f"""WITH {_PART} SELECT p.p_partkey, coalesce(s, '') AS sequence_text FROM part p LEFT JOIN (SELECT p_partkey, string_agg(address || ':' || upper(format('{{:02x}}', shade)), '·' ORDER BY pos) AS s FROM t GROUP BY 1) x ON p.p_partkey = x.p_partkey""")
def streaming_encode(spark, sf_dir):
    """Part names, encoded as a stream of files."""
    folder = shared.folder(spark)
    _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")).repartition(3).write.parquet(f"{folder}/in")
    source = spark.readStream.schema("doc_id long, text string").parquet(f"{folder}/in")
    streams.run_once(streams.encode_stream, source, lexicon.sample(spark), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select(F.col("doc_id").alias("p_partkey"), "sequence_text")
