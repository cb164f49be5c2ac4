"""Operators on small rows: encoding, code, alignment, index, layers, readers, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from semcodec.functions import codec
from semcodec.operators import align, code, encode, evaluate, fingerprint, graph, lexicon, search
from semcodec.plans import layers
from semcodec.sources import readers, writers
from semcodec.streaming import encode as streams


def encoded(spark, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in encode.described(encode.encode(rows, lexicon.sample(spark), **options)).collect()}


def test_encode(spark):
    found = encoded(spark, "The very happy dogs, not sad!", "", None, "zzz qqq zzz", "binary search of a tree")
    assert [t["word"] for t in found[0]["tokens"]] == ["happy", "dog", "sad"]
    parts = [codec_parts(t["shade"]) for t in found[0]["tokens"]]
    assert parts[0][0] == 2 and parts[1][0] == 1 and parts[2][3] == 2
    assert found[1]["tokens"] == found[2]["tokens"] == [] and found[1]["byte_size"] == 8
    assert found[3]["unknowns"] == ["zzz", "qqq", "zzz"]
    assert found[4]["tokens"][-1]["role"] != 5  # "binary" isn't in the small dictionary, so no frame
    plain = encoded(spark, "not happy", context=False)
    assert [t["shade"] for t in plain[0]["tokens"]] == [0x55]


def codec_parts(value):
    return value >> 6 & 3, value >> 4 & 3, value >> 2 & 3, value & 3


def test_code(spark):
    rows = spark.createDataFrame([(1, 'def fetch_file(x):  # open\n    return "old dog"', "python"), (2, "", "python"), (3, None, "none")], "doc_id long, source string, language string")
    out = {r["doc_id"]: r for r in code.encode_code(rows, lexicon.sample(spark)).collect()}
    assert [t["word"] for t in out[1]["tokens"]] == ["def", "fetch", "file", "return", "old", "dog"]
    assert (out[1]["structural_count"], out[1]["semantic_count"], out[1]["unknowns"]) == (2, 4, ["x"])
    assert out[1]["structural_density"] == pytest.approx(1 / 3)
    assert out[2]["tokens"] == out[3]["tokens"] == [] and out[2]["structural_density"] == 0.0


def greedy(a, b):
    total, used = 0.0, set()
    for x in a:
        best, at = 0.0, None
        for j, y in enumerate(b):
            if j in used:
                continue
            near = 1 - abs(x[1] - y[1]) / 255
            s = 0.75 + 0.25 * near if x[0] == y[0] else 0.4 + 0.05 * near if x[0] >> 8 == y[0] >> 8 else 0.25 + 0.05 * near if x[0] >> 16 == y[0] >> 16 else 0.0
            if s > best:
                best, at = s, j
        if at is not None:
            used.add(at)
            total += best
    return total / max(len(a), len(b)) if a or b else 0.0


def test_alignment_is_greedy(spark):
    rng = random.Random(5)
    seq = lambda: [(rng.randrange(3) << 16 | rng.randrange(2) << 8 | rng.randrange(3), rng.randrange(256)) for _ in range(rng.randrange(6))]
    pairs = [(k, seq(), seq()) for k in range(60)]
    token = lambda t: (0, f"w{t[0]}", t[0], t[1], 1, 0, [])
    rows = spark.createDataFrame([(k, [token(t) for t in a], [token(t) for t in b]) for k, a, b in pairs], f"k int, a array<{codec.TOKEN}>, b array<{codec.TOKEN}>")
    out = rows.select("k", align.align(F.col("a"), F.col("b"))["score"].alias("s"), align.aligned_score(F.col("a"), F.col("b")).alias("l")).collect()
    for row in out:
        expected = greedy(*pairs[row["k"]][1:])
        assert row["s"] == pytest.approx(expected, abs=1e-9) and row["l"] == pytest.approx(expected, abs=1e-9)


def test_profiles():
    assert align.choose_profile("auto", False, False, 5, 50, 1.0) == "base"
    assert align.choose_profile("auto", True, False, 1, 1, 0.0) == "topical"
    assert align.choose_profile("auto", True, False, 3, 5, 0.0) == "sentence"
    assert align.choose_profile("auto", True, False, 3, 12, 0.0) == "code_search"
    assert align.choose_profile("strict", True, True, 1, 1, 1.0) == "strict"


def test_compare_and_explain(spark):
    rows = encoded(spark, "happy dog", "glad cat")
    pair = spark.createDataFrame([(rows[0]["tokens"], rows[1]["tokens"])], f"tokens_a array<{codec.TOKEN}>, tokens_b array<{codec.TOKEN}>")
    for options in ({}, {"bridge": True}, {"profile_name_": "strict"}):
        out = align.compare(pair, **options)
        assert 0.2 < out.first()["result"]["score"] <= 1.05
    line = out.select(align.explain(F.col("tokens_a"), F.col("tokens_b"), F.col("result"))).first()[0]
    assert "happy ~ glad" in line


def test_index(spark):
    docs = spark.createDataFrame([(0, "small dog"), (1, "red plate"), (2, "happy cat")], "doc_id long, text string")
    index = search.build(encode.encode(docs, lexicon.sample(spark)), "doc_id")
    query = encode.encode(spark.createDataFrame([(9, "dog")], "doc_id long, text string"), lexicon.sample(spark))
    assert [r["doc_id"] for r in search.search(index, query, top_k=1).collect()] == [0]
    assert search.search(index, query, domains=[]).count() == 0
    empty = encode.encode(spark.createDataFrame([(9, "")], "doc_id long, text string"), lexicon.sample(spark))
    assert [r["score"] for r in search.search(index, empty).collect()] == [0.0, 0.0, 0.0]


def test_fingerprints(spark):
    rows = encoded(spark, "happy walk", "happy tree")
    frame = spark.createDataFrame([(rows[0]["tokens"], rows[1]["tokens"])], f"a array<{codec.TOKEN}>, b array<{codec.TOKEN}>")
    prints = [fingerprint.fingerprint(frame.select(F.lit(1).alias("doc_id"), F.col(c).alias("tokens"))).first() for c in "ab"]
    assert prints[0]["total"] == 2 and prints[0]["fingerprint_bytes"] == 16
    top = "array<struct<address:string,n:int>>"
    pair = spark.createDataFrame([(prints[0]["top"], prints[1]["top"], prints[0]["histogram"], prints[1]["histogram"], [])], f"x {top}, y {top}, h map<string,int>, g map<string,int>, none {top}")
    out = pair.select(fingerprint.top_jaccard(F.col("x"), F.col("y")), fingerprint.top_jaccard(F.col("none"), F.col("none")), fingerprint.histogram_cosine(F.col("h"), F.col("h"))).first()
    assert out[0] == pytest.approx(1 / 3) and out[1] == 0.0 and out[2] == pytest.approx(1.0)


def test_seeds_are_unique():
    with pytest.raises(ValueError):
        lexicon.seed_rows("text EM 0 0 a\ntext EM 0 0 b")


def test_layers(spark, tmp_path):
    cache = layers.LayerCache(spark, f"file://{tmp_path}/cache")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "word string, x int")
    key = layers.rows_hash(rows)
    assert key == layers.rows_hash(rows.orderBy(F.desc("x"))) != layers.rows_hash(rows.where("x = 1"))
    assert [cache.get_or_build("one", key, lambda: rows)[1] for _ in range(2)] == [False, True]
    cache.clear()
    assert cache.read("one", key) is None
    scores = spark.createDataFrame([("happy", 1, 0.9, 0.0), ("sad", 1, 0.0, 0.8)], "word string, sense int, positive double, negative double")
    edges = spark.createDataFrame([("happy", "SYNONYM", 5, 2.0)], "word string, type string, addr int, score double")
    irregular = spark.createDataFrame([("ran", "run")], "word string, lemma string")
    build = layers.Build(cache, lexicon.sample(spark), {"sentiment": (scores, layers.sentiment_layer)})
    out = {r["word"]: r for r in build.run(irregular, edges).where("kind = 'text'").collect()}
    assert out["happy"]["polarity"] == 3 and out["sad"]["polarity"] == 0 and out["ran"]["addr"] == out["run"]["addr"]
    assert [(e["addr"], e["weight"]) for e in out["happy"]["related"]] == [(5, 255)]
    build.run()
    assert build.hits["sentiment"]
    kept = build.run(previous=build.run(irregular, edges)).where("word = 'happy'").first()
    assert len(kept["related"]) == 1


def test_dictionary_file(spark, tmp_path):
    body = {"entries": {"foo": {"d": "EM", "c": 1, "n": 2, "s": {"p": 3}, "trel": [["SYN", "AC001", 300], ["bad"]]}, "bar": {"d": "??", "c": 1, "n": 1}}, "code_entries": {"baz": {"d": "CF", "c": 0, "n": 1, "rel": [["EM106", 10]]}}}
    (tmp_path / "d.json").write_text(json.dumps(body))
    (tmp_path / "e.json").write_text(json.dumps({"entries": {"FOO": {"d": "QU", "c": 0, "n": 0}}}))
    rows = {r["word"]: r for r in readers.dictionary_json(spark, str(tmp_path / "d.json")).collect()}
    assert set(rows) == {"foo", "baz"} and rows["foo"]["addr"] == 258 and (rows["foo"]["polarity"], rows["foo"]["intensity"]) == (3, 1)
    assert [(e["addr"], e["weight"], e["type"]) for e in rows["foo"]["related"]] == [(0x010001, 255, "SYNONYM")]
    assert [(e["addr"], e["weight"], e["type"]) for e in rows["baz"]["related"]] == [(262, 10, "RELATED")]
    over = readers.dictionaries(spark, str(tmp_path / "d.json"), [str(tmp_path / "e.json")])
    assert over.where("word = 'foo'").first()["addr"] == 0x030000
    writers.dictionary_json(over, str(tmp_path / "out"))
    back = readers.dictionary_json(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, over.collect())) and back.count() == 2


def test_readers(spark, tmp_path):
    write = lambda name, body: (tmp_path / name).write_text(body) and str(tmp_path / name)
    assert [tuple(r) for r in readers.word_pairs(spark, write("p", "# note\na\tb\t1.5\nx\ty\nc\td\tno\n")).collect()] == [("a", "b", 1.5)]
    assert [tuple(r) for r in readers.sentence_pairs(spark, write("s", "2.5\tone two\tthree\n")).collect()] == [("one two", "three", 2.5)]
    assert [tuple(r) for r in readers.relatedness_pairs(spark, write("r", "id\ta\tb\tscore\n1\tx\ty\t4.0\n")).collect()] == [("x", "y", 4.0)]
    assert readers.corpus_jsonl(spark, write("c", '{"id":"1","content":"x"}\n\n')).count() == 1
    rows = readers.assertions(spark, write("g", '/a\t/r/IsA\t/c/en/dog\t/c/en/cat\t{"weight": 2.0}\n/a\t/r/IsA\t/c/en/dog\t/c/en/tree\t{}\nbad\n'))
    assert [r["weight"] for r in rows.collect()] == [2.0, 1.0]
    edges = graph.aggregate_edges(rows, lexicon.sample(spark))
    assert {(r["word"], r["type"]) for r in edges.collect()} == {("dog", "ISA"), ("cat", "ISA"), ("tree", "ISA")}
    assert readers.vector_text(spark, write("v", "2 3\n/c/en/hot_dog 1 2 3\nzero 0 0 0\nbad 1 x 2\n")).collect()[0]["word"] == "hot dog"
    names, adjacency = readers.association_graph(spark, write("n", "A\nb\n"), write("a", "0\t1\t5\n"))
    assert {(r["word"], r["other"]) for r in graph.associations(adjacency, names).collect()} == {("a", "b"), ("b", "a")}
    seeds = readers.seed_files(spark, [("EM", write("em", 'SEEDS = [(0, 1, ["joy", "glee"])]'))], [])
    assert {r["word"] for r in seeds.collect()} == {"joy", "glee"}
    (tmp_path / "adapters").mkdir()
    (tmp_path / "adapters/x.json").write_text(json.dumps({"name": "x", "profile": {"antonym_penalty": 0.5, "relation_scale": {"SYN": 0.1}}, "frames": [{"name": "f", "codon": "EM001", "groups": [["A"]]}]}))
    profiles, frames = readers.adapter_files(spark, str(tmp_path / "adapters"))
    assert profiles["x"].antonym == 0.5 and profiles["x"].weight("SYNONYM") == 0.1 and frames == [("f", "EM001", ["a"])]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(0, "happy dog"), (1, "zzz")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.run_once(streams.encode_stream, source, lexicon.sample(spark), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r["doc_id"]: r["sequence_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = encoded(spark, "happy dog", "zzz")
    assert got == {k: r["sequence_text"] for k, r in expected.items()}


def test_measures(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.5), (0, 0.1)], "label int, score double")
    assert evaluate.best_f1(rows).first()["f1"] == 1.0
    assert evaluate.spearman(rows, "label", "score").first()["rho"] == pytest.approx(0.894427, abs=1e-5)
    scores = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.1), (1, 1, 0.9)], "q int, j int, score double").withColumn("gold", F.col("q"))
    assert evaluate.mean_reciprocal_rank(scores).first()["mrr"] == pytest.approx(0.75)
    assert spark.range(1).select(evaluate.verdict(F.lit(0.5), F.lit(0.495))).first()[0] == "TIE"


def test_windowed_counts(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'hot plate' AS text UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'hot' UNION ALL SELECT timestamp'2024-01-01 09:00:00', 'cold'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.run_once(streams.count_stream, source, lexicon.sample(spark), str(tmp_path / "out"), str(tmp_path / "check"), "text", "ts")
    got = {r["address"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"QU500": 2, "OB905": 1}  # the last window isn't over yet
