"""Ranks, means, prototypes, clones and layers where a value, a list or a file is large or broken."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from semcodec.functions import codec
from semcodec.operators import evaluate, fingerprint, graph, senses, vectors
from semcodec.plans import layers
from semcodec.sources import readers


def test_rows_of_one_value_are_split(spark):
    rng = random.Random(1)
    rows = [(k, 5.0 if rng.random() < 0.9 else float(rng.randrange(10)), rng.random()) for k in range(4000)]
    frame = spark.createDataFrame(rows, "k int, v double, a double").withColumn("one", F.lit(1))
    placed = evaluate._before(frame, ["v", "k"], "one", "at")
    assert [r["k"] for r in sorted(placed.collect(), key=lambda r: r["at"])] == [k for k, *_ in sorted(rows, key=lambda r: (r[1], r[0]))]
    ranged = frame.repartitionByRange(4, "v", "k").where("v = 5").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) > 1 and max(r["count"] for r in ranged) < 0.5 * len(rows)
    by = {(r["c"], r["k"]): r["at"] for r in evaluate._before(frame.withColumn("c", F.col("k") % 3), ["v", "k"], "one", "at", "c").collect()}
    for c in range(3):
        own = sorted((v, k) for k, v, _ in rows if k % 3 == c)
        assert [by[c, k] for _, k in own] == list(range(len(own)))


def test_means_of_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"k{i % 7}" if i % 11 else None, rng.normal(size=5).tolist()) for i in range(300)] + [("zero", [0.0] * 5), ("none", None)]
    frame = spark.createDataFrame(rows, "key string, v array<double>").repartition(5)
    for held in (1, 10**6):
        monkeypatch.setattr(vectors, "HELD", held)
        for as_units in (False, True):
            found = {r["key"]: r["mean"] for r in vectors.means(frame, "key", "v", as_units=as_units).collect()}
            own = {}
            for k, v in rows:
                if v is not None and (any(v) or not as_units):
                    own.setdefault(k, []).append(np.array(v) / (np.linalg.norm(v) if as_units else 1))
            assert set(found) == set(own) and all(np.allclose(found[k], np.mean(own[k], axis=0)) for k in own)


def test_prototypes_in_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 40), rng.normal(size=8).tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    protos = graph.prototypes(frame, "label")
    whole = graph.nearest_prototypes(frame, protos, "vec_id", "label", least=0.0)
    split = graph.nearest_prototypes(frame, protos, "vec_id", "label", least=0.0, most_bytes=1024)
    rounded = lambda found: sorted((r["vec_id"], r["label"], round(r["cosine"], 9)) for r in found.collect())
    assert rounded(whole) == rounded(split) and len(rounded(whole)) > 400


@pytest.mark.parametrize("part", [1000, 3])
@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_clones_are_brute_force(spark, monkeypatch, part, threshold):
    monkeypatch.setattr(fingerprint, "PART", part)
    rng = random.Random(3)
    base = [rng.sample(range(40), rng.randint(1, 12)) for _ in range(12)]
    rows = [(k, [a if rng.random() < 0.9 else rng.randrange(40) for a in rng.choice(base)] if k % 9 else []) for k in range(120)]
    token = lambda a: (0, "w", a, 0, 1, 0, [])
    frame = spark.createDataFrame([(k, [token(a) for a in own]) for k, own in rows], f"doc_id long, tokens array<{codec.TOKEN}>")
    classes = {}
    for k, own in rows:
        if own:
            classes.setdefault(frozenset(own), k)
    sets = [(k, s) for s, k in classes.items()]
    expected = sorted((min(i, j), max(i, j), round(len(x & y) / len(x | y), 9)) for n, (i, x) in enumerate(sets) for j, y in sets[:n] if len(x & y) / len(x | y) >= threshold)
    found = fingerprint.clone_pairs(frame, threshold)
    assert sorted((r["a"], r["b"], round(r["jaccard"], 9)) for r in found.collect()) == expected and expected


def test_broken_layers_are_misses(spark, tmp_path):
    cache = layers.LayerCache(spark, str(tmp_path / "cache"))
    rows = spark.range(1000).select("id", F.col("id").cast("string").alias("word"))
    assert cache.get_or_build("seeds", "k1", lambda: rows)[1] is False and cache.get_or_build("seeds", "k1", lambda: rows)[1] is True
    folder = tmp_path / "cache" / f"v{layers.VERSION}" / "seeds"
    part = next((folder / "k1").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-40])
    assert cache.read("seeds", "k1") is None
    found, there = cache.get_or_build("seeds", "k1", lambda: rows)
    assert not there and found.count() == 1000 and cache.read("seeds", "k1", thorough=True).count() == 1000
    next((folder / "k1").glob("part-*")).unlink()
    assert cache.read("seeds", "k1") is None


def test_the_first_of_two_writers_stays(spark, tmp_path):
    cache = layers.LayerCache(spark, str(tmp_path / "cache"))
    first, second = spark.range(5), spark.range(7)
    assert cache.write("x", "k", first).count() == 5 and cache.write("x", "k", second).count() == 5
    folder = tmp_path / "cache" / f"v{layers.VERSION}" / "x"
    assert [p.name for p in folder.iterdir()] == ["k"]
    (folder / "k" / layers.NOTE).write_text("broken")
    assert cache.read("x", "k") is None and cache.write("x", "k", second).count() == 7
    assert not any(p.is_dir() for p in (folder / "k").iterdir())


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"name {k} " + "x" * (k % 90) for k in range(3000)]
    (tmp_path / "names.txt").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "40000")
    try:
        assert spark.read.text(str(tmp_path / "names.txt")).rdd.getNumPartitions() >= 3
        found = {r["id"]: r["value"] for r in readers.numbered_lines(spark, str(tmp_path / "names.txt")).collect()}
    finally:
        spark.conf.unset(key)
    assert found == dict(enumerate(lines))


def test_objects_of_an_array_over_splits(spark, tmp_path):
    rng = random.Random(4)
    odd = ["}", "{", '"', "\\", "\\\\", '\\"', "[", "]", ",", "a", "é", "\n", " "]
    word = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    rows = [{"doc": word(), "x": {"y": [{"z": word()}, {}]}, "code": word()} if k % 7 else {"doc": None} if k % 2 else {} for k in range(2000)]
    forms = {"one line": json.dumps(rows), "many lines": "\ufeff" + json.dumps(rows, indent=2, ensure_ascii=False) + "\n", "none": "[]\n", "one": json.dumps([rows[1]])}
    for name, body in forms.items():
        (tmp_path / f"{name}.json").write_text(body)
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "20000")
    try:
        for name, body in forms.items():
            path = str(tmp_path / f"{name}.json")
            own = [(k, r.get("doc"), r.get("code")) for k, r in enumerate(json.loads(body.lstrip("\ufeff")))]
            assert len(own) < 2000 or spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() >= 3
            assert sorted(map(tuple, readers.code_search_records(spark, path).collect()), key=lambda r: r[0]) == own
            assert sorted(map(tuple, readers.code_search_records(spark, path, 5).collect()), key=lambda r: r[0]) == own[:5]
    finally:
        spark.conf.unset(key)


def test_edges_of_senses_are_shuffled_once(spark):
    edges = spark.range(5000).select(F.col("id").cast("string").alias("synset"), F.floor(F.col("id") / 3).cast("string").alias("neighbor"), F.lit(0).alias("n"))
    last = spark.range(40).select(F.col("id").cast("string").alias("synset"), F.col("id").cast("int").alias("addr"))
    own = senses.placed(edges)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = senses.step(own, last)._jdf.queryExecution().sparkPlan().toString()
        prepared = senses.step(own, last)._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in prepared and "RepartitionByExpression" not in plan
        above = prepared.split("InMemoryRelation")[0]
        assert above.count("hashpartitioning(neighbor") == 1  # of last alone
        assert {r["synset"]: r["addr"] for r in senses.step(own, last).collect()} == {str(k): k // 3 for k in range(120)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        own.unpersist()


def test_relations_by_part_of_speech(spark):
    parts = spark.createDataFrame([("n1", "n"), ("v1", "v"), ("a1", "a"), ("s1", "s"), ("r1", "r"), ("x1", None)], "synset string, pos string")
    names = ("hypernym", "instance_hypernym", "verb_group", "similar", "antonym", "pertainym", "derived", "hyponym", "instance_hyponym", "also", "other", None)
    relations = spark.createDataFrame([(s, f"{r}{k}", r, 9 - k) for s in ("n1", "v1", "a1", "s1", "r1", "x1", "zz") for r in names for k in range(2)], "synset string, neighbor string, relation string, place int")
    found = {}
    for r in senses.network(relations, parts).orderBy("synset", "kind", "n").collect():
        found.setdefault((r["synset"], r["kind"]), []).append((r["neighbor"], r["branch"]))
    of = lambda *names: [(f"{r}{k}", 1 - k) for r in names for k in (1, 0)]
    adjective = {"up": of("similar", "antonym", "pertainym", "derived"), "down": of("also", "similar")}
    expected = {"n1": {"up": of("hypernym", "instance_hypernym"), "down": of("hyponym", "instance_hyponym")}, "v1": {"up": of("hypernym", "instance_hypernym", "verb_group"), "down": of("hyponym", "instance_hyponym")}, "a1": adjective, "s1": adjective, "r1": {"up": of("pertainym", "derived")}}
    assert found == {(s, kind): rows for s, kinds in expected.items() for kind, rows in (kinds | {"derived": of("derived")}).items()}
    assert senses.network(relations.limit(0), parts).count() == 0
