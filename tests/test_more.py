"""The command line, long alignments under every profile, layers, senses, dictionaries' folders."""

import json
import random
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semcodec import cli
from semcodec.functions import codec, text
from semcodec.functions.constants import PROFILES, RELATIONS
from semcodec.operators import align, encode, evaluate, kernel, lexicon, senses
from semcodec.sources import readers, writers


def run(capsys, *args):
    capsys.readouterr()
    code = cli.main(list(args))
    return code, capsys.readouterr().out.strip()


def test_command_line(spark, capsys, tmp_path):
    code, out = run(capsys, "encode", "happy dog")
    assert code == 0 and out == "EM000:55·NA000:45"
    assert run(capsys, "encode", "happy dog", "--format", "hex")[1].startswith("5353030800020000")
    assert json.loads(run(capsys, "encode", "happy zzz", "--format", "json")[1])["unknowns"] == ["zzz"]
    (tmp_path / "x.py").write_text("def fetch(): return")
    assert "CF402" in run(capsys, "--language", "python", "encode", "--file", str(tmp_path / "x.py"))[1]
    assert float(run(capsys, "compare", "happy dog", "glad puppy")[1]) > 0.9
    assert run(capsys, "compare", "happy dog", "glad cat", "--explain")[1].startswith("score 0.")
    assert run(capsys, "inspect", "dog")[1].split("\t")[:3] == ["text", "dog", "NA000"]
    assert run(capsys, "inspect", "zzzz")[0] == 1
    entry = json.loads(run(capsys, "inspect", "Dogs", "--json")[1])
    assert {k: entry[k] for k in ("found", "token", "address", "domain", "category", "concept", "shade")} == {"found": True, "token": "Dogs", "address": "NA000", "domain": "NA", "category": 0, "concept": 0, "shade": "45"}
    assert entry["synonyms"] == sorted(entry["synonyms"]) and "puppy" in entry["synonyms"] and "dog" not in entry["synonyms"]
    assert run(capsys, "inspect", "zzzz", "--json") == (1, '{"found":false,"token":"zzzz"}')
    shown = json.loads(run(capsys, "encode", "happy dog", "--format", "json")[1])
    assert shown == {"sequence": "EM000:55·NA000:45", "byte_size": 72, "tokens": [{"word": "happy", "address": "EM000", "shade": "55"}, {"word": "dog", "address": "NA000", "shade": "45"}], "unknowns": []}
    of_code = json.loads(run(capsys, "encode", "--file", str(tmp_path / "x.py"), "--mode", "auto", "--format", "json")[1])
    assert of_code["language"] == "python" and of_code["structural_count"] >= 1 and of_code["structural_density"] == round(of_code["structural_count"] / (of_code["structural_count"] + of_code["semantic_count"]), 3)
    assert run(capsys, "encode", "def x", "--mode", "code")[1] == run(capsys, "--language", "python", "encode", "def x")[1]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": str(k), "content": t}) for k, t in enumerate(("small dog", "red plate", "happy cat"))))
    found = [json.loads(x) for x in run(capsys, "search", "dog", "--corpus", str(tmp_path / "c.jsonl"), "--top", "1")[1].splitlines()]
    assert [x["id"] for x in found] == ["0"]


def test_command_line_build(spark, capsys, tmp_path):
    (tmp_path / "em.py").write_text('SEEDS = [(0, 0, ["joy", "glee"]), (0, 1, ["woe"])]')
    (tmp_path / "sentiment.tsv").write_text("joy\t1\t0.9\t0.0\nwoe\t1\t0.0\t0.9\n")
    (tmp_path / "irregular.tsv").write_text("joyed\tjoy\n")
    args = ["build", str(tmp_path / "out"), "--seeds", f"EM={tmp_path}/em.py", "--sentiment", str(tmp_path / "sentiment.tsv"), "--irregular", str(tmp_path / "irregular.tsv"), "--cache", f"file://{tmp_path}/cache"]
    assert run(capsys, *args) == (0, "sentiment: built")
    assert run(capsys, *args) == (0, "sentiment: cached")
    assert run(capsys, *args, "--invalidate", "sentiment") == (0, "sentiment: built")
    assert run(capsys, *args, "--no-cache") == (0, "sentiment: built")
    rows = {r["word"]: r for r in readers.dictionary_json(spark, str(tmp_path / "out")).collect()}
    assert set(rows) == {"joy", "glee", "woe", "joyed"} and (rows["joy"]["polarity"], rows["woe"]["polarity"], rows["glee"]["polarity"]) == (3, 0, 1)
    assert run(capsys, "--dictionary", str(tmp_path / "out"), "inspect", "joyed")[1].startswith("text\tjoyed\tEM000")


def sequences(rng, most):
    edge = lambda: (rng.randrange(2) << 16 | rng.randrange(2) << 8 | rng.randrange(3), rng.randrange(256), rng.choice(RELATIONS), 0)
    token = lambda: (0, rng.choice(("w1", "w2", "W3", "")), rng.choice((0, 1, 0x20)) << 16 | rng.randrange(2) << 8 | rng.randrange(3), rng.randrange(256), 1, 0, [edge() for _ in range(rng.randrange(3))])
    return [[token() for _ in range(rng.randrange(most))] for _ in range(2)]


@pytest.mark.parametrize("name", PROFILES)
@pytest.mark.parametrize("code_aware", [False, True])
def test_aligned_is_the_fold(spark, name, code_aware):
    rng = random.Random(5)
    rows = [(k, *sequences(rng, 6)) for k in range(25)]
    pairs = spark.createDataFrame(rows, f"k int, a array<{codec.TOKEN}>, b array<{codec.TOKEN}>")
    a, b = F.col("a"), F.col("b")
    for row in pairs.select(align.align(a, b, name, code_aware=code_aware).alias("fold"), align.aligned(a, b, name, code_aware=code_aware).alias("own"), align.aligned_score(a, b, name, code_aware=code_aware).alias("score")).collect():
        fold, own = row["fold"].asDict(True), row["own"].asDict(True)
        assert own.pop("score") == pytest.approx(fold.pop("score"), abs=1e-9) and row["score"] == pytest.approx(row["own"]["score"], abs=1e-12)
        assert [(m["i"], m["j"]) for m in own.pop("matches")] == [(m["i"], m["j"]) for m in fold.pop("matches")] and own == fold


def step_by_step(a, b, p, code_aware):
    """The greedy alignment of two lists of tokens, one pair at a time."""
    score = lambda x, y: kernel.class_scores(kernel.Tokens(pa.array([[x]], TOKENS)), np.array([0]), kernel.Tokens(pa.array([[y]], TOKENS)), np.array([0]), p, code_aware)[0, 0]
    used, out = set(), []
    for i, x in enumerate(a):
        best, at = 0.0, None
        for j, y in enumerate(b):
            s = score(x, y) if j not in used else 0.0
            s = s + 0.05 * (1 - abs(i / len(a) - j / len(b))) if code_aware and s > 0 else s
            best, at = (s, j) if s > best else (best, at)
        if at is not None:
            used.add(at)
            out.append((i, at))
    return out


TOKENS = pa.list_(pa.struct([("addr", pa.int32()), ("shade", pa.int32()), ("word", pa.string()), ("related", pa.list_(pa.struct([("addr", pa.int32()), ("weight", pa.int32()), ("type", pa.string())])))]))


@pytest.mark.parametrize("cells", [1 << 21, 200])
def test_kernel_settles_conflicts_of_any_length(monkeypatch, cells):
    monkeypatch.setattr(kernel, "CELLS", cells)
    rng = random.Random(cells)
    token = lambda: {"addr": rng.randrange(2) << 16 | rng.randrange(3) << 8 | rng.randrange(4), "shade": rng.randrange(4), "word": "w", "related": [{"addr": rng.randrange(4), "weight": 200, "type": rng.choice(("ISA", "ANTONYM"))}] if rng.random() < 0.2 else []}
    sides = [[[token() for _ in range(rng.choice((0, 1, 3, 12, 30)))] for _ in range(24)] for _ in range(2)]
    a, b = (pa.array([*side, None], TOKENS) for side in sides)
    names = [rng.choice(("base", "sentence", "code_search")) for _ in range(25)]
    profiles = {n: align.profile(n) for n in names}
    for code_aware in (False, True):
        found = kernel.matches(a, b, [profiles[n] for n in names], code_aware).to_pylist()
        assert kernel.scores(a, b, [profiles[n] for n in names], code_aware).tolist() == [m["score"] for m in found]
        for x, y, n, m in zip(*sides, names, found):
            own = step_by_step(x, y, profiles[n], code_aware)
            assert [(k["i"], k["j"]) for k in m["matches"]] == own
            assert m["unmatched_a"] == sorted(set(range(len(x))) - {i for i, _ in own}) and m["unmatched_b"] == sorted(set(range(len(y))) - {j for _, j in own})
        assert found[-1] == {"score": 0.0, "matches": [], "unmatched_a": [], "unmatched_b": []}


def test_kernel_is_quick():
    rng = random.Random(1)
    token = lambda: {"addr": rng.randrange(4) << 16 | rng.randrange(6) << 8 | rng.randrange(8), "shade": rng.randrange(256), "word": "w", "related": []}
    a, b = (pa.array([[token() for _ in range(150)] for _ in range(400)], TOKENS) for _ in range(2))
    began = time.process_time()
    kernel.scores(a, b, [align.profile("base")] * 400, False)
    assert 400 / (time.process_time() - began) > 326  # pairs a second on one core


def test_scores_of_any_length(spark):
    texts = [(0, "happy dog", "glad cat"), (1, "happy dog sad cat " * 40, "glad puppy tree " * 50)]
    rows = spark.createDataFrame(texts, "k int, x string, y string")
    a, b = (encode.encode(rows, lexicon.sample(spark), "k", c).select("k", F.col("tokens").alias(c)) for c in "xy")
    found = {r["k"]: r["score"] for r in align.align_score(a.join(b, "k"), "x", "y", "sentence").collect()}
    assert set(found) == {0, 1} and all(0 < s <= 1 for s in found.values())


def test_lemmas(spark):
    rows = spark.createDataFrame([("dogs",), ("walking",), ("seen",), ("houses",), ("Happy",), (None,), ("boxes",)], "w string")
    found = {r["w"]: r["lemma"] for r in lexicon.lemma_lookup(rows, "w", lexicon.sample(spark)).collect()}
    assert found == {"dogs": "dog", "walking": "walk", "seen": None, "houses": "house", "Happy": "happy", None: None, "boxes": "box"}
    assert spark.range(1).select(text.lemma_candidates(F.lit("s"))).first()[0] == ["s"]


def test_ranks_without_one_window(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.randrange(50)), rng.random(), rng.randrange(3)) for k in range(500)]
    frame = spark.createDataFrame(rows, "k int, a double, b double, c int")
    import pandas as pd

    local = frame.toPandas()
    assert evaluate.spearman(frame, "a", "b").first()["rho"] == pytest.approx(pd.Series(local["a"]).rank().corr(pd.Series(local["b"]).rank()))
    placed = {r["k"]: r["at"] for r in evaluate._before(frame.withColumn("one", F.lit(1)), ["a", "k"], "one", "at").collect()}
    assert [k for k, _ in sorted(placed.items(), key=lambda x: x[1])] == [k for k, *_ in sorted(rows, key=lambda r: (r[1], r[0]))] and sorted(placed.values()) == list(range(500))
    plan = evaluate.spearman(frame, "a", "b")._jdf.queryExecution().toString()
    assert "No Partition Defined" not in plan
    assert evaluate.spearman(frame.limit(0), "a", "b").first()["n"] == 0


def test_default_dictionary_needs_a_base(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.default_dictionary(spark, str(tmp_path))


def test_written_dictionary_keeps_relations(spark, tmp_path):
    base = lexicon.sample(spark)
    edge = F.array(F.struct(F.lit(0x10203).alias("addr"), F.lit(9).alias("weight"), F.lit("ISA").alias("type"), F.lit(2).alias("direction"))).cast(lexicon.RELATED)
    old = base.where("word = 'tree'").withColumn("related", edge)
    writers.dictionary_json(base, str(tmp_path / "d"), previous=old)
    found = readers.dictionary_json(spark, str(tmp_path / "d"))
    assert found.count() == base.count()
    assert [tuple(e) for r in found.where("word = 'tree' and kind = 'text'").collect() for e in r["related"]] == [(0x10203, 9, "ISA", 2)]


def test_senses_step_by_step(spark):
    rng = random.Random(3)
    names = [f"s{k:03}" for k in range(60)]
    edges = [(a, b, "up", n) for a in names for n, b in enumerate(rng.sample(names, 2))]
    anchors = {"s001": 1, "s010": 2, "s030": 3}
    known, level = dict(anchors), set(anchors)
    for _ in range(30):
        new = {}
        for a, b, _, n in sorted(edges, key=lambda e: (e[0], e[3], e[1])):
            if a not in known and b in level and a not in new:
                new[a] = known[b]
        known |= new
        level = set(new)
    frame = spark.createDataFrame(edges, "synset string, neighbor string, kind string, n int")
    found = senses.classify(spark.createDataFrame([(n,) for n in names], "synset string"), spark.createDataFrame(list(anchors.items()), "synset string, addr int"), frame)
    fallback = 4 << 16
    assert {r["synset"]: r["addr"] for r in found.collect()} == {n: known.get(n, fallback) for n in names}


def test_balanced_pairs(spark):
    rows = spark.createDataFrame([(f"a{k}", f"b{k}", int(k % 3 == 0)) for k in range(90)], "id_a string, id_b string, label int")
    one, again, other = (readers.balanced_pairs(rows, 20, seed=s).collect() for s in (1, 1, 2))
    assert one == again != other and sum(r["label"] for r in one) == 10 and len(one) == 20
    assert [r["label"] for r in one] != sorted((r["label"] for r in one), reverse=True)


def test_entry_without_training_data_operators(monkeypatch):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "address_histogram" in sys.modules["semcodec.queries"].QUERIES
