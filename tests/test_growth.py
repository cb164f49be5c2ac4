"""Work that grows with the rows, where it grew with their square."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from semcodec.operators import align, encode, kernel, lexicon, senses

TOKENS = pa.list_(pa.struct([("addr", pa.int32()), ("shade", pa.int32()), ("related", pa.list_(pa.struct([("addr", pa.int32()), ("weight", pa.int32()), ("type", pa.string())])))]))
KINDS = ["SYNONYM", "ANTONYM", "CAUSES", "IS_A", "ODD"]


def _tokens(rng, n, edges=4, addresses=40):
    edge = lambda: {"addr": int(rng.choice([rng.integers(addresses) << 8, 255 << 16])), "weight": int(rng.integers(256)), "type": str(rng.choice(KINDS))}
    return [{"addr": int(rng.integers(addresses)) << 8, "shade": int(rng.integers(256)), "related": [edge() for _ in range(rng.integers(edges + 1))]} for _ in range(n)]


def test_cells_are_the_table(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = (kernel.Tokens(pa.array([_tokens(rng, 40)], TOKENS)) for _ in "ab")
    every_a, every_b = np.arange(len(a.addr)), np.arange(len(b.addr))
    x, y = np.repeat(every_a, len(every_b)), np.tile(every_b, len(every_a))
    for cells in (kernel.CELLS, 7):
        monkeypatch.setattr(kernel, "CELLS", cells)
        for p in (align.Profile(), align.profile("topical"), align.Profile(hierarchy=0.5, antonym=0.4)):
            for code_aware in (False, True):
                table = kernel.class_scores(a, every_a, b, every_b, p, code_aware)
                assert np.array_equal(kernel.cell_scores(a, x, b, y, p, code_aware), table.ravel()) and table.any()
    assert len(kernel.cell_scores(a, x[:0], b, y[:0], p, False)) == 0


def test_pairs_of_many_distinct_tokens_with_edges_are_quick():
    """Of 4,000 pairs of single tokens only 4,000 of 16 million cells are needed."""
    side = lambda at: pa.array([[{"addr": at << 16, "shade": 85, "related": [{"addr": 3 << 16 | 2, "weight": k % 256, "type": KINDS[k % 5]}, {"addr": k, "weight": 255, "type": "SYNONYM"}]}] for k in range(4000)], TOKENS)
    start = time.process_time()
    found = kernel.scores(side(5), side(6), [align.profile("topical")] * 4000, False)
    assert time.process_time() - start < 1.5 and (found > 0).sum() > 1000


def test_no_table_of_synsets_is_gathered_on_the_driver(spark):
    edges = spark.createDataFrame([("a", "b", "hypernym"), ("b", "c", "hypernym")], "synset string, neighbor string, relation string")
    parts = spark.createDataFrame([("a", "n"), ("b", "n")], "synset string, pos string")
    known = spark.createDataFrame([("c", 7)], "synset string, addr int")
    rows = senses.network(edges, parts)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert plan(rows).count("BroadcastHashJoin") == 1  # the fixed rules
    assert "BroadcastHashJoin" not in plan(senses.step(edges.withColumn("n", F.lit(0)), known))
    found = {r["synset"]: (r["addr"], r["how"]) for r in senses.classify(parts, known, rows).collect()}
    assert found == {"a": (7, "up"), "b": (7, "up"), "c": (7, "anchor")}


def test_words_outside_of_a_large_dictionary_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "BROADCAST_BYTES", 10)
    own = lexicon.sample(spark).withColumn("synset", F.lit(""))
    docs = spark.createDataFrame([(1, "zebra happy unicorn dogs qwerty " * 50), (2, None), (3, "qwerty")], "doc_id long, text string")
    split = encode._told_apart(docs.select(F.col("doc_id").alias("id"), "text"), lexicon.prepared(own), False)
    assert sum(len(r["some"]) for r in split.collect()) < 130  # of 251 words, 100 are in it
    for exact in (True, False):
        if not exact:  # a map that lets words pass that aren't keys
            monkeypatch.setattr(lexicon, "key_filter", lambda table: (lambda w: w, lambda words: F.transform(words, lambda w: ~w.startswith("q"))))
        found = {r["doc_id"]: ([t["word"] for t in r["tokens"]], r["unknowns"]) for r in encode.encode(docs, own, context=False).collect()}
        assert found == {1: (["happy", "dog"] * 50, ["zebra", "unicorn", "qwerty"] * 50), 2: ([], []), 3: ([], ["qwerty"])}
