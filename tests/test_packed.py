"""Look-up in the packed dictionary against the join of exploded words, and the plan without a shuffle."""

import random

from pyspark.sql import functions as F

from semcodec.functions.constants import FORMAL, INTENSITY, NEGATIONS
from semcodec.operators import code, encode, lexicon, packed

WORDS = ["happy", "dogs", "walked", "the", "a", "House", "tiny", "'", "can't", "n't", "unknownword", "Éclair", "x", "running", "cold", "economy", *FORMAL[:3], *NEGATIONS[:4], *INTENSITY[3][:2], *INTENSITY[2][:2], *INTENSITY[1][:1]]


def texts(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(WORDS) + rng.choice((" ", " ", " ", ". ", "! ", "?", ", ", "\n", "--")) for _ in range(rng.randint(0, 60))))
    return [*out, None, "", "...", "not", "very. not. happy", "İstanbul house"]


def test_packed_is_the_join(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(None if k % 7 == 0 else k % 20, t) for k, t in enumerate(texts(rng, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    related = F.array(F.struct(F.lit(5).alias("addr"), F.lit(9).alias("weight"), F.lit("ISA").alias("type"), F.lit(1).alias("direction")))
    own = lexicon.sample(spark).withColumn("related", F.when(F.col("word").startswith("h"), related).otherwise(F.expr(f"cast(array() as {lexicon.RELATED})"))).withColumn("polarity", F.length("word") % 3)
    for context in (True, False):
        quick = encode.encode(docs, own, context=context)
        plan = quick._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan.replace("Exchange RoundRobinPartitioning", "")
        with monkeypatch.context() as m:
            m.setattr(lexicon, "sent", lambda d: None)
            slow = encode.encode(docs, own, context=context).collect()
        assert sorted(map(repr, quick.collect())) == sorted(map(repr, slow)) and len(slow) == len(rows)
    assert any(t["shade"] != u["shade"] for r in slow for t in r["tokens"] for u in r["tokens"] if t["word"] == u["word"]) is False


def test_large_dictionaries_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "BROADCAST_BYTES", 10)
    own = lexicon.sample(spark).withColumn("synset", F.lit(""))
    found = encode.encode(spark.createDataFrame([(1, "happy dogs"), (1, "happy dogs"), (None, "nothing of it")], "doc_id long, text string"), own)
    assert lexicon.sent(own) is None
    assert sorted((str(r["doc_id"]), [t["word"] for t in r["tokens"]]) for r in found.collect()) == [("1", ["happy", "dog"]), ("1", ["happy", "dog"]), ("None", [])]


def test_100_000_rows_without_ids(spark):
    docs = spark.range(100_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a happy dog").alias("text"))
    found = encode.encode(docs, lexicon.sample(spark)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("t")).collect()
    assert len(found) == 4 and sum(r["t"] for r in found) == 200_000


def test_contexts_of_long_texts(spark):
    text = "not very happy. hereby dog and cat! " * 20_000
    tokens = spark.range(1).select(F.lit(text).alias("text"), F.lit(1).alias("doc_id"))
    found = encode.encode(tokens, lexicon.sample(spark)).first()["tokens"]
    assert len(found) == 60_000 and len({(t["word"], t["shade"]) for t in found}) == 3 and [t["pos"] for t in found[:3]] == [0, 2, 4]
    assert packed.MARKS == ".!?"


SNIPPETS = ["def mergeSort(list):\n    return 'very happy dogs. not cold' # comment house", 'int fetchData(String userName) { return "walk"; } /* x */', "for x in map(): loop_over(TreeNode, 12.5, 'economy value buy')", "", None, "\"\"", "unknownThing + otherThing", "function readFile() { if (hot) parse('data file'); }", "'login doctor patient' 'a'"]


def test_packed_code_is_the_join(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, "\n".join(filter(None, rng.choices(SNIPPETS, k=rng.randint(0, 6)))) if k % 9 else SNIPPETS[k // 9 % len(SNIPPETS)], rng.choice(("python", "java", "javascript", "xx", None))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, language string")
    own = lexicon.sample(spark).withColumn("formality", F.col("formality"))
    quick = code.encode_code(docs, own)
    assert "Exchange" not in quick._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(repr, quick.collect()))
    with monkeypatch.context() as m:
        m.setattr(lexicon, "sent", lambda d: None)
        assert sorted(map(repr, code.encode_code(docs, own).collect())) == found
    twice = code.encode_code(docs.withColumn("doc_id", F.lit(None).cast("long")), own)
    assert twice.count() == len(rows) and sum(r["structural_count"] for r in twice.collect()) > 100
