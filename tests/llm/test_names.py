"""Every text of op10 is compared by its name."""

from semcodec.llm import exact_dedup


def test_every_text_is_named(spark, monkeypatch):
    named = []
    own = exact_dedup.block_names
    monkeypatch.setattr(exact_dedup, "block_names", lambda *a, **k: named.append(own(*a, **k)) or named[-1])
    docs = spark.createDataFrame([(1, "a b"), (2, "ab "), (3, "alone"), (4, None), (None, "x"), (5, "alone, longer")], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs, block_bytes=4).collect()}
    assert found == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True), 4: (4, 1, True), None: (None, 1, True), 5: (5, 1, True)}
    assert named[0].count() == 6 and named[0].select("n1", "n2", "n3").distinct().count() == 5
