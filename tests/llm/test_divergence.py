"""The divergence audit against brute force."""

import collections
import random
import re

import pytest

from semcodec.llm import divergence, queries


def brute(rows, least, top):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) for t, _, _ in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        docs, n = collections.Counter(), collections.defaultdict(collections.Counter)
        for (_, g, s), found in zip(rows, terms):
            if g == lang:
                docs.update(set(found))
                n[s].update(found)
        kept = sorted(t for t, k in docs.items() if k >= least)
        rate = lambda own, t: 1 + 10**9 * (own[t] + 5) // (sum(own[x] for x in kept) + 5 * len(kept))
        whole = sum(n.values(), collections.Counter())
        p = {s: {t: rate(own, t) for t in kept} for s, own in n.items()}
        q = {t: rate(whole, t) for t in kept}
        for s in n:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in n if o != s)
            above = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if n[s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(above[:top])]
    return sorted(out)


def corpus(rng, sources):
    vocabulary = ["the", "Of", "naïve", "Δx", "don't", "a1b", "x", "漢字", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    rows = []
    for k in range(300):
        s = rng.randrange(sources)
        own = vocabulary[: 20 + s % 7 * 6] if s % 3 else vocabulary[s % 40 :]
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randint(0, 40))), rng.choice(("en", "fr", None)), None if s == 1 else f"s{s}"))
    return rows + [(None, "en", "silent"), ("", "xx", "alone"), ("", "yy", "a"), (None, "yy", "b"), rows[0], rows[0]]


@pytest.mark.parametrize("options", [{}, {"heavy": 0.0}, {"heavy": 2.0}, {"sources": 4, "postings": 16}, {"sources": 2, "postings": 8, "heavy": 0.3}])
def test_divergence_is_brute_force(spark, options):
    rows = corpus(random.Random(len(options)), 17)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value long, term string").repartition(3)
    found = divergence.divergence(docs, least_documents=10, top=7, **options)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, 7)


def test_counts_are_sent_on(spark, monkeypatch):
    rows = corpus(random.Random(9), 5)
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "BYTES_OF_TEXT", 16)
    rows.append(("big " * 100_000 + "end" + "é" * 50_000, "en", "s2"))
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    assert sorted(map(tuple, divergence.divergence(docs, least_documents=5).collect())) == brute(rows, 5, 50)


def test_rates_are_exact(spark):
    row = spark.range(1).selectExpr("9000000000000000 n", "10000000000000000 own_n", "12345678 terms")
    found = row.select(divergence._rate(*map(divergence.F.col, ("n", "own_n", "terms")))).first()[0]
    assert found == 1 + 10**9 * (9 * 10**15 + 5) // (10**16 + 5 * 12345678)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergence(docs).collect() == []
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_divergence(spark, str(tmp_path)).dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
