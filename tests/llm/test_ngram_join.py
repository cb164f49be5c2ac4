"""The n-gram join against brute force, and the trie by itself."""

import random

import numpy as np
import pytest

from semcodec.llm import ngram_join, queries
from test_llm import brute_components, words


def grams(text):
    found = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    return {tuple(found[i : i + 3]) for i in range(max(1, len(found) - 2))} if found else set()


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def brute(rows):
    """component of each row: the least id that links lead to"""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(rng):
    rows = []
    for k in range(25):  # groups of copies with few and many edits, some of them chained
        text = words(rng, rng.choice((1, 2, 3, 12, 60, 400)))
        for _ in range(rng.randint(1, 12)):
            rows.append(" ".join(text))
            text = list(text) if rng.random() < 0.5 else text
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
    passage = words(rng, 80)
    rows += [" ".join(words(rng, rng.randint(1, 150)) + passage + words(rng, rng.randint(1, 150))) for _ in range(40)]
    rows += [" ".join(passage + [f"x{k}"]) for k in range(30)] + ["", None, " \t", "One Two", "one two", "ONE  two\n"]
    rng.shuffle(rows)
    return [(3 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("long, block", [(24, 1 << 19), (3, 600), (1000, 300)])
def test_join_is_brute_force(spark, monkeypatch, long, block):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(random.Random(long))
    found = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows))


def test_odd_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, list long, id long, label long")
    assert ngram_join.similar_documents(empty).collect() == []
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "other words here"), (3, "other words here"), (None, None), (9, long), (5, long + " more")]
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, list long, id long, label string")
    found = sorted(map(str, map(tuple, ngram_join.similar_documents(docs).collect())))
    assert found == sorted(map(str, [(None, 2, None), (7, 2, 7), (7, 1, 3), (3, 1, 3), (None, 0, None), (9, 119_998, 5), (5, 119_999, 5)]))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_ngram_join(spark, str(tmp_path)).columns == ["doc_id", "n_shingles", "component_id"]


def test_trie_tells_similar_sets():
    rng = random.Random(5)
    base = [rng.sample(range(4000), rng.randint(1, 300)) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(8):
            own = set(b)
            for _ in range(rng.randint(0, len(b) // 15 + 1)):
                own.discard(rng.choice(b))
                own.add(rng.randrange(4000))
            sets.append(own)
    n = np.array([len(s) for s in sets])
    lists = np.array([k % 3 for k in range(len(sets))])
    whole = [np.array(sorted(s)) for s in sets]
    part = [x[len(x) - min(len(x), 2 * (len(x) // 10) + 1) :] for x in whole]
    every = np.arange(len(sets))
    pairs = {(i, j) for i in every for j in every if i != j and lists[i] == lists[j] and similar(sets[i], sets[j])}

    def told(own):
        trie = ngram_join.Trie(lists, n, own, every)
        found = [zip(*map(np.ndarray.tolist, trie.probe(every[k : k + 64]))) for k in range(0, len(every), 64)]
        return {p for f in found for p in f}

    assert told(whole) == pairs
    assert pairs <= told(part) and len(pairs) > 20


def test_copies_give_few_links(spark, monkeypatch):
    """A group of copies is linked by about as many links as it has members."""
    rng = random.Random(6)
    text = words(rng, 300)
    rows = [(k, " ".join(text[:k] + [f"e{k}"] + text[k + 1 :])) for k in range(150)]
    seen = []
    joined = ngram_join._joined
    monkeypatch.setattr(ngram_join, "_joined", lambda links: seen.append(links.count()) or joined(links))
    found = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0} and max(seen) < 300
