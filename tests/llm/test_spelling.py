"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np

from semcodec.llm import queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=5):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if k >= least and len(w) >= 6}
    form, count = {}, {}
    for w in words:
        own = sorted((-k, x) for x, k in words.items() if near(w, x))
        count[w] = len(own)
        form[w] = own[0][1] if own and -own[0][0] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], count[w], words.get(form[w])))
    return sorted(out, key=str)


def corpus(rng):
    stems = ["letters", "kitten", "sitting", "mississippi", "naïveté", "Österreich", "aaaaaa", "aaaaaaa", "committee", "×÷×÷×÷×"]
    rows = []
    for k in range(400):
        found = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(stems)
            for _ in range(rng.choice((0, 0, 0, 0, 0, 1, 1, 2, 3))):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("aeimst")) + w[at + (kind < 2) :]
            found.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, rng.choice((" ", ", ", "\n", "1", "漢", "Ā")).join(found)))
    rows += [(500 + k, "chainaa " * 1 + "chainab " * 6 + "chainbb " * 40) for k in range(5)]
    return rows + [(None, "letters kitten " * 3), (None, None), (1000, ""), (5, rows[5][1]), (5, rows[5][1])]


def test_variants_are_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(1))
    monkeypatch.setattr(spelling, "HELD", 50)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(3)
    found = sorted(map(tuple, spelling.variants(docs).collect()), key=str)
    assert found == brute(rows)
    assert any(f and r != f for _, f, r, *_ in found) and len(found) > 30


def test_neighbours_are_all_and_distinct(monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 7)
    words, alphabet = [b"abba", b"a", b"cccc", b"bac"], np.frombuffer(b"abc", np.uint8)
    found = collections.defaultdict(list)
    for word, h, place, kind, letter in spelling.neighbours(words, alphabet):
        for w, x, p, k, c in zip(word.tolist(), h.tolist(), place.tolist(), kind.tolist(), letter.tolist()):
            own = words[w]
            text = own[:p] + (bytes([c]) if k != spelling.DELETED else b"") + own[p + (k != spelling.INSERTED) :]
            assert int(spelling.hashes([text])[0]) == x
            found[w].append(text)
    for w, own in enumerate(words):
        edits = {own[:p] + own[p + 1 :] for p in range(len(own))}
        edits |= {own[:p] + bytes([c]) + own[p + 1 :] for p in range(len(own)) for c in alphabet.tolist()} - {own}
        edits |= {own[:p] + bytes([c]) + own[p:] for p in range(len(own) + 1) for c in alphabet.tolist()}
        assert len(found[w]) == len(set(found[w])) and set(found[w]) == edits


def test_long_words_and_empty_tables(spark, tmp_path):
    long = "ab" * 20_000
    rows = [(k, f"{long} {long[:-1]} word") for k in range(6)] + [(9, f"{long}c " * 40)]
    found = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    empty.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_spelling(spark, str(tmp_path)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(spark.createDataFrame([(1, "short words only")], "doc_id long, text string")).collect() == []
