"""Models and scans of the training-data operators recomputed step by step, very long texts, clashing column names, the shared folder."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from semcodec.llm import bpe, common, exact_dedup, kernel, licenses, minhash, packing, quality_model, quality_rules, queries, secrets, tokens, toxicity, url_filter  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def prose(rng, n):
    return " ".join(rng.choice(("the", "river", "Tiger", "stone,", "walks", "under", "light", "Éclair", "a1", "cc", "by", "MIT", "license")) for _ in range(n))


def buffers(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def one_hash(raw: bytes) -> int:
    return int(kernel.span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), lower=True)[0])


def bucket(x: int, bits: int) -> int:
    return int(kernel.mix(np.array([x % (1 << 64)], np.uint64))[0]) >> (64 - bits)


def test_toxicity_scores():
    rng = random.Random(1)
    model = toxicity.Toxicity(np.random.default_rng(2).normal(0, 1, 1 << toxicity.BUCKET_BITS), -0.5)
    texts = [prose(rng, 30), "", "x", "grumblefoot snarkwaddle " * 3, prose(rng, 200)]
    found = model.score(*buffers(*texts))
    for text, score in zip(texts, found):
        words = [w for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
        means = []
        for w in words:
            numbers = [one_hash(w)]
            for n in range(toxicity.LEAST, toxicity.MOST + 1):
                for at in range(len(w) - n + 1):
                    numbers.append(one_hash(w[at : at + n]) * 4 + (at == 0) + 2 * (at == len(w) - n))
            means.append(np.mean([model.value[bucket(x, toxicity.BUCKET_BITS)] for x in numbers]))
        expected = 1 / (1 + math.exp(-(model.bias + toxicity.SCALE * (np.mean(means) if means else 0))))
        assert score == pytest.approx(expected, abs=1e-9)


def test_toxicity_fits_jointly():
    rng = random.Random(3)
    y = np.array([k % 3 == 0 for k in range(300)]).astype(np.int64)
    texts = [prose(rng, 60) + (" grumblefoot" * 2 if bad else "") for bad in y]
    bag, count = toxicity.word_counts(pa.array(texts))
    assert collections.Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", texts[0].lower().replace("é", "É"))) == collections.Counter(dict(zip(bag[0].as_py().decode().split(), count[0].as_py())))
    own = toxicity.Bags(bag.to_pylist(), count.flatten().to_numpy())
    every, toxic = own.texts_with(y)
    sets = [set(toxicity.subwords(*buffers(t))[0].tolist()) for t in texts]
    for b in list(sets[0])[:50]:
        assert (every[b], toxic[b]) == (sum(b in s for s in sets), sum(b in s and t for s, t in zip(sets, y)))
    model = toxicity.train(bag.to_pylist(), count.flatten().to_numpy(), y)
    fine, bad, unseen = model.score(*buffers(prose(rng, 60), prose(rng, 60) + " grumblefoot grumblefoot", prose(rng, 60) + " grumblefooot grumblefoots"))
    assert fine < 0.3 < unseen < 1 and bad > 0.7


def test_quality_updates():
    rng = random.Random(4)
    texts = [prose(rng, 12) for _ in range(9)]
    y = np.array([k % 2 for k in range(9)])
    at, count = quality_model.feature_counts(pa.array(texts))
    model = quality_model.train([(a.values.to_numpy(), c.values.to_numpy()) for a, c in zip(at, count)], y)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        own_l1 = 0.0 if k == "bias" else l1
        return 0.0 if abs(z[k]) <= own_l1 else -(z[k] - math.copysign(own_l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    features = []
    for text in texts:
        words = [w.lower() if w.isascii() else w for w in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[^\s0-9A-Za-z\x80-\U0010FFFF]+", text)]
        codes = [one_hash(w.encode()) for w in words]
        pairs = [int(quality_model._TWICE) if a == b else int(kernel.mix(np.array([(a * 3 + b * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]) for a, b in zip(codes, codes[1:])]
        own = collections.Counter(bucket(x, quality_model.BITS) for x in codes + pairs)
        features.append({k: quality_model.SHARE * v / sum(own.values()) for k, v in own.items()} | {"bias": 1.0})
    for _ in range(4):
        for x, label in zip(features, y):
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    assert model.bias == pytest.approx(weight("bias"), abs=1e-9)
    for x in features:
        for k in x:
            if k != "bias":
                assert model.weights[k] == pytest.approx(weight(k), abs=1e-5)
    for text, x, score in zip(texts, features, model.score(*buffers(*texts))):
        assert score == pytest.approx(1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items()))), abs=1e-5)


def test_isolation_scores():
    rows = np.random.default_rng(5).normal(0, 1, (300, 3))
    forest = quality_rules.IsolationForest(rows, np.ones(3), trees=20, size=64)
    for row, score in zip(rows[:20], forest.score(rows[:20])):
        paths = []
        for t in range(20):
            node = 1
            while forest.feature[t, node] >= 0:
                node = 2 * node + (row[forest.feature[t, node]] > forest.cut[t, node])
            paths.append(forest.path[t, node])
        assert score == pytest.approx(2 ** (-np.mean(paths) / quality_rules.expected_path(64)))
    odd = forest.score(np.array([[9.0, 9.0, 9.0]]))[0]
    assert odd > forest.score(rows).mean()


def test_url_margins_and_held_out_urls(spark):
    rng = random.Random(6)
    urls = [f"http://{rng.choice(('www.', '', 'a.b.'))}{rng.choice(('example', 'other', 'site9'))}.{rng.choice(('com', 'net', 'org'))}/{rng.choice(('en', 'de', 'es'))}/{rng.randrange(100)}{'?a=1&b' * rng.randrange(2)}" for _ in range(600)]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls + urls[:200])], "page_id long, url string")
    labelled = url_filter.labelled_by_rules(rows)
    model = url_filter.train(labelled.where("crc32(cast(url as binary)) % 4 <> 2"))
    sample = url_filter.with_margin(model.classes(rows.select("url", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))), model).limit(60).collect()
    for r in sample:
        url, host, path = r["url"], r["host"], r["path"]
        entropy = -sum(n / len(host) * math.log2(n / len(host)) for n in collections.Counter(host).values())
        query = url.split("?", 1)[1] if "?" in url else ""
        values = {
            "length": len(url), "host_length": len(host), "depth": len([x for x in path.split("/") if x]), "labels": host.count(".") + 1, "digit_ratio": sum(c.isdigit() for c in url) / len(url), "entropy": entropy,
            "parameters": len(query.split("&")) if query else 0, "hyphens": url.count("-"), "suffix_rate": model.suffixes.get(".".join(host.split(".")[-2:]), model.suffix_default),
        }
        cls = {k: sum(v > e + 1e-12 for e in url_filter.FEATURES[k]) for k, v in values.items()}
        margin = model.prior + sum(leaves[sum((cls[f] > k) << level for level, (f, k) in enumerate(splits))] for splits, leaves in model.trees)
        assert r["margin"] == pytest.approx(margin, abs=1e-9)
    held = url_filter.with_margin(model.classes(labelled.where("crc32(cast(url as binary)) % 4 = 2")), model)
    right, n = held.agg(F.avg(((F.col("margin") > 0).cast("int") == F.col("blocked")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.7


def test_license_places():
    rng = random.Random(7)
    words = ("gnu", "general", "public", "license", "apache", "CC", "by", "MIT", "é", "x")
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice((" ", "-", "\n", "", ". ")) for _ in range(rng.randrange(40)))
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split()]
        found = licenses.scan_text(text)
        assert found[:5] == (len(own), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({x for _, x in places})))
    many = licenses.scan_text("SPDX-License-Identifier: " + " OR ".join(f"name{k}" for k in range(1000)))
    assert many[5].split(",") == sorted(f"name{k}" for k in range(1000))


def test_ownership_counts(spark):
    rng = random.Random(8)
    value = lambda k: hashlib.sha256(str(k).encode()).hexdigest()[:30].upper() + "Zx"
    rows = [(k, f"Bearer {value(rng.randrange(40))} end Bearer {value(rng.randrange(40))}", f"s{rng.randrange(3)}", f"l{rng.randrange(2)}") for k in range(60)]
    owners, repos = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, source, lang in rows:
        for v in re.findall(r"Bearer (\S+)", text):
            owners[v].add(source)
            repos[v].add((source, lang))
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect():
        text = dict((k, t) for k, t, *_ in rows)[r["doc_id"]]
        assert {text[s["start"] : s["end"]] for s in r["live"]} == {v for v in re.findall(r"Bearer (\S+)", text) if len(owners[v]) <= 2 and len(repos[v]) <= 2}


def within(seconds, work):
    began = time.process_time()
    out = work()
    assert time.process_time() - began < seconds
    return out


def test_very_long_texts():
    import tiktoken

    own = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=tokens.load_ranks(RANKS), special_tokens={})
    codec = bpe.Codec(RANKS, P.PATTERN)
    rng = random.Random(9)
    for text in ("a" * 1_000_000, "".join(rng.choice("abcdeé") for _ in range(300_000))):
        assert np.frombuffer(within(20, lambda t=text: codec.encode([t]))[0], "<u4").tolist() == own.encode_ordinary(text)
    blank = " " * 1_000_000 + "x\n" + "\t\n" * 200_000
    assert codec.decode(within(20, lambda: codec.encode([blank]))[0]) == blank.encode()
    plain = tokens.TextEncoder(P.path("byte_bpe_50k.tiktoken"), tokens.added_tokens(P.path("byte_bpe_50k.json")))
    assert len(within(20, lambda: plain.encode(blank))) > 0
    found = within(10, lambda: licenses.scan_text("cc by " * 200_000))
    assert found[:4] == (400_000, 200_000, 0, 399_998)
    text = "x\n".join(f"Bearer abcdefghijklmnopqrst{k:06}" for k in range(50_000))
    assert len(within(10, lambda: secrets._more(text, []))) == 50_000
    for text in ("-----BEGIN PRIVATE KEY-----" + " " * 1_000_000, "-----BEGIN PRIVATE KEY-----\n" * 40_000, "eyJaaaaaaaa-" * 90_000, "eyJaaaaaaaa." * 90_000, "key-" * 250_000, "key='" * 200_000, "Bearer " * 150_000, "sk-" * 350_000, "BEGIN " * 170_000):
        within(5, lambda t=text: secrets._more(t, secrets._base(t)))
    assert within(10, lambda: quality_rules.text_counts(pa.array(["a b\n" * 250_000, "x" * 1_000_000])))[:, 0].tolist() == [500_000, 1]


def test_clashing_columns(spark, tmp_path):
    rng = random.Random(10)
    names = ["_kept", "_n", "_spans", "spans", "row", "odd", "ids", "Size", "token", "odd name"]
    rows = [(k, prose(rng, 40) + (" token = abcdef0123456789" if k == 3 else ""), "en", "s") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.lit(7).alias(n) for n in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.union(docs.limit(1))):
            out = stage(spark, rows, str(tmp_path)).collect()
            assert len(out) in (12, 13) and all(r[n] == 7 for r in out for n in names) and list(out[0].asDict()) == docs.columns
    model = url_filter.train(url_filter.labelled_by_rules(spark.createDataFrame([("http://a.com/en/1",), ("http://a.net/de/1",)], "url string")))
    pages = spark.createDataFrame([(1, "http://b.com/x", 7, 7)], "page_id long, url string, suffix int, rule int")
    assert url_filter.judge(pages, model).count() == 1


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "the river walks under a stone of light and then some more"), (1, "the river walks under a stone of light and then some more"), (None, "MIT license <|endoftext|>"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "http://a.com/en/1"), (None, None), (3, ""), (3, "")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in queries.QUERIES.items():
        if name in ("op11_divergence", "op13_spelling", "spelling_forms"):  # rows of theirs are terms and words
            continue
        key = "page_id" if "url" in name else "doc_id"
        found = sorted(str(r[key]) for r in query(spark, str(tmp_path)).collect())
        assert found == (["3", "3", "None", "None"] if key == "page_id" else ["1", "1", "2", "None", "None"]), name


def test_rows_without_ids_are_spread(spark, monkeypatch):
    """100,000 rows without an id, all of one length, don't meet in one task."""
    monkeypatch.setattr(packing, "BUCKET", 1000)
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a stone of light "), F.col("id") % 50).alias("text"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        for find in (lambda: packing.pack_documents(docs, P.path("byte_bpe_50k.tiktoken")), lambda: minhash.near_duplicates(docs), lambda: exact_dedup.exact_duplicates(docs)):
            sizes = [r["count"] for r in find().groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 100_000 and len(sizes) > 1 and max(sizes) < 60_000
    finally:
        spark.conf.unset(key)


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    found, y = common.labelled_features(docs, labels, "quality", 10, lambda texts: [pa.array([len(x.as_py()) for x in texts], pa.int64())], "n long")
    assert found.num_rows == 2 and sorted(y) == [0, 1]


def test_shared_folder():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

        def setCheckpointDir(self, folder):  # noqa: N802
            self.folder = folder

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": folder} if folder else {}

    assert common.shared_root(Session("spark://x:7077", "hdfs://x/tmp/")) == "hdfs://x/tmp"
    assert common.shared_root(Session("local[2]")).startswith("file:///")
    with pytest.raises(RuntimeError):
        common.shared_root(Session("spark://x:7077"))


def test_tables_go(spark):
    with common.temporary_tables() as keep:
        a, b = common.materialize(spark.range(3), "a"), keep(common.materialize(spark.range(4), "b"))
    assert b.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        a.count()
    common.drop(b)


@pytest.mark.parametrize("most", [1 << 28, 1 << 10])
def test_id_filter(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FILTER_BITS_MOST", most)
    rows, keep = common.passing(spark.range(5000).toDF("doc_id"), "doc_id", spark.range(0, 5000, 10).toDF("id"), "id")
    found = {r[0] for r in rows.mapInArrow(lambda bs: map(keep, bs), "doc_id long").collect()}
    assert found >= set(range(0, 5000, 10)) and len(found) < 1500
