"""Searches by bounds in blocks: right in small blocks, and without rows for pairs that meet."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semcodec.functions import codec
from semcodec.operators import align, bounds, kernel, search
from semcodec.plans import shared

EDGE = pa.struct([("addr", pa.int32()), ("weight", pa.int32()), ("type", pa.string())])
SEQ = pa.list_(pa.struct([("addr", pa.int32()), ("shade", pa.int32()), ("related", pa.list_(EDGE))]))


def sequences(rng, count, edges):
    address = lambda: rng.randrange(5) << 16 | rng.randrange(3) << 8 | rng.randrange(4)
    edge = lambda: {"addr": address(), "weight": rng.randrange(256), "type": rng.choice(("ISA", "SYNONYM", "ANTONYM"))}
    token = lambda: {"addr": address(), "shade": rng.randrange(4), "related": [edge() for _ in range(edges and rng.randrange(3))]}
    return pa.array([[token() for _ in range(rng.choice((1, 3, 8, 30)))] for _ in range(count)], SEQ)


@pytest.mark.parametrize("edges", [False, True])
@pytest.mark.parametrize("size", [1 << 20, 40])
def test_scan_is_brute_force(monkeypatch, edges, size):
    monkeypatch.setattr(bounds, "BLOCK", size)
    monkeypatch.setattr(bounds, "BATCH", size)
    rng, base = random.Random(size), align.profile("base")
    rows, asked = sequences(rng, 60, edges), sequences(rng, 12, edges)
    domains = lambda s: {t["addr"] >> 16 for t in s}
    pairs = [(q, k) for q in range(12) for k in range(60) if domains(asked[q].as_py()) & domains(rows[k].as_py())]
    score = kernel.scores(asked.take([q for q, _ in pairs]), rows.take([k for _, k in pairs]), [base] * len(pairs), False)
    least = np.array([0.0, 0.2, 0.4, 0.7] * 3)
    sent = SimpleNamespace(value=pa.table({"qkey": pa.array(range(12)), "tokens": asked, "least": least}))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 20)), rows.slice(lo, 20)], ["key", "tokens"]) for lo in (0, 20, 40)]
    found = [(r["qkey"], r["key"], r["score"]) for b in bounds.scan(sent, base, edges)(iter(batches)) for r in b.to_pylist()]
    assert sorted(found) == [(q, k, s) for (q, k), s in zip(pairs, score.tolist()) if s >= least[q]]
    best = [(r["at"], r["score"]) for b in bounds.scan(sent, base, edges, 2)(iter(batches)) for r in b.to_pylist()]
    assert {q for q, _ in best} >= {0, 4, 8} and all(s in {t for (p, _), t in zip(pairs, score.tolist()) if p == q} for q, s in best)


def test_pairs_that_meet_are_no_rows(spark, monkeypatch):
    """400 sequences of one address and 20 queries of it: 8,000 pairs meet, none of them in a join, and queries are sent in turns."""
    plans, write = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df))
    monkeypatch.setattr(search, "ASKED_ROWS", 6, raising=False)
    token = lambda k: (k, "w", 1 << 16 | 2 << 8 | 3, k, 1, 0, [])
    rows = [(d, [token(0)] * 3 + [token(d % 256)] + [token(d // 256)]) for d in range(400)]
    seq = f"tokens array<{codec.TOKEN}>"
    index, queries = search.build(spark.createDataFrame(rows, f"doc_id long, {seq}"), "doc_id"), spark.createDataFrame(rows[:20], f"query_id long, {seq}")
    found = search.search_many(index, queries, top_k=1, relations=False)
    assert plans and not any("Join" in p or "Generate" in p for p in plans)
    assert sorted((r["query_id"], r["seq"], r["score"]) for r in found.collect()) == [(d, d, 1.0) for d in range(20)]
    assert search.search_many(index, queries.where(F.lit(False)), top_k=1, relations=False).count() == 0
