"""Fingerprints are made in place: no join, and no table gathered on the driver."""

from pyspark.sql import functions as F

import __spark_entry__
from semcodec.functions import codec
from semcodec.operators import fingerprint

SQ = f"doc_id long, tokens array<{codec.TOKEN}>"


def test_fingerprints_join_nothing(spark):
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    token = lambda k, addr: (k, "w", addr, 85, 1, 0, [])
    rows = [(1, [token(k, a) for k, a in enumerate((5, 1 << 16, 7, 5, 7, 1 << 16 | 1, 9))]), (None, []), (2, None), (3, [token(0, 5)] * 3)]
    found = fingerprint.fingerprint(spark.createDataFrame(rows, SQ), 3)
    assert "Join" not in plan(found) and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    text = lambda addr: spark.range(1).select(codec.address_text(F.lit(addr))).first()[0]
    domain = lambda addr: text(addr)[:2]
    got = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(t) for t in got[1]["top"]] == [(text(5), 2), (text(7), 2), (text(1 << 16), 1)]  # the first found of equals
    assert got[1]["histogram"] == {domain(5): 5, domain(1 << 16): 2} and got[1]["total"] == 7 and got[1]["fingerprint_bytes"] == 21
    assert all(got[k]["top"] == [] and got[k]["histogram"] == {} and got[k]["fingerprint_bytes"] == 0 for k in (None, 2))
    assert [tuple(t) for t in got[3]["top"]] == [(text(5), 3)] and got[3]["histogram"] == {domain(5): 3}


def test_neighbours_are_met_by_a_shuffle(spark):
    found = __spark_entry__.queries()["fingerprint_similarities"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
