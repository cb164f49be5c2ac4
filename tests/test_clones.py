"""Classes of clone_pairs meet under pairs of addresses."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from semcodec.operators import fingerprint


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_few_classes_meet(spark, threshold):
    rng = random.Random(8)
    sets = {tuple(sorted(rng.sample(range(120), rng.choice((1, 2, 3, 5, 8, 12, 16))))) for _ in range(300)}
    sets |= {tuple(sorted({*s[:-1], rng.randrange(120)})) for s in rng.sample(sorted(sets), 60)}
    sets = sorted(sets)
    rows = spark.createDataFrame([(k, list(s), len(s)) for k, s in enumerate(sets)], "rep long, ordered array<long>, size int")
    size = F.col("size")
    alike = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= threshold}
    lists = []
    for least in (fingerprint._least_overlap(size, size, threshold), fingerprint._least_overlap(F.greatest(F.lit(1), F.ceil(F.lit(threshold) * size - 1e-9).cast("int")), size, threshold)):
        under = defaultdict(set)
        for r in fingerprint._posted(rows, least).collect():
            assert sets[r["rep"]][r["at"]] == r["y"] and r["x"] in sets[r["rep"]]
            under[r["x"], r["y"]].add(r["rep"])
        lists.append(under)
    meet = {(min(i, j), max(i, j)) for key, own in lists[0].items() for i in own for j in lists[1][key] if i != j}
    singly = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if {*sets[i]} & {*sets[j]}}
    assert alike <= meet and len(meet) < (0.45 if threshold < 0.5 else 0.2) * len(singly)
