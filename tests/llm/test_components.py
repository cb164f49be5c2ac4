"""Components of links: few rounds, whatever order the edges come in."""

import random

import pytest

from semcodec.llm import components


def test_links_of_one_task_take_no_round(spark, monkeypatch):
    rounds = []
    own = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or own(edges))
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)]
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long").coalesce(1)).collect()}
    assert found == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)} and not rounds


@pytest.mark.parametrize("held", [1 << 18, 5])
def test_links_of_several_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(components, "FOREST_NODES", held)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7), (500, 501), (501, 500), (501, 502), (502, 503)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    expected = {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    found = [(r["id"], r["component"]) for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()]
    assert dict(found) == expected and len(found) == len(expected)
