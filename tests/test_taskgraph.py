"""The task graph's rounds against plain loops, on a graph of some thousand tasks."""

import random

import pytest

from siltstone.operators import taskgraph as G


def tasks(n, seed):
    """Tasks in layers, each needing some of the layer before; the first hundred are parents of the others; a few run in a circle."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        layer = i * 7 // n
        before = range(max(0, (layer - 1) * n // 7), layer * n // 7)
        needs = sorted({f"t{draw.choice(before)}" for _ in range(draw.randrange(4))}) if layer else []
        parent = f"t{draw.randrange(100)}" if i >= 100 and draw.random() < 0.3 else None
        rows.append([f"t{i}", parent, draw.choices(["verified", "implemented", "in_progress", "not_started"], [12, 1, 1, 1])[0], needs])
    for a, b in ((n - 1, n - 2), (n - 2, n - 3), (n - 3, n - 1)):
        rows[a][3] = sorted({*rows[a][3], f"t{b}"})
    return rows


def needs_of(rows):
    own = {r[0]: set(r[3]) for r in rows}
    return {r[0]: own[r[0]] | (own[r[1]] if r[1] else set()) for r in rows}


@pytest.fixture(scope="module", params=[3, 4])
def graph(spark, request):
    rows = tasks(3_000, request.param)
    return rows, spark.createDataFrame(rows, "id string, parent string, status string, dependencies array<string>").repartition(4)


def test_cycles(graph):
    rows, df = graph
    edges = {(i, n) for i, needs in needs_of(rows).items() for n in needs} | {(r[1], r[0]) for r in rows if r[1]}
    while True:
        waiting = {i for i, _ in edges}
        left = {(i, n) for i, n in edges if n in waiting}
        if left == edges:
            break
        edges = left
    assert {r["id"] for r in G.cycles(df).collect()} == {i for i, _ in edges} and f"t{len(rows) - 1}" in {i for i, _ in edges}
    assert G.cycles(df.where("id in ('t1', 't2')").selectExpr("id", "cast(null as string) as parent", "status", "array() as dependencies")).count() == 0


def test_invalidation(graph):
    rows, df = graph
    needs, now = needs_of(rows), {r[0]: r[2] for r in rows}
    kids = {}
    for r in rows:
        if r[1]:
            kids.setdefault(r[1], []).append(r[0])
    while True:
        bad = {i for i, s in now.items() if s != "verified"}
        new = {}
        for i, s in now.items():
            if s in G.STARTED and needs[i] & bad:
                new[i] = "blocked"
            elif s == "verified" and bad & set(kids.get(i, ())):
                new[i] = "implemented"
        if not new:
            break
        now |= new
    got = {r["id"]: r["status"] for r in G.invalidate(df).collect()}
    assert got == now and {"blocked", "implemented", "verified"} <= set(now.values())
