"""Betweenness by joins against a plain search, in blocks of sources and from some sources."""

import random

import pytest

from graphloom.operators import triples as K


def plain(pairs, sources):
    """Sums of shares of shortest paths through each node, from the sources."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    total = dict.fromkeys({x for p in pairs for x in p}, 0.0)
    for s in sources(near):
        dist, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        gain = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    gain[v] += paths[v] / paths[w] * (1 + gain[w])
            if w != s:
                total[w] += gain[w]
    n = len(near)
    return {v: t / ((n - 1) * (n - 2)) if n > 2 else t for v, t in total.items()}


@pytest.mark.parametrize("at_once", [10**9, 1500])
def test_betweenness_equals_a_plain_search(spark, monkeypatch, at_once):
    monkeypatch.setattr(K, "ROWS_AT_ONCE", at_once)
    rng = random.Random(6)
    pairs = {tuple(sorted((f"n{rng.randrange(40)}", f"n{rng.randrange(40)}"))) for _ in range(60)}  # with loops
    pairs |= {(f"p{i:02}", f"p{i + 1:02}") for i in range(7)} | {("hub", f"leaf{i}") for i in range(6)} | {("loop", "loop")}
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    got = {r["node"]: r["betweenness"] for r in K.betweenness(df).collect()}
    want = plain(pairs, lambda near: near)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_some_sources_stand_for_all(spark):
    pairs = [("hub", f"leaf{i:03}") for i in range(60)]
    got = {r["node"]: r["betweenness"] for r in K.betweenness(spark.createDataFrame(pairs, "a string, b string"), sources=20).collect()}
    assert 0.8 < got.pop("hub") < 1.2 and set(got.values()) == {0.0}


def test_no_edges(spark):
    assert K.betweenness(spark.createDataFrame([], "a string, b string")).count() == 0
