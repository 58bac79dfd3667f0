"""Communities against known divisions and against the modularity of every division of a small graph."""

import itertools

from graphloom.operators.triples import communities


def modularity(edges, part):
    m = len(edges)
    degree = {}
    for a, b in edges:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    within = sum(part[a] == part[b] for a, b in edges) / m
    return within - sum((sum(d for n, d in degree.items() if part[n] == c) / (2 * m)) ** 2 for c in set(part.values()))


def divisions(nodes):
    if not nodes:
        yield []
        return
    for rest in divisions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


def found(spark, edges):
    rows = communities(spark.createDataFrame(edges, "a string, b string")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["community"] for r in rows}


def test_ring_of_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}") for g in "abcd" for i, j in itertools.combinations(range(5), 2)]
    edges += [("a0", "b1"), ("b0", "c1"), ("c0", "d1"), ("d0", "a1")]
    assert found(spark, edges) == {f"{g}{i}": f"{g}0" for g in "abcd" for i in range(5)}


def test_close_to_the_best_division(spark):
    edges = [tuple(x) for x in "ab ac bc cd de df ef fg gh".split()]
    nodes = sorted({n for e in edges for n in e})
    best = max(modularity(edges, {n: i for i, g in enumerate(d) for n in g}) for d in divisions(nodes))
    assert modularity(edges, found(spark, edges)) >= best - 0.05


def test_nothing_to_join(spark):
    assert found(spark, [("a", "a")]) == {"a": "a"}
    assert communities(spark.createDataFrame([], "a string, b string")).count() == 0
