"""Searches over vectors: against all pairs, with copies, ties, repeated ids and vectors that take no part."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import negatives, neighbours, queries, searching

SCHEMA = "vec_id long, embedding array<{}>, label int, same string, id int"


def fixture(kind):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(20, 12))
    rows = []
    for i in range(600):
        x = base[rng.integers(20)] * 0.3 + rng.normal(size=12) * rng.choice([0, 1e-9, 0.02, 0.2])
        if kind == "float":
            x = x.astype(np.float32)
        rows.append((i * 5 % 611, [float(v) for v in x], int(rng.integers(4))))
    one = rows[3][1]
    rows += [(1000 + i, one, i % 2) for i in range(80)]  # copies, some of them queries
    rows += [(700, one, 1), (700, one, 1), (700, rows[8][1], 2), (rows[9][0], rows[9][1], rows[9][2])]  # repeated ids and rows
    rows += [(800, None, 1), (900, [0.0] * 12, 1), (1200, [-0.0] * 12, 2), (1300, [math.nan] + one[1:], 1), (1400, one[:5], 3), (1500, [None] + one[1:], 1)]
    rows += [(1600, one, None), (None, one, 1), (1700, [], 0), (1800, [math.inf] * 12, 0), (1900, [-v for v in one], 1)]
    return [(*r, "x", 1) for r in rows]


def filled(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else np.array([*v, *[0.0] * (12 - len(v))])


def all_nearest(rows, k):
    known = [(i, x) for i, v, *_ in rows if i is not None and (x := filled(v)) is not None and x.any()]
    out = []
    for a, (i, x) in enumerate(known):
        if i % 100 == 0:
            def distance(y):
                total = 0.0
                for p, q in zip(x.tolist(), y.tolist()):
                    total += (p - q) ** 2
                return math.sqrt(total)

            near = sorted((distance(y), j) for b, (j, y) in enumerate(known) if a != b)[:k]
            out += [(i, rank, j, d) for rank, (d, j) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_neighbours_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "TILE", 64)
    monkeypatch.setattr(searching, "LEAST_ROWS", 100)
    monkeypatch.setattr(searching, "BLOCK_BYTES", 5000)
    rows = fixture(kind)
    df = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3)
    for k in (1, 10):
        got = sorted(tuple(r) for r in neighbours.nearest(df, k, F.col("id") % 100 == 0).collect())
        assert got == sorted(all_nearest(rows, k))


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [3.0, 1.0], 2)], schema)
    assert [tuple(r)[:3] for r in neighbours.nearest(few, 10, F.col("id") == 0).collect()] == [(0, 1, 1), (0, 2, 2)]
    for rows in ([], [(0, [1.0], 1)], [(0, None, None)]):
        df = spark.createDataFrame(rows, schema)
        assert neighbours.nearest(df, 10, F.col("id") == 0).count() == 0
        assert negatives.mine(df, F.col("label"), F.col("id") == 0, 5, 5, 80).count() == 0


def test_bounds_hold_distances():
    rng = np.random.default_rng(0)
    for dim in (1, 3, 64, 2100):
        x = rng.normal(size=(60, dim)) * 10.0 ** rng.integers(-8, 8, (60, 1))
        x[30:40] = x[20:30] * (1 + 1e-12)
        q = neighbours.quantised(x)
        low, high = neighbours.bounds(q, q, slice(0, 60))
        real = np.array([neighbours.distances(np.repeat(x[i : i + 1], 60, 0), x) for i in range(60)])
        assert (low <= real).all() and (real <= high).all()
    huge = np.array([[1e200, 1.0], [-1e200, 1.0]])
    q = neighbours.quantised(huge)
    low, high = neighbours.bounds(q, q, slice(0, 2))
    assert (low <= 0).all() and np.isinf(high).all()


def all_negatives(rows):
    known = [(i, (n + 1) % 10 if i % 7 == 0 else n, [math.floor(256 * c) for c in x]) for i, v, n, *_ in rows if i is not None and n is not None and (x := filled(v)) is not None]
    out = []
    for a, (i, n, x) in enumerate(known):
        if i % 100 == 0:
            scores = sorted((-sum(p * q for p, q in zip(x, y)), j, m) for b, (j, m, y) in enumerate(known) if a != b)
            for s, j in [(-s, j) for s, j, m in scores if m == n][:5]:
                window = [(-t, h) for t, h, m in scores if m != n and 80 * s <= -100 * t <= 100 * s][:5]
                out += [(i, j, rank, h, s, t) for rank, (t, h) in enumerate(window, 1)]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, tmp_path, kind):
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(searching, "LEAST_ROWS", 100)
    monkeypatch.setattr(searching, "BLOCK_BYTES", 5000)
    rows = fixture(kind)
    spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect())
    assert len(got) > 100 and got == sorted(all_negatives(rows))


def test_ball_tree_skips_leaves():
    """Grouped vectors: most leaves stay closed."""
    from types import SimpleNamespace

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 20
    x = np.floor(np.repeat(centres, 250, 0) + rng.normal(size=(10_000, 16)))
    table = SimpleNamespace(x=x, labels=rng.integers(0, 3, 10_000).astype("<i4"), ends=np.arange(10_001), values=np.arange(10_000), same=np.arange(20_000).astype("<u8").reshape(-1, 2))
    index = negatives.tree(table)
    q = SimpleNamespace(x=x[::100], labels=table.labels[::100], same=table.same[::100])
    best = searching.Best(100, 6)
    negatives.descend(index, q, np.arange(100), np.full(100, -np.inf), np.full(100, np.inf), True, best)
    for i in range(100):
        scores = sorted((-float(x[100 * i] @ x[j]), j) for j in np.flatnonzero(table.labels == q.labels[i]))[:6]
        assert sorted((-key, -v) for key, v, _ in best.heaps[i]) == scores
    assert index.opened < 0.5 * 100 * index.leaves


@pytest.mark.parametrize("name", ["op11_nearest_neighbours", "op13_hard_negatives"])
def test_queries_equal_sql(spark, sf, name):
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())
