"""The inverted file over vectors equals a scan, and leaves cells closed where vectors come in groups."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import cells as I
from graphloom.operators.vectors import top_k, top_k_batch


def grouped(spark, n=3000):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    rows = [(i, [float(c) for c in (centres[i % 30] * rng.uniform(0.5, 3) + rng.normal(size=24) * 0.15).astype(np.float32)], i % 5) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [None] * 24, 1), (n + 4, rows[0][1], 0), (n + 5, rows[0][1], 3)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain(df):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_searches_equal_a_scan_and_skip_cells(spark):
    rows, items = grouped(spark)
    good = items.filter("vec_id < 3000 or vec_id > 3003")
    index = I.write_index(items, keep=["label"])
    assert index.rows.sum() == 3002 and index.read().count() == 3002
    read = []
    for k, where, q in ((10, None, 0), (10, None, 17), (3, F.col("label") == 2, 5), (2000, None, 4), (4000, None, 4)):
        query = rows[q][1]
        assert plain(I.nearest(index, query, k, where)) == plain(top_k(good, query, k, where))
        if k <= 10:
            read.append(len(I.cells_for(index, query, k, where)) / len(index.cells))
    print("share of the cells read", read)
    assert max(read) < 0.5
    within = items.filter("vec_id % 7 = 0").select("vec_id")
    assert plain(I.nearest(index, rows[9][1], 5, within=within)) == plain(top_k(good.filter("vec_id % 7 = 0"), rows[9][1], 5))
    assert I.nearest(index, [0.0] * 24, 5).count() == 0


def test_batches_equal_all_pairs(spark):
    _, items = grouped(spark, 600)
    index = I.write_index(items)
    queries = items.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    good = items.filter("vec_id < 600 or vec_id > 603")
    for k, least in ((5, -1.0), (4, 0.9), (700, -1.0)):
        got = I.nearest_batch(index, queries, k, least)
        assert plain(got.select("query_id", "vec_id", "similarity", "rank")) == plain(top_k_batch(good, queries.filter("query_id < 600"), k, least).select("query_id", "vec_id", "similarity", "rank"))
    plan = I.nearest_batch(index, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_batches_make_no_row_of_a_pair_and_keep_the_order_of_copies(spark):
    rng = np.random.default_rng(5)
    own = [[float(c) for c in rng.normal(size=16).astype(np.float32)] for _ in range(40)]
    items = spark.createDataFrame([(i, own[i % 40] if i < 1500 else own[0]) for i in range(2500)], "vec_id long, embedding array<float>")
    index = I.write_index(items)
    queries = items.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = I.nearest_batch(index, queries, 7)
    assert plain(found.select("query_id", "vec_id", "similarity", "rank")) == plain(top_k_batch(items, queries, 7).select("query_id", "vec_id", "similarity", "rank"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "MapInArrow" in plan  # products of tiles, not a joined row and a lambda for each pair


def test_empty_collection(spark):
    items = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    index = I.write_index(items)
    assert I.nearest(index, [1.0, 2.0], 3).count() == 0
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>")
    assert I.nearest_batch(index, queries, 3).count() == 0
