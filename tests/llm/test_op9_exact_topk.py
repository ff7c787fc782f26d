import math
from fractions import Fraction

import numpy as np
import pytest
from fixtures_path import fx  # noqa: F401
from pyspark.sql import functions as F

from ferrule.llm import op9_exact_topk as op

SCHEMA = "vec_id long, embedding array<double>, score double, rank int, query_id long"


def brute(rows, mod, k):
    clean = [(i, [math.floor(Fraction(v) * 256) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    queries = {}
    for i, x in sorted((r for r in clean if r[0] % mod == 0)):
        queries.setdefault(i, x)
    out = []
    for q, x in queries.items():
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in clean if i != q and len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def got(spark, rows, mod=5, k=3, **how):
    df = spark.createDataFrame([(i, x, 0.0, 1, 2) for i, x in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in op.exact_topk(df, F.col("vec_id") % mod == 0, k, **how).collect())


@pytest.mark.parametrize(("n", "d"), [(300, 3), (700, 16)])
def test_random_vectors_with_ties_and_copies(spark, n, d):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, d)), 1)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert got(spark, rows) == brute(rows, 5, 3)


def test_odd_rows(spark):
    rows = [(0, [1.0, -2.0]), (5, [1e300, 1.0]), (10, None), (15, [1.0, None]), (20, [math.nan, 1.0]), (25, [math.inf, 1.0]), (30, []), (31, []), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [3.0]), (35, [2.0]), (35, [1.0])]
    small = [r for r in rows if r[0] != 5]
    assert got(spark, small) == brute(small, 5, 3)
    assert {q for q, *_ in got(spark, rows)} == {0, 5, 30, 35}  # huge scores are cut, not lost


def test_large_whole_numbers_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-(10**7), 10**7, 6) / 256).tolist()) for i in range(60)]
    assert got(spark, rows) == brute(rows, 5, 3)


def test_query_blocks_and_empty_table(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    assert got(spark, rows, block=7) == brute(rows, 5, 3)
    assert got(spark, []) == []


def test_the_walk_prunes():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(20_000, 2)) * 256)
    tree = op.Tree(np.arange(len(x)), x)
    q = np.floor(rng.normal(size=(40, 2)) * 256)
    best = op.Best(np.full(40, -1), q, 5)
    best.search(tree)
    assert (best.scores == np.sort(x @ q.T, axis=0)[::-1][:5].T).all()
    assert best.opened < 40 * (tree.left < 0).sum() / 10
    first = best.opened
    best.search(op.Tree(np.arange(len(x)) + 10**6, x - 10**4))  # nothing here reaches the k-th scores
    far = best.opened - first
    assert far < 40 * (tree.left < 0).sum() / 2


def test_the_kth_score_is_carried_over_shards(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, np.round(rng.normal(size=5), 2).tolist()) for i in range(600)]
    want = brute(rows, 5, 3)
    monkeypatch.setattr(op, "SHARD", 50)
    assert got(spark, rows) == want and got(spark, rows, block=11) == want


def test_a_task_reads_bounded_parts(spark):
    rows = [(i, [float(i), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    blocks = op.build_blocks(op.usable(df, "vec_id", "embedding"), 64)
    assert [len(r.ids) // 8 for r in blocks.collect()] == [64, 64, 64, 64, 44]


def test_stored_trees_come_back_whole():
    rng = np.random.default_rng(2)
    for n, d in ((500, 3), (5, 1), (4, 0)):
        tree = op.Tree(np.arange(n), np.floor(rng.normal(size=(n, d)) * 9))
        back = op.Tree.load(d, tree.dump())
        assert all(np.array_equal(getattr(tree, f), getattr(back, f)) and getattr(tree, f).shape == getattr(back, f).shape for f in op.Tree.FIELDS)
