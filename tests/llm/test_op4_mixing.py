from collections import defaultdict

import numpy as np
import pytest
from fixtures_path import fx

from ferrule.llm import op4_mixing as op
from ferrule.llm.common import materialize


def brute_targets(sizes: dict) -> dict:
    """Water filling by repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 2 * sizes[s] for s in above}


def mixed(spark, df):
    return op.mix(materialize(op.sized(df), "sizes"))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_targets_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}" if i else None, int(rng.integers(0, 1000))) for i in range(int(rng.integers(2, 12))) for _ in range(3)]
    sizes = defaultdict(int)
    for s, n in rows:
        sizes[s] += n
    got = {r.source: r.target for r in op.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets(dict(sizes))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_flight_keeps_totals_and_leaves_two():
    rng = np.random.default_rng(3)
    sizes, pi = rng.integers(1, 500, 300).astype(float), np.full(300, 0.37)
    p = op.flight(sizes, pi, 9)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs((p * sizes).sum() - (pi * sizes).sum()) < 1e-6 and abs(p.sum() - pi.sum()) < 1e-6
    assert set(np.unique(op.land(sizes, p))) <= {0.0, 1.0}


def test_flight_meets_inclusion_probabilities():
    sizes = np.array([5.0, 9, 2, 7, 7, 1, 3, 8])
    taken = np.mean([op.land(sizes, op.flight(sizes, np.full(8, 0.5), s)) for s in range(800)], axis=0)
    assert np.abs(taken - 0.5).max() < 0.12


def test_sources_come_near_their_targets_and_reruns_agree(spark, sf):
    first, again = ([tuple(r) for r in op.query(spark, sf).collect()] for _ in range(2))
    assert sorted(first) == sorted(again) and len(first) == 200
    by = defaultdict(lambda: [0, 0.0, 0])
    for _, size, _, target, taken, source in first:
        assert taken in (0, size, 2 * size)
        by[source][0] += taken
        by[source][1] = target
        by[source][2] = max(by[source][2], size)
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())


def test_odd_rows(spark):
    df = fx.documents(spark)
    rows = mixed(spark, df).collect()
    assert sum(r.n for r in rows) == df.count()
    repeated = op.mix_documents(df)
    assert repeated.columns == df.columns
    want = sum(r.copies for r in rows)
    assert repeated.count() == want


def test_rows_of_one_key_share_its_copies(spark):
    texts = [f"word{k} and some more words of text" for k in range(40)]
    df = fx.documents(spark, [(None, t, "en", "a") for t in texts] + [(k, "b " * 50, "en", "b") for k in range(30)])
    units = {(r.doc_id, r.source): r for r in mixed(spark, df).collect()}
    one = units[None, "a"]
    assert one.n == 40 and abs(one.copies * one.size - one.target) <= one.size
    taken = defaultdict(int)
    for r in op.mix_documents(df).where("source = 'a'").collect():
        taken[r.text] += 1
    counts = [taken[t] for t in texts]
    assert sum(counts) == one.copies and max(counts) - min(counts) <= 1 and max(counts) <= 2
    shown = spark.createDataFrame([(None, t, "a") for t in texts] + [(k, "b " * 50, "b") for k in range(30)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in op.mix_documents(shown).groupBy("source").count().collect()) == sorted(tuple(r) for r in op.mix_documents(df).groupBy("source").count().collect())


@pytest.mark.parametrize("columns", [["copies__unit", "n", "copies", "place", "size"], ["COPIES", "_copies", "doc_id__unit", "_n", "h"]])
def test_mixing_among_clashing_names(spark, columns):
    from pyspark.sql import functions as F

    df = fx.documents(spark).select("doc_id", "text", "source", *(F.lit(1).alias(c) for c in columns))
    got = op.mix_documents(df)
    assert got.columns == df.columns and got.count() == op.mix_documents(fx.documents(spark)).count()


def test_many_chunks_settle_in_rounds(spark):
    units = spark.range(3000).selectExpr("id AS doc_id", "'a' AS source", "id % 97 + 1 AS size", "1L AS n", "1 AS rank", "3000L AS n_units", "0.4D AS pi")
    out = op.cube_sample(units, chunk=32).collect()
    assert len(out) == 3000 and all(r.pi in (0.0, 1.0) for r in out)
    assert abs(sum(r.pi * r.size for r in out) - 0.4 * sum(r.size for r in out)) <= 97


def test_empty_and_wordless(spark):
    assert mixed(spark, fx.empty(spark)).collect() == []
    rows = mixed(spark, fx.documents(spark, [(1, None, None, None), (2, "", "en", "a")])).collect()
    assert [(r.size, r.target, r.copies) for r in rows] == [(0, 0.0, 0)] * 2


def test_removing_a_table_leaves_its_neighbours(spark, monkeypatch, tmp_path):
    from ferrule.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}/ferrule-jobs")
    one, two = common.materialize(spark.range(3), "one"), common.materialize(spark.range(4), "two")
    common.remove(one)
    common.remove(spark.range(2))
    assert two.count() == 4 and len(list((tmp_path / "ferrule-jobs").iterdir())) == 1
