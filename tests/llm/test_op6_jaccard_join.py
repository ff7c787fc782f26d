import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures_path import fx

from ferrule.llm import op6_jaccard_join as op


def brute(rows):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = lambda g: min((x for x in g if x is not None), default=None)
    return sorted(((rows[i][0], len(sets[i]), least(groups[find(i)]) if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def got(df):
    return sorted((tuple(r) for r in op.jaccard_join(df).collect()), key=repr)


def test_whole_table_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op.query(spark, sf).collect()), key=repr) == brute(rows)


def test_odd_rows(spark):
    assert got(fx.documents(spark)) == brute([(r[0], r[1]) for r in fx.odd_rows()])


def test_empty_table(spark):
    assert got(fx.empty(spark)) == []


@pytest.mark.parametrize("texts", [["just one text of a few more words than five"], ["one two three four five six", "seven eight nine ten eleven twelve", "a"], ["", None], ["only"] * 3])
def test_tables_without_a_shared_shingle(spark, texts):
    rows = list(enumerate(texts))
    df = fx.documents(spark, [(i, t, "en", "a") for i, t in rows])
    assert got(df) == brute(rows)
    assert op.deduplicate(df).count() == len({c for _, _, c in brute(rows)})


@pytest.mark.parametrize("block", [None, 16])
def test_clusters_around_the_threshold(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(op, "BLOCK", block)  # large groups are cut into blocks
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy) + (" " + passage if rng.random() < 0.3 else "")))
    for i in range(40):
        rows.append((2000 + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))))
    assert got(fx.documents(spark, [(i, t, "en", "a") for i, t in rows])) == brute(rows)


def test_tree_pairs_lose_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (20, 200)).astype(np.uint64)
    sets = [np.unique(np.concatenate([b[: 200 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for b in base for k in (0, 5, 15, 30)]
    n = np.array([len(s) for s in sets])
    vec = op.coordinates(np.array([op.count_vector(s) for s in sets]))
    a, b = op.tree_pairs(n, vec, np.arange(len(sets)), np.zeros(len(sets), int), None)
    found = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= op.needed(n[i], n[j]):
                assert (j, i) in found


def test_deduplicate_keeps_one_row_of_each_component(spark):
    df = fx.documents(spark)
    kept = op.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 9, 10, 11, 12, 13], key=str)


def test_large_counts_bound_nothing():
    v = op.count_vector(np.zeros(70_000, np.uint64))
    assert (v == op.FULL).all() and op.coordinates(v[None]).min() > 70_000


def test_shingles_of_every_kind_of_space():
    a, b, c, d = op.shingle_sets(pa.array(["A b\tc\nd\x0be", "a  b c d e ", "a b c d", None]))
    assert a.tolist() == b.tolist() and len(a) == len(c) == 1 and a[0] != c[0] and len(d) == 0


def test_frequent_shingles_are_dealt_and_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(40)]
        rows += [(len(rows) + k, f"{passage} {' '.join(base[:39 - k])}") for k in range(3)]
    df = fx.documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    counted = op.materialize(op.document_sets(df), "documents")
    frequent = op.frequent_shingles(counted, len(rows))
    assert len(frequent) >= 8 and (np.diff(frequent.astype(object)) > 0).all()
    blobs = op.materialize(op.postings(df, 7, frequent), "blobs")
    by_bucket = {r.bucket: r.n for r in blobs.groupBy("bucket").agg({"counts": "count"}).withColumnRenamed("count(counts)", "n").collect()}
    assert {b for b in by_bucket if b >= 7} == set(range(7, 14))  # one shingle's postings are in many groups
    assert got(df) == brute(rows)
    monkeypatch.setattr(op, "FREQUENT_LIST", 0)
    assert got(df) == brute(rows)


def test_a_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(0)
    summary = op.Summary(200)
    for _ in range(40):
        summary.add([np.unique(np.concatenate([np.array([7, 9], np.uint64), rng.integers(10, 2**60, 100).astype(np.uint64)]))])
        summary.prune()
    counts = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
    assert len(counts) <= 200 and counts[7] == counts[9] and 20 <= counts[7] <= 40


@pytest.mark.parametrize("columns", [["marked_id", "_marked_id", "stays", "sid", "marked_sid"], ["STAYS", "_marked_sid", "_stays_7", "_sid_7"]])
def test_deduplicate_among_clashing_names(spark, columns):
    from pyspark.sql import functions as F

    df = fx.documents(spark).select("doc_id", "text", *(F.lit(1).alias(c) for c in columns))
    kept = op.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == 10


def test_nearest_pairs_do_not_depend_on_pruning(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 120 - k % 9], rng.integers(0, 2**63, k % 9).astype(np.uint64)])) for k in range(300)]
    n, vec = np.array([len(s) for s in sets]), op.coordinates(np.array([op.count_vector(s) for s in sets]))
    pairs = lambda: set(zip(*(x.tolist() for x in op.tree_pairs(n, vec, np.arange(len(sets)), np.zeros(len(sets), int), 2)), strict=True))
    whole = pairs()
    monkeypatch.setattr(op, "HELD_PAIRS", 50)
    assert pairs() == whole and 150 <= len(whole) <= 600
