import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.operators import changes, geo, health, hierarchy, ranking, topics
from ferrule.plans import topics as topic_plans
from ferrule.sources.corpus import under


def arm(spark, name, kind, ids):
    return spark.createDataFrame([(name, kind, i, r + 1) for r, i in enumerate(ids)], "arm string, kind int, id long, rank int")


def order(df, column="fused_rank"):
    return [(r.kind, r.id) for r in df.orderBy(column).collect()]


def test_agreement_beats_one_top_hit(spark):
    fused = ranking.fuse([arm(spark, "file_dense", 0, [1, 2]), arm(spark, "file_lexical", 0, [3, 2])])
    assert order(fused)[0] == (0, 2)


def test_one_arm_keeps_its_order_and_kinds_stay_apart(spark):
    assert order(ranking.fuse([arm(spark, "file_dense", 0, [5, 3, 9])])) == [(0, 5), (0, 3), (0, 9)]
    both = ranking.fuse([arm(spark, "file_dense", 0, [1]), arm(spark, "dir_dense", 1, [1])])
    assert set(order(both)) == {(0, 1), (1, 1)}


def loop_select(kinds, limit):
    most, out, held = max(1, int(limit * 0.34 + 0.5)), [], []
    dirs = 0
    for i, k in enumerate(kinds):
        if len(out) >= limit:
            break
        if k == 1 and dirs >= most:
            held.append(i)
            continue
        dirs += k
        out.append(i)
    return (out + held)[:limit]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=30), st.integers(1, 20))
def test_quota_equals_the_loop(kinds, limit):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(k, i, i + 1) for i, k in enumerate(kinds)], "kind int, id long, fused_rank int")
    assert [i for _, i in order(ranking.select_quota(df, limit), "position")] == loop_select(kinds, limit)


def test_quota_with_few_files(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (0, 5, 5)], "kind int, id long, fused_rank int")
    assert order(ranking.select_quota(df, 4), "position") == [(1, 1), (0, 5), (1, 2), (1, 3)]


def test_prefix_range_takes_the_subtree_only(spark):
    df = spark.createDataFrame([("/p/a",), ("/p-old/a",), ("/pz",), ("/p",), ("/p/zz/b",)], "path string")
    assert sorted(r.path for r in df.where(under(F.col("path"), ["/p"])).collect()) == ["/p/a", "/p/zz/b"]


def test_generations(spark):
    rows = spark.createDataFrame([("/a/kept", 2), ("/a/stale", 1), ("/b/untouched", 1)], "path string, generation long")
    assert {r.path for r in changes.survivors(rows, 2, ["/a/"]).collect()} == {"/a/kept", "/b/untouched"}
    assert {r.path for r in changes.survivors(rows, 2).collect()} == {"/a/kept"}


def test_a_vector_of_an_older_text_is_not_current(spark):
    kind = "path string, mtime_ns long, size long, hash string, vector_hash string"
    old = spark.createDataFrame([("/a", 1, 1, "new", "old"), ("/b", 1, 1, "x", None), ("/c", 1, 1, "x", "x")], kind)
    new = spark.createDataFrame([("/a", 2, 1, "new", None), ("/b", 1, 1, "x", None), ("/c", 2, 1, "x", None)], kind)
    got = {r.path: (r.status, r.needs_embed) for r in changes.detect(new, old).collect()}
    assert got == {"/a": ("touched", True), "/b": ("touched", True), "/c": ("touched", False)}


def test_replacing_rows_twice_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c")], "id long, v string")
    once = changes.replace_rows(base, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, changes.replace_rows(once, new).collect())) == [(1, "a"), (2, "c")]


def test_rollup_stops_at_the_root(spark):
    files = spark.createDataFrame([(1, "/r/a/x.txt", "/r/a"), (2, "/r/a/b/y.txt", "/r/a/b"), (3, "/r/z.txt", "/r")], "id long, path string, parent string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    assert {r.path: r.file_count for r in hierarchy.rollup_counts(files, vectors).collect()} == {"/r": 2, "/r/a": 2, "/r/a/b": 1}
    names = hierarchy.directories(files).select("path", F.array(F.lit(0.0), F.lit(1.0)).alias("vector"))
    rolled = {r.path: r.vector for r in hierarchy.rollup_vectors(files, vectors, names, ["/r"]).collect()}
    assert set(rolled) == {"/r/a", "/r/a/b"} and np.allclose(rolled["/r/a"], [np.sqrt(0.5)] * 2)


def test_four_blobs_are_four_topics(spark):
    names = ["alpha", "beta", "gamma", "delta"]
    rng = np.random.default_rng(0)
    rows = [(k * 10 + i + 1, f"/t/{n}/{n}_{i + 1}.txt", (np.eye(8)[k] * 10 + rng.normal(0, 0.1, 8)).tolist()) for k, n in enumerate(names) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, path string, vector array<double>")
    built = [topic_plans.build(df.select("id", "vector"), df.select("id", "path"), ["/t"], k=4) for _ in range(2)]
    (named, members, variance), (again, _, _) = built
    rows = named.orderBy("topic").collect()
    assert [r.files for r in rows] == [10] * 4 and variance > 0.99
    assert all(any(n in r.label for n in names) for r in rows) and rows == again.orderBy("topic").collect()
    assert members.count() == 40


def test_training_refuses_what_cannot_be():
    for rows, k in ((np.zeros((1, 3)), 2), (np.zeros((5, 0)), 2), (np.zeros((5, 3)), 1), (np.zeros((5, 3)), 6)):
        with pytest.raises(ValueError):
            topics.train(rows, k)
    for k, epochs, sample in ((1, 5, 10), (2000, 5, 10), (4, 0, 10), (4, 21, 10), (4, 5, 1)):
        with pytest.raises(ValueError):
            topics.check_options(k, epochs, sample)


def test_starved_clusters_revive():
    rng = np.random.default_rng(1)
    position, mass = np.array([[5.0, 1.0], [0.0, 0.0]]), np.array([10.0, 0.0])
    total = position * mass[:, None]
    topics._revive(position, total, mass, rng)
    assert mass.tolist() == [5.0, 5.0] and not np.array_equal(position[0], position[1]) and np.allclose(position, [5, 1], atol=1e-2)


def test_nearest_place(spark):
    places = spark.createDataFrame([(43.85, 18.38, "Sarajevo", 1), (44.8, 20.46, "Belgrade", 2), (43.85, 18.38, "Again", 3)], "lat double, lon double, place string, number long")
    points = spark.createDataFrame([(1, 43.8563, 18.4131), (2, 91.0, 0.0), (3, 0.0, 181.0)], "id long, lat double, lon double")
    assert {r.id: r.place for r in geo.nearest_place(points, places).collect()} == {1: "Sarajevo", 2: None, 3: None}


def test_city_table(spark, tmp_path):
    (tmp_path / "cities.tsv").write_text("# lat\tlon\tplace\n43.85\t18.38\tSarajevo, Bosnia\nbroken\n44.8\t20.46\tBelgrade, Serbia\n")
    assert [r.place for r in geo.read_places(spark, str(tmp_path / "cities.tsv")).orderBy("number").collect()] == ["Sarajevo, Bosnia", "Belgrade, Serbia"]


def test_percentiles_are_nearest_rank(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, 2.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    row = health.percentiles(df, "v", "g").first()
    s = sorted(values)
    assert (row.p50, row.p95) == (s[int(5 * 0.5 + 0.5)], s[int(5 * 0.95 + 0.5)])


def test_stale_notes():
    assert topics.stale_note(False, 0, False) and topics.stale_note(True, 3, False) and topics.stale_note(True, 0, True)
    assert topics.stale_note(True, 0, False) is None


def test_embed_files_reads_the_content_budget(spark):
    from ferrule.functions import models
    from ferrule.functions import text as T
    from ferrule.plans import queries
    from ferrule.sources import corpus
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    got = {r.id: [int(x) / 1e5 for x in r.vector.split(",")] for r in queries.QUERIES["embed_files"](spark, sf).collect()}
    rel = T.relative_path(F.col("path"), F.lit(corpus.ROOT))
    rows = corpus.files(spark, sf).select("id", "body", T.embed_text(rel, T.name_tokens(rel), T.normalize_ws(F.col("body"), 1024)).alias("text")).collect()
    assert any(len(r.body) > 256 for r in rows)
    want = models.EMBEDDERS["hashing-64"].embed_docs([r.text for r in rows])
    assert all(abs(a - b) < 2e-5 for r, w in zip(rows, want, strict=True) for a, b in zip(got[r.id], w, strict=True))


def test_a_probe_counts_the_files_beyond_its_cap(spark):
    files = spark.range(7).select(F.concat(F.lit("/p/f"), "id", F.when(F.col("id") > 4, ".py").otherwise(".txt")).alias("path"))
    assert tuple(health.probe(files, cap=5).first()) == (7, 2, True, "code")
    assert tuple(health.probe(files, cap=8).first()) == (7, 2, False, "content")
