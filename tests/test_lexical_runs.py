"""Stored postings: runs ordered by term, made without a shuffle."""

import pytest
from pyspark.sql import functions as F

import oracle
from ferrule.operators import lexical
from ferrule.plans import queries
from ferrule.sources import corpus

ROWS = [(1, "/p/Élan/x.txt", "x.txt", "élan elan ÉLAN x"), (2, "/p/y", "y", None), (3, "", "", ""), (4, "/q", "q", "straße naïve ١٢ z_z z"), (None, "/n", "n", "n n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, path string, name string, body string")


def test_runs_equal_the_grouped_postings(spark, docs):
    made = lexical.runs(docs.coalesce(1))
    want = lexical.postings(docs)
    assert sorted(map(repr, made.drop("n_tokens").collect())) == sorted(map(repr, want.collect()))
    long = {r.id: r.n_tokens for r in lexical.lengths(docs).collect()}
    assert all(r.n_tokens == long[r.id] for r in made.collect())
    stats, old = lexical.statistics_of(made, docs).first(), lexical.statistics(lexical.lengths(docs)).first()
    assert tuple(stats) == tuple(old)
    assert tuple(lexical.statistics_of(lexical.runs(docs.limit(0)), docs.limit(0)).first()) == (0, 0.0)


def test_runs_are_ordered_and_not_shuffled(spark, sf):
    made = lexical.runs(corpus.files(spark, sf).coalesce(1))
    assert "Exchange" not in lexical.stored(corpus.files(spark, sf))[0]._jdf.queryExecution().toString()
    keys = [(r.term.encode(), r.id) for r in made.collect()]
    assert len(keys) > 1000 and keys == sorted(set(keys))


def test_equal_ids_stay_rows_of_their_own(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest([1, 1, 2])::BIGINT AS doc_id, unnest(['a b', 'b c', 'c']) AS text, 'en' AS lang, 'src1' AS source) TO '{tmp_path}/documents.parquet' (FORMAT PARQUET)")
    con.execute(f"COPY (SELECT unnest([1, 2, 7])::BIGINT AS vec_id, [1.0 FOR x IN range(64)]::FLOAT[] AS embedding, 0 AS label) TO '{tmp_path}/embeddings.parquet' (FORMAT PARQUET)")
    assert oracle.differences(queries.stored_index(spark, str(tmp_path)), oracle.connect(str(tmp_path)), queries.ORACLES["stored_index"]) is None


def test_a_single_search_builds_no_postings(spark, tmp_path, monkeypatch):
    """A topic listing builds nothing, a search its directories alone; what is stored is used."""
    import shutil

    own = str(tmp_path / "tables")
    shutil.copytree("/root/testdata/sf0.001", own)
    staged, stage = [], queries.Snapshots.stage
    monkeypatch.setattr(queries.Snapshots, "stage", lambda self, name, df: staged.append(name) or stage(self, name, df))
    assert queries.search_topic_only(spark, own).count() > 0 and staged == []
    counted = queries.hybrid_search(spark, own).collect()
    assert "postings" not in staged and "dirs" in staged
    queries.stored_index(spark, own).collect()
    assert "postings" in staged
    assert sorted(queries.hybrid_search(spark, own).collect()) == sorted(counted)


def test_counting_once_gives_the_same_scores(spark, docs, tmp_path):
    kept = []

    def keep(df):
        kept.append(df)
        df.write.parquet(str(tmp_path / str(len(kept))))
        return spark.read.parquet(str(tmp_path / str(len(kept))))

    for text in ("elan x", "strasse naive z", "stra", "١٢ n", "?"):
        for where in (None, F.col("path") > "/p"):
            want = sorted(map(repr, lexical.bm25(docs, text, candidates=where).collect()))
            assert sorted(map(repr, lexical.bm25_once(docs, text, keep, candidates=where).collect())) == want
    assert len(kept) == 8
