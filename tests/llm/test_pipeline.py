"""The stages on small tables: what each decides takes effect on all that the one before kept."""

import public_tokenizers
from fixtures_path import fx

import corpus_pipeline
from ferrule.llm import op2_quality_classifier, op3_toxicity, op4_mixing, op6_jaccard_join
from ferrule.llm.common import local_rows, materialize
from test_op6_jaccard_join import brute
from test_op7_packing import check

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "jaccard_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    kept = materialize(corpus_pipeline.STAGES[0][1](spark, docs, SF), "t")
    scored = op3_toxicity.toxicity(docs, op3_toxicity.fit(docs, labels)).where("score < 0.5")
    assert kept.columns == columns and ids(kept) == ids(scored)

    good = materialize(corpus_pipeline.STAGES[1][1](spark, kept, SF), "t")
    scored = op2_quality_classifier.quality_classifier(kept, op2_quality_classifier.fit(kept, labels)).where("score >= 0.7")
    assert good.columns == columns and ids(good) == ids(scored)

    single = materialize(corpus_pipeline.STAGES[2][1](spark, good, SF), "t")
    components = brute([(r.doc_id, r.text) for r in good.collect()])
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in components})

    mixed = materialize(corpus_pipeline.STAGES[3][1](spark, single, SF), "t")
    units = op4_mixing.mix(materialize(op4_mixing.sized(single), "t")).collect()
    assert mixed.columns == columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in units if r.copies}

    unique = mixed.dropDuplicates(["doc_id"])
    check(corpus_pipeline.packing(spark, unique, SF).collect(), {r.doc_id: r.text for r in unique.collect()})


def test_empty_and_odd_documents(spark, tmp_path):
    for df in (fx.empty(spark), fx.documents(spark)):
        folder = str(tmp_path / f"t{df.count()}")
        df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
        fx.labels(spark, []).write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert (len(rows) > 0) == (df.count() > 0)


def test_tokenizer_is_a_parameter():
    assert corpus_pipeline.TOKENIZER == public_tokenizers.path("byte_bpe_50k.json")
    assert op6_jaccard_join.PERCENT == 80 and op6_jaccard_join.WORDS == 5


def test_one_row_and_no_duplicates(spark, tmp_path):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    for n in (1, 3, 40):
        folder = str(tmp_path / f"n{n}")
        rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", f"s{i % 3}") for i in range(n)]
        fx.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
        fx.labels(spark, []).write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        kept = corpus_pipeline.near_duplicates(spark, docs, folder)
        assert kept.count() == n  # nothing is like anything else
        units = op4_mixing.mix(materialize(op4_mixing.sized(docs), "t")).collect()
        assert sum(r.copies for r in units) == got.where("start = 0").count()


def test_rows_of_the_driver_wake_no_further_python_workers(spark, sf, monkeypatch):
    from pyspark import SparkContext

    def refuse(*_, **__):
        raise AssertionError("rows of the driver are read by Python workers of their own")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    for schema, rows in (("a long, b string", [(1, "x"), (None, None)]), ("a long, b int", [])):
        df = local_rows(spark, rows, schema)
        assert [tuple(r) for r in df.collect()] == rows and df.schema.simpleString() == f"struct<{schema.replace('long', 'bigint').replace(' ', ':').replace(',:', ',')}>"
        assert "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()
    assert corpus_pipeline.run(spark, sf).count() > 0
