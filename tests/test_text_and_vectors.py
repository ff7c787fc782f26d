import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule import fixed_values as C
from ferrule.functions import models
from ferrule.functions import text as T
from ferrule.functions import vectors as V
from ferrule.operators import dense, lexical


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def each(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("text", ["F#", "it's \"so\"", "kale OR NOT leek", "leek NEAR kale", "{soil} - {sun}", "title:leek", "l*k ^2"])
def test_user_text_is_never_syntax(spark, text):
    docs = spark.createDataFrame([(1, "/p/x.txt", "x", "leek kale soil sun title l k so f")], "id long, path string, name string, body string")
    assert T.query_terms(text) and lexical.bm25(docs, text).count() <= 1


@pytest.mark.parametrize("text", ["--", "", "\t\n", "...;"])
def test_no_word_matches_nothing(spark, text):
    docs = spark.createDataFrame([(1, "/p/x.txt", "x", "foo")], "id long, path string, name string, body string")
    assert T.query_terms(text) == [] and lexical.bm25(docs, text).collect() == []


def test_only_the_last_word_is_a_prefix():
    assert T.query_terms("Leek ü k") == [("leek", False), ("u", False), ("k", False)]
    assert T.query_terms("leek ka") == [("leek", False), ("ka", True)]


def test_bm25_equals_the_full_text_engine_of_sqlite(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(30)] + ["émile", "naïve"]
    rows = [(i, f"/a/b{i % 4}/f{i}.txt", f"f{i} {rng.choice(words)}", " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(path, name, body, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, path, name, body) VALUES (?, ?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "id long, path string, name string, body string")
    index, lengths = lexical.postings(docs), lexical.lengths(docs)
    for text, match in [("w1 w2", '"w1" OR "w2"*'), ("emile", '"emile"*'), ("b1 w3 w", '"b1" OR "w3" OR "w"'), ("w5 txt", '"w5" OR "txt"*')]:
        want = {i: -s for i, s in con.execute("SELECT rowid, bm25(t, 1.0, 3.0, 1.0) FROM t WHERE t MATCH ?", (match,))}
        for scored in (lexical.bm25(docs, text), lexical.bm25_postings(index, lengths, text)):
            got = {r.id: r.score for r in scored.collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_path_words(spark):
    got = each(spark, ["greenhouseRoof_planV2-final", "1998 seedOrders.CSV", "beds_from_north_to_south.md", "g/Garden/g/garden", None], T.name_tokens(F.col("v")))
    assert got == ["greenhouse roof plan v2 final", "1998 seed orders csv", "beds from north to south md", "garden", ""]


def test_normalize_keeps_characters_not_bytes(spark):
    got = each(spark, ["  a\x00\tb\n\n c ", "é" * 10, None, "ab  "], T.normalize_ws(F.col("v"), 4))
    assert got == ["a b", "éééé", "", "ab"]


def test_extension_and_kind(spark):
    assert each(spark, ["/a/b.TXT", "/a/.hidden", "/a/b", "/a.b/c"], T.extension(F.col("v"))) == ["txt", "", "", ""]
    kinds = each(spark, ["/a.pdf", "/a.docx", "/a.jpg", "/a.c"], T.extract_kind(F.col("v"), F.lit("body"), F.lit("content")))
    assert kinds == ["pdf", "office", "name-only", "text"]
    assert each(spark, ["/a.c"], T.extract_kind(F.col("v"), F.lit("body"), F.lit("name-only"))) == ["name-only"]


def test_binary_sniff(spark):
    values = [b"\x7fELF\x00\x01", b"int main() {}", b"", "accentué".encode(), b"\x01" * 64, b"a" * 8192 + b"\x00"]
    assert each(spark, values, T.looks_binary(F.col("v")), "binary") == [True, False, False, False, True, False]


def test_label_tokens(spark):
    tokens = ["b4", "compost", "0ddba11", "777", "docx", "z", "xy", "d9e", "cd7", "img9034", "1998b", "from"]
    assert each(spark, tokens, T.keeps_label_token(F.col("v"))) == [True, True] + [False] * 10
    assert each(spark, ["/a/Recipes/x.MD", "/a/Recipes/x", "/x.md", "/x"], T.fallback_label(F.col("v"))) == ["recipes · md", "recipes", "md", "topic"]


def test_gps_pair(spark):
    got = each(spark, ["Title\n43.5\n18.25\n\n", "43.5\n181", "x\ny", "1"], T.gps_pair(F.col("v")))
    assert (got[0].lat, got[0].lon) == (43.5, 18.25) and got[1:] == [None] * 3


def test_display(spark):
    assert each(spark, ["/home/me/x", "/home/me", "/home/men"], T.tilde(F.col("v"), "/home/me")) == ["~/x", "~", "/home/men"]
    assert each(spark, [59, 60, 7200, 200_000], T.human_duration(F.col("v")), "int") == ["59s", "1m", "2h", "2d"]


def test_due(spark):
    got = each(spark, [None, 900, 901, 2000], T.refresh_due(F.col("v"), F.lit(1000), 100), "int")
    assert got == ["never", "elapsed", "no", "no"]
    assert each(spark, [None, 0], T.refresh_due(F.col("v"), F.lit(1000), None), "int") == ["never", "no"]


def test_quantised_vectors_keep_their_direction(spark):
    rows = [(i, [(((i * 7919 + j * 104729) % 2003) / 1000 - 1) for j in range(384)]) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    back = dense.store_codes(df).select("id", V.dequantize(F.col("q"), F.col("scale")).alias("b")).join(df, "id")
    cosines = [r.c for r in back.select((V.dot(F.col("b"), F.col("vector")) / V.norm(F.col("b")) / V.norm(F.col("vector"))).alias("c")).collect()]
    assert min(cosines) > 0.999


def test_dead_vectors_and_ties(spark):
    df = spark.createDataFrame([(9, [0.0, 0.0])] + [(i, [1.0, 0.0]) for i in range(8)], "id long, vector array<double>")
    codes = dense.store_codes(df)
    assert codes.where("scale = 0").select("id").collect() == [(9,)]
    assert [r.id for r in dense.top_codes(codes, [1.0, 0.0], 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.id for r in dense.top_dense(df, [1.0, 0.0], 3).orderBy("rank").collect()] == [0, 1, 2]
    assert one(spark, V.norm(V.normalize(V.literal([0.0, 0.0])))) == 0


def test_batch_search_equals_single_searches(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    asked = df.where("id < 4").select(F.col("id").alias("query_id"), "vector")
    many = {(r.query_id, r["rank"]): (r.id, r.score) for r in dense.top_dense_batch(df, asked, 5, block=3).collect()}
    assert len(many) == 20
    for i in range(4):
        for r in dense.top_dense(df, x[i].tolist(), 5).collect():
            assert many[i, r["rank"]] == (r.id, r.score)
    assert dense.top_dense_batch(df, asked.limit(0), 5).count() == 0


def test_blend(spark):
    blend = lambda total, n: one(spark, V.blend(V.literal([1.0, 0.0]), V.literal(total), F.lit(n), 0.5))
    assert blend([0.0, 0.0], 0) == [1.0, 0.0]
    assert np.allclose(blend([0.0, 4.0], 4), [math.sqrt(0.5)] * 2)
    assert np.allclose(blend([0.0, 0.0], 4), [1.0, 0.0])
    weights = [blend([0.0, float(k)], 10)[1] for k in range(0, 11)]
    assert weights == sorted(weights)


def test_laws():
    assert C.batch_recipe(8013, 32, 5) == (512, pytest.approx(0.67695, abs=1e-4), 80)
    assert C.batch_recipe(8013, 512, 5) == (1024, pytest.approx(0.35126, abs=1e-4), 40)
    assert [C.default_topic_count(n) for n in (1, 4, 8258, 274_379)] == [1, 2, 91, 256]


def test_models():
    e = models.lookup(models.EMBEDDERS, "hashing-64")
    a, b, c = e.embed_docs(["winter squash soup", "soup of winter squash", "lawn mower"])
    assert np.isclose(a @ a, 1) and a @ b > 0.6 > abs(a @ c)
    assert not np.allclose(models.EMBEDDERS["hashing-query"].embed_query("squash"), models.EMBEDDERS["hashing-query"].embed_docs(["squash"])[0])
    with pytest.raises(KeyError, match="known"):
        models.lookup(models.EMBEDDERS, "nothing")
    assert models.effective_reranker("none", "substring") is None and models.effective_reranker(None, "substring").model_id == "substring"
    with pytest.raises(FileNotFoundError):
        models.OnnxEmbedder("/nowhere", 8, "x").embed_docs(["a"])


def test_measured_models(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    report = models.measure(models.HashingEmbedder(), texts, ("squash soup", "soup of squash", "lawn mower"), levels=5, per_level=3)
    assert report["docs_per_second"] > 0 and report["margin"] > 0 and report["hours_for"](0) == 0 and 5 <= report["texts"] <= 15
    with pytest.raises(ValueError):
        models.measure(models.HashingEmbedder(), texts.limit(0), ("a", "b", "c"))
    assert models.measure_reranker(models.SubstringReranker(), "leek", ["kale", "leek"])["places"] == [1, 0]


class FakeSession:
    """Stands for an opened model: every token's state is its id and its kind, and a pair's logits say
    how many tokens of the second kind there are."""

    def __init__(self, logits=False):
        self.logits, self.widths = logits, []

    def get_inputs(self):
        return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask", "token_type_ids")]

    def run(self, _, feed):
        self.widths.append(feed["input_ids"].shape[1])
        if self.logits:
            n = (feed["token_type_ids"] * feed["attention_mask"]).sum(1)
            return [np.stack([-n, n], axis=1).astype(float)]
        return [np.stack([feed["input_ids"], np.ones_like(feed["input_ids"])], axis=2).astype(float)]


class FakeTokenizer:
    def encode_batch(self, texts):
        parts = lambda t: (t, "") if isinstance(t, str) else t
        made = []
        for t in texts:
            a, b = (x.split() for x in parts(t))
            made.append(type("E", (), {"ids": [len(w) for w in (*a, *b)], "type_ids": [0] * len(a) + [1] * len(b)}))
        return made


def test_onnx_models_run_in_padded_batches_and_keep_order(monkeypatch):
    plain, pairs = FakeSession(), FakeSession(True)
    monkeypatch.setattr(models, "_onnx", lambda folder, device: (plain if folder == "e" else pairs, FakeTokenizer()))
    texts = ["aaa " * 40, "b", "cc cc", "d " * 20, ""]
    out = models.OnnxEmbedder("e", 2, "m", batch=2, lengths=(4, 32, 64)).embed_docs(texts)
    want = np.array([[3, 1], [1, 1], [2, 1], [1, 1], [0, 0]], float)
    assert np.allclose(out, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12))
    assert plain.widths == [4, 32, 64]
    assert models.OnnxReranker("r", "m", batch=2).score("q", ["a b c", "", "a"]) == [3.0, 0.0, 1.0]


def test_onnx_models_from_files(tmp_path):
    onnx = pytest.importorskip("onnxruntime")
    assert models.providers("cpu") == ["CPUExecutionProvider"] and models.providers("auto")[-1] == "CPUExecutionProvider"
    if models.providers("auto") == ["CPUExecutionProvider"]:
        with pytest.raises(ValueError, match="GPU"):
            models.providers("gpu")
    (tmp_path / "model.onnx").write_bytes(b"no model")
    (tmp_path / "tokenizer.json").write_text("{}")
    with pytest.raises(Exception):  # noqa: B017
        models.OnnxReranker(str(tmp_path), "m").score("a", ["b"])
    assert onnx.__version__


def test_grouped_sums_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 5}", rng.normal(size=7).tolist()) for i in range(200)] + [("g0", None), (None, [1.0] * 7)]
    df = spark.createDataFrame(rows, "g string, vector array<double>").repartition(6)
    got = {}
    for r in V.grouped_sums(df, "g", squares=True).collect():
        key = r.g
        old = got.setdefault(key, [np.zeros(7), 0, np.zeros(7)])
        got[key] = [old[0] + r.total, old[1] + r.n, old[2] + r.total2]
    for g in ("g0", "g3"):
        x = np.array([v for k, v in rows if k == g and v is not None])
        assert np.allclose(got[g][0], x.sum(0)) and got[g][1] == len(x) and np.allclose(got[g][2], (x * x).sum(0))


def test_hours_are_the_largest_unit_without_days(spark):
    assert each(spark, [59, 3600, 86_399, 86_400, 200_000], T.human_duration(F.col("v"), days=False), "int") == ["59s", "1h", "23h", "24h", "55h"]


def test_hashing_does_not_depend_on_the_order_of_words():
    words = [f"w{i}" for i in range(200)]
    a, b = models.EMBEDDERS["hashing-64"].embed_docs([" ".join(words), " ".join(words[::-1])])
    assert a.tolist() == b.tolist()


def test_search_memory_does_not_grow_with_the_block(spark):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows, asked = rng.integers(-2, 3, (4096, 8)) * 0.5, rng.integers(-2, 3, (1024, 8)) * 0.5  # many ties
    ids = rng.permutation(4096)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(rows.ravel(), 8)], names=["id", "vector"])
    tracemalloc.start()
    got = list(dense._search(np.arange(1024), asked, 10)(iter([batch.slice(0, 3000), batch.slice(3000)])))[0].to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = asked @ rows.T
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :10]
    assert got["query_id"] == np.repeat(np.arange(1024), 10).tolist() and got["id"] == ids[order].ravel().tolist()
    assert got["score"] == np.take_along_axis(scores, order, 1).ravel().tolist()
    assert peak < 64 << 20  # one block of scores alone has 32 MB
