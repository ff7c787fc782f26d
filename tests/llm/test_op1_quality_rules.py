import re

from fixtures_path import fx
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import op1_quality_rules as op


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        b = brute(t)
        assert {k: r[k] for k in b} == b, t
        assert r.base_failed == (b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"])
        assert not (r.kept and r.base_failed)


def test_odd_rows(spark):
    texts = [r[1] for r in fx.odd_rows() if r[1] is None or len(r[1]) < 6000]
    df = fx.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    check(sorted(op.quality_rules(df).collect(), key=lambda r: r.doc_id), texts)


def test_empty_table(spark):
    assert op.quality_rules(fx.empty(spark)).collect() == []


def test_long_text_with_many_repeats(spark):
    text = "a b c d e " * 20_000
    row = op.quality_rules(fx.documents(spark, [(1, text, "en", "a")])).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (100_000, 100_000, False)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=60), min_size=1, max_size=20))
def test_any_text(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = fx.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    check(sorted(op.quality_rules(df).collect(), key=lambda r: r.doc_id), texts)


def test_plan_is_native(spark, sf):
    plan = op.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
