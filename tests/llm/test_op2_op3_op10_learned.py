"""Learned operators: awkward rows, the held-out fold, accuracy on labelled rows."""

import math
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from fixtures_path import fx

from ferrule.llm import op2_quality_classifier as quality
from ferrule.llm import op3_toxicity as toxicity
from ferrule.llm import op10_language_id as language
from ferrule.llm.common import labelled_sample

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def models(spark):
    documents, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit(documents, labels), toxicity.fit(documents, labels), language.fit(documents)


def truth(spark, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}


@pytest.mark.parametrize(("query", "column", "mod", "rest", "least"), [(quality.query, "quality", 4, 2, 0.93), (toxicity.query, "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, query, column, mod, rest, least):
    known = truth(spark, column)
    rows = query(spark, BIG).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) >= least


def test_language_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = language.query(spark, BIG).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, models):
    df = fx.documents(spark)
    n = len(fx.odd_rows())
    assert len([r for r in quality.quality_classifier(df, models[0]).collect() if 0 <= r.score <= 1]) == n
    assert len([r for r in toxicity.toxicity(df, models[1]).collect() if 0 <= r.score <= 1]) == n
    rows = {r.doc_id: r for r in language.language_id(df, models[2]).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[6].lang_pred in ("de", "en", "es", "fr")


def test_no_letter_and_other_scripts(spark, models):
    df = fx.documents(spark, [(1, "12 34 -- 5", "en", "a"), (2, "日本", "ja", "a"), (3, "é", "fr", "a")])
    rows = {r.doc_id: r.lang_pred for r in language.language_id(df, models[2]).collect()}
    assert rows[1] == "und" and rows[2] != "und" and rows[3] != "und"


def test_empty_tables(spark, models):
    none = fx.empty(spark)
    assert quality.quality_classifier(none, models[0]).collect() == []
    assert toxicity.toxicity(none, models[1]).collect() == []
    assert language.language_id(none, models[2]).collect() == []
    for fitted in (quality.fit(none, fx.labels(spark, [])), toxicity.fit(none, fx.labels(spark, []))):
        assert fitted["curve"] is None
    assert language.fit(none)["langs"] == []


def test_nothing_learned_rejects_nothing(spark):
    df, no_labels = fx.documents(spark), fx.labels(spark, [(None, 1, 0), (5, None, None), (6, 1, 0), (6, 0, 1)])
    assert quality.keep_good(df, quality.fit(df, no_labels)).count() == df.count()
    assert toxicity.drop_toxic(df, toxicity.fit(df, no_labels)).columns == df.columns
    assert {r.lang_pred for r in language.language_id(df, language.fit(fx.empty(spark))).collect()} == {"und"}


def test_filters_keep_rows_whole(spark, models):
    df = fx.documents(spark)
    kept = quality.keep_good(df, models[0])
    assert kept.schema == df.schema and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("text", ["you idiot", "you 1d10t", "YOU IDIOT!!", "you іdіоt", "you i.d.i.o.t", "you ｉｄｉｏｔ", "you id​iot", "so $tupid, idi0t"])
def test_folding_finds_disguises(text):
    automaton = toxicity.build_automaton({" idiot": 2.0}, ())
    assert toxicity.hits(automaton, toxicity.fold(text))[1] == 1


def test_exception_phrases_do_not_count():
    automaton = toxicity.build_automaton({" trash": 2.0, " trash ": 3.0}, ("trash can",))
    assert toxicity.hits(automaton, toxicity.fold("the trash can")) == (0, 0)
    assert toxicity.hits(automaton, toxicity.fold("the trash canned trash")) == (6.0, 2)


def test_mixture_finds_both_languages(models):
    en = "the of and is that this was with from are by for " * 6
    de = "nicht der die und das ist ein eine zu von mit sich auf " * 2
    _, _, sets = language.identify(pa.array([en + de, en]), models[2])
    assert sets == ["en,de", "en"]


def test_fitting_sees_whole_texts(spark):
    filler = " ".join(f"plain{k % 97}" for k in range(4000))
    rows = [(i, filler + (" grobian grobian" if i % 2 else " gentle gentle") + f" n{i}", "en", "a") for i in range(120)]
    df, marked = fx.documents(spark, rows), fx.labels(spark, [(i, 1 - i % 2, i % 2) for i in range(120)])
    sample, _ = labelled_sample(df, marked, "toxic", 5, 0, 1500, 8000)
    assert sample and all(t == rows[i][1] for i, t, _ in sample)
    assert any(p.startswith(" grob") for p in toxicity.fit(df, marked)["lexicon"])
    seen = language.fit(spark.createDataFrame([(i, t, "x" if i % 2 else "y") for i, t, *_ in rows], "doc_id long, text string, lang string"))
    last = language.identify(pa.array(["grobian", "gentle"]), seen)[0]  # what only the texts' ends hold
    assert [seen["langs"][k] for k in last] == ["x", "y"]
    # the bound leaves whole rows out: 40 ids a class, room for three texts of 31 kB
    few, share = labelled_sample(df, marked, "toxic", 5, 0, 40, 2500)
    assert sorted(y for *_, y in few) == [0] * 3 + [1] * 3 and all(t == rows[i][1] for i, t, _ in few) and 0 < share < 1
    one, _ = labelled_sample(df, marked, "toxic", 5, 0, 40, 1)
    assert sorted(y for *_, y in one) == [0, 1]


def test_mixture_finds_four_languages(spark, models):
    known: dict[str, list[str]] = {}
    for r in spark.read.parquet(f"{BIG}/documents.parquet").orderBy("doc_id").collect():
        if len(words := [w for w in r.text.split() if w.isalpha()]) >= 80:
            known.setdefault(r.lang, words[:80])
    text = " ".join(" ".join(known[lang]) for lang in ("de", "en", "es", "fr"))
    _, score, sets = language.identify(pa.array([known_text := " ".join(known["en"]), text, "", known_text]), models[2])
    assert sets[0] == sets[3] == "en" and set(sets[1].split(",")) == {"de", "en", "es", "fr"}
    assert score[1] < 0.4


# --- plain versions, one text at a time ------------------------------------------------------
def plain_quality(model, text):
    """The two dictionaries through the library's own calls."""
    data = (text or "").encode()
    if not data:
        f = np.zeros((1, 4))
    else:
        sizes = []
        for content in (model["good"], model["bad"]):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=1)
            c = zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
        good, bad = sizes
        whole = len(zstandard.compress(data, 1))
        f = np.array([[(bad - good) / (bad + good), min(good, bad) / len(data), whole / len(data), math.log1p(len(data))]])
    d, r, w, n = f[0]
    x = [d, d * abs(d), r, r * r, w, w * n, n]
    curve = model["curve"]
    z = curve["beta"][0] + sum(b * (v - m) / s for b, v, m, s in zip(curve["beta"][1:], x, curve["mean"], curve["scale"], strict=True))
    return 1 / (1 + math.exp(-z))


def plain_toxicity(model, text):
    """Every pattern looked for at every place of the folded text."""
    t = toxicity.fold(text or "")
    free = set()
    for phrase in map(toxicity.fold, model["exceptions"]):
        for m in re.finditer(f"(?={re.escape(phrase)})", t):
            free |= set(range(m.start(), m.start() + len(phrase) - 1))  # the blank behind it is the next word's
    at = defaultdict(float)
    for p, w in model["lexicon"].items():
        for m in re.finditer(f"(?={re.escape(p)})", t):
            at[m.start()] = max(at[m.start()], w)
    hits = [w for s, w in at.items() if s not in free]
    x = math.log1p(100 * sum(hits) / (len(t.split()) + 50))
    curve = model["curve"]
    return 1 / (1 + math.exp(-(curve["beta"][0] + curve["beta"][1] * (x - curve["mean"][0]) / curve["scale"][0]))), len(hits)


def plain_language(model, text):
    """Textbook expectation-maximisation over the words of one text; every set of the most probable
    languages is tried."""
    langs, table = model["langs"], model["table"].astype(float)
    b = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").lower().encode()) + b" "
    padded, words, word = b"  " + b + b" ", [], None
    for i, c in enumerate(b):
        if c == 32:
            word = None
            continue
        h = 0
        for part, factor in zip(padded[i : i + 4], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), strict=True):
            h ^= part * factor & 0xFFFFFFFF
        h ^= h >> 15
        gram = table[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16]
        if word is None:
            words.append(word := np.zeros(len(langs)))
        word += gram
    if not words or not any(c.isalpha() for c in text):
        return "und"
    like = np.array([np.exp(np.maximum(w - w.max(), -60)) for w in words])

    def mixture(allowed, steps):
        pi = allowed / allowed.sum()
        for _ in range(steps):
            r = like * pi
            pi = (r / r.sum(1, keepdims=True)).mean(0)
        return pi, np.log((like * pi).sum(1)).sum()

    first, _ = mixture(np.ones(len(langs)), 6)
    order, best = np.argsort(-first, kind="stable"), (-math.inf, None)
    for k in range(1, len(langs) + 1):
        allowed = np.zeros(len(langs))
        allowed[order[:k]] = 1
        pi, value = mixture(allowed, 0 if k == 1 else 4)
        value -= (k - 1) * 3.0 * math.log(len(words) + 1)
        if value > best[0] + 1e-9:
            best = value, pi
    return langs[int(best[1].argmax())]


LONG = [(100, "the of and is that " * 6000 + "idiot", "en", "a"), (101, "x" * 90_000, "en", "a"), (102, "a idiot b stupid idiots 1d10t " * 40, "en", "a"), (103, "trash can " * 30 + "trash", "en", "a"), (None, "idiot", "en", "a"), (None, None, None, None)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    return rows + fx.odd_rows() + LONG


def by_row(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_quality_equals_a_plain_version(spark, models, table):
    got = quality.quality_classifier(fx.documents(spark, table), models[0]).collect()
    want = [(i, plain_quality(models[0], t)) for i, t, *_ in table]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-6 for a, b in zip(sorted(((r.doc_id, r.score) for r in got), key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1])), strict=True))


def test_toxicity_equals_a_plain_version(spark, models, table):
    model = models[1] | {"exceptions": ["trash can"]}
    got = by_row(toxicity.toxicity(fx.documents(spark, table), model).collect(), ("doc_id", "n_hits", "score"))
    want = by_row([dict(doc_id=i, n_hits=n, score=round(p, 6)) for i, t, *_ in table for p, n in [plain_toxicity(model, t)]], ("doc_id", "n_hits", "score"))
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_language_equals_a_plain_version(spark, models, table):
    got = by_row(language.language_id(fx.documents(spark, table), models[2]).collect(), ("doc_id", "lang_pred"))
    want = by_row([dict(doc_id=i, lang_pred=plain_language(models[2], t)) for i, t, *_ in table], ("doc_id", "lang_pred"))
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= len(want) // 200  # rounding decides some ties


def test_equal_shares_go_to_the_smaller_language():
    flat = {"langs": ["aa", "bb"], "table": np.zeros((1 << 16, 2), np.float32)}
    best, score, sets = language.identify(pa.array(["any words at all"]), flat)
    assert best[0] == 0 and sets[0] == "aa" and score[0] == 1


@pytest.mark.parametrize("columns", [["score", "y", "g", "n", "half"], ["TEXTS", "label", "_text", "h", "predicted"]])
def test_filters_among_clashing_names(spark, models, columns):
    from pyspark.sql import functions as F

    df = fx.documents(spark).select("doc_id", "text", *(F.lit(1).alias(c) for c in columns))
    for kept in (quality.keep_good(df, models[0]), toxicity.drop_toxic(df, models[1])):
        assert kept.columns == df.columns and 0 < kept.count() <= df.count()
        assert kept.where("text IS NULL").count() in (0, 1)
    assert quality.keep_good(df.limit(0), models[0]).count() == toxicity.drop_toxic(df.limit(0), models[1]).count() == 0


def test_repeated_ids_give_one_bounded_text(spark):
    one, two = [i for i in range(4, 20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    rows = [(one, f"text number {k}", "en", "a") for k in range(500)] + [(two, "other", "de", "a")]
    df = fx.documents(spark, rows)
    sample, _ = labelled_sample(df, fx.labels(spark, [(one, 1, 1), (two, 0, 0)]), "quality", 4, 2, 10, 1000)
    assert sample == [(one, "text number 0", 1), (two, "other", 0)]
    assert language.fit(df)["langs"] == ["de", "en"]


def test_exceptions_are_mined_from_clean_texts():
    clean = [f"put it in the trash can {k}" for k in range(30)] + ["nothing here"] * 20
    toxic = [f"you trash person {k} trash" for k in range(30)]
    folded = [toxicity.fold(t) for t in toxic], [toxicity.fold(t) for t in clean]
    found = toxicity.mine_exceptions(*folded, {" trash": 2.0})
    assert "trash can" in found and "the trash" in found and not any("you" in p or "person" in p for p in found)
    assert toxicity.mine_exceptions(*folded, {}) == []


def test_many_repeats_of_an_exception_are_linear():
    automaton = toxicity.build_automaton({" trash": 2.0}, ("trash can",))
    began = time.perf_counter()
    assert toxicity.hits(automaton, toxicity.fold("trash can " * 100_000)) == (0, 0)
    assert time.perf_counter() - began < 3
