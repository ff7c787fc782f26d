"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each word comes from one of them, with a likelihood given by
the character n-grams of the language.  Expectation-maximisation estimates the proportions per
document; among the sets of its one, two, ... most probable languages, up to all, the one with
the largest penalised likelihood is kept (a document leaves the search when an upper bound of
the likelihood shows that no larger set can win), and the language with the largest proportion in it is reported.

Everything runs over arrays: bytes, then words, then (word x language) for a run of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, byte_slices, held_out, map_arrow, read_table

TABLE_BITS = 16
#: Bounds of what fitting sees: texts per language, and characters per text on average; texts are whole.
SAMPLE, SAMPLE_CHARS = 600, 8_000
STEPS = 6
#: Cost of one more language in a document's set, in units of log(words + 1).
PENALTY = 3.0

_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts, each closed by a blank, and where each starts and ends."""
    closed = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(texts, "")), pa.scalar("", texts.type), pa.scalar(" ", texts.type)).cast(pa.large_binary())
    offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + len(closed) + 1]
    data = np.frombuffer(closed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(closed) else np.zeros(0, np.uint8)
    return _CLASS[data], offsets - offsets[0]


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the four bytes that end one past each place (blank-padded)."""
    p = np.concatenate([np.full(2, 0x20, np.uint8), b, np.full(1, 0x20, np.uint8)]).astype(np.uint32)
    h = p[:-3] * np.uint32(0x9E3779B1) ^ p[1:-2] * np.uint32(0x85EBCA77) ^ p[2:-1] * np.uint32(0xC2B2AE3D) ^ p[3:] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - TABLE_BITS)


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], b != 0x20, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def fit(documents: DataFrame, mod: int = 4, remainder: int = 2, per_lang: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> dict:
    """n-gram log likelihoods from at most `per_lang` whole texts of each language value outside the
    held-out fold, taken by the hash of their ids as far as `per_lang * max_chars` characters go;
    null texts and null languages are left out, and an id in several rows of a language gives its
    smallest text."""
    known = documents.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(mod, remainder))
    # a language's share of hash space that holds about twice the texts wanted: what reaches the
    # driver is bounded without gathering a language's rows in one task
    counts = known.groupBy("lang").count().collect()
    share = F.coalesce(*(F.when(F.col("lang") == r.lang, F.lit(min(1.0, 2 * per_lang / r["count"]))) for r in counts), F.lit(0.0))
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().collect()
    ids = [r for lang in {r.lang for r in counts} for r in sorted((r for r in near if r.lang == lang), key=lambda r: (r.h, r.doc_id))[:per_lang]]
    if not ids:
        return {"langs": [], "table": np.zeros((1 << TABLE_BITS, 0), np.float32)}
    keys = [(r.doc_id, r.lang) for r in ids]
    wanted = F.broadcast(documents.sparkSession.createDataFrame(keys, "doc_id long, g string"))
    rows = bounded_texts(documents.select("doc_id", "text", F.col("lang").alias("g")).join(wanted, ["doc_id", "g"]), keys, per_lang * max_chars)
    langs = sorted({g for *_, g in rows})
    counts = np.zeros((len(langs), 1 << TABLE_BITS))
    for k, lang in enumerate(langs):
        b, _ = _buffers(pa.array([t for _, t, g in rows if g == lang], pa.large_string()))
        g = _grams(b)
        counts[k] = np.bincount(g[b != 0x20], minlength=1 << TABLE_BITS)
    pooled = counts.sum(0)
    base = (pooled + 0.05) / (pooled.sum() + 0.05 * len(pooled))
    strength = 2000.0
    p = (counts + strength * base) / (counts.sum(1, keepdims=True) + strength)
    return {"langs": langs, "table": np.ascontiguousarray(np.log(p).T.astype(np.float32))}


def _mixture(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over words: proportions (documents x languages) within `allowed`, and log likelihoods."""
    pi = allowed / allowed.sum(1, keepdims=True)
    counts = np.diff(np.append(starts, len(doc)))[:, None]
    for _ in range(steps):
        r = like * pi[doc]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, starts, axis=0) / counts
    total = np.log((like * pi[doc]).sum(1))
    return pi, np.add.reduceat(total, starts)


def identify(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each text: index of the language (-1: none), its proportion, the set found."""
    n, langs = len(texts), model["langs"]
    best, score, sets = np.full(n, -1), np.zeros(n), [""] * n
    b, offsets = _buffers(texts)
    starts, ends = _words(b)
    if not langs or not len(starts):
        return best, score, sets
    # a text ends in a blank, so a word's end is always a place in the array
    bounds = np.ravel(np.column_stack([starts, ends]))
    run = np.add.reduceat(model["table"][_grams(b)], bounds, axis=0)[::2].astype(np.float64)
    like = np.exp(np.maximum(run - run.max(1, keepdims=True), -60.0))
    doc_of = np.searchsorted(offsets, starts, side="right") - 1
    docs, first = np.unique(doc_of, return_index=True)
    doc = np.searchsorted(docs, doc_of)
    n_words = np.diff(np.append(first, len(doc)))
    pi, ll = _mixture(like, doc, first, np.ones((len(docs), len(langs))), STEPS)
    # no mixture's log likelihood is above 0 (the best language of a word counts as 1), nor above
    # this one's by more than n log(largest mean ratio of a language to the mixture)
    ratio = np.add.reduceat(like / (like * pi[doc]).sum(1, keepdims=True), first, axis=0).max(1) / n_words
    most = np.minimum(ll + n_words * np.log(ratio), 0.0) + 1e-6
    cost = PENALTY * np.log(n_words + 1)
    order = np.argsort(-pi, axis=1, kind="stable")
    chosen, value = np.zeros_like(pi), np.full(len(docs), -np.inf)
    for k in range(1, len(langs) + 1):
        still = np.flatnonzero(most - (k - 1) * cost > value)
        if not len(still):
            break
        words = np.isin(doc, still)
        allowed = np.zeros((len(still), len(langs)))
        np.put_along_axis(allowed, order[still, :k], 1.0, axis=1)
        begin = np.cumsum(n_words[still]) - n_words[still]
        p, ll = _mixture(like[words], np.repeat(np.arange(len(still)), n_words[still]), begin, allowed, 0 if k == 1 else 4)
        v = ll - (k - 1) * cost[still]
        better = v > value[still]
        chosen[still[better]], value[still[better]] = p[better], v[better]
    top = chosen.argmax(1)
    best[docs], score[docs] = top, chosen[np.arange(len(docs)), top]
    names = np.array(langs, object)
    for i, p in zip(docs, chosen, strict=True):
        sets[i] = ",".join(names[j] for j in np.argsort(-p, kind="stable") if p[j] >= 0.01)
    return best, score, sets


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script; only texts without an ASCII one are walked."""
    plain = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~plain):
        t = texts[int(i)].as_py()
        plain[i] = t is not None and any(c.isalpha() for c in t)
    return plain


def language_id(documents: DataFrame, model: dict) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, langs (the set found, largest share first).

    Defined results: `und` with score 0 for a null text, one without a letter, or when nothing
    was learned; equal shares go to the smaller language value; repeated rows are judged each;
    an empty table gives an empty table; other columns are not read.  Runs of texts of about
    2 MB are held at a time, a longer text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model["langs"], "und"], pa.string())
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = part.column(1).cast(pa.large_string())
                best, score, sets = identify(texts, model)
                best = np.where(has_letter(texts) & (best >= 0), best, len(names) - 1)
                known = best < len(names) - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), names.take(pa.array(best)), pa.array(np.where(known, np.round(np.clip(score, 0, 1), 6), 0.0)), pa.array([s if k else "" for s, k in zip(sets, known, strict=True)], pa.string())],
                    names=["doc_id", "lang_pred", "score", "langs"],
                )

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, langs string")


def query(spark, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return language_id(documents, fit(documents)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "langs")
