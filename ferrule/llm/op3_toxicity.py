"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding maps look-alike letters of other scripts, full-width forms and digits or signs that
stand for letters onto plain letters.  The lexicon is mined from labelled text: words and word
beginnings whose rate in toxic text is far above that in clean text, weighted by the log of
the two rates' ratio.  A hit inside an exception phrase does not count; such phrases are mined from
clean labelled texts that hold lexicon words.  The weights found are divided by the text's length in
words, and a logistic curve makes the score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, held_out, labelled_sample, map_arrow, read_table, where_text
from .fitting import fit_logistic, predict_logistic

#: Look-alike letters (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ѡ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
#: Digits and signs that stand for letters (fixed values).
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): str(i) for i in range(10)} | {c: "" for c in "­​‌‍⁠﻿"})
_DIGITS = str.maketrans(DIGITS)
_SIGNS = str.maketrans(SIGNS)
_MIXED = re.compile(r"[^\W_]*(?:[0-9][^\W\d_]|[^\W\d_][0-9])[^\W_]*")
_SIGNED = re.compile(r"[@$!]+(?=[^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_*]){2,}[^\W_](?![^\W_])")
_SPACED_SIGN = re.compile(r"[.\-_*][^\W_][.\-_*]")
_DIGIT = re.compile("[0-9]")
_OTHER = re.compile(r"[\W_]+")
_FOLDED = frozenset(map(chr, _FOLD))
_BLANKED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Bounds of what fitting sees: ids per class, and characters per id on average; texts are whole.
SAMPLE, SAMPLE_CHARS = 1500, 8_000
THRESHOLD = 0.5
#: Letters of a word's beginning that may be a pattern of its own, least and most (whole words are
#: patterns at any length; a longer beginning is found by its shorter one).
BEGINNING = (4, 12)
#: Words added to a text's length, so that one hit in a few words is no certainty.
DAMPING = 50
#: Share of a text's words from which a pattern is dense in it.
DENSE = 0.005


def fold(text: str) -> str:
    """Lower-case words of letters and digits, single blanks between and around them.

    Each step is tried only where its signs occur: most texts need none but the last."""
    t = text.lower()
    if not t.isascii():
        beyond = {c for c in set(t) if c > "\x7f"}
        if not beyond.isdisjoint(_FOLDED):
            t = t.translate(_FOLD)
        if others := {ord(c): " " for c in beyond if not c.isalnum() and c not in _FOLDED}:
            t = t.translate(others)
    if "@" in t or "$" in t or "!" in t:
        t = _SIGNED.sub(lambda m: m[0].translate(_SIGNS), t)
    if _SPACED_SIGN.search(t):
        t = _SPACED.sub(lambda m: _OTHER.sub("", m[0]), t)
    if _DIGIT.search(t):
        t = _MIXED.sub(lambda m: m[0].translate(_DIGITS), t)
    words = t.encode("utf-8", "surrogatepass").translate(_BLANKED).split()
    return " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "


def tally(texts: list[str], only: set[str] | None = None, beginning: tuple[int, int] = BEGINNING) -> tuple[Counter, Counter, Counter, int, int]:
    """By pattern (within `only`): tokens, texts, and texts where it is dense; and the numbers
    of words and texts.

    A pattern starts at a word's start; one that ends in a blank is a whole word, any other a
    word's beginning of `beginning` letters."""
    tokens, docs, dense, n = Counter(), Counter(), Counter(), 0
    known: dict[str, list[str]] = {}

    def patterns(w: str) -> list[str]:
        if (found := known.get(w)) is None:
            found = [p for p in (f" {w} ", *(" " + w[:k] for k in range(beginning[0], min(len(w), beginning[1]) + 1))) if only is None or p in only]
            known[w] = found
        return found

    for t in texts:
        words = Counter(t.split())
        total = sum(words.values())
        n += total
        own: Counter = Counter()
        for w, c in words.items():
            for p in patterns(w):
                own[p] += c
        tokens.update(own)
        docs.update(own.keys())
        dense.update(p for p, c in own.items() if c >= 2 and c >= DENSE * total)
    return tokens, docs, dense, n, len(texts)


def mine(toxic: list[str], clean: list[str], least_docs: int = 3, least_ratio: float = 8.0, least_evidence: float = 18.0) -> dict[str, float]:
    """Lexicon of folded texts: pattern -> weight, the log of the ratio of its rates.

    A pattern stays if at least `least_docs` toxic texts hold it, its rate there is
    `least_ratio` times that in clean text, and the log-likelihood ratio of the texts that hold
    it, or where it is dense, is `least_evidence` or more (many patterns are tried, so chance finds must be kept out).
    Of nested beginnings with nearly equal counts the longest stays; a longer one that adds
    nothing to a kept beginning goes."""
    t_tokens, t_docs, t_dense, t_n, t_all = tally(toxic)
    candidates = {p for p, d in t_docs.items() if d >= least_docs}
    c_tokens, c_docs, c_dense, c_n, c_all = tally(clean, candidates)

    def evidence(p: str) -> float:
        return max(ratio_test(t_docs[p], c_docs[p]), ratio_test(t_dense[p], c_dense[p]))

    def ratio_test(k: int, m: int) -> float:
        if not k:
            return 0.0
        rate = (k + m) / (t_all + c_all)
        part = lambda x, n, q: (x * math.log(x / (n * q)) if x else 0.0) + ((n - x) * math.log((n - x) / (n * (1 - q))) if n > x and q < 1 else 0.0)
        return 2 * (part(k, t_all, rate) + part(m, c_all, rate)) if k / t_all > m / max(c_all, 1) else 0.0

    found = {}
    for p in candidates:
        ratio = ((t_tokens[p] + 0.5) / max(t_n, 1)) / ((c_tokens[p] + 0.5) / max(c_n, 1))
        if ratio >= least_ratio and evidence(p) >= least_evidence:
            found[p] = math.log(ratio)
    kept: set[str] = set()
    for p in sorted(found, key=lambda p: (p.endswith(" "), len(p), p)):
        stem, whole = p.rstrip(" "), p.endswith(" ")
        shorter = next((stem[:k] for k in range(len(stem) - (not whole), 4, -1) if stem[:k] in kept), None)
        if shorter is None:
            kept.add(p)
        elif not whole and t_tokens[p] >= 0.9 * t_tokens[shorter]:
            kept.remove(shorter)
            kept.add(p)
    return {p: round(found[p], 6) for p in sorted(kept)}


def mine_exceptions(toxic: list[str], clean: list[str], lexicon: dict[str, float], least_docs: int = 3, least_ratio: float = 8.0) -> list[str]:
    """Harmless phrases: a word that the lexicon hits with its neighbour on either side, where at
    least `least_docs` clean texts hold the two and their share of clean texts is `least_ratio` times
    that of toxic ones."""
    whole, begins = {p.strip() for p in lexicon if p.endswith(" ")}, tuple(p.strip() for p in lexicon if not p.endswith(" "))

    def phrases(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for t in texts:
            w = t.split()
            at = [i for i, x in enumerate(w) if x in whole or (begins and x.startswith(begins))]
            out.update({f"{w[i]} {w[j]}" for k in at for i, j in ((k - 1, k), (k, k + 1)) if i >= 0 and j < len(w)})
        return out

    if not lexicon:
        return []
    harmless, other = phrases(clean), phrases(toxic)
    rate = lambda n, all_: (n + 0.5) / max(all_, 1)
    return sorted(p for p, n in harmless.items() if n >= least_docs and rate(n, len(clean)) >= least_ratio * rate(other[p], len(toxic)))


def build_automaton(lexicon: dict[str, float], exceptions=()) -> ahocorasick.Automaton:
    """Both kinds of pattern in one automaton; an exception has no weight."""
    a = ahocorasick.Automaton()
    for p, w in lexicon.items():
        a.add_word(p, (len(p), w))
    for p in exceptions:
        a.add_word(fold(p), (len(fold(p)), None))
    if len(a):
        a.make_automaton()
    return a


def hits(automaton: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Sum of weights and number of hits; at one place the heaviest pattern counts, and nothing
    counts inside an exception."""
    if not len(automaton):
        return 0.0, 0
    found: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w is None:
            free.append((start, end))
        elif w > found.get(start, 0.0):
            found[start] = w
    if free:
        joined: list[list[int]] = []  # overlapping exceptions as one interval each
        for a, b in sorted(free):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        starts = [a for a, _ in joined]
        inside = lambda s: (k := bisect_right(starts, s)) and s < joined[k - 1][1]
        found = {s: w for s, w in found.items() if not inside(s)}
    return sum(found.values()), len(found)


def feature(automaton: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Weight of the hits by the text's length in words, as a logarithm; and their number."""
    weight, n = hits(automaton, folded)
    return math.log1p(100 * weight / (folded.count(" ") - 1 + DAMPING)), n


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, remainder: int = 0, per_class: int = SAMPLE, max_chars: int = SAMPLE_CHARS, exceptions=()) -> dict:
    """Lexicon, exception phrases (those given and those mined) and curve.

    Mines the lexicon on one half of the sample and calibrates on the other, both ways round
    for the curve; the lexicon used is that of the whole sample.  Without labels of both
    classes the lexicon is empty and every score is 0."""
    rows, share = labelled_sample(documents, labels, label, mod, remainder, per_class, max_chars)
    folded = [fold(t) for _, t, _ in rows]
    y = np.array([v for *_, v in rows])
    if len(set(y.tolist())) < 2:
        return {"lexicon": {}, "exceptions": list(exceptions), "curve": None}

    def learn(known: list[tuple]) -> tuple[dict, list]:
        toxic, clean = ([t for t, a in known if a == v] for v in (1, 0))
        lexicon = mine(toxic, clean)
        return lexicon, [*exceptions, *mine_exceptions(toxic, clean, lexicon)]

    half = np.arange(len(rows)) % 2
    f = np.zeros((len(rows), 1))
    for side in (0, 1):
        automaton = build_automaton(*learn([(t, a) for t, a, h in zip(folded, y, half, strict=True) if h != side]))
        for i in np.flatnonzero(half == side):
            f[i] = feature(automaton, folded[i])[0]
    lexicon, harmless = learn(list(zip(folded, y, strict=True)))
    return {"lexicon": lexicon, "exceptions": harmless, "curve": fit_logistic(f, y, share)}


def scores(model: dict, automaton: ahocorasick.Automaton, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Scores and numbers of hits; where nothing was learned the score is 0 (nothing is known to
    be toxic)."""
    f = np.array([feature(automaton, fold(t or "")) for t in texts]).reshape(-1, 2)
    p = np.zeros(len(f)) if model["curve"] is None else predict_logistic(model["curve"], f[:, :1])
    return np.round(p, 6), f[:, 1].astype(np.int64)


def toxicity(documents: DataFrame, model: dict) -> DataFrame:
    """One row per input row: doc_id, score, n_hits; a map over the texts, no shuffle.

    Defined results: a null text scores as the empty one (no hits); repeated rows are scored
    each; an empty table gives an empty table; other columns are not read.  Texts are matched
    whole, one at a time.  Between two hits at one place the heavier counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(model["lexicon"], model["exceptions"])
        for batch in batches:
            for part in byte_slices(batch, "text"):
                p, n = scores(model, automaton, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(n)], names=["doc_id", "score", "n_hits"])

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, score double, n_hits long")


def drop_toxic(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below `threshold`.

    Defined results: a null text is judged as the empty one; rows repeated in all columns stay or go
    together; with nothing learned all stay; an empty table gives an empty table; columns of any
    name but `text` are carried along unread.
    """

    def keep():
        automaton = build_automaton(model["lexicon"], model["exceptions"])
        return lambda texts: (scores(model, automaton, texts)[0] < threshold).tolist()

    return where_text(documents, keep)


def query(spark, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = fit(documents, read_table(spark, sf_dir, "labels"))
    return toxicity(documents, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_hits"
    )
