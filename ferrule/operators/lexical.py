"""Lexical retrieval: postings, statistics, BM25 with column weights."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BM25_B, BM25_FILE_WEIGHTS, BM25_K1, BM25_LEAST_IDF, CANDIDATES
from ..functions import text as T
from ..shipping import ship

#: Postings that a task holds and orders at a time, and rows of a batch that it hands on.
RUN, HANDED = 1 << 20, 1 << 16


def postings(docs: DataFrame, columns: tuple = ("path", "name", "body")) -> DataFrame:
    """id, term, tf_<column>...: how often each column of a row holds each term.

    The terms of a row are grouped with partial aggregation, so what is shuffled is a row per
    distinct term of a document, not per token."""

    def tagged(i: int):
        return lambda t: F.struct(F.lit(i).alias("c"), t.alias("t"))

    each = F.concat(*(F.transform(T.index_tokens(F.col(c)), tagged(i)) for i, c in enumerate(columns)))
    tokens = docs.select("id", F.explode(each).alias("x")).select("id", F.col("x.t").alias("term"), "x.c")
    return tokens.groupBy("id", "term").agg(*(F.count(F.when(F.col("c") == i, F.lit(1))).alias(f"tf_{c}") for i, c in enumerate(columns)))


def lengths(docs: DataFrame, columns: tuple = ("path", "name", "body")) -> DataFrame:
    """id, n_tokens over all columns, for every row (also those without tokens)."""
    return docs.select("id", reduce(lambda a, b: a + b, (F.size(T.index_tokens(F.col(c))) for c in columns)).cast("long").alias("n_tokens"))


def _score(hits: DataFrame, stats: DataFrame, n_terms: int) -> DataFrame:
    """hits: id, n_tokens, f0, f1, ... (weighted frequencies); stats: one row."""
    total = F.lit(0.0)
    for t in range(n_terms):
        n = F.col(f"n{t}").cast("double")
        raw = F.log((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(raw <= 0, F.lit(BM25_LEAST_IDF)).otherwise(raw)
        f = F.col(f"f{t}").cast("double")
        long = F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("n_tokens") / F.col("avg_tokens")
        total = total + idf * f * F.lit(BM25_K1 + 1) / (f + F.lit(BM25_K1) * long)
    return hits.crossJoin(F.broadcast(stats)).select("id", F.round(total, 6).alias("score"))


def bm25(docs: DataFrame, query: str, weights: dict | None = None, candidates=None) -> DataFrame:
    """id, score of the rows that hold a term of the query; higher is better, 6 digits.

    Each row's tokens are counted once per scan (a generator keeps filters above the counting), in
    one scan for the one-row statistics and one for the scores: no token is shuffled.  `candidates` is a filter on scored rows;
    the statistics always cover all of `docs`.  A query without words matches nothing."""
    terms, weights = T.query_terms(query), weights or BM25_FILE_WEIGHTS
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    columns = list(weights)
    counted = lambda x: F.array(F.size(x), *(T.count_term(x, term, prefix) for term, prefix in terms))
    per_row = F.struct(*(T.let(T.index_tokens(F.col(c)), counted).alias(c) for c in columns))
    m = docs.select("*", F.explode(F.array(per_row)).alias("m"))
    sum_at = lambda i, scaled: reduce(lambda a, b: a + b, (F.get(F.col(f"m.{c}"), i) * (F.lit(float(weights[c])) if scaled else 1) for c in columns))
    flat = m.select(
        *docs.columns,
        sum_at(F.lit(0), False).cast("long").alias("n_tokens"),
        *(sum_at(F.lit(i + 1), True).alias(f"f{i}") for i in range(len(terms))),
    )
    stats = flat.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"), *(F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(terms))))
    hits = flat.where(reduce(lambda a, b: a | b, (F.col(f"f{i}") > 0 for i in range(len(terms)))))
    if candidates is not None:
        hits = hits.where(candidates)
    return _score(hits, stats, len(terms))


def bm25_once(docs: DataFrame, query: str, keep, weights: dict | None = None, candidates=None) -> DataFrame:
    """The same scores with one pass over the texts: a row's length and frequencies are counted in
    Python and written down by `keep` (a function that writes a table and reads it back), and
    statistics and scores come from those few numbers a row."""
    terms, weights = T.query_terms(query), weights or BM25_FILE_WEIGHTS
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long, f = np.zeros(len(batch), np.int64), np.zeros((len(terms), len(batch)))
            for c, weight in weights.items():
                for r, text in enumerate(batch.column(c)):
                    words = T.words(text.as_py())
                    if text.as_py() and not text.as_py().isascii():
                        words = list(map(T.fold, words))
                    long[r] += len(words)
                    for i, (term, prefix) in enumerate(terms):
                        f[i, r] += weight * (sum(w.startswith(term) for w in words) if prefix else words.count(term))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), pa.array(long), *map(pa.array, f)], names=["id", "path", "n_tokens", *names])

    ship(docs.sparkSession)
    names = [f"f{i}" for i in range(len(terms))]
    made = docs.select(*dict.fromkeys(["id", "path", *weights])).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, path string, n_tokens long, " + ", ".join(f"{n} double" for n in names))
    flat = keep(made)
    stats = flat.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"), *(F.count(F.when(F.col(n) > 0, 1)).alias(f"n{i}") for i, n in enumerate(names)))
    hits = flat.where(reduce(lambda a, b: a | b, (F.col(n) > 0 for n in names)))
    return _score(hits if candidates is None else hits.where(candidates), stats, len(terms))


def bm25_postings(index: DataFrame, doc_lengths: DataFrame, query: str, weights: dict | None = None) -> DataFrame:
    """The same scores from stored postings: the scan of the terms is pushed down, and what is
    grouped is only the postings of the query's terms."""
    terms, weights = T.query_terms(query), weights or BM25_FILE_WEIGHTS
    if not terms:
        return doc_lengths.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    is_term = [F.col("term").startswith(t) if prefix else F.col("term") == t for t, prefix in terms]
    f = reduce(lambda a, b: a + b, (F.col(f"tf_{c}") * float(w) for c, w in weights.items()))
    hits = index.where(reduce(lambda a, b: a | b, is_term)).groupBy("id").agg(*(F.sum(F.when(hit, f).otherwise(0.0)).alias(f"f{i}") for i, hit in enumerate(is_term)))
    counts = hits.agg(*(F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(terms))))
    stats = doc_lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("avg_tokens")).crossJoin(counts)
    return _score(hits.join(doc_lengths, "id"), stats, len(terms))


def stored(docs: DataFrame, columns: tuple = ("path", "name", "body")) -> tuple[DataFrame, DataFrame]:
    """The index of repeated queries: postings that carry their row's n_tokens, in runs ordered by
    term, and the lengths they come from."""
    return runs(docs, columns), lengths(docs, columns)


class _Codes(dict):
    """Word -> number of its folded form, which `folded` counts out."""

    def __init__(self):
        self.folded: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        self[word] = n = self.folded.setdefault(T.fold(word), len(self.folded))
        return n


def runs(docs: DataFrame, columns: tuple = ("path", "name", "body")) -> DataFrame:
    """id, term, tf_<column>..., n_tokens of each row, counted where the row is read: nothing is
    shuffled or spilled.  A task hands on runs of about `RUN` postings ordered by (term, id), so that of
    each run a query reads the pages of its terms; memory does not depend on the size of a task."""

    def ordered_run(ids: list, known: dict, parts: list) -> Iterator[pa.RecordBatch]:
        ids, size = pa.chunked_array(ids).combine_chunks(), np.array([len(p[0]) for p in parts])
        code, tf = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        row, column = (np.repeat(x, size) for x in np.divmod(np.arange(len(parts)), len(columns)))
        terms = sorted(known)
        place, by_id, long = np.empty(len(terms), np.int64), np.empty(len(ids), np.int64), np.zeros(len(ids), np.int64)
        place[[known[t] for t in terms]] = np.arange(len(terms))
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        np.add.at(long, row, tf)
        key = place[code] * len(ids) + by_id[row]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        sums = [np.add.reduceat(np.where(column == i, tf, 0)[order], first) for i in range(len(columns))]
        own = row[order][first]
        found = [ids.take(pa.array(own)), pa.array(terms, pa.string()).take(pa.array(place[code[order][first]])), *map(pa.array, sums), pa.array(long[own])]
        whole = pa.RecordBatch.from_arrays(found, names=names)
        for start in range(0, len(whole), HANDED):
            yield whole.slice(start, HANDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, parts, held = [], _Codes(), [], 0
        for batch in batches:
            start, texts = 0, [batch.column(i + 1) for i in range(len(columns))]
            for r in range(len(batch)):
                for x in texts:
                    counts = Counter(T.words(x[r].as_py()))
                    parts.append((np.fromiter(map(codes.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))))
                    held += len(counts)
                if held >= RUN or r == len(batch) - 1:
                    ids.append(batch.column(0).slice(start, r + 1 - start))
                    start = r + 1
                if held >= RUN:
                    yield from ordered_run(ids, codes.folded, parts)
                    ids, codes, parts, held = [], _Codes(), [], 0
        if held:
            yield from ordered_run(ids, codes.folded, parts)

    ship(docs.sparkSession)
    names = ["id", "term", *(f"tf_{c}" for c in columns), "n_tokens"]
    return docs.select("id", *columns).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, term string, " + ", ".join(f"`{n}` long" for n in names[2:]))


def ordered(rows: DataFrame) -> DataFrame:
    """Postings by ranges of (term, id): a query reads the files and row groups of its terms."""
    return rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def statistics_of(stored_postings: DataFrame, docs: DataFrame) -> DataFrame:
    """n_docs, avg_tokens in one row from `runs` of `docs`: each token is in one posting, so no text
    is read again."""
    tokens = reduce(lambda a, b: a + b, (F.col(c) for c in stored_postings.columns if c.startswith("tf_")))
    total = stored_postings.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("total"))
    counted = docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(F.broadcast(total))
    return counted.select("n_docs", F.when(F.col("n_docs") > 0, F.col("total") / F.col("n_docs")).otherwise(0.0).alias("avg_tokens"))


def statistics(doc_lengths: DataFrame) -> DataFrame:
    """n_docs, avg_tokens in one row."""
    return doc_lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("avg_tokens"))


def bm25_stored(index: DataFrame, stats: DataFrame, query: str, weights: dict | None = None) -> DataFrame:
    """The same scores from `stored` postings and `statistics`: the terms reach the scan, only the
    postings of the query's terms are grouped, and no other table is read."""
    terms, weights = T.query_terms(query), weights or BM25_FILE_WEIGHTS
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    is_term = [F.col("term").startswith(t) if prefix else F.col("term") == t for t, prefix in terms]
    f = reduce(lambda a, b: a + b, (F.col(f"tf_{c}") * float(w) for c, w in weights.items()))
    hits = index.where(reduce(lambda a, b: a | b, is_term)).groupBy("id", "n_tokens").agg(*(F.sum(F.when(hit, f).otherwise(0.0)).alias(f"f{i}") for i, hit in enumerate(is_term)))
    counts = hits.agg(*(F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(terms))))
    return _score(hits, stats.crossJoin(counts), len(terms))


def top(scored: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """id, score, rank of the k best, ties to the smaller id; rank counts from 1."""
    from .ranking import ranked

    return ranked(scored.orderBy(F.col("score").desc(), "id").limit(k))
