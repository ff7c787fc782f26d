"""The search facade: five ranked arms, fusion, optional reranking, quota, result rows."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BM25_DIR_WEIGHTS, CANDIDATES, DEFAULT_FLOOR, DEFAULT_LIMIT
from ..functions import text as T
from ..operators import dense, lexical, ranking
from ..sources.corpus import under


@dataclass(frozen=True)
class SearchRequest:
    text: str = ""
    mode: str = "hybrid"
    limit: int = DEFAULT_LIMIT
    floor: float = DEFAULT_FLOOR
    scopes: tuple = ()
    topic: int | None = None
    query_vector: tuple | None = None

    def __post_init__(self):
        if self.mode not in ("hybrid", "lexical", "dense"):
            raise ValueError(f"no mode named {self.mode!r}; known: hybrid, lexical, dense")
        if self.topic is not None and self.topic < 1:
            raise ValueError("topics count from 1")


@dataclass
class Index:
    """Tables of an index.  files: id, path, name, parent, body; vectors: id, vector; dirs: id,
    path, tokens, file_count; dir_vectors: id, vector; file_topics: id, topic, distance.

    With stored postings and statistics (see `lexical.stored`), no text is read but that of the rows
    shown; without them, texts are counted for the query at hand.  With codes, files are ranked by
    the int8 store.  With `keep` (it writes a table down and reads it back), texts without postings
    are read once for a query."""

    files: DataFrame
    vectors: DataFrame
    dirs: DataFrame
    dir_vectors: DataFrame | None = None
    file_topics: DataFrame | None = None
    roots: tuple = ()
    postings: DataFrame | None = None
    stats: DataFrame | None = None
    dir_postings: DataFrame | None = None
    dir_stats: DataFrame | None = None
    codes: DataFrame | None = None
    keep: Callable[[DataFrame], DataFrame] | None = None


def looks_like_path(word: str) -> bool:
    return "/" in word or word in ("~", ".", "..")


def split_scope(words: list[str], exists=os.path.isdir) -> tuple[list[str], str]:
    """Leading words that name existing folders are the scope, the rest is the text."""
    n = 0
    while n < len(words) and looks_like_path(words[n]) and exists(os.path.expanduser(words[n])):
        n += 1
    return words[:n], " ".join(words[n:])


def at_once(lists: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Ranked lists (id, score, rank) as local relations, all of them in one job."""
    if not lists:
        return {}
    tagged = [df.select(F.lit(name).alias("list"), "id", "score", "rank") for name, df in lists.items()]
    rows: dict[str, list] = {name: [] for name in lists}
    for r in reduce(DataFrame.unionAll, tagged).collect():
        rows[r.list].append((r.id, r.score, r["rank"]))
    spark = tagged[0].sparkSession
    kinds = {"id": pa.int64(), "score": pa.float64(), "rank": pa.int32()}
    return {name: spark.createDataFrame(pa.table([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))) for name, found in rows.items()}


def local(df: DataFrame) -> DataFrame:
    """Rows of a ranked list as a local relation, which the optimiser evaluates without a job where
    it can.  Lists are cut to a few hundred rows before they come here, so that what is read for
    them afterwards can be asked for by id."""
    return df.sparkSession.createDataFrame(df.toArrow())


def by_id(rows: DataFrame, keys: DataFrame, kind: int) -> DataFrame:
    """The rows whose ids are among the (kind, id) keys, as a filter that reaches the scan: the
    texts of a few rows are read, not those of all."""
    ids = [r.id for r in keys.where(F.col("kind") == kind).select("id").collect()]
    return rows.where(F.col("id").isin(ids) if ids else F.lit(False))


def _results(df: DataFrame, index: Index) -> DataFrame:
    """Adds path, snippet, file_count to local (kind, id) rows; rows whose file or directory is
    gone drop out."""
    files = by_id(index.files, df, 0).select(F.lit(0).alias("kind"), "id", "path", T.snippet(F.col("body")).alias("snippet"), F.lit(None).cast("long").alias("file_count"))
    dirs = by_id(index.dirs, df, 1).select(F.lit(1).alias("kind"), "id", "path", F.lit(None).cast("string").alias("snippet"), F.col("file_count").cast("long"))
    return files.unionByName(dirs).join(F.broadcast(df), ["kind", "id"])


def topic_listing(index: Index, topic: int, limit: int) -> DataFrame:
    hits = index.file_topics.where(F.col("topic") == topic).orderBy("distance", "id").limit(limit)
    listed = ranking.ranked(hits.select("id", (-F.col("distance")).alias("score"), "distance"))
    columns = listed.select(F.lit(0).alias("kind"), "id", F.lit(0.0).alias("score"), F.col("rank").alias("position"), F.col("distance").alias("topic_distance"))
    return _results(local(columns), index)


def arms(index: Index, request: SearchRequest) -> dict[str, DataFrame]:
    """Ranked lists (id, score, rank) by arm.  Scope and topic restrict what may be ranked; the
    cosine floor cuts what was ranked.  A topic is a set of files, so it leaves no directory arm."""
    scope = under(F.col("path"), list(request.scopes)) if request.scopes else F.lit(True)
    out: dict[str, DataFrame] = {}
    in_topic = index.file_topics.where(F.col("topic") == request.topic).select("id") if request.topic is not None else None

    def allowed(rows: DataFrame, members: bool) -> DataFrame:
        rows = rows.where(scope) if request.scopes else rows
        return rows.join(in_topic, "id", "left_semi") if members and in_topic is not None else rows

    if request.mode != "lexical" and request.query_vector is not None:
        vectors = index.vectors if index.codes is None else index.codes
        if request.scopes or in_topic is not None:
            vectors = vectors.join(allowed(index.files.select("id", "path"), True).select("id"), "id", "left_semi")
        if index.codes is None:
            out["file_dense"] = dense.top_dense(vectors, request.query_vector, floor=request.floor)
        else:
            out["file_dense"] = dense.top_codes(vectors, request.query_vector).where(F.col("score") >= request.floor)
        if request.topic is None and index.dir_vectors is not None:
            dir_vectors = index.dir_vectors
            if request.scopes:
                self_too = F.col("path").isin(*(s.rstrip("/") for s in request.scopes))
                dir_vectors = dir_vectors.join(index.dirs.where(scope | self_too).select("id"), "id", "left_semi")
            out["dir_dense"] = dense.top_dense(dir_vectors, request.query_vector, floor=request.floor)
    if request.mode != "dense" and T.query_terms(request.text):
        if index.postings is not None:
            hits = lexical.bm25_stored(index.postings, index.stats, request.text)
            hits = hits.join(index.files.where(scope).select("id"), "id", "left_semi") if request.scopes else hits
        elif index.keep is not None:
            hits = lexical.bm25_once(index.files, request.text, index.keep, candidates=scope)
        else:
            hits = lexical.bm25(index.files, request.text, candidates=scope)
        out["file_lexical"] = lexical.top(hits.join(in_topic, "id", "left_semi") if in_topic is not None else hits)
        if request.topic is None:
            self_too = F.col("path").isin(*(s.rstrip("/") for s in request.scopes)) if request.scopes else F.lit(False)
            if index.dir_postings is not None:
                hits = lexical.bm25_stored(index.dir_postings, index.dir_stats, request.text, BM25_DIR_WEIGHTS)
                hits = hits.join(index.dirs.where(scope | self_too).select("id"), "id", "left_semi") if request.scopes else hits
            else:
                named = index.dirs.where(~F.col("path").isin(*index.roots)) if index.roots else index.dirs
                hits = lexical.bm25(named.select("id", "path", F.col("tokens").alias("name")), request.text, BM25_DIR_WEIGHTS, candidates=scope | self_too)
            out["dir_lexical"] = lexical.top(hits)
    return out


def search(index: Index, request: SearchRequest, reranker=None) -> DataFrame:
    """position, kind, id, path, score, cosine, dense_rank, lexical_rank, rerank, file_count,
    topic_distance, snippet, explain of the rows shown."""
    none = lambda kind: F.lit(None).cast(kind)
    if not request.text.strip():
        if request.topic is None:
            return index.files.select(F.lit(1).alias("position"), F.lit(0).alias("kind"), "id", "path").where(F.lit(False))
        rows = topic_listing(index, request.topic, request.limit)
        return rows.select("position", "kind", "id", "path", "score", none("double").alias("cosine"), none("int").alias("dense_rank"), none("int").alias("lexical_rank"), none("double").alias("rerank"), "file_count", "topic_distance", "snippet", F.format_string("topic member at %.4f", "topic_distance").alias("explain"))
    found = arms(index, request)
    empty = index.files.select("id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where(F.lit(False))
    kinds = {name: 0 if name.startswith("file") else 1 for name in ranking.ARM_WEIGHTS}
    found = at_once(found)
    if request.topic is None:
        positions = local(ranking.merged_files(found.get("file_dense", empty), found.get("file_lexical", empty)).where(F.col("position") <= 2 * CANDIDATES))
        parents = by_id(index.files, positions.withColumn("kind", F.lit(0)), 0).select("id", "parent").join(index.dirs.select(F.col("path").alias("parent"), F.col("id").alias("parent_id")), "parent").select("id", "parent_id")
        roots = index.dirs.where(F.col("path").isin(*index.roots)).select("id") if index.roots else None
        found["dir_children"] = local(ranking.children_arm(positions, parents, roots))
    fused = local(ranking.fuse([ranking.arm(df, name, kinds[name]) for name, df in found.items()]))
    if reranker is not None and request.mode != "lexical":
        size = ranking.pool_size(request.limit)
        head = fused.where(F.col("fused_rank") <= size)
        texts = by_id(index.files, head, 0).select(F.lit(0).alias("kind"), "id", T.rerank_text(F.lit(0), F.col("path"), F.col("name"), F.col("body")).alias("text")).unionByName(by_id(index.dirs, head, 1).select(F.lit(1).alias("kind"), "id", F.col("path").alias("text")))
        pool = ranking.rerank_pool(fused, texts, request.text, reranker, size)
        head = ranking.select_quota(pool, request.limit, "pool_rank")
        chosen = ranking.with_tail(head, fused, size, request.limit).join(pool.select("kind", "id", "rerank"), ["kind", "id"], "left")
    else:
        chosen = ranking.select_quota(fused, request.limit).withColumn("rerank", none("double"))

    def ranks(names: tuple, column: str, score: str | None) -> DataFrame:
        rows = None
        for n in names:
            part = found.get(n, empty).select(F.lit(kinds[n]).alias("kind"), "id", F.col("rank").alias(column), *([F.col("score").alias(score)] if score else []))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    shown = (
        chosen.select("position", "kind", "id", "score", "rerank")
        .join(ranks(("file_dense", "dir_dense"), "dense_rank", "cosine"), ["kind", "id"], "left")
        .join(ranks(("file_lexical", "dir_lexical"), "lexical_rank", None), ["kind", "id"], "left")
    )
    d, x = F.col("dense_rank"), F.col("lexical_rank")
    explain = (
        F.when(d.isNotNull() & x.isNotNull(), F.format_string("by meaning (#%d) and text (#%d)", d, x))
        .when(d.isNotNull(), F.format_string("by meaning (#%d)", d))
        .when(x.isNotNull(), F.format_string("by text (#%d)", x))
        .otherwise("contents of this directory")
    )
    return _results(local(shown), index).select("position", "kind", "id", "path", "score", "cosine", "dense_rank", "lexical_rank", "rerank", "file_count", none("double").alias("topic_distance"), "snippet", explain.alias("explain"))
