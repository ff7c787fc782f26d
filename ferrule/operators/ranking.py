"""Ranked lists: fusion, credit from children, directory quota, reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CANDIDATES, DIR_ARM_SCALE, DIR_FROM_CHILDREN_WEIGHT, MAX_DIR_FRACTION, RERANK_POOL_LEAST, RERANK_POOL_MOST, RRF_K
from ..shipping import ship

FILE, DIR = 0, 1
ARM_WEIGHTS = {"file_dense": 1.0, "file_lexical": 1.0, "dir_dense": DIR_ARM_SCALE, "dir_lexical": DIR_ARM_SCALE, "dir_children": DIR_FROM_CHILDREN_WEIGHT * DIR_ARM_SCALE}


def ranked(top: DataFrame) -> DataFrame:
    """Adds rank by score (desc) and id.  For lists already cut to a few hundred rows: the
    window has one partition."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def arm(top: DataFrame, name: str, kind: int) -> DataFrame:
    return top.select(F.lit(name).alias("arm"), F.lit(kind).alias("kind"), "id", "rank")


def fuse(arms: list[DataFrame]) -> DataFrame:
    """kind, id, score, best, fused_rank: reciprocal rank fusion, 9 digits; ties by best rank,
    then files before directories, then id."""
    weight = reduce(lambda w, x: w.when(F.col("arm") == x[0], F.lit(x[1])), list(ARM_WEIGHTS.items())[1:], F.when(F.col("arm") == "file_dense", F.lit(1.0)))
    rows = reduce(DataFrame.unionByName, arms)
    fused = rows.groupBy("kind", "id").agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best"))
    return fused.withColumn("fused_rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "best", "kind", "id")))


def merged_files(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """id, position: dense hits in their order, then lexical hits that are not among them."""
    both = dense.select("id", F.col("rank").alias("p")).unionByName(lexical.select("id", (F.col("rank") + F.lit(1_000_000)).alias("p")))
    first = both.groupBy("id").agg(F.min("p").alias("p"))
    return first.select("id", F.row_number().over(Window.orderBy("p")).alias("position"))


def children_arm(positions: DataFrame, parents: DataFrame, roots: DataFrame | None = None, k: int = CANDIDATES) -> DataFrame:
    """id, score, rank of directories by the credit of the files in them: sum of 1 / (60 +
    position), 9 digits.  parents: id, parent_id.  Configured roots are no answers."""
    owned = parents.join(F.broadcast(positions), "id").where(F.col("parent_id").isNotNull())
    credit = owned.groupBy(F.col("parent_id").alias("id")).agg(F.round(F.sum(1.0 / (RRF_K + F.col("position"))), 9).alias("score"))
    if roots is not None:
        credit = credit.join(F.broadcast(roots), "id", "left_anti")
    return ranked(credit.orderBy(F.col("score").desc(), "id").limit(k))


def most_dirs(limit: int) -> int:
    return max(1, math.floor(limit * MAX_DIR_FRACTION + 0.5))


def select_quota(fused: DataFrame, limit: int, order: str = "fused_rank") -> DataFrame:
    """The first `limit` rows with at most a third of directories; held back ones fill up what
    files leave.  Adds position."""
    own = F.row_number().over(Window.partitionBy("kind").orderBy(order))
    marked = fused.withColumn("held", ((F.col("kind") == DIR) & (own > most_dirs(limit))).cast("int"))
    return marked.withColumn("position", F.row_number().over(Window.orderBy("held", order))).where(F.col("position") <= limit).drop("held")


def pool_size(limit: int) -> int:
    return min(RERANK_POOL_MOST, max(RERANK_POOL_LEAST, 2 * limit))


def rerank_pool(fused: DataFrame, texts: DataFrame, query: str, reranker, size: int) -> DataFrame:
    """The first `size` fused rows with the reranker's score and pool_rank (score desc, then
    fused order).  texts: kind, id, text; a missing text scores as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = reranker.score(query, [t or "" for t in batch.column("text").to_pylist()])
            if len(scores) != batch.num_rows:
                raise ValueError(f"the reranker gave {len(scores)} scores for {batch.num_rows} texts")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(scores, pa.float64())], names=["kind", "id", "score", "fused_rank", "rerank"])

    pool = fused.where(F.col("fused_rank") <= size).join(texts, ["kind", "id"], "left").select("kind", "id", "score", "fused_rank", "text")
    ship(fused.sparkSession)
    scored = pool.mapInArrow(run, "kind int, id long, score double, fused_rank int, rerank double")
    return scored.withColumn("pool_rank", F.row_number().over(Window.orderBy(F.col("rerank").desc(), "fused_rank")))


def with_tail(head: DataFrame, fused: DataFrame, pool: int, limit: int) -> DataFrame:
    """Reranked head (with position), then the rest of the fused list in its order; the tail
    keeps no directory quota."""
    tail = fused.where(F.col("fused_rank") > pool).join(head.select("kind", "id"), ["kind", "id"], "left_anti")
    both = head.select("kind", "id", "score", F.lit(0).alias("part"), F.col("position").alias("o")).unionByName(tail.select("kind", "id", "score", F.lit(1).alias("part"), F.col("fused_rank").alias("o")))
    return both.withColumn("position", F.row_number().over(Window.orderBy("part", "o"))).where(F.col("position") <= limit).drop("part", "o")
