"""Dense retrieval: exact top-k by cosine, for one query or many, over floats or int8 codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CANDIDATES
from ..functions import vectors as V
from ..shipping import ship
from .ranking import ranked

#: Queries and rows per block of a batch search: a pair of blocks is what a task holds.
QUERY_BLOCK, ROW_BLOCK = 2048, 8192
#: Scores that a task makes at a time.
SCORES = 1 << 20
#: Queries that are broadcast at most (their vectors, eight bytes an element).
BROADCAST_QUERIES = 50_000


def top_dense(vectors: DataFrame, query, k: int = CANDIDATES, floor: float | None = None) -> DataFrame:
    """id, score, rank of the k rows (id, vector) with the largest dot product with `query`, 6
    digits, ties to the smaller id.  The floor applies after the k are chosen; filters on what
    may be chosen belong on `vectors`.  A matrix product per Arrow batch; each task keeps its k."""
    ship(vectors.sparkSession)
    rows = vectors.where(F.col("vector").isNotNull()).select("id", V.doubles(F.col("vector")).alias("vector"))
    found = rows.mapInArrow(_search(np.zeros(1, np.int64), np.array([list(query)], np.float64), k), "query_id long, id long, score double")
    best = ranked(found.select("id", "score").orderBy(F.col("score").desc(), "id").limit(k))
    return best if floor is None else best.where(F.col("score") >= floor)


def _search(ids: np.ndarray, matrix: np.ndarray, k: int):
    """The k best rows of each query over all batches.  Scores are made for a few queries at a time
    (`SCORES` of them), so memory depends neither on the number of queries nor on that of the rows."""

    def best_of(q: np.ndarray, own: np.ndarray, scores: np.ndarray) -> tuple:
        order = np.lexsort((own, -scores, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        kept = order[place < k]
        return q[kept], own[kept], scores[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            own = batch.column(0).to_numpy()
            if not len(own):
                continue
            rows = V.matrix(batch.column(1))
            found, step = [best] if best is not None else [], max(1, SCORES // len(own))
            for start in range(0, len(ids), step):
                scores = np.round(matrix[start : start + step] @ rows.T, 6)
                least = np.partition(scores, len(own) - k, axis=1)[:, len(own) - k, None] if len(own) > k else -np.inf
                q, r = np.nonzero(scores >= least)  # all that tie with the k-th
                found.append(best_of(q + start, own[r], scores[q, r]))
            best = best_of(*(np.concatenate(x) for x in zip(*found, strict=True))) if len(found) > 1 else found[0]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])

    return run


def top_dense_batch(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank for all rows of `queries` (query_id, vector): a matrix product of
    a block of queries with a run of rows, the k best per query and task, then a window over those.

    Queries and rows are packed into blocks as binary rows, and a run of rows meets every block of
    queries in turn: by broadcast up to `BROADCAST_QUERIES` of them, beyond by salted runs, each of
    which gets the blocks once.  The table is read once, and neither side passes the driver."""
    ship(vectors.sparkSession)

    def packed(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, most):
                    part = batch.slice(start, most)
                    ids, x = part.column(0).to_numpy(), V.matrix(part.column(1))
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.large_binary()), pa.array([x.tobytes()], pa.large_binary())], names=["ids", "x"])

        return run

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # views of the batch, no copies
                (q_ids, ids), (q, x) = ([np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c in at] for at, kind in (((0, 2), np.int64), ((1, 3), np.float64)))
                rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(x, len(x) // len(ids))], names=["id", "vector"])
                yield from _search(q_ids, q.reshape(len(q_ids), -1), k)(iter([rows]))

    live = lambda df, key: df.where(F.col("vector").isNotNull()).select(F.col(key).cast("long"), V.doubles(F.col("vector")).alias("vector"))
    blocks = live(queries, "query_id").mapInArrow(packed(block), "ids binary, x binary").select(F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    runs = live(vectors, "id").mapInArrow(packed(ROW_BLOCK), "ids binary, x binary")
    if queries.count() <= BROADCAST_QUERIES:
        met = runs.join(F.broadcast(blocks))
    else:
        salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = runs.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long")), "salt")
    out = met.select("q_ids", "q", "ids", "x").mapInArrow(scored, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def store_codes(vectors: DataFrame) -> DataFrame:
    """id, q, scale: the int8 store.  Dead vectors are kept with scale 0."""
    return vectors.select("id", V.quantize(F.col("vector")).alias("z")).select("id", "z.q", "z.scale")


def top_codes(codes: DataFrame, query, k: int = CANDIDATES) -> DataFrame:
    """Top k over int8 codes: the query is quantised too, and the whole-number dot product is
    scaled by both; dead rows take no part."""
    v = np.asarray(query, float)
    peak = np.abs(v).max()
    if not peak > 1e-12:
        return codes.select("id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where(F.lit(False))
    q = np.clip(V.round_half_away(v * 127.0 / peak), -127, 127)
    scored = codes.where("scale <> 0").select("id", F.round(V.dot(F.col("q"), V.literal(q)) * F.col("scale") * float(peak / 127.0), 6).alias("score"))
    return ranked(scored.orderBy(F.col("score").desc(), "id").limit(k))


def dense_gap(vectors: DataFrame | None, files: DataFrame) -> str | None:
    """What dense search cannot find, in words, or None."""
    if vectors is None or vectors.isEmpty():
        return "no vectors are stored, so nothing is found by meaning; scan with a model"
    missing = files.count() - vectors.count()
    return f"{missing} files have no vector yet and are found by text alone; scan with a model" if missing > 0 else None
