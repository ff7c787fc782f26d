"""Exact top-k by inner product over KD-trees, one tree per shard.

Vectors are scaled to whole numbers.  Each task cuts its rows into shards of bounded size, builds a
KD-tree over each (median splits along the widest coordinate, a tight box around every node) and
writes it down.  The queries are written down too, in blocks of bounded size.  A task then takes
one block and a range of shards and walks the trees best-first for the whole block at once: of the
leaves whose box can still reach a query's k-th score, those with the largest bounds are opened
first, twice as many each time, and scored by matrix products.  The k-th score is carried from
leaf to leaf and from shard to shard.

Neither vectors nor queries pass the driver, and every vector is read once whatever the number of
queries; what is shuffled is k rows per query and range, and there are as many ranges as tasks are
wanted beyond the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_uri, map_arrow, materialize, read_table

SCALE, K = 256, 5
LEAF, SHARD, BLOCK = 128, 65_536, 4_096
_LONG = (1 << 63) - 1


class Tree:
    """A KD-tree over vectors; nodes in arrays, children of i at left[i], left[i] + 1."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        spans, left, low, high = [(0, len(ids))], [-1], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            own = x[order[a:b]]
            low.append(own.min(0))
            high.append(own.max(0))
            if b - a > leaf and (width := high[-1] - low[-1]).size and width.max() > 0:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(width.argmax())], mid)]
                left[at] = len(spans)
                spans += [(a, a + mid), (a + mid, b)]
                left += [-1, -1]
            at += 1
        self.spans, self.left = np.array(spans), np.array(left)
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.x = ids[order], x[order]

    FIELDS = ("ids", "x", "spans", "left", "low", "high")

    def dump(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS]

    @classmethod
    def load(cls, dims: int, parts: list[bytes]) -> Tree:
        own = cls.__new__(cls)
        kinds = (np.int64, np.float64, np.int64, np.int64, np.float64, np.float64)
        shapes = (-1, dims, 2, -1, dims, dims)
        n = len(parts[0]) // 8
        for name, kind, width, data in zip(cls.FIELDS, kinds, shapes, parts, strict=True):
            flat = np.frombuffer(data, kind)
            if width == 0:
                flat = np.zeros((n if name == "x" else len(parts[3]) // 8, 0))
            setattr(own, name, flat if width == -1 else flat.reshape(-1, width) if width else flat)
        return own

    def bounds(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Largest inner product that the nodes' boxes allow for each query."""
        return np.maximum(q, 0) @ self.high[nodes].T + np.minimum(q, 0) @ self.low[nodes].T

    def leaves(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves that some query's k-th score lets through, down from the root, and their bounds."""
        found, open_nodes = [], np.zeros(1, np.int64)
        while len(open_nodes):
            alive = open_nodes[(self.bounds(q, open_nodes) >= least[:, None]).any(axis=0)]
            inner = alive[self.left[alive] >= 0]
            found.append(alive[self.left[alive] < 0])
            open_nodes = np.concatenate([self.left[inner], self.left[inner] + 1])
        kept = np.sort(np.concatenate(found))
        return kept, self.bounds(q, kept)


class Best:
    """The k best (score, id) found so far for each query of a block, ties to the smaller id."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.scores, self.ids = np.full((len(q), k), -np.inf), np.full((len(q), k), _LONG)
        self.opened = 0

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Adds candidates (query's place, score, id)."""
        mine = np.unique(rows)
        rows = np.concatenate([np.repeat(mine, self.k), rows])
        scores = np.concatenate([self.scores[mine].ravel(), scores])
        ids = np.concatenate([self.ids[mine].ravel(), ids])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.scores[mine], self.ids[mine] = scores[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)

    def search(self, tree: Tree) -> None:
        leaves, bounds = tree.leaves(self.q, self.least)
        if not len(leaves):
            return
        order = np.argsort(-bounds, axis=1, kind="stable")
        begin, width = 0, 1
        while begin < len(leaves):
            wave = order[:, begin : begin + width]
            rows = np.repeat(np.arange(len(self.q)), wave.shape[1])
            leaf = wave.ravel()
            alive = bounds[rows, leaf] >= self.least[rows]
            if not alive.any():
                break  # bounds fall along the order, so no later leaf is of use to any query
            rows, leaf = rows[alive], leaf[alive]
            by_leaf = np.argsort(leaf, kind="stable")
            rows, leaf = rows[by_leaf], leaf[by_leaf]
            found = []
            for at in np.split(np.arange(len(leaf)), np.flatnonzero(leaf[1:] != leaf[:-1]) + 1):
                found.append(self._open(tree, int(leaves[leaf[at[0]]]), rows[at]))
            if parts := [f for f in found if f is not None]:
                self.take(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            begin, width = begin + width, width * 2

    def _open(self, tree: Tree, leaf: int, rows: np.ndarray):
        a, b = tree.spans[leaf]
        ids = tree.ids[a:b]
        scores = self.q[rows] @ tree.x[a:b].T
        scores[self.q_ids[rows][:, None] == ids[None, :]] = -np.inf
        self.opened += len(rows)
        least = self.least[rows]
        if scores.shape[1] > self.k:  # of one leaf's, only the k best and their equals can count
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        return (rows[i], scores[i, j], ids[j]) if len(i) else None

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query id, id, score of all that was found."""
        i, j = np.nonzero(self.scores > -np.inf)
        return self.q_ids[i], self.ids[i, j], np.clip(self.scores[i, j], -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def is_exact(x: np.ndarray) -> bool:
    """Whether every inner product of such whole numbers is exact in double precision."""
    return not x.size or float(np.abs(x).max()) < (2.0**52 / x.shape[1]) ** 0.5


def exact_rows(q_ids: np.ndarray, q: np.ndarray, shards: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple:
    """The same rows for numbers too large for that, by Python's whole numbers, one query at a time:
    no bound is trusted, so all rows are scored."""
    whole = lambda rows: [[math.floor(Fraction(v) * SCALE) for v in row] for row in rows.tolist()]
    best: dict[int, list] = {int(i): [] for i in q_ids}
    asked = whole(q)
    for ids, x in shards:
        rows = whole(x)
        for own, vector in zip(q_ids.tolist(), asked, strict=True):
            scored = [(-sum(map(lambda a, b: a * b, vector, row)), i) for i, row in zip(ids.tolist(), rows, strict=True) if i != own]
            best[own] = sorted(best[own] + scored)[:k]
    out = [(own, i, max(-_LONG - 1, min(_LONG, -s))) for own, found in best.items() for s, i in found]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and x of the rows that take part."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    x = F.col(vector_column).cast("array<double>")
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(F.forall("x", fine), F.lit(False))
    )


def matrices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(coordinates, ids, vectors) of at most `most` rows each, from (vec_id, x) batches; rows of
    other lengths than the task has seen before open a matrix of their own."""
    held: dict[int, list] = {}
    for batch in batches:
        x = batch.column(1)
        offsets = x.offsets.to_numpy()
        flat = x.values.to_numpy(zero_copy_only=False)
        lengths, ids = np.diff(offsets), batch.column(0).to_numpy()
        for dims in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dims)
            own = flat[(offsets[:-1][at][:, None] + np.arange(dims)[None, :])].astype(np.float64).reshape(len(at), dims)
            parts = held.setdefault(dims, [])
            parts.append((ids[at], own))
            while sum(len(i) for i, _ in parts) >= most:
                i, v = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield dims, i[:most], v[:most]
                parts[:] = [(i[most:], v[most:])]
    for dims, parts in held.items():
        i, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        if len(i):
            yield dims, i, v


def build_shards(rows: DataFrame) -> DataFrame:
    """dims, exact, n and the arrays of a tree per shard (as vectors without a tree, if the numbers
    are too large for exact products)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, x in matrices(batches, SHARD):
            with np.errstate(over="ignore"):
                whole = np.floor(x * SCALE)
            exact = is_exact(whole)
            parts = Tree(ids, whole).dump() if exact else [ids.tobytes(), x.tobytes(), b"", b"", b"", b""]
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([exact]), *(pa.array([p], pa.large_binary()) for p in parts)], names=["dims", "exact", *Tree.FIELDS])

    return map_arrow(rows, run, "dims int, exact boolean, " + ", ".join(f"{f} binary" for f in Tree.FIELDS))


def build_blocks(asked: DataFrame, block: int) -> DataFrame:
    """dims, ids, x: the queries in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, x in matrices(batches, block):
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.large_binary()), pa.array([x.tobytes()], pa.large_binary())], names=["dims", "ids", "x"])

    return map_arrow(asked, run, "dims int, ids binary, x binary")


def _stored(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _rows_of(uri: str, columns: list[str], **wanted) -> Iterator[dict]:
    """Rows of one stored file whose small columns have the wanted values, one at a time; nothing
    else of a file without such rows is read."""
    system, path = _stored(uri)
    with system.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        small = file.read(columns=list(wanted)).to_pylist()
        fits = [row == wanted for row in small]
        if not any(fits):
            return
        at = 0
        for batch in file.iter_batches(batch_size=1, columns=columns):
            for i in range(batch.num_rows):
                if fits[at]:
                    yield {name: batch.column(name)[i].as_py() for name in columns}
                at += 1


def exact_topk(vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row.

    Defined results: null ids and vectors that are null or hold null, NaN or infinite values
    take no part; vectors are compared with those of as many coordinates; of query rows with
    the same id the smallest vector asks, and no row of that id is among its answers; equal
    scores go by the smaller id, repeated candidates each count; fewer than k candidates give
    fewer rows; an empty table gives an empty table; other columns are not read.  Scores beyond
    a long are cut to its range.  A task holds one block of queries (some `BLOCK` x (coordinates +
    leaves of a shard) x 8 bytes) and one shard (`SHARD` x coordinates x 8 bytes) at a time.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    asked = usable(vectors.where(is_query), id_column, vector_column).groupBy("vec_id").agg(F.min("x").alias("x"))
    shards, blocks = materialize(build_shards(rows), "shards"), materialize(build_blocks(asked, block), "blocks")
    # where the parts lie: a row per stored file and row, without their arrays
    listed = lambda df: df.select("dims", F.col("_metadata.file_path").alias("file")).groupBy("dims", "file").count()
    files, asks = listed(shards), listed(blocks)
    wanted = 2 * spark.sparkContext.defaultParallelism
    n_blocks, n_files = asks.count(), files.count()
    ranges = max(1, min(n_files, -(-wanted // max(1, n_blocks))))
    # a block file meets the list of shard files of its dimension, cut into ranges: names, not rows
    lists = files.withColumn("range", F.pmod(F.xxhash64("file"), F.lit(ranges))).groupBy("dims", "range").agg(F.sort_array(F.collect_list("file")).alias("shards"))
    tasks = asks.select("dims", F.col("file").alias("block")).join(lists, "dims").select("dims", "block", "shards").repartition(max(1, n_blocks * ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, block_file, shard_files in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for own in _rows_of(local_uri(block_file), ["ids", "x"], dims=dims):
                    ids = np.frombuffer(own["ids"], np.int64)
                    raw = np.frombuffer(own["x"], np.float64).reshape(len(ids), dims)
                    for part in _answers(ids, raw, dims, shard_files, k):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], names=["query_id", "vec_id", "score"])

    found = map_arrow(tasks, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(ids: np.ndarray, raw: np.ndarray, dims: int, files: list[str], k: int) -> Iterator[tuple]:
    """Answers of one block from the shards of some files: those with large numbers apart."""
    with np.errstate(over="ignore"):
        q = np.floor(raw * SCALE)
    stored = lambda exact: (row for f in files for row in _rows_of(local_uri(f), list(Tree.FIELDS), dims=dims, exact=exact))
    plain = is_exact(q)
    if plain:
        best = Best(ids, q, k)
        for row in stored(True):
            best.search(Tree.load(dims, [row[f] for f in Tree.FIELDS]))
        yield best.rows()

    def large() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for exact in (False,) if plain else (False, True):
            for row in stored(exact):
                own = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["x"], np.float64).reshape(len(own), dims)
                yield own, x / SCALE if exact else x

    yield exact_rows(ids, raw, large(), k)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""
