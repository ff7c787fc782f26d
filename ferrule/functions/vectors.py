"""Vector functions: Column expressions for single values, NumPy for bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .text import let

_D = "double"


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def peak(v: Column) -> Column:
    return F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))


def quantize(v: Column) -> Column:
    """struct(q array<tinyint>, scale): round(127 x / peak), halves away from zero; a vector with
    no coordinate above 1e-12 is dead: no codes, scale 0."""
    dead = F.struct(F.array().cast("array<tinyint>").alias("q"), F.lit(0.0).alias("scale"))
    code = lambda p: F.transform(doubles(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x * 127.0 / p))).cast("tinyint"))
    return let(peak(v), lambda p: F.when(p > 1e-12, F.struct(code(p).alias("q"), (p / 127.0).alias("scale"))).otherwise(dead))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast(_D) * scale)


def blend(name_vector: Column, total: Column, count: Column, most: float) -> Column:
    """A directory's vector: its name's, moved towards the mean of its members by at most
    `most`, in proportion to how much the members agree (the mean's length)."""

    def mixed(name: Column, mean: Column) -> Column:
        def weigh(length: Column) -> Column:
            w = F.lit(most) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), length))
            return normalize(F.zip_with(name, mean, lambda a, b: (1.0 - w) * a + w * F.when(length > 0, b / length).otherwise(b)))

        return let(norm(mean), weigh)

    return F.when(count == 0, normalize(name_vector)).otherwise(
        let(normalize(name_vector), lambda name: let(F.transform(doubles(total), lambda x: x / count), lambda mean: mixed(name, mean)))
    )


def nearest_centroids(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centroid of each row, the lowest index on a
    tie, by blocks; ||x||^2 - 2 x.c + ||c||^2 picks, the difference itself measures."""
    index = np.empty(len(rows), np.int64)
    for start in range(0, len(rows), 8192):
        part = rows[start : start + 8192]
        index[start : start + 8192] = ((centroids * centroids).sum(1)[None, :] - 2.0 * part @ centroids.T).argmin(1)
    difference = rows - centroids[index]
    return index, (difference * difference).sum(1)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors without nulls as one array, without Python objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Groups whose sums a task holds before it hands them on.
HELD_GROUPS = 4_096


def grouped_sums(rows: DataFrame, group: str | None = None, squares: bool = False) -> DataFrame:
    """group, total, n: element-wise sums of `vector` per group and task (a group may come several
    times, so sums of these rows are wanted next), and with `squares` those of the squares as
    total2.  Null vectors are left out."""
    kept = rows.where(F.col("vector").isNotNull()).select(F.col(group).cast("string").alias("g") if group else F.lit("").alias("g"), doubles(F.col("vector")).alias("vector"))
    names = [group or "g", "total", "n", *["total2"] * squares]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            lists = lambda i: pa.array([v[i] for v in held.values()], pa.list_(pa.float64()))
            columns = [pa.array([g for g, _ in held], pa.string()), lists(0), pa.array([v[1] for v in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *[lists(2)] * squares], names=names)

        for batch in batches:
            groups, lengths = np.array(batch.column(0).to_pylist(), object), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(lengths).tolist():  # one pass where all vectors are equally long
                at = np.flatnonzero(lengths == width)
                x = matrix(batch.column(1).take(pa.array(at))).reshape(len(at), int(width))
                known, place = np.unique(groups[at].astype(str), return_inverse=True)
                totals, n = np.zeros((len(known), x.shape[1])), np.bincount(place, minlength=len(known))
                np.add.at(totals, place, x)
                totals2 = np.zeros_like(totals)
                if squares:
                    np.add.at(totals2, place, x * x)
                for k, g in enumerate(known.tolist()):
                    old = held.get((g, width))
                    held[g, width] = [totals[k], n[k], totals2[k]] if old is None else [old[0] + totals[k], old[1] + n[k], old[2] + totals2[k]]
            if len(held) >= HELD_GROUPS:
                yield out()
                held.clear()
        yield out()

    ship(rows.sparkSession)
    return kept.mapInArrow(run, f"`{group or 'g'}` string, total array<double>, n long" + ", total2 array<double>" * squares)


def round_half_away(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)
