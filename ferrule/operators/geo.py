"""Nearest place of a coordinate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..shipping import ship

#: A city table has tens of thousands of rows; one beyond this bound is refused.
MOST_PLACES = 500_000
#: Degrees of latitude to either side that are looked at first.
BAND = 1.0


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of lat, lon and "City, Country"; lines that begin with # are
    comments, lines that do not parse are left out."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="lat double, lon double, place string", mode="DROPMALFORMED")
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL AND place IS NOT NULL").withColumn("number", F.monotonically_increasing_id())


def nearest_place(points: DataFrame, places: DataFrame) -> DataFrame:
    """Points (id, lat, lon, ...) with place and place_number of the nearest city (lat, lon,
    place, number), the first of equals; null off the globe.

    The distance is equirectangular, with the cosine of the point's own latitude.  The city table is
    of checked size and goes to each task as arrays ordered by latitude; a point looks at bands of
    latitude around its own, widening until a band alone is farther than the best city."""
    count = places.count()
    if count > MOST_PLACES:
        raise ValueError(f"{count} places; a city table has at most {MOST_PLACES}")
    rows = places.select("number", "lat", "lon", "place").orderBy("lat", "number").collect()  # at most MOST_PLACES
    number, lat, lon = (np.array([r[i] for r in rows], kind) for i, kind in ((0, np.int64), (1, float), (2, float)))
    names = [r.place for r in rows]

    def nearest(y: float, x: float) -> int:
        width, best, done = BAND, None, (0, 0)
        while True:
            a, b = np.searchsorted(lat, [y - width, y + width])
            if best is None or (a, b) != done:
                dx, dy = np.radians(lon[a:b] - x) * math.cos(math.radians(y)), np.radians(lat[a:b] - y)
                d2 = dx * dx + dy * dy
                if len(d2):
                    least = d2.min()
                    ties = np.flatnonzero(d2 == least)
                    best = float(least), int(a + ties[number[a:b][ties].argmin()])
                done = (a, b)
            if (best is not None and best[0] < math.radians(width) ** 2) or (a == 0 and b == len(lat)):
                return best[1]
            width *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for y, x in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True):
                known = y is not None and x is not None and -90 <= y <= 90 and -180 <= x <= 180 and names
                found.append(nearest(y, x) if known else None)
            columns = [pa.array([None if i is None else names[i] for i in found], pa.string()), pa.array([None if i is None else int(number[i]) for i in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "place", "place_number"])

    at = points.columns.index("lat"), points.columns.index("lon")
    ship(points.sparkSession)
    return points.mapInArrow(run, StructType([*points.schema.fields, StructField("place", StringType()), StructField("place_number", LongType())]))
