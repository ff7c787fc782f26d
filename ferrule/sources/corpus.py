"""The corpus over the test tables: files with paths, texts, vectors, snapshots and places.

Every column is a deterministic expression, so an SQL oracle can derive the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ROOT = "/corpus"
ROOTS = ("/corpus", "/corpus/de/src1")
EXTENSIONS = ("txt", "md", "py", "rs", "html", "pdf", "jpg")
MTIME = 1_700_000_000_000_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_path() -> Column:
    ext = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    number = F.lpad(F.col("doc_id").cast("string"), 6, "0")
    return F.concat(F.lit(ROOT + "/"), "lang", F.lit("/"), "source", F.lit("/doc_"), number, F.lit("."), ext)


def files(spark: SparkSession, sf_dir: str, columns: tuple = ("id", "path", "name", "parent", "body")) -> DataFrame:
    """id, path, name, parent, body of each document; body is the whole text."""
    path = corpus_path()
    made = {"id": F.col("doc_id"), "path": path, "name": T.file_name(path), "parent": T.parent_path(path), "body": F.col("text"), "size": F.octet_length("text").cast("long")}
    return read_table(spark, sf_dir, "documents").select(*(made[c].alias(c) for c in columns))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector of the files that have one."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def snapshot(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    """path, size, mtime_ns, hash, generation of the previous or the current state.  From one
    to the other some files go (id % 17 = 0), some are edited (13), some touched (11), and
    the files whose id is a multiple of 19 come in once more under a new name."""
    base = files(spark, sf_dir, ("id", "path", "body"))
    if current:
        body = F.when(F.col("id") % 13 == 0, F.concat("body", F.lit(" edited"))).otherwise(F.col("body"))
        moved = (F.col("id") % 13 == 0) | (F.col("id") % 11 == 0)
        new = base.where("id % 19 = 0").select("id", F.concat("path", F.lit(".new")).alias("path"), "body", F.lit(1).alias("moved"))
        base = base.where("id % 17 <> 0").select("id", "path", body.alias("body"), moved.cast("int").alias("moved")).unionByName(new)
    else:
        base = base.withColumn("moved", F.lit(0))
    return base.select(
        "path",
        F.octet_length("body").cast("long").alias("size"),
        (F.lit(MTIME) + F.col("id") * 1000 + F.col("moved")).alias("mtime_ns"),
        T.content_hash(F.col("body")).alias("hash"),
        F.lit(8 if current else 7).cast("long").alias("generation"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lat, lon, place, number: a city table made from nations by key arithmetic."""
    k = F.col("n_nationkey")
    return read_table(spark, sf_dir, "nation").select(
        (F.pmod(k * 37, F.lit(140)) - 70 + k / 100.0).cast("double").alias("lat"),
        (F.pmod(k * 83, F.lit(340)) - 170 + k / 50.0).cast("double").alias("lon"),
        F.col("n_name").alias("place"),
        k.cast("long").alias("number"),
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def under(path: Column, scopes: list[str]) -> Column:
    """Whether a path lies below one of the scopes, byte by byte; a range, so a scan of sorted
    paths can skip what is outside."""
    folders = [s if s.endswith("/") else s + "/" for s in scopes]
    return any_of([(path >= f) & (path < f[:-1] + "0") for f in folders])
