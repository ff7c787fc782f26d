"""The directory tree over file paths: directories, parents, roots, roll-up of counts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MAX_CENTROID_WEIGHT
from ..functions import text as T
from ..functions import vectors as V


def directories(files: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """path, parent_path, name, depth of every directory above a file; with roots, from the deepest
    root that holds the file downwards.  Each file yields its ancestors; equal ones meet in a
    distinct with partial aggregation.  The topmost directories have no parent here."""
    up, clean = files.select(F.explode(T.ancestors(F.col("path"))).alias("path"), F.col("path").alias("file")), [r.rstrip("/") for r in roots or ()]
    if roots is not None:
        held = deepest_root(up, clean, "file").where(F.col("root").isNotNull())
        up = held.where((F.col("path") == F.col("root")) | F.startswith(F.col("path"), F.concat("root", F.lit("/"))))
    up = up.select("path").distinct()
    parent = F.nullif(T.parent_path(F.col("path")), F.lit(""))
    topmost = [r for r in clean if not any(r.startswith(o + "/") for o in clean if o != r)]
    inside = F.when(~F.col("path").isin(topmost), parent) if topmost else parent
    return up.select("path", inside.alias("parent_path"), T.file_name(F.col("path")).alias("name"), F.size(F.split("path", "/")).cast("long").alias("depth"))


def with_ids(dirs: DataFrame) -> DataFrame:
    """Adds id, a hash of the path that is the same in every run; order is always by path."""
    return dirs.withColumn("id", F.xxhash64("path"))


def deepest_root(rows: DataFrame, roots: list[str], column: str = "path") -> DataFrame:
    """Adds root: the longest of the roots (a short list of the configuration) that holds the
    path; null outside of all."""
    root = F.lit(None).cast("string")
    for r in sorted(roots, key=len):
        root = F.when((F.col(column) == r) | F.startswith(F.col(column), F.lit(r.rstrip("/") + "/")), F.lit(r)).otherwise(root)
    return rows.withColumn("root", root)


def name_text(rows: DataFrame, roots: list[str]) -> DataFrame:
    """Adds tokens: name tokens of the path below its deepest root; of a root, its own name."""
    rooted = deepest_root(rows, roots)
    below = F.when(F.col("path") == F.col("root"), F.lit("")).when(F.col("root").isNull(), F.col("path")).otherwise(T.relative_path(F.col("path"), F.col("root")))
    tokens = T.name_tokens(below)
    return rooted.withColumn("tokens", F.when(tokens == "", T.file_name(F.col("path"))).otherwise(tokens))


def rollup_counts(files: DataFrame, embedded: DataFrame) -> DataFrame:
    """path, file_count: embedded files anywhere below each directory (0 where there is none)."""
    has = files.join(embedded.select("id").distinct().withColumn("has", F.lit(1)), "id", "left")
    each = has.select(F.explode(T.ancestors(F.col("path"))).alias("path"), F.coalesce("has", F.lit(0)).alias("has"))
    return each.groupBy("path").agg(F.sum("has").cast("long").alias("file_count"))


def rollup_sums(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """path, pos, total, n: element-wise sums of the vectors below each directory.

    Each task first adds its files up by directory, whole vectors at a time; so one row per
    task, directory and element is spread over the ancestors, and each level adds partial sums."""
    own = V.grouped_sums(files.join(vectors, "id").select("parent", "vector"), "parent")
    up = own.select(F.explode(T.ancestors(F.concat("parent", F.lit("/x")))).alias("path"), F.posexplode("total").alias("pos", "x"), "n")
    return up.groupBy("path", "pos").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def rollup_vectors(files: DataFrame, vectors: DataFrame, names: DataFrame, roots: list[str]) -> DataFrame:
    """path, vector, file_count of every directory but the configured roots.  names: path,
    vector of the directory's name; one without embedded files keeps that alone."""
    sums = rollup_sums(files, vectors).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("e"), F.max("n").alias("n"))
    joined = names.where(~F.col("path").isin(*roots)).join(sums, "path", "left")
    total = F.transform(F.coalesce(F.col("e"), F.array().cast("array<struct<pos:int,total:double>>")), lambda s: s["total"])
    count = F.coalesce("n", F.lit(0)).cast("long")
    return joined.select("path", V.blend(F.col("vector"), total, count, MAX_CENTROID_WEIGHT).alias("vector"), count.alias("file_count"))
