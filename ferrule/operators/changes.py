"""Incremental scans: change detection, survivors of a generation, counters, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import under


def detect(current: DataFrame, previous: DataFrame, embed: bool = True, force: bool = False) -> DataFrame:
    """path, status, needs_embed for every path of either state (path, mtime_ns, size, hash, and
    in `previous` optionally vector_hash, the hash a vector was made from).

    First gate: equal (mtime, size) of a file whose vector was made from its known text is
    "unchanged" without a look at the text.  Second gate: equal text hashes make a touched file "touched", which needs no
    new vector.  One full outer join gives additions and deletions too."""
    has_vector = "vector_hash" in previous.columns
    old = previous.select("path", F.col("mtime_ns").alias("m0"), F.col("size").alias("s0"), F.col("hash").alias("h0"), (F.col("vector_hash") if has_vector else F.col("hash")).alias("v0"), F.lit(True).alias("was"))
    new = current.select("path", F.col("mtime_ns").alias("m1"), F.col("size").alias("s1"), F.col("hash").alias("h1"), F.lit(True).alias("is_"))
    both = new.join(old, "path", "full_outer")
    stat_same = (F.col("m0") == F.col("m1")) & (F.col("s0") == F.col("s1"))
    vector_good = F.coalesce(F.col("v0") == F.col("h1"), F.lit(False))
    status = (
        F.when(F.col("is_").isNull(), "deleted")
        .when(F.col("was").isNull(), "added")
        .when(stat_same & (F.coalesce(F.col("v0") == F.col("h0"), F.lit(False)) | F.lit(not embed)) & F.lit(not force), "unchanged")
        .when(F.col("h0") == F.col("h1"), "touched")
        .otherwise("edited")
    )
    marked = both.select("path", status.alias("status"), vector_good.alias("good"))
    needs = F.lit(embed) & ~F.col("status").isin("deleted", "unchanged") & (F.lit(force) | ~F.col("good"))
    return marked.select("path", "status", needs.alias("needs_embed"))


def scan_stats(changes: DataFrame) -> DataFrame:
    """One row of counters."""
    one = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return changes.agg(
        one("added", "touched", "edited", "unchanged").alias("seen"),
        one("added").alias("added"),
        one("touched", "edited").alias("updated"),
        one("unchanged").alias("unchanged"),
        F.count(F.when(F.col("needs_embed"), 1)).alias("embedded"),
        one("deleted").alias("deleted"),
    )


def survivors(rows: DataFrame, generation: Column | int, scopes: list[str] | None = None) -> DataFrame:
    """Rows seen in a generation; with scopes, those outside of them stay as they are."""
    seen = F.col("generation") == generation
    return rows.where(seen if scopes is None else seen | ~under(F.col("path"), scopes))


def index_consistency(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """orphans, missing: index rows without a file and files without an index row."""
    orphans = indexed.join(files.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    missing = files.join(indexed.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return orphans.crossJoin(missing)


def replace_rows(base: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Base rows less those whose key is in `changed`, and the changed rows: delete and insert
    in one pass, so doing it twice changes nothing."""
    return base.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)
