"""Incremental indexing: change detection, embedding, directories, roll-up, one commit at the end."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import BM25_DIR_WEIGHTS, REFRESH_SECONDS
from ..functions import models
from ..functions import text as T
from ..operators import changes, dense, hierarchy, lexical
from ..sources.corpus import under
from ..sources.store import Snapshots

FILES = "id long, path string, name string, parent string, size long, mtime_ns long, hash string, vector_hash string, extract_kind string, body string, snippet string, generation long"


@dataclass
class Scan:
    """What a scan did."""

    generation: int
    counters: dict


def hashed(files: DataFrame, roots: list[str]) -> DataFrame:
    """The files with id, text (what a model is given) and hash."""
    tokens = hierarchy.name_text(files.select("path"), roots).select("path", "tokens", "root")
    text = T.embed_text(T.relative_path(F.col("path"), F.coalesce("root", F.lit(""))), F.col("tokens"), F.col("body"))
    return files.join(tokens, "path").withColumn("text", text).withColumn("hash", T.content_hash(F.col("text"))).withColumn("id", F.xxhash64("path"))


def scan(spark: SparkSession, folder: str, files: DataFrame, roots: list[str], embedder: models.Embedder | None, scopes: list[str] | None = None, force: bool = False, config: dict | None = None, skipped: int = 0) -> Scan:
    """Brings the index in `folder` up to the state of `files` (path, name, parent, size,
    mtime_ns, extract_kind, body, snippet).

    With scopes, only files below them are compared and may vanish.  Texts are hashed, so a
    touched file keeps its vector.  A vector stays as long as the text it was made from is the
    file's own: a scan without an embedder drops those of edited and deleted files, and the next one
    with an embedder makes them anew.  Vectors are computed first; all tables and settings are then
    switched by one commit, so a scan that dies anywhere leaves the old index.  `skipped` files
    that could not be read are counted; `config` and the roots are kept with the index."""
    store = Snapshots(spark, folder)
    with store.lock():
        meta = store.current()["meta"]
        generation, model = int(meta.get("generation", 0)) + 1, meta.get("model_id")
        if embedder is not None and model not in (None, embedder.model_id):
            force = True  # vectors of two models cannot be compared
        new, old = hashed(files, roots), store.read("files")
        if old is None:
            old = spark.createDataFrame([], FILES)
        compared = old if scopes is None else old.where(under(F.col("path"), scopes))
        found = store.stage("changes", changes.detect(new, compared, embedder is not None, force))
        vectors, before = None, store.read("vectors")
        if embedder is not None:
            wanted = new.join(found.where("needs_embed").select("path"), "path", "left_semi")
            vectors = store.stage("new_vectors", models.embed(wanted, embedder, "id", "text").withColumn("model_id", F.lit(embedder.model_id)))
        known = old.select("path", F.col("vector_hash").alias("old_vector_hash"))
        fresh = new.join(found.select("path", "needs_embed"), "path").join(known, "path", "left")
        vector_hash = F.when(F.col("needs_embed") | (F.col("old_vector_hash") == F.col("hash")), F.col("hash"))
        rows = fresh.select("id", "path", "name", "parent", "size", "mtime_ns", "hash", vector_hash.alias("vector_hash"), "extract_kind", "body", "snippet", F.lit(generation).cast("long").alias("generation"))
        outside = old.where(F.lit(False)) if scopes is None else old.where(~under(F.col("path"), scopes))
        all_files = store.stage("files", rows.unionByName(outside))
        settings = {"generation": str(generation), "roots": json.dumps(sorted(roots))}
        if vectors is None and before is not None:
            vectors = before.where(F.lit(False))
        if vectors is not None:
            made = vectors if before is None else changes.replace_rows(before, vectors)
            current = made.join(all_files.where("vector_hash IS NOT NULL").select("id"), "id", "left_semi")
            vectors = store.stage("vectors", current)
            store.stage("codes", dense.store_codes(vectors))
            if embedder is not None:
                settings |= {"model_id": embedder.model_id, "dim": str(embedder.dim)}
        stage_directories(store, all_files, vectors, roots, embedder or models.EMBEDDERS.get(model))
        moved = found.where(F.col("status").isin("added", "edited", "deleted")).select(F.xxhash64("path").alias("id"))
        stage_postings(store, all_files, store.read("postings"), store.read("lengths"), moved if not force else None)
        now = int(time.time())
        for r in scopes or roots:
            settings[f"root {r}"] = f"{generation} {now}"
        if config is not None:
            settings["config"] = json.dumps(config)
        counters = changes.scan_stats(found).first().asDict() | {"skipped": skipped}
        store.commit(settings, drop=("new_vectors",))
        return Scan(generation, counters)


def stage_directories(store: Snapshots, files: DataFrame, vectors: DataFrame | None, roots: list[str], embedder: models.Embedder | None) -> None:
    """Directories from the deepest root of a file downwards, their search index, and, where there
    are vectors, their counts and rolled-up vectors.  Roots have neither vectors nor postings."""
    named = hierarchy.with_ids(hierarchy.name_text(hierarchy.directories(files, roots), roots))
    if vectors is not None:
        named = named.join(hierarchy.rollup_counts(files, vectors), "path", "left")
    else:
        named = named.withColumn("file_count", F.lit(0))
    dirs = store.stage("dirs", named.select("id", "path", "parent_path", "name", "depth", F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"), "tokens"))
    answers = dirs.where(~F.col("path").isin(roots)) if roots else dirs
    postings, lengths = lexical.stored(answers.select("id", "path", F.col("tokens").alias("name")), tuple(BM25_DIR_WEIGHTS))
    store.stage("dir_postings", postings)
    store.stage("dir_stats", lexical.statistics(lengths))
    if vectors is not None and embedder is not None:
        rolled = hierarchy.rollup_vectors(files, vectors.select("id", "vector"), models.embed(answers, embedder, "path", "tokens"), roots)
        store.stage("dir_vectors", rolled.select(F.xxhash64("path").alias("id"), "vector"))


def stage_postings(store: Snapshots, files: DataFrame, old: DataFrame | None, old_lengths: DataFrame | None, moved: DataFrame | None) -> None:
    """Postings, lengths and statistics; with old ones, only texts of the `moved` ids are read."""
    rows = files.select("id", "path", "name", "body")
    if old is None or old_lengths is None or moved is None:
        postings, lengths = lexical.stored(rows)
    else:
        fresh, long = lexical.stored(rows.join(moved, "id", "left_semi"))
        postings = lexical.ordered(old.join(moved, "id", "left_anti").unionByName(fresh))
        lengths = old_lengths.join(moved, "id", "left_anti").unionByName(long)
    store.stage("postings", postings)
    store.stage("stats", lexical.statistics(store.stage("lengths", lengths)))


def root_state(spark: SparkSession, folder: str, root: str) -> tuple[int, int] | None:
    """Generation and time of a root's last scan."""
    text = Snapshots(spark, folder).get_meta(f"root {root}")
    return tuple(map(int, text.split())) if text else None


def due(spark: SparkSession, folder: str, root: str, refresh: str, now: int | None = None) -> str:
    """"never", "elapsed" or "no"; a last scan in the future counts as just done."""
    state, interval = root_state(spark, folder, root), REFRESH_SECONDS[refresh]
    if state is None:
        return "never"
    return "elapsed" if interval is not None and (now or int(time.time())) - state[1] >= interval else "no"


def open_index(spark: SparkSession, folder: str, embedder: models.Embedder | None = None):
    """The stored index, ready for `search`, with its own roots.

    An embedder that is to ask it must be the one its vectors come from, in model and in
    dimension; else it is refused here and not by odd results."""
    from .search import Index

    store = Snapshots(spark, folder)
    state = store.current()
    files, meta = store.read("files"), state["meta"]
    if files is None:
        raise FileNotFoundError(f"{folder} holds no index; run a scan first")
    vectors = store.read("vectors")
    if embedder is not None and vectors is not None:
        if meta.get("model_id") != embedder.model_id or int(meta.get("dim", embedder.dim)) != embedder.dim:
            raise ValueError(f"the index has vectors of {meta.get('model_id')} ({meta.get('dim')} elements), not of {embedder.model_id} ({embedder.dim})")
    if vectors is None:
        vectors = files.select("id", F.array().cast("array<double>").alias("vector")).where(F.lit(False))
    return Index(
        files.select("id", "path", "name", "parent", "body"),
        vectors.select("id", "vector"),
        store.read("dirs"),
        store.read("dir_vectors"),
        store.read("file_topics"),
        tuple(json.loads(meta.get("roots", "[]"))),
        postings=store.read("postings"),
        stats=store.read("stats"),
        dir_postings=store.read("dir_postings"),
        dir_stats=store.read("dir_stats"),
        codes=store.read("codes"),
    )
