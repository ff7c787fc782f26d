"""Topics: codebook training, assignment, numbering, labels, summaries, staleness.

Training needs one mini-batch after the other, so it runs on the driver over a bounded sample
(at most `TOPIC_SAMPLE` rows); all rows are then assigned on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as C
from ..functions import text as T
from ..functions import vectors as V
from ..shipping import ship
from .hierarchy import name_text


def check_options(k: int | None, epochs: int, sample: int) -> None:
    if k is not None and not 2 <= k <= C.TOPIC_MAX_K:
        raise ValueError(f"the number of topics is from 2 to {C.TOPIC_MAX_K}, not {k}")
    if not 1 <= epochs <= C.TOPIC_MAX_EPOCHS:
        raise ValueError(f"epochs are from 1 to {C.TOPIC_MAX_EPOCHS}, not {epochs}")
    if sample < 2:
        raise ValueError("a sample has 2 rows at least")


def sample_rows(vectors: DataFrame, sample: int = C.TOPIC_SAMPLE, seed: int = C.TOPIC_SEED) -> np.ndarray:
    """A reproducible sample of live vectors, in a shuffled order that depends on the seed."""
    live = vectors.where(F.coalesce(V.peak(F.col("vector")) > 0, F.lit(False)))
    picked = live.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
    return np.array([r.vector for r in picked], np.float64)


def _revive(position: np.ndarray, total: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> None:
    """Starved clusters take half of a donor's mass and a place beside it; donors are drawn
    without replacement in proportion to their mass."""
    floor = C.REVIVAL * mass.sum() / len(mass)
    starved, donors = np.flatnonzero(mass < floor), np.flatnonzero((mass >= floor) & (mass > 0))
    n = min(len(starved), len(donors))
    if not n:
        return
    keys = np.log(np.maximum(rng.random(len(donors)), np.finfo(float).tiny)) / mass[donors]
    chosen = donors[np.argsort(-keys, kind="stable")[:n]]
    sign = np.where(np.arange(position.shape[1]) % 2 == 0, 1.0, -1.0)
    for to, source in zip(starved[:n], chosen, strict=True):
        mass[[to, source]] = mass[source] / 2
        base = position[source].copy()
        position[source], position[to] = base * (1 - C.SPLIT * sign), base * (1 + C.SPLIT * sign)
        if np.array_equal(position[source], position[to]):
            position[to] = np.nextafter(position[to], np.inf)
        total[[to, source]] = position[[to, source]] * mass[[to, source], None]


def train(rows: np.ndarray, k: int, epochs: int = C.TOPIC_EPOCHS, seed: int = C.TOPIC_SEED) -> np.ndarray:
    """Centroids (k x dim): mini-batches move exponentially averaged masses and sums, with a step
    that falls along a cosine; starved clusters revive every few steps; the last pass's
    assignments give the closing means."""
    n, dim = rows.shape if rows.ndim == 2 else (len(rows), 0)
    if dim == 0 or n < 2 or k < 2 or k > n or epochs < 1:
        raise ValueError(f"cannot make {k} topics from {n} vectors of {dim} elements in {epochs} epochs")
    rng = np.random.default_rng(seed)
    batch, first, steps = C.batch_recipe(n, k, epochs)
    order = rng.permutation(n)
    position = rows[order[:k]].copy()
    mass = np.full(k, C.EMA_COUNT)
    total = position * C.EMA_COUNT
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        last_total, last_count = np.zeros_like(total), np.zeros(k)
        for start in range(0, n, batch):
            own = rows[order[start : start + batch]]
            cluster, _ = V.nearest_centroids(own, position)
            count = np.bincount(cluster, minlength=k).astype(float)
            moved = np.zeros_like(total)
            np.add.at(moved, cluster, own)
            last_total += moved
            last_count += count
            alpha = first * (C.ALPHA_FLOOR + (1 - C.ALPHA_FLOOR) * 0.5 * (1 + math.cos(math.pi * min(step, steps) / max(steps, 1))))
            mass = (1 - alpha) * mass + alpha * count
            total = (1 - alpha) * total + alpha * moved
            empty = mass < C.LEAST_COUNT
            mass[empty] = C.LEAST_COUNT
            total[empty] = position[empty] * C.LEAST_COUNT
            position[~empty] = total[~empty] / mass[~empty, None]
            step += 1
            if step % C.REVIVAL_EVERY == 0:
                _revive(position, total, mass, rng)
    filled = last_count > 0
    position[filled] = last_total[filled] / last_count[filled, None]
    return position


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared, to the nearest centroid); dead vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = V.matrix(batch.column(1))
            if len(rows):
                cluster, distance = V.nearest_centroids(rows, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    ship(vectors.sparkSession)
    live = vectors.where(F.coalesce(V.peak(F.col("vector")) > 0, F.lit(False)))
    return live.select("id", "vector").mapInArrow(run, "id long, cluster long, distance double")


def variance_explained(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """variance: 1 - SSE / (sum of squared lengths - squared length of the sum / n), in [0, 1].

    Each task gives one row of element sums, so what is grouped by element is tasks x elements."""
    sums = V.grouped_sums(vectors.select("vector"), squares=True)
    elements = sums.select("n", F.posexplode(F.arrays_zip("total", "total2")).alias("pos", "z")).groupBy("pos").agg(F.sum("z.total").alias("s"), F.sum("z.total2").alias("s2"), F.sum("n").alias("n"))
    spread = elements.agg((F.sum("s2") - F.sum(F.col("s") * F.col("s") / F.col("n"))).alias("spread"))
    sse = assigned.agg(F.sum("distance").alias("sse"))
    share = F.when(F.col("spread") > 0, 1 - F.col("sse") / F.col("spread")).otherwise(0.0)
    return spread.crossJoin(sse).select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 6).alias("variance"))


def renumber(assigned: DataFrame) -> DataFrame:
    """cluster, topic, files: topics count from 1, the largest first; empty ones do not occur."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("files"))
    return sizes.withColumn("topic", F.row_number().over(Window.orderBy(F.col("files").desc(), "cluster")))


def size_summary(sizes: DataFrame) -> DataFrame:
    """smallest, middle (the upper of two), largest: over at most a thousand topics."""
    s = sizes.agg(F.sort_array(F.collect_list("files")).alias("s"))
    return s.select(F.element_at("s", 1).alias("smallest"), F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("middle"), F.element_at("s", -1).alias("largest"))


def nearest_members(file_topics: DataFrame, k: int) -> DataFrame:
    """topic, id, distance, r: the k members nearest to each topic's centre."""
    order = Window.partitionBy("topic").orderBy("distance", "id")
    return file_topics.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def labels(file_topics: DataFrame, paths: DataFrame, roots: list[str], members: int = C.LABEL_MEMBERS) -> DataFrame:
    """topic, label: the three path tokens of largest tf-idf among a topic's core members, or
    what its nearest member's path gives."""
    core = nearest_members(file_topics, members).join(paths, "id")
    sizes = core.groupBy("topic").agg(F.count(F.lit(1)).alias("members"), F.min_by("path", "r").alias("example"))
    words = name_text(core, roots).select("topic", F.explode(F.array_distinct(F.split("tokens", " "))).alias("token")).where(T.keeps_label_token(F.col("token")))
    counts = words.groupBy("topic", "token").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    topics = sizes.agg(F.count(F.lit(1)).alias("topics"))
    scored = counts.join(df, "token").join(sizes, "topic").crossJoin(F.broadcast(topics))
    weight = F.round(F.col("n") / F.col("members") * F.log(1 + F.col("topics") / (1.0 + F.col("df"))), 9)
    order = Window.partitionBy("topic").orderBy(F.col("w").desc(), "token")
    best = scored.withColumn("w", weight).withColumn("r", F.row_number().over(order)).where(F.col("r") <= 3)
    named = best.groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "token"))), lambda s: s["token"]), " · ").alias("label"))
    return sizes.join(named, "topic", "left").select("topic", F.coalesce("label", T.fallback_label(F.col("example"))).alias("label"))


def summaries(topics: DataFrame, file_topics: DataFrame) -> DataFrame:
    """topic, label, files; a topic without files has 0."""
    joined = topics.join(file_topics.select("topic", "id"), "topic", "left")
    return joined.groupBy("topic", "label").agg(F.count("id").alias("files"))


def members(file_topics: DataFrame, files: DataFrame, topic: int, limit: int) -> DataFrame:
    """path, distance of a topic's files, the nearest first."""
    hits = file_topics.where(F.col("topic") == topic).orderBy("distance", "id").limit(limit)
    return hits.join(files, "id").select("id", "path", "distance").orderBy("distance", "id")


def staleness(file_topics: DataFrame, embedded: DataFrame, built_with: str, index_model: str) -> DataFrame:
    """added, removed, model_mismatch: ids are compared, so one file gone and one come show as
    such."""
    added = embedded.select("id").join(file_topics.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("added"))
    removed = file_topics.select("id").join(embedded.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("removed"))
    return added.crossJoin(removed).withColumn("model_mismatch", F.lit(built_with != index_model))


def stale_note(built: bool, added: int, mismatch: bool) -> str | None:
    if not built:
        return "there are no topics yet; build them"
    if mismatch:
        return "topics were built with another model than the index uses; build them again"
    return f"{added} files came in after the topics were built; build them again" if added else None
