"""Building the topics of an index and keeping them as one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import TOPIC_EPOCHS, TOPIC_SAMPLE, TOPIC_SEED, default_topic_count
from ..operators import topics
from ..sources.store import Snapshots


def build(vectors: DataFrame, paths: DataFrame, roots: list[str], k: int | None = None, epochs: int = TOPIC_EPOCHS, sample: int = TOPIC_SAMPLE, seed: int = TOPIC_SEED) -> tuple[DataFrame, DataFrame, float]:
    """topics (topic, label, files), file_topics (id, topic, distance), variance explained."""
    topics.check_options(k, epochs, sample)
    rows = topics.sample_rows(vectors, sample, seed)
    if len(rows) < 2:
        raise ValueError(f"topics need two vectors at least, there are {len(rows)}")
    centroids = topics.train(rows, k or default_topic_count(vectors.count()), epochs, seed)
    assigned = topics.assign(vectors, centroids)
    numbers = topics.renumber(assigned)
    file_topics = assigned.join(F.broadcast(numbers.select("cluster", "topic")), "cluster").select("id", "topic", "distance")
    named = numbers.select("topic", "files").join(topics.labels(file_topics, paths, roots), "topic").select("topic", "label", "files")
    variance = topics.variance_explained(vectors, assigned).first()[0]
    return named, file_topics, variance


def build_stored(spark: SparkSession, folder: str, roots: list[str], **options) -> DataFrame:
    """Builds the topics of a stored index and switches to them."""
    store = Snapshots(spark, folder)
    vectors, files = store.read("vectors"), store.read("files")
    if vectors is None or store.get_meta("model_id") is None:
        raise ValueError("the index has no vectors; scan with a model first")
    with store.lock():
        named, file_topics, variance = build(vectors.select("id", "vector"), files.select("id", "path"), roots, **options)
        store.stage("file_topics", file_topics)
        out = store.stage("topics", named)
        store.commit({"topics_model_id": store.get_meta("model_id"), "topics_variance": str(variance)})
    return out
