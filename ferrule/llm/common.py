"""Helpers shared by the training-data operators: tables, the shared folder, batches."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_dir
from ..shipping import ship

#: ASCII white space: the separators of words.  Everything else is a word character.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ferrule-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back: lineage ends here and
    the rows survive the loss of any executor.  `schema` is passed on, so no file is opened
    to infer it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Lets Spark delete the shuffle files of a query as soon as it has ended: what it wrote needs
    them no more."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


_OWN = re.compile(r"(.*/ferrule-[a-z_]+-[0-9a-f]{32})/[^/]*")


def remove(df: DataFrame) -> None:
    """Deletes the folder of a table made by `materialize` once nothing reads it again.  Only the
    folder that holds the files, and only one with a name that `new_path` gives, is deleted."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for root in {m[1] for f in df.inputFiles() if (m := _OWN.fullmatch(f))}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """Rows of the driver as a local relation.  `createDataFrame` on a list reads it in Python workers
    of a kind of their own, which then stay on every executor beside those of the operators."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], names=kinds.names), schema)


def local_uri(path: str) -> str:
    """A path as Spark names files, as a URI that Arrow's file systems open."""
    return unquote(re.sub(r"^file:/+", "file:///", path))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def held_out(mod: int, remainder: int, col: str = "doc_id") -> Column:
    return (crc32_of_id(col) % F.lit(mod)) == F.lit(remainder)


def byte_slices(batch: pa.RecordBatch, text_column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `limit` bytes of text each (one row at least),
    so that what is held per slice is bounded by the limit or by the longest single text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names that none of the columns has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, per_class: int, max_chars: int) -> tuple[list, float]:
    """A bounded, reproducible sample of labelled texts outside the held-out fold, as
    (doc_id, text, label) rows, and the share of label 1 among all labelled ids of the fold.

    At most `per_class` ids of each label value, those of smallest xxhash64(id), reach the driver
    with their whole texts, as far as `per_class * max_chars` characters of the value go (one
    text at least); this bounds what *fitting* sees and nothing else.  Null ids, labels and texts
    are left out, an id with contradicting labels too, and an id that occurs in several rows
    gives its smallest text.
    """
    votes = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(mod, remainder))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("y2"))
        .where("y = y2")
        .select("doc_id", "y")
    )
    totals = {r.y: r["count"] for r in votes.groupBy("y").count().collect()}
    ids = [
        (r.doc_id, r.y)
        for y in sorted(totals)
        for r in votes.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    ]
    if not ids:
        return [], 0.5
    wanted = F.broadcast(local_rows(documents.sparkSession, ids, "doc_id long, g int"))
    texts = documents.select("doc_id", "text").join(wanted, "doc_id")
    return bounded_texts(texts, ids, per_class * max_chars), totals.get(1, 0) / sum(totals.values())


def bounded_texts(texts: DataFrame, order: list[tuple], room: int) -> list[tuple]:
    """(doc_id, text, g) of the keys (doc_id, g) in `order`, with whole texts: of each value of g the
    first that hold `room` characters together, one at least.  `texts` (doc_id, text, g) has those
    keys alone; null texts are left out, and a key in several rows gives its smallest text."""
    one = texts.where(F.col("text").isNotNull()).groupBy("doc_id", "g").agg(F.min("text").alias("text"))
    # lengths first: where the bound is met whole rows are left out, so that no text is cut
    held = materialize(one, "sample")
    sizes = {(r.doc_id, r.g): r.n for r in held.select("doc_id", "g", F.char_length("text").alias("n")).collect()}
    left, taken = {}, []
    for key in order:
        if key in sizes:
            free = left.setdefault(key[1], room)
            if free == room or sizes[key] <= free:
                taken.append(key)
                left[key[1]] = free - sizes[key]
            else:
                left[key[1]] = -1  # nothing behind the first that does not fit
    wanted = F.broadcast(local_rows(held.sparkSession, taken, held.select("doc_id", "g").schema)) if taken else held.select("doc_id", "g").limit(0)
    rows = held.join(wanted, ["doc_id", "g"]).select("doc_id", "text", "g").collect()
    remove(held)
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[2]))


def give_back() -> None:
    """Gives freed memory of this worker back to the system.  Spark keeps workers for later tasks,
    and what they hold on to counts for their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """`mapInArrow` with this package shipped to the workers that run `function`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """`applyInArrow` on the groups of one column, with this package shipped to the workers."""

    def run(table: pa.Table) -> pa.Table:
        out = function(table)
        give_back()
        return out

    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(run, schema)


def where_text(df: DataFrame, keep) -> DataFrame:
    """The rows of `df`, all columns as they are, whose texts `keep` accepts; it is called once
    per task and gives a function from a list of texts (None for null) to a list of booleans."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = keep()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                yield part.filter(pa.array(accepts(part.column(at).to_pylist()), pa.bool_()))

    return map_arrow(df, run, df.schema)
