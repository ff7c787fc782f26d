"""Where results and indexes are kept: snapshots under one manifest, locks, text sinks."""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA_VERSION = 3
#: Seconds after which a lock whose owner no longer renews it may be taken over.
LOCK_SECONDS = 300


class Snapshots:
    """Tables under one folder, named by one manifest.

    `stage` writes a table's new version beside the old one; `commit` writes the next manifest,
    which names all versions and carries all settings, and moves it into place under its number in
    one rename.  Readers take the manifest of the highest number, so they see all of a commit or
    nothing of it, and what fails before leaves the old state.  Versions that neither this manifest
    nor the one before names are dropped after the switch; readers of the one before can finish.
    Paths go through Hadoop's file systems, so the folder can be in any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.staged: dict[str, str] = {}
        self.owner: str | None = None

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Writes a new file; False if there is one."""
        fs, p = self._fs(path)
        if fs.exists(p):
            return False
        try:
            stream = fs.create(p, False)
        except Exception:  # another writer was faster
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.folder}/_manifests") if n.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        found = json.loads(self._read_text(f"{self.folder}/_manifests/{number:010d}.json"))
        if found["schema"] != SCHEMA_VERSION:
            raise ValueError(f"{self.folder} was written with schema version {found['schema']}, this library reads {SCHEMA_VERSION}; build the index again")
        return found

    def current(self) -> dict:
        """tables (name -> version) and meta (key -> value) of the newest manifest."""
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else {"schema": SCHEMA_VERSION, "tables": {}, "meta": {}}

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a new version of a table, to be switched to by `commit`, and reads it back."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}/{version}")
        self.staged[name] = version
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}/{version}")

    def commit(self, meta: dict | None = None, drop: tuple = ()) -> None:
        """Switches to all staged versions and settings at once; tables in `drop` are left out."""
        if self.owner is not None and self._read_text(f"{self.folder}/_lock") != self.owner:
            raise RuntimeError(f"the lock of {self.folder} was taken over; nothing is committed")
        numbers, old = self._numbers(), self.current()
        new = {
            "schema": SCHEMA_VERSION,
            "tables": {k: v for k, v in (old["tables"] | self.staged).items() if k not in drop},
            "meta": old["meta"] | {k: v for k, v in (meta or {}).items()},
        }
        number = (numbers[-1] if numbers else 0) + 1
        aside, target = f"{self.folder}/_aside-{uuid.uuid4().hex}", f"{self.folder}/_manifests/{number:010d}.json"
        self._create(aside, json.dumps(new))
        fs, place = self._fs(target)
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(self._fs(aside)[1], place):
            raise OSError(f"another writer has committed {target}")
        self.staged = {}
        for k in numbers[:-1]:
            fs.delete(self._fs(f"{self.folder}/_manifests/{k:010d}.json")[1], False)
        for name in self._names(self.folder):
            if not name.startswith("_"):
                for version in self._names(f"{self.folder}/{name}"):
                    if version not in (new["tables"].get(name), old["tables"].get(name)):
                        fs.delete(self._fs(f"{self.folder}/{name}/{version}")[1], True)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        out = self.stage(name, df)
        self.commit()
        return out

    def read(self, name: str) -> DataFrame | None:
        version = self.current()["tables"].get(name)
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{name}/{version}")

    def discard(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)

    def get_meta(self, key: str) -> str | None:
        return self.current()["meta"].get(key)

    def set_meta(self, key: str, value: str) -> None:
        self.commit({key: value})

    @contextmanager
    def lock(self, seconds: float = LOCK_SECONDS) -> Iterator[None]:
        """One writer at a time.  The lock file names its owner and is renewed while held; one that
        has not been renewed for `seconds` (its owner was killed) is moved away and taken over."""
        path = f"{self.folder}/_lock"
        fs, p = self._fs(path)
        owner = f"{socket.gethostname()} {os.getpid()} {uuid.uuid4().hex}"
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > seconds:
            aside = self._fs(f"{path}.{uuid.uuid4().hex}")[1]
            if fs.rename(p, aside):  # of several that try, one succeeds
                fs.delete(aside, False)
        if not self._create(path, owner):
            raise RuntimeError(f"another scan holds {path}: {self._read_text(path)}")
        self.owner, self.staged, done = owner, {}, threading.Event()

        def renew() -> None:
            while not done.wait(seconds / 4):
                fs.setTimes(p, int(time.time() * 1000), -1)

        keeper = threading.Thread(target=renew, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            done.set()
            keeper.join()
            self.owner = None
            if self._read_text(path) == owner:
                fs.delete(p, False)


def plain_lines(results: DataFrame) -> DataFrame:
    """One line per result; directories are marked."""
    return results.select(T.display_path(F.col("kind"), F.col("path")).alias("value"))


def score_lines(results: DataFrame) -> DataFrame:
    number = lambda c, label: F.when(F.col(c).isNotNull(), F.format_string(label + "=%.3f", F.col(c))).otherwise(F.lit(label + "=-"))
    return results.select(F.concat(F.format_string("%.4f", "score"), F.lit("  "), number("cosine", "cos"), F.lit(" "), number("rerank", "rr"), F.lit("\t"), T.display_path(F.col("kind"), F.col("path"))).alias("value"))


def topic_lines(topics: DataFrame) -> DataFrame:
    return topics.select(F.concat_ws("\t", F.col("topic").cast("string"), F.col("files").cast("string"), "label").alias("value"))


def save_lines(lines: DataFrame, path: str) -> None:
    """Writes text; a path that exists is refused.  The name has no folder parts of its own."""
    if os.path.basename(path) in ("", ".", ".."):
        raise ValueError(f"{path!r} names no file")
    lines.write.mode("errorifexists").text(path)
