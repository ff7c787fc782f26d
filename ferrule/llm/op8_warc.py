"""WARC archives: writing with payload revisits, and reading by boundary-chain verification.

Writing: each task appends records to archives of bounded size in the shared folder, under
names made of the task's number, first aside and then renamed, so a task that runs again
replaces its own files.  Of records with equal payloads the one with the smallest id carries
the payload; the others are revisit records that name it.

Reading: an archive is cut into byte ranges.  A task looks at its range for the record magic,
wherever it occurs, and emits for each place where a header parses the offset of its successor.
Within a range these links are followed to the first offset beyond it; across ranges pointer
jumping from the start of the file, doubling its stride each round, finds which places are
real record starts.  A magic inside a payload is on no chain from the start, so it drops out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, local_uri, map_arrow, materialize, new_path, read_table, remove

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
#: Bytes of a record header: a longer one is no header, neither for the writer nor for the reader.
MOST_HEADER = 1 << 20
#: A table of repeated payloads up to this many rows is broadcast.  Beyond, the most frequent ones
#: are, and the others, each in a bounded number of rows, are joined by shuffle.
BROADCAST_PAYLOADS = 200_000
#: Tasks that read ranges: one per range up to this many.
MOST_TASKS = 20_000
#: Records carry a fixed date, so that writing the same rows again gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI with the scheme of its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(local_uri(uri))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP header alone.  Control characters of a URL are
    percent-encoded, since a header is one line."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return MAGIC + "\r\n".join(head).encode() + END + block + END


def first_payloads(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """digest, payload_bytes, first_id, n of the payloads that occur in more than one record."""
    return pages.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def with_first(hashed: DataFrame, first: DataFrame, most: int | None = None) -> DataFrame:
    """The rows with first_id of their payload, null where it occurs once.

    The `most` most frequent payloads come by broadcast.  Where there are more, a payload beyond
    them occurs at most 1 / most of all rows each, so the shuffled join of the rest has no key
    that fills a task."""
    most, key = BROADCAST_PAYLOADS if most is None else most, ["digest", "payload_bytes"]
    if first.count() <= most:
        return hashed.join(F.broadcast(first.drop("n")), key, "left")
    top = materialize(first.orderBy(F.col("n").desc(), *key).limit(most).select(*key, F.col("first_id").alias("top_id"), F.lit(True).alias("top")), "payloads")
    marked = hashed.join(F.broadcast(top), key, "left")
    frequent = marked.where("top").select(*hashed.columns, F.col("top_id").alias("first_id"))
    rest = marked.where("top IS NULL").select(*hashed.columns).join(first.drop("n"), key, "left")
    return frequent.unionByName(rest)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of (page_id, url, html) and returns the manifest (path, bytes).

    Defined results: a null html is the empty payload; rows of equal payload and the smallest
    id are responses (all of them, if that id is repeated), the others revisit it; a row with a
    null id revisits if any row of its payload has an id; an empty table gives no archive.
    """
    spark = pages.sparkSession
    target = qualified(spark, folder)
    hashed = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    hashed = hashed.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = materialize(first_payloads(hashed, least_bytes), "payloads")
    revisit = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = with_first(hashed, first).select("page_id", "url", "payload", "digest", revisit.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_fs(target)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        done, out, aside, name, size = [], None, None, None, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                system.move(aside, name)
                done.append((name, size))
                out = None

        for batch in batches:
            for part in byte_slices(batch, "payload"):
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None or size >= archive_bytes:
                        close()
                        name = f"{base}/part-{task.partitionId():06d}-{len(done):04d}.warc"
                        aside, size = f"{name}.{task.taskAttemptId()}.tmp", 0
                        out = system.open_output_stream(aside)
                    data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)
                    out.write(data)
                    size += len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "bytes"])

    manifest = materialize(map_arrow(rows, run, "path string, bytes long"), "manifest")
    remove(first)
    return manifest


def _header(stream, offset: int, size: int) -> tuple[dict, int, int] | None:
    """Fields, block offset and successor offset of a record that starts at `offset`; None where
    no header parses or its block would pass the end of the file."""
    stream.seek(offset)
    data, seen = bytearray(), 0
    while (at := data.find(END, seen)) < 0:
        seen = max(0, len(data) - len(END) + 1)
        more = stream.read(4096)
        if not more or len(data) > MOST_HEADER:
            return None
        data += more
    fields = {}
    for line in bytes(data[:at]).split(b"\r\n")[1:]:
        key, sep, value = line.partition(b":")
        if not sep:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    after = offset + at + len(END) + int(fields["content-length"]) + len(END)
    return (fields, offset + at + len(END), after) if after <= size else None


def successors(data: bytes, start: int, within: int, size: int) -> dict[int, int]:
    """Place -> successor for every magic that begins in the first `within` bytes of `data` (which
    lies at `start` in a file of `size` bytes) and opens a header that parses.

    All magics before one header end share its lines, so these are split once: a header is valid
    from the line on after which every line is a field, and the last of equal fields counts.  Work
    is linear in the bytes, whatever a payload holds."""
    found: dict[int, int] = {}
    at = data.find(MAGIC, 0, within + len(MAGIC) - 1)
    while at >= 0:
        end = data.find(END, at)
        if end < 0:
            break
        least = max(at, end - MOST_HEADER)  # a header is no longer than that
        places = [m.start() for m in re.finditer(re.escape(MAGIC), data[least : min(end + 2, within + len(MAGIC) - 1)])]
        lines = data[least:end].split(b"\r\n")
        begins, position = [], 0
        for line in lines:
            begins.append(position)
            position += len(line) + 2
        valid_from = next((i + 1 for i in range(len(lines) - 1, -1, -1) if b":" not in lines[i]), 0)
        last = {key.strip().lower(): i for i, line in enumerate(lines) if (key := line.partition(b":")[0])}
        length, kind = last.get(b"content-length", -1), last.get(b"warc-type", -1)
        value = lines[length].partition(b":")[2].strip() if length >= 0 else b""
        if value.isdigit() and kind >= 0:
            after = start + end + 2 * len(END) + int(value)
            for p in places:
                first = bisect_left(begins, p + len(MAGIC))  # the line after the magic's own
                if p + len(MAGIC) <= end and first >= valid_from and first <= min(length, kind) and after <= size:
                    found[start + least + p] = after
        at = data.find(MAGIC, end + 2, within + len(MAGIC) - 1)
    return found


def spread(rows: DataFrame, n: int) -> DataFrame:
    """The rows dealt evenly over a task each, at most `MOST_TASKS`: they are tiny, but each stands
    for a range of bytes to read, which no size estimate of theirs shows."""
    return rows.repartition(max(1, min(n, MOST_TASKS)))


def ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, bytes, start: one row per byte range of each archive, spread over tasks."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    return spread(manifest.select("path", "bytes", starts.alias("start")), range_count(manifest, range_bytes))


def range_count(manifest: DataFrame, range_bytes: int) -> int:
    return int(manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0)


def candidates(manifest: DataFrame, folder_uri: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, bytes, offset, exit: every place where a record header parses, and where the chain
    of successors that starts there leaves the byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open_fs(folder_uri)
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end = min(start + range_bytes, size)
                with system.open_input_file(path) as stream:
                    stream.seek(start)
                    data = stream.read(end - start + len(MAGIC) - 1)
                    if data.rfind(MAGIC) > data.rfind(END):  # the last header ends behind the range
                        data += stream.read(MOST_HEADER)
                after = successors(data, start, end - start, size)
                del data
                exits: dict[int, int] = {}
                for p in sorted(after, reverse=True):  # successors lie behind, so theirs are known
                    exits[p] = exits.get(after[p], -1) if after[p] < end else after[p]
                kept = [(p, e) for p, e in exits.items() if e >= 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(kept), pa.string()), pa.array([size] * len(kept), pa.int64()), pa.array([p for p, _ in kept], pa.int64()), pa.array([e for _, e in kept], pa.int64())],
                    names=["path", "bytes", "offset", "exit"],
                )

    return map_arrow(ranges(manifest, range_bytes), run, "path string, bytes long, offset long, exit long")


def entries(links: DataFrame, most_ranges: int) -> DataFrame:
    """path, offset: where the chain from each file's start enters its ranges.

    Pointer jumping: known entries take one jump while the jump table is joined with itself,
    so r rounds reach 2^r ranges."""
    known = links.where("offset = 0").select("path", "offset")
    jumps = links.select("path", "offset", "exit")
    reach = 1
    while reach < most_ranges:
        step = known.join(jumps, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        before, known = known, materialize(known.unionByName(step).distinct(), "entries")
        if reach > 1:  # the first ones belong to the caller
            remove(before)
        reach *= 2
        if reach < most_ranges:
            ahead = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("farther"))
            shorter, jumps = jumps, materialize(jumps.join(ahead, ["path", "exit"]).select("path", "offset", F.col("farther").alias("exit")), "jumps")
            if reach > 2:
                remove(shorter)
    return known


def read_archives(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every real record.

    The digest of a response is computed from the payload read and held against its header; a
    mismatch, an archive whose start is no record, or a chain that ends before the archive's
    end is an error, since rows would otherwise be lost in silence."""
    spark = manifest.sparkSession
    uri = qualified(spark, folder)
    links = materialize(candidates(manifest, uri, range_bytes), "links")
    most = manifest.agg(F.max(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    starts = entries(links, int(most))
    complete = starts.join(links.where("exit = bytes"), ["path", "offset"], "left_semi").select("path").distinct()
    broken = manifest.where("bytes > 0").join(complete, "path", "left_anti")
    if (bad := broken.first()) is not None:
        raise ValueError(f"the record chain of {bad.path} does not reach its end")
    inside = spread(materialize(starts.join(manifest, "path").where("offset < bytes"), "inside"), range_count(manifest, range_bytes))
    remove(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open_fs(uri)
        for batch in batches:
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end, found = (at // range_bytes + 1) * range_bytes, []
                with system.open_input_file(path) as stream:
                    while at < min(end, size):
                        fields, block, after = _header(stream, at, size)
                        stream.seek(block)
                        data = stream.read(int(fields["content-length"]))
                        http, _, payload = data.partition(END)
                        length = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
                            raise ValueError(f"{path} at {at}: the payload does not fit its digest")
                        number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None  # noqa: E731, B023
                        found.append((number("warc-record-id"), length, digest, kind, number("warc-refers-to")))
                        at = after
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)

    return map_arrow(inside.select("path", "offset", "bytes"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first_id FROM p),
b AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (('0x' || substr(d, (5 * (i // 4) + 1)::INT, 5))::BIGINT // (CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END)) % 32)::INT, 1)), 'string_agg', '') AS b32
  FROM f)
SELECT page_id, n AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b"""
