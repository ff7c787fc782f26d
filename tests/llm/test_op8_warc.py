import pytest
from fixtures_path import fx  # noqa: F401
from pyspark.sql import functions as F

from ferrule.llm import op8_warc as op
from ferrule.llm.common import new_path


def write_read(spark, rows, range_bytes=op.RANGE_BYTES, **how):
    df = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], "page_id long, url string, html string, digest string, payload string, path string")
    folder = new_path(spark, "warc-test")
    manifest = op.write_archives(df, folder, **how)
    return sorted((tuple(r) for r in op.read_archives(manifest, folder, range_bytes).collect()), key=repr)


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "") if len(data) >= least else i
        response = to is None or i == to
        out.append((i, len(data), op.sha1_base32(data), "response" if response else "revisit", None if response else to))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, None, None),
    (4, "http://a/ b\r\nX: y", ""),
    (5, "http://a/5", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40),
    (6, "http://a/6", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n"),
    (7, "http://a/7", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100000\r\n\r\n"),
    (0, "http://a/0", "<p>one</p>"),
    (0, "http://a/0", "<p>one</p>"),
    (None, "http://a/n", "<p>one</p>"),
    (None, None, "alone"),
]


@pytest.mark.parametrize("range_bytes", [op.RANGE_BYTES, 700, 97])
def test_round_trip(spark, range_bytes):
    assert write_read(spark, ROWS, range_bytes) == expected(ROWS)


def test_small_archives_and_least_bytes(spark):
    assert write_read(spark, ROWS, 500, archive_bytes=600, least_bytes=11) == expected(ROWS, 11)


def test_empty_table(spark):
    assert write_read(spark, []) == []


def test_magic_in_payloads_is_a_candidate_but_no_record(spark):
    folder = new_path(spark, "warc-test")
    df = spark.createDataFrame(ROWS[:7], "page_id long, url string, html string").coalesce(1)
    manifest = op.write_archives(df, folder)
    assert op.candidates(manifest, op.qualified(spark, folder), 700).count() > 40
    assert op.read_archives(manifest, folder, 700).count() == 7


def test_a_broken_archive_is_an_error(spark):
    folder = new_path(spark, "warc-test")
    manifest = op.write_archives(spark.createDataFrame(ROWS[:3], "page_id long, url string, html string").coalesce(1), folder)
    path = manifest.first().path
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-10])
    with pytest.raises(ValueError, match="does not reach"):
        op.read_archives(manifest.withColumn("bytes", F.col("bytes") - 10), folder).collect()


def test_ranges_are_dealt_over_many_tasks(spark):
    manifest = spark.createDataFrame([("a", 400 * 97), ("b", 10)], "path string, bytes long")
    rows = op.ranges(manifest, 97)
    assert rows.rdd.getNumPartitions() == 401
    sizes = rows.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 401 and max(sizes) <= 16 and sum(n > 0 for n in sizes) > 100


def naive(data, size):
    """Every place where a header parses, read one at a time."""
    import io

    out, at = {}, data.find(op.MAGIC)
    while at >= 0:
        if (h := op._header(io.BytesIO(data), at, size)) is not None:
            out[at] = h[2]
        at = data.find(op.MAGIC, at + 1)
    return out


def test_successors_equal_one_header_at_a_time():
    import random

    rng = random.Random(4)
    pieces = [op.MAGIC, b"\r\n", b"\r\n\r\n", b"WARC-Type: response\r\n", b"Content-Length: 7\r\n", b"Content-Length: x\r\n", b"a: b\r\n", b"no field\r\n", b"text", b"x WARC/1.1\r\n", b":"]
    for _ in range(400):
        data = b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))
        want = naive(data, len(data) + 5)
        assert op.successors(data, 0, len(data), len(data) + 5) == want
        assert op.successors(data, 0, 20, len(data) + 5) == {p: e for p, e in want.items() if p < 20}


def test_a_payload_full_of_magics_is_read_in_linear_time():
    import time

    for data in (op.MAGIC * 300_000, b"a:" + op.MAGIC * 300_000 + b"\r\n", (b"k:" + op.MAGIC) * 200_000 + b"Content-Length: 1\r\nWARC-Type: x\r\n\r\n"):
        began = time.perf_counter()
        op.successors(data, 0, len(data), len(data) + 100)
        assert time.perf_counter() - began < 5


def test_more_repeated_payloads_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_PAYLOADS", 1)
    rows = ROWS + [(100 + i, None, f"body {i % 5}") for i in range(30)] + [(200, None, "alone again")]
    assert write_read(spark, rows) == expected(rows)
