"""N-gram Jaccard join: count vectors in an R-tree, exact verification, linked components.

1. Texts become sets of hashed word shingles; equal sets collapse to one set id.
2. Shingles meet by hash range, packed into one binary row per range and run of texts, which
   gives every shingle's exact number of sets.  Only shared shingles go on.  Those that a share
   of all texts holds are found beforehand by frequency summaries of the tasks; they count as the
   most frequent of all and go straight to their sets, so that no task gathers such a shingle.
3. A set that must share t of its n shingles with any partner holds, among its n - t + 1 rarest
   ones, one that the partner holds too (prefix filter, rarest first).  Sets with more private
   shingles than n - t have no partner and stop here.
4. The sets of one such key are a candidate group.  A set is a point: its shared shingles
   hashed into groups, the counts as coordinates.  The sum of coordinate minima bounds the
   overlap of two sets, and of two boxes of an R-tree; pairs whose bound reaches the
   threshold are verified on the shingles.
5. What links is one component, so a group first asks only for pairs with a hub, then for the
   nearest points of each set in the tree; at last the tree joins all sets of different
   components that are left.  Groups above a bound are cut into blocks, so no task holds a
   whole large group.

No step drops or caps candidates; hubs, nearest points and blocks only order the work.  Sets are compared
by 64 bits a shingle (48 of its hash and its range), never by words: results are exact up to equal
hashes of different shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_slices, free_names, group_arrow, local_rows, map_arrow, materialize, read_table, remove, shuffle_parts

WORDS, PERCENT = 5, 80
GROUPS, NODE, FULL = 64, 32, 65_535
RANGE_POSTINGS, BLOCK, SLICE = 2_000_000, 2048, 1 << 20
#: Entries of a task's frequency summary, shingles counted between two prunings, and the share of
#: all texts from which a shingle is frequent.  At most `FREQUENT_LIST` of them, eight bytes each,
#: go out with the tasks; any others pass through their hash ranges like rare ones.
SUMMARY, COUNTED, FREQUENT_SHARE, FREQUENT_LIST = 1 << 17, 1 << 18, 1 / 512, 1 << 18
#: Pairs a task holds before it keeps each set's nearest alone.
HELD_PAIRS = 1 << 17
#: All pairs are asked for once those left are at most this many per set, once a round links
#: less than a hundredth of the sets, or after `ROUNDS`.
PAIRS_PER_SET, ROUNDS = 8, 4
#: Components above this many rows are looked up from a broadcast table of at most `HOT_ROWS`.
HOT, HOT_ROWS = 5_000, 100_000
#: Rows that deduplication drops are broadcast up to this many (24 bytes each), else shuffled.
BROADCAST_COPIES = 500_000

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words has one
    hash of its whole sequence, one without words (or null) has none."""
    closed = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
    offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + len(closed) + 1]
    data = _LOWER[np.frombuffer(closed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    first = np.searchsorted(starts, offsets)  # index of each text's first word
    if not len(starts):
        return [np.zeros(0, _U)] * len(texts)
    # a word's hash: sum of byte * p^(place in word), then mixed with its length
    lengths = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.cumprod(np.full(int(lengths.max()), _P, _U), dtype=_U)
    value = (data.astype(_U) + _U(1)) * powers[np.minimum(place, len(powers) - 1)]
    value[_SPACE[data]] = 0
    word = mixed(np.add.reduceat(value, starts) + lengths.astype(_U))
    out = []
    n = len(word) - words + 1
    rolled = np.zeros(max(n, 0), _U)
    for k in range(words):
        if n > 0:
            rolled = rolled * _P + word[k : k + n]
    rolled = mixed(rolled)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = _U(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _P + w
            out.append(mixed(np.array([h], _U) + _U(1)))
        else:
            out.append(np.zeros(0, _U))
    return out


def pack(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each hash, six bytes each: the hash range of a row stands for the rest."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes, bucket: int | np.ndarray) -> np.ndarray:
    """Shingle ids: the packed bits under the number of their hash range."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(_U) | (np.asarray(bucket) % 65_536).astype(_U) << _U(48)


def set_id(hashes: np.ndarray) -> int:
    return int(np.add.reduce(mixed(hashes ^ _P), dtype=_U).view(np.int64)) if len(hashes) else 0


def spans(cut: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Start and end of the runs that begin at `cut` in an array of n; none of an empty one."""
    return zip(cut.tolist(), [*cut[1:].tolist(), n], strict=True) if n else zip((), (), strict=True)


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def needed(n, m, percent: int = PERCENT):
    """Shingles that sets of n and m must share: 100 I >= percent (n + m - I)."""
    return -(-percent * (n + m) // (100 + percent))


class Summary:
    """Counts of the most frequent shingles seen, in bounded space: whenever more than `size` are
    held, all counts drop by that of the first one too many.  A count is then too low by at most
    the number of shingles seen over `size`."""

    def __init__(self, size: int = SUMMARY):
        self.size, self.waiting, self.n = size, [], 0
        self.keys, self.counts = np.zeros(0, _U), np.zeros(0, np.int64)

    def add(self, hashes: list[np.ndarray]) -> None:
        self.waiting += hashes
        self.n += sum(map(len, hashes))
        if self.n >= COUNTED:
            self.prune()

    def prune(self) -> None:
        keys = np.concatenate([self.keys, *self.waiting])
        counts = np.concatenate([self.counts, np.ones(self.n, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.waiting, self.n = [], 0
        if len(self.keys) > self.size:
            self.counts = self.counts - np.partition(self.counts, len(self.counts) - self.size - 1)[len(self.counts) - self.size - 1]
            kept = self.counts > 0
            self.keys, self.counts = self.keys[kept], self.counts[kept]


def document_sets(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sid per row; and rows whose n_shingles is null, each with a shingle (as
    doc_id) and how often (as sid) a task's summary counts it, if that is not once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, names, n_sets = Summary(), ["doc_id", "n_shingles", "sid"], 0
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                sets = shingle_sets(part.column(1))
                n_sets += len(sets)
                summary.add(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], names=names)
        summary.prune()
        often = summary.counts > max(1, n_sets * FREQUENT_SHARE / 2)
        yield pa.RecordBatch.from_arrays([pa.array(summary.keys[often].view(np.int64)), pa.nulls(int(often.sum()), pa.int64()), pa.array(summary.counts[often])], names=names)

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, n_shingles long, sid long")


def frequent_shingles(rows: DataFrame, n_texts: int) -> np.ndarray:
    """Sorted hashes of the shingles that the tasks' summaries count in `FREQUENT_SHARE` of all
    texts, a bounded list.  Which ones are in it changes no result, only how postings travel."""
    counted = rows.where("n_shingles IS NULL").groupBy("doc_id").agg(F.sum("sid").alias("n"))
    found = counted.where(F.col("n") >= F.lit(max(2.0, n_texts * FREQUENT_SHARE))).orderBy(F.col("n").desc(), "doc_id").limit(FREQUENT_LIST)
    return np.sort(np.array([r.doc_id for r in found.select("doc_id").collect()], np.int64).view(_U))


def range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def postings(documents: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """bucket, sids, sizes, counts, hashes: the sets of a run of texts, cut by hash range.

    `hashes` holds, set after set, those in the range; `counts` says how many of each set.
    Postings of `frequent` shingles are dealt by their set's id instead, into rows with bucket
    `buckets + part` and whole shingle ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                sets = {set_id(s): s for s in shingle_sets(part.column(0)) if len(s)}
                if not sets:
                    continue
                sids, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
                h = np.concatenate(list(sets.values()))
                owner = np.repeat(np.arange(len(sids)), sizes)
                bucket = range_of(h, buckets)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    often = frequent[place] == h
                    bucket[often] = buckets + sids[owner[often]] % buckets
                order = np.argsort(bucket.astype(np.int16) if buckets < 1 << 14 else bucket, kind="stable")
                h, owner, bucket = h[order], owner[order], bucket[order]
                used, cut = np.unique(bucket, return_index=True)
                rows: list = [[], [], [], [], []]
                for b, (a, z) in zip(used, spans(cut, len(h)), strict=True):
                    who, counts = np.unique(owner[a:z], return_counts=True)
                    held = pack(h[a:z]) if b < buckets else unpack(pack(h[a:z]), range_of(h[a:z], buckets)).tobytes()
                    for column, v in zip(rows, (int(b), sids[who].tobytes(), sizes[who].tobytes(), counts.astype(np.int64).tobytes(), held), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["bucket", "sids", "sizes", "counts", "hashes"])

    return map_arrow(documents.select("text"), run, "bucket int, sids binary, sizes binary, counts binary, hashes binary")


def _whole(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def shared_postings(blobs: DataFrame, parts: int) -> DataFrame:
    """part, bucket, sids, sizes, counts, hashes, df: per hash range and part of the set ids,
    the shingles that two sets or more hold, packed as in `postings`; df is cut at 65535, which
    keeps the order of all rarer ones.  Frequent shingles come dealt by part (bucket -1, whole
    ids) and have a df of 65535."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        dealt, blob = bucket >= parts, b"".join(table.column("hashes").to_pylist())
        counts, h = _whole(table, "counts", np.int64), np.frombuffer(blob, _U) if dealt else unpack(blob, bucket)
        owner = np.repeat(np.arange(len(counts)), counts)
        sids, sizes = _whole(table, "sids", np.int64), _whole(table, "sizes", np.int64)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        if not dealt:
            again = np.flatnonzero(np.concatenate([h[1:] == h[:-1], [False]]) | np.concatenate([[False], h[1:] == h[:-1]]))
            h, owner = h[again], owner[again]
        sid = sids[owner]
        order = np.lexsort((sid, h))  # equal sets of other runs are one set
        h, sid, owner = h[order], sid[order], owner[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])]) if len(h) else np.zeros(0, bool)
        h, sid, owner = h[keep], sid[keep], owner[keep]
        _, back, df = np.unique(h, return_inverse=True, return_counts=True)
        df = np.full(len(h), 65535) if dealt else df[back] if len(h) else df
        keep = df > 1
        h, sid, owner, df = h[keep], sid[keep], owner[keep], np.minimum(df[keep], 65535).astype("<u2")
        part = sid % parts
        order = np.lexsort((sid, part))
        h, sid, owner, df, part = h[order], sid[order], owner[order], df[order], part[order]
        used, cut = np.unique(part, return_index=True)
        rows: list = [[], [], [], [], [], [], []]
        for p, (i, j) in zip(used, spans(cut, len(h)), strict=True):
            who, first, k = np.unique(sid[i:j], return_index=True, return_counts=True)
            for column, v in zip(rows, (int(p), -1 if dealt else bucket, who.tobytes(), sizes[owner[i:j][first]].tobytes(), k.astype(np.int64).tobytes(), h[i:j].tobytes() if dealt else pack(h[i:j]), df[i:j].tobytes()), strict=True):
                column.append(v)
        return pa.table([*(pa.array(c, pa.int32()) for c in rows[:2]), *(pa.array(c, pa.binary()) for c in rows[2:])], names=["part", "bucket", "sids", "sizes", "counts", "hashes", "df"])

    return group_arrow(blobs, "bucket", run, "part int, bucket int, sids binary, sizes binary, counts binary, hashes binary, df binary")


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """Shingles per group; `FULL` in all coordinates if one does not fit, which bounds nothing."""
    counts = np.bincount((hashes & _U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return (counts if counts.max() < FULL else np.full(GROUPS, FULL)).astype("<u2")


def coordinates(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.int64)
    wide[wide == FULL] = 1 << 40
    return wide


def prefixes(shared: DataFrame) -> DataFrame:
    """sid, n, hashes (sorted), vec, keys of the sets that can have a partner."""

    def run(table: pa.Table) -> pa.Table:
        sids, sizes, counts = (_whole(table, c, np.int64) for c in ("sids", "sizes", "counts"))
        h = np.concatenate([np.frombuffer(b, _U) if k < 0 else unpack(b, k) for b, k in zip(table.column("hashes").to_pylist(), table.column("bucket").to_pylist(), strict=True)])
        df = _whole(table, "df", "<u2")
        sid, size = np.repeat(sids, counts), np.repeat(sizes, counts)
        order = np.lexsort((h, df, sid))
        h, sid, size = h[order], sid[order], size[order]
        used, cut = np.unique(sid, return_index=True)
        rows: list = [[], [], [], [], []]
        for i, j in spans(cut, len(h)):
            n = int(size[i])
            # n - t + 1 rarest shingles, of which those no other set holds come first
            length = n - least_overlap(n) + 1 - (n - (j - i))
            if length > 0:
                own = np.sort(h[i:j])
                for column, v in zip(rows, (int(sid[i]), n, own.tobytes(), count_vector(own).tobytes(), h[i : i + length].view(np.int64)), strict=True):
                    column.append(v)
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["sid", "n", "hashes", "vec", "keys"])

    return group_arrow(shared, "part", run, "sid long, n long, hashes binary, vec binary, keys array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs of set ids that link.  Count vectors, a few bytes a set, rule out most
    of the others before any shingles travel."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (coordinates(np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, GROUPS)) for i in (4, 5))
            kept = batch.filter(pa.array(np.minimum(x, y).sum(1) >= needed(n, m)))
            yield pa.RecordBatch.from_arrays(kept.columns[:4], names=["a", "b", "na", "nb"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                keep.append(len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True)) >= needed(n, m))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    def side(end: str, what: str) -> DataFrame:
        return sets.select(F.col("sid").alias(end), *([F.col("n").alias(f"n{end}")] if what == "vec" else []), F.col(what).alias(f"{what}_{end}"))

    points = pairs.select("a", "b").join(side("a", "vec"), "a").join(side("b", "vec"), "b").select("a", "b", "na", "nb", "vec_a", "vec_b")
    near = map_arrow(points, bounded, "a long, b long, na long, nb long")
    whole = near.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b").select("a", "b", "na", "nb", "hashes_a", "hashes_b")
    return map_arrow(whole, exact, "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (u, v): alternating large and small stars, the
    root being the smallest node of the component.  Each round is written down."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, "edges")
        found = mark(after)
        remove(now)
        now = after
        if found == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found


def tree_pairs(n: np.ndarray, vec: np.ndarray, component: np.ndarray, side: np.ndarray, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose sets may link: the R-tree of the points joined with itself.  With
    `nearest`, each place keeps that many partners, those of the largest bounds.

    Points are packed into leaves by size and then by their heaviest coordinate; a box of
    leaves bounds what it holds.  Pairs of one component, and pairs on one side of a block of
    two sides, are left out."""
    order = np.lexsort((vec.argmax(1), n))
    n, vec, component, side = n[order], vec[order], component[order], side[order]
    cuts = np.arange(0, len(n), NODE)
    high, low_n, high_n = np.maximum.reduceat(vec, cuts), np.minimum.reduceat(n, cuts), np.maximum.reduceat(n, cuts)
    found: list = []
    waiting = 0
    two_sides = side.min() != side.max()

    def nearest_of(parts: list) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are among the `nearest` of one of their ends; what is left out here can
        be among them in no larger set of pairs, so pruning early loses nothing."""
        a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
        share = np.concatenate([np.minimum(vec[a[i : i + 16_384]], vec[b[i : i + 16_384]]).sum(1) for i in range(0, len(a), 16_384)]) / (n[a] + n[b])
        ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
        by_end = np.lexsort((b[pair], a[pair], -share[pair], ends))
        place = np.arange(len(by_end)) - np.searchsorted(ends[by_end], ends[by_end])
        keep = np.unique(pair[by_end[place < nearest]])
        return a[keep], b[keep]

    def may(i: np.ndarray, j: np.ndarray, top: np.ndarray, least_n: np.ndarray, most_n: np.ndarray) -> np.ndarray:
        fits = (most_n[i] * 100 >= PERCENT * least_n[j]) & (most_n[j] * 100 >= PERCENT * least_n[i])
        i, j = i[fits], j[fits]
        bound = np.minimum(top[i], top[j]).sum(1) >= needed(least_n[i], least_n[j])
        return i[bound], j[bound]

    super_cuts = np.arange(0, len(cuts), NODE)
    s_high, s_low, s_top = np.maximum.reduceat(high, super_cuts), np.minimum.reduceat(low_n, super_cuts), np.maximum.reduceat(high_n, super_cuts)
    for i, j in zip(*may(*np.triu_indices(len(super_cuts)), s_high, s_low, s_top), strict=True):
        x, y = (a.ravel() for a in np.meshgrid(np.arange(i * NODE, min((i + 1) * NODE, len(cuts))), np.arange(j * NODE, min((j + 1) * NODE, len(cuts))), indexing="ij"))
        up = x <= y
        for p, q in zip(*may(x[up], y[up], high, low_n, high_n), strict=True):
            a, b = (v.ravel() for v in np.meshgrid(np.arange(p * NODE, min((p + 1) * NODE, len(n))), np.arange(q * NODE, min((q + 1) * NODE, len(n))), indexing="ij"))
            ok = (a < b) & (component[a] != component[b])
            if two_sides:
                ok &= side[a] != side[b]
            a, b = may(a[ok], b[ok], vec, n, n)
            if len(a):
                found.append((a, b))
                waiting += len(a)
            if nearest is not None and waiting > HELD_PAIRS:
                found, waiting = [nearest_of(found)], 0
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = nearest_of(found) if nearest is not None else (np.concatenate(c) for c in zip(*found, strict=True))
    return order[a], order[b]


def block_pairs(entries: DataFrame, nearest: int | None = None) -> DataFrame:
    """a, b: candidate pairs (the `nearest` per set and block, or all) of the key groups in `entries` (key, sid, n, vec, component, m).

    A group of m sets above `BLOCK` is dealt into chunks, and each pair of chunks is a block of
    its own, so a task holds two chunks at most.  A component of more than `BLOCK` sets has chunks
    of its own; the others are dealt by their component.  Blocks inside one component are left
    out, so a set of a large component is repeated once per chunk of other components only."""
    large = entries.where(F.col("m") > BLOCK).groupBy("key", "component", "m").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK)
    large = large.withColumn("own_chunks", F.ceil(F.col("k") / BLOCK).cast("int"))
    before = Window.partitionBy("key").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)  # large components of a key, m / BLOCK at most
    placed = large.withColumn("first", F.coalesce(F.sum("own_chunks").over(before), F.lit(0)).cast("int"))
    taken = placed.groupBy("key").agg(F.sum("own_chunks").cast("int").alias("taken"), F.sum("k").alias("inside"))
    known = entries.join(taken, "key", "left").join(placed.select("key", "component", "own_chunks", "first"), ["key", "component"], "left")
    shared = F.greatest(F.lit(1), F.ceil((F.col("m") - F.coalesce("inside", F.lit(0))) / BLOCK)).cast("int")
    known = known.withColumn("shared", shared).withColumn("c", F.coalesce("taken", F.lit(0)) + F.col("shared"))
    alone = F.col("own_chunks").isNotNull()
    own = F.when(alone, F.col("first") + F.pmod(F.xxhash64("sid"), F.col("own_chunks"))).otherwise(F.coalesce("taken", F.lit(0)) + F.pmod(F.xxhash64("component"), F.col("shared"))).cast("int")
    others = F.when(alone, F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda x: (x < F.col("first")) | (x >= F.col("first") + F.col("own_chunks")))).otherwise(F.sequence(F.lit(0), F.col("c") - 1))
    dealt = known.withColumn("own", own).withColumn("other", F.explode(others))
    blocks = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "n", "vec", "component")
    blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(rows: list) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        _, _, _, own, sid, n, vec, component = zip(*rows, strict=True)
        a, b = tree_pairs(np.array(n), coordinates(np.frombuffer(b"".join(vec), "<u2").reshape(-1, GROUPS)), np.array(component), np.array(own), nearest)
        if not len(a):
            return None
        sid = np.array(sid)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[a], sid[b])), pa.array(np.maximum(sid[a], sid[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if (out := pairs(held)) is not None:
                        yield out
                    held, at = [], row[:3]
                held.append(row)
        if (out := pairs(held)) is not None:
            yield out

    return map_arrow(blocks, run, "a long, b long").distinct()


def link_sets(sets: DataFrame) -> DataFrame:
    """sid, component for the sets that link to a smaller set id: components of all pairs that
    link.

    First each group's sets are held against one hub (without it the tree's first round meets whole
    groups of near copies, which costs more memory than an executor has), then against their nearest
    points in the tree, twice as many each time while many pairs are left; then every pair of two
    components that the tree lets through is verified."""
    spark = sets.sparkSession
    keys = sets.select(F.explode("keys").alias("key"), "sid", "n")
    wide = materialize(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "key"), "entries")
    total = sets.count()
    moved = local_rows(spark, [], "sid long, component long")
    n_moved = before = 0

    def labelled(rows: DataFrame, sid: str, name: str) -> DataFrame:
        side = moved.select(F.col("sid").alias(sid), F.col("component").alias("_to"))
        side = F.broadcast(side) if n_moved <= BROADCAST_COPIES else side
        return rows.join(side, sid, "left").withColumn(name, F.coalesce("_to", sid)).drop("_to")

    def merge(edges: DataFrame) -> None:
        nonlocal moved, n_moved
        tied = labelled(labelled(edges, "a", "u"), "b", "v").where("u <> v").select("u", "v")
        roots = connect(tied)
        known = moved.join(roots.withColumnRenamed("node", "component"), "component", "left").select("sid", F.coalesce("root", "component").alias("component"))
        own = roots.select(F.col("node").alias("sid"), F.col("root").alias("component"))
        before_merge, moved = moved, materialize(known.unionByName(own), "labels")
        n_moved = moved.count()
        remove(before_merge)
        remove(roots)

    for r in range(ROUNDS + 1):
        here = labelled(wide, "sid", "component")
        per = here.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64("sid"), "sid", "n")).alias("h"))
        per = per.groupBy("key").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count(F.lit(1)).alias("parts"), F.min(F.struct("h", "component")).alias("hub")).where("parts > 1")
        mixed_keys = materialize(per.select("key", "m", ((F.col("m") * F.col("m") - F.col("squares")) / 2).alias("pairs"), F.col("hub.h.sid").alias("hub"), F.col("hub.h.n").alias("hub_n"), F.col("hub.component").alias("hub_component")), "keys")
        left = mixed_keys.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            break
        if r == 0:
            near = (F.col("n") * 100 >= F.col("hub_n") * PERCENT) & (F.col("hub_n") * 100 >= F.col("n") * PERCENT)
            stars = here.drop("m").join(mixed_keys.drop("m"), "key").where((F.col("component") != F.col("hub_component")) & near)
            pairs = stars.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()
        else:
            last = left <= PAIRS_PER_SET * total or n_moved - before <= total // 100 or r == ROUNDS
            rest = here.drop("m").join(mixed_keys.select("key", "m"), "key").join(sets.select("sid", "vec"), "sid")
            pairs = block_pairs(rest, None if last else 1 << (r - 1))
        before = n_moved
        merge(verified(pairs, sets))
        remove(mixed_keys)
        if r and last:
            break
    remove(wide)
    return moved


def members(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as doc_id, n_shingles, sid; and those with shingles as doc_id, n_shingles, sid,
    component."""
    spark = documents.sparkSession
    counted = materialize(document_sets(documents), "documents")
    rows = counted.where("n_shingles IS NOT NULL")
    n_texts, volume = rows.agg(F.count(F.when(F.col("n_shingles") > 0, 1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    buckets = max(shuffle_parts(spark), -(-volume // RANGE_POSTINGS))
    frequent = frequent_shingles(counted, n_texts)
    sets = materialize(prefixes(shared_postings(postings(documents, buckets, frequent), buckets)), "sets")
    moved = link_sets(sets)
    held = rows.where("n_shingles > 0").join(moved, "sid", "left").select("doc_id", "n_shingles", "sid", F.coalesce("component", "sid").alias("component"))
    held = materialize(held, "members")
    remove(sets)
    remove(moved)
    return rows, held


def jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per input row; component_id is the smallest doc_id that
    links reach.

    Defined results: a text that is null, empty or without words has no shingles, links with
    nothing and is its own component; a text of fewer than five words is one shingle, its whole
    sequence; equal sets link whatever their doc_ids, and rows repeated in all columns get the
    same result each; a null doc_id counts in no minimum (null if a component has no other);
    an empty table gives an empty table; other columns are not read.
    """
    rows, held = members(documents)
    ids = materialize(held.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    large = ids.where(F.col("n") > HOT).select("component", F.col("component_id").alias("large_id"), F.lit(True).alias("large"))
    if large.count() <= HOT_ROWS:
        marked = held.join(F.broadcast(large), "component", "left")
        rest = marked.where("large IS NULL").join(ids.where(F.col("n") <= HOT), "component")
        found = rest.select("doc_id", "n_shingles", "component_id").unionByName(marked.where("large").select("doc_id", "n_shingles", F.col("large_id").alias("component_id")))
    else:
        found = held.join(ids, "component").select("doc_id", "n_shingles", "component_id")
    bare = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(bare)


def deduplicate(documents: DataFrame) -> DataFrame:
    """The rows, with all their columns, less all but one of each component.

    The row with the smallest doc_id stays (a null id only if the component has no other); of
    rows with the same id and the same shingles, any one.  Rows without shingles all stay.  The
    texts are not shuffled while the rows to drop fit the broadcast bound.
    """
    _, held = members(documents)
    keys = held.groupBy("doc_id", "sid", "component").agg(F.count(F.lit(1)).alias("k"))
    best = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("w"))
    best = best.select(F.col("w.doc_id").alias("_best_id"), F.col("w.sid").alias("_best_sid"))
    won = keys.join(best, keys.doc_id.eqNullSafe(F.col("_best_id")) & (keys.sid == F.col("_best_sid")), "left")
    marked = materialize(won.select("doc_id", "sid", "k", F.col("_best_sid").isNotNull().alias("stays")).where("NOT stays OR k > 1"), "copies")
    mark, sid, marked_id, marked_sid = free_names(documents.columns, "stays", "sid", "marked_id", "marked_sid")
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                ids = [set_id(s) if len(s) else None for s in shingle_sets(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.int64())], names=[*part.schema.names, sid])

    known = map_arrow(documents, run, StructType([*documents.schema.fields, StructField(sid, LongType())]))
    side = marked.select(F.col("doc_id").alias(marked_id), F.col("sid").alias(marked_sid), F.col("stays").alias(mark))
    side = F.broadcast(side) if marked.count() <= BROADCAST_COPIES else side
    joined = known.join(side, known["doc_id"].eqNullSafe(F.col(marked_id)) & (known[sid] == F.col(marked_sid)), "left")
    alone = joined.where(F.col(mark).isNull()).select(*documents.columns)
    repeated = joined.where(F.col(mark)).select(*documents.columns, sid).dropDuplicates(["doc_id", sid]).select(*documents.columns)
    return alone.unionByName(repeated)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted; then reachability by recursion.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT rid, s FROM (
    SELECT rid, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5
    UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
i AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM i JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
c AS (SELECT a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)"""
