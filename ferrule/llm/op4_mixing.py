"""Mixing sources to target weights by the cube method of balanced sampling.

Every source gets a target: its weight's share of 150 % of all words, at most twice its own
words.  The ratio of target to size is how often its documents are taken; the whole part for
certain, the rest by a balanced sample.  In the flight phase the inclusion probabilities of
three documents move along the null space of the two balancing equations (words, documents)
until one of them is 0 or 1; documents of a source are dealt to chunks of bounded size by the
hash of their id, and what each chunk leaves (two at most) meets in the next, much smaller
round.  What the last round leaves per source, two documents at most, lands on the choice
nearest to the word target.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import WORD, free_names, materialize, read_table, remove

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
CHUNK = 2048
#: A table of sources up to this many rows is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Likewise for the table of units that the mix takes (some 80 bytes a row).
BROADCAST_UNITS = 1_000_000
_KEY = ["doc_id", "source", "size"]


def sized_column():
    """Number of words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size."""
    return documents.select("doc_id", "source", sized_column().alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, n_units, source_size, target: water filling over the table of sources.

    Sources in code point order (null last) take the weights in turn.  With the caps in order of
    cap / weight, the level that those from one source on would share, all before being capped,
    rises up to the first source that its cap does not stop and falls after it, so its largest
    value is the water level.  The windows run over sources, not over documents."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = F.row_number().over(by_name)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((order - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        totals.withColumn("weight", w)
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("water", F.max("level").over(everything))
    )
    target = F.least(F.col("most"), F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    return ranked.select("source", "n_units", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def flight(sizes: np.ndarray, pi: np.ndarray, seed: int) -> np.ndarray:
    """Moves probabilities along the null space of (size, 1) until two at most are fractional."""
    rng = np.random.default_rng(seed)
    s, p, eps = sizes.astype(float).tolist(), pi.astype(float).tolist(), 1e-9
    queue = [i for i in range(len(p)) if eps < p[i] < 1 - eps][::-1]
    draws, used = rng.random(len(queue) + 8), 0
    active: list[int] = []
    while True:
        while queue and len(active) < 3:
            active.append(queue.pop())
        if len(active) < 3:
            break
        a, b, c = active
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, x in zip(active, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        step = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        for i, x in zip(active, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] < eps or p[i] > 1 - eps:
                p[i] = float(round(p[i]))
        active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.array([0.0 if x < eps else 1.0 if x > 1 - eps else x for x in p])


def land(sizes: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Settles what the last flight leaves: of all 0/1 choices (four at most) the one whose words
    are nearest to what was expected, then whose number of documents is."""
    p = pi.copy()
    rest = np.flatnonzero((p > 0) & (p < 1))
    choices = [[(k >> j) & 1 for j in range(len(rest))] for k in range(1 << len(rest))]
    miss = lambda c: (abs(float(((np.array(c) - p[rest]) * sizes[rest]).sum())), abs(float((np.array(c) - p[rest]).sum())), c)
    if len(rest):
        p[rest] = min(choices, key=miss)
    return p


def _round(last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # the largest first: what the flight leaves are then the smallest units of the group
        frame = frame.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        sizes = frame["size"].to_numpy(float)
        pi = flight(sizes, frame["pi"].to_numpy(float), int(frame["place"].iloc[0]) & 0x7FFFFFFF)
        frame["pi"] = land(sizes, pi) if last else pi
        return frame

    return run


def cube_sample(units: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Units (doc_id, source, size, n, rank, n_units, pi) with pi settled to 0 or 1.

    The units of one source are dealt to ceil(n_units / chunk) groups by hash, and each round
    divides the groups by chunk / 2, the leftovers of one group being two; the number of rounds
    is the logarithm of the largest source."""
    ship(units.sparkSession)
    open_units = units.withColumn("h", F.xxhash64("doc_id", "size"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_units") / chunk)).cast("long")
    open_units = open_units.withColumn("place", F.pmod(F.col("h"), groups)).withColumn("groups", groups)
    most = units.agg(F.max("n_units")).first()[0] or 0
    left, settled = max(1, math.ceil(most / chunk)), []
    schema = open_units.schema
    while True:
        last = left == 1
        done = materialize(open_units.groupBy("rank", "place").applyInPandas(_round(last), schema), "cube")
        fractional = (F.col("pi") > 0) & (F.col("pi") < 1)
        settled.append(done.where(~fractional))
        if last:
            break
        open_units = done.where(fractional).withColumn("place", F.floor(F.col("place") / (chunk // 2)).cast("long"))
        left = math.ceil(left / (chunk // 2))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies: one row per distinct (doc_id,
    source, size), `n` being how many input rows it stands for and `copies` how often they are taken
    together: each copies / n times, rounded down, and copies mod n of them once more.

    Defined results: rows equal in id, source and size are one unit, whose rows share its copies; a
    null source is a source, last in order; sizes of 0 are taken like any other and add
    nothing; a source without words has target 0 and is not taken; an empty table gives an empty
    table; reruns agree, since every draw is seeded by hashes of ids and groups.
    """
    spark = sizes.sparkSession
    units = materialize(sizes.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")), "units")
    per_source = targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap)
    rated = per_source.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rated = materialize(rated.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "sources")
    side = F.broadcast(rated) if rated.count() <= BROADCAST_SOURCES else rated
    whole, expected = F.floor(F.col("rate") * F.col("n") + 1e-9).cast("double"), F.col("rate") * F.col("n")
    joined = units.alias("u").join(side.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")), "inner").select(
        *(F.col(f"u.{c}").alias(c) for c in (*_KEY, "n")), "rank", "n_units", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), expected - whole).alias("pi")
    )
    settled = cube_sample(joined)  # written down with all columns
    remove(units)
    remove(rated)
    return settled.withColumn("copies", (F.col("whole") + F.col("pi")).cast("long")).select(*_KEY, "n", "source_size", "target", "copies")


def mix_documents(documents: DataFrame) -> DataFrame:
    """The rows as often as the mix takes them, with all their columns.

    Defined results: as for `mix`; of rows equal in id, source and size, those whose hash over all
    columns is smaller are taken once more where the copies do not come out even (only such rows
    are shuffled); a null text has size 0; an empty table gives an empty table; columns of any name
    are carried along.
    """
    kept = documents.columns
    own_id, own_source, own_size, n, copies, place = free_names(kept, *_KEY, "n", "copies", "place")
    sizes = materialize(sized(documents), "sizes")
    units = mix(sizes).where("copies > 0").select(*(F.col(c).alias(x) for c, x in zip((*_KEY, "n", "copies"), (own_id, own_source, own_size, n, copies), strict=True)))
    units = materialize(units, "copies")
    remove(sizes)
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (sized_column() == F.col(own_size))
    even = F.col(copies) % F.col(n) == 0

    def repeated(rows: DataFrame, times) -> DataFrame:
        return rows.withColumn(copies, F.explode(F.array_repeat(F.lit(0).cast("long"), times.cast("int")))).select(*kept)

    def matched(part: DataFrame) -> DataFrame:
        return documents.join(F.broadcast(part) if part.count() <= BROADCAST_UNITS else part, same)

    odd = units.where(~even)
    level = repeated(matched(units.where(even)), F.col(copies) / F.col(n))
    if odd.isEmpty():
        return level
    order = Window.partitionBy(own_id, own_source, own_size).orderBy(F.xxhash64(*kept))
    placed = matched(odd).withColumn(place, F.row_number().over(order))
    return level.unionByName(repeated(placed, F.floor(F.col(copies) / F.col(n)) + (F.col(place) <= F.col(copies) % F.col(n)).cast("long")))


def query(spark, sf_dir: str) -> DataFrame:
    sizes = materialize(sized(read_table(spark, sf_dir, "documents")), "sizes")
    mixed = mix(sizes)
    remove(sizes)
    rows = mixed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    times = F.floor(F.col("copies") / F.col("n")) + (F.col("row") <= F.col("copies") % F.col("n")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source")
