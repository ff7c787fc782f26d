"""Compression classifier of quality.

Two zstandard dictionaries are built, from good and from bad labelled text.  A document is cut
into blocks, and every block is compressed with either dictionary: what the dictionary knows
costs little.  The difference of the two sizes, divided by their sum, is turned into a
probability by a logistic curve, together with how far the text compresses at all (a text that
repeats itself is small under either dictionary, so the difference alone cannot see it).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, held_out, labelled_sample, map_arrow, read_table, where_text
from .fitting import fit_logistic, predict_logistic

BLOCK = 1024
DICTIONARY = 48 << 10
LEVEL = 1
#: Bounds of what fitting sees: ids per class, and characters per id on average; texts are whole.
SAMPLE, SAMPLE_CHARS = 1500, 20_000
THRESHOLD = 0.7


def build_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on blocks of the texts; too little text for training gives the raw
    text itself as dictionary content."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-DICTIONARY:].ljust(16, b" ")


def without_shared_lines(texts: list[bytes]) -> list[bytes]:
    """The texts less the lines that several of them hold: boilerplate says nothing of quality,
    and a dictionary that held it for one class only would favour that class."""
    holders = Counter(line for t in texts for line in set(t.split(b"\n")))
    return [b"\n".join(line for line in t.split(b"\n") if holders[line] == 1) for t in texts]


class Sizer:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = self._open(good), self._open(bad)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)

    @staticmethod
    def _open(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float, float, float]:
        """Normalised difference, size per byte in blocks, whole size against blocks, log length."""
        if not text:
            return 0.0, 0.0, 0.0, 0.0
        good = bad = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
        whole = len(self.plain.compress(text))
        return (bad - good) / (bad + good), min(good, bad) / len(text), whole / len(text), float(np.log1p(len(text)))


def expand(f: np.ndarray) -> np.ndarray:
    """Logistic inputs: the difference, the two ratios and their bends; length only as damping."""
    d, r, w, n = f.T
    return np.column_stack([d, d * np.abs(d), r, r * r, w, w * n, n])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 4, remainder: int = 2, per_class: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> dict:
    """Fits on at most `per_class` labelled ids a class, outside the held-out fold.

    Half of the sample builds the dictionaries and the other half the calibration, then the
    halves swap, so that no text is scored under a dictionary that holds it.  Without labels of
    both classes every score is 1.
    """
    rows, share = labelled_sample(documents, labels, label, mod, remainder, per_class, max_chars)
    texts = [t.encode("utf-8", "surrogatepass") for _, t, _ in rows]
    own = without_shared_lines(texts)
    y = np.array([v for *_, v in rows])
    if len(set(y.tolist())) < 2:
        return {"good": b" " * 16, "bad": b" " * 16, "curve": None}
    half = np.arange(len(rows)) % 2
    parts = []
    for side in (0, 1):
        pick = lambda v: [t for t, a, h in zip(own, y, half, strict=True) if a == v and h == side]  # noqa: E731, B023
        parts.append(Sizer(build_dictionary(pick(1)), build_dictionary(pick(0))))
    f = np.array([parts[1 - h].features(t) for t, h in zip(texts, half, strict=True)])
    curve = fit_logistic(expand(f), y, share)
    good = build_dictionary([t for t, a in zip(own, y, strict=True) if a == 1])
    bad = build_dictionary([t for t, a in zip(own, y, strict=True) if a == 0])
    return {"good": good, "bad": bad, "curve": curve}


def scores(model: dict, sizer: Sizer, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Scores and size differences; where nothing was learned the score is 1 (nothing is known
    to be bad)."""
    f = np.array([sizer.features((t or "").encode("utf-8", "surrogatepass")) for t in texts]).reshape(-1, 4)
    p = np.ones(len(f)) if model["curve"] is None else predict_logistic(model["curve"], expand(f))
    return np.round(p, 6), np.round(f[:, 0], 6)


def quality_classifier(documents: DataFrame, model: dict) -> DataFrame:
    """One row per input row: doc_id, score, size_difference; a map over the texts, no shuffle.

    Defined results: a null text scores as the empty one, which gets the curve's value at zero
    sizes; repeated rows are scored each; an empty table gives an empty table; other columns
    are not read.  Texts are scored whole, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model["good"], model["bad"])
        for batch in batches:
            for part in byte_slices(batch, "text"):
                p, difference = scores(model, sizer, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(difference)], names=["doc_id", "score", "size_difference"])

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, score double, size_difference double")


def keep_good(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score `threshold` or more.

    Defined results: a null text is judged as the empty one; rows repeated in all columns stay or go
    together; with nothing learned all stay; an empty table gives an empty table; columns of any
    name but `text` are carried along unread.
    """

    def keep():
        sizer = Sizer(model["good"], model["bad"])
        return lambda texts: (scores(model, sizer, texts)[0] >= threshold).tolist()

    return where_text(documents, keep)


def query(spark, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = fit(documents, read_table(spark, sf_dir, "labels"))
    return quality_classifier(documents, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "size_difference"
    )
