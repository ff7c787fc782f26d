"""Packing documents into training sequences: vector bin packing by the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens) and a sequence has a limit in
each.  The open sequence takes, from a bounded pool, the example whose vector has the largest
dot product with what the sequence has left, among those that fit in every coordinate.  Where
examples may be cut, the gap that no whole example fits is filled by a cut piece.

Each task packs the rows it reads, streaming: texts are encoded, cut and placed in one pass, so
nothing is shuffled, and a task holds its pool and one run of texts.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, read_table

LIMIT, SEGMENTS, POOL = 2048, 1024, 512
#: Limits of an instruction sequence: tokens, examples, loss-bearing tokens.
INSTRUCTION_LIMITS = (2048, 16, 1024)
END_ID = 1
#: Texts of these characters alone are split alike by both tokenizer libraries.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-ɏͰ-ͳΑ-ΡΣ-ϿЀ-ҁҊ-ԣ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]*")
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def _slow(path: str):
    """The tokenizer file itself, read once it is needed: it takes some memory."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _fast(path: str):
    """Where the folder has the vocabulary's ranks, the faster library over them; else None."""
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a whole text, without special ones added.  The rank file gives the same ids as
    the tokenizer file for the characters in `_PLAIN`; any other text goes to the latter."""
    fast = _fast(path)
    if fast is not None and SPECIAL not in text and _PLAIN.fullmatch(text):
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.array(_slow(path).encode(text, add_special_tokens=False).ids, "<u4")


class Packer:
    """Places examples into sequences; see the module text.

    `limits` bounds (tokens, segments, loss tokens).  With `cut`, an example may be split
    anywhere, every sequence is filled to the token limit while others wait, and what remains
    at the end is cut at powers of two, where no padding is needed.
    """

    def __init__(self, limits=(LIMIT, SEGMENTS, LIMIT), pool: int = POOL, cut: bool = True, first_id: int = 0):
        self.limits = np.array(limits, float)
        self.size, self.cut, self.next_id = pool, cut, first_id
        self.items: list = []
        self.vectors = np.zeros((0, 3))

    def add(self, items: list[tuple]) -> Iterator[tuple]:
        """items: (key, start, tokens, loss tokens, ...).  Yields placed pieces as
        (item, start, length, sequence id, offset)."""
        fresh = []
        for item in items:
            key, start, n, loss, *rest = item
            if self.cut:
                full = int(self.limits[0])
                while n >= full and loss <= n and full <= self.limits[2]:
                    yield item, start, full, self._new_id(), 0
                    start, n, loss = start + full, n - full, max(loss - full, 0)
                if n == 0:
                    continue
            elif n > self.limits[0] or loss > self.limits[2]:
                raise ValueError(f"an example of {n} tokens ({loss} of loss) is over the limits {tuple(self.limits)}")
            fresh.append((key, start, n, loss, *rest))
        self._pool(fresh)
        while len(self.items) >= self.size:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.items:
            yield from self._fill(last=True)

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _pool(self, items: list) -> None:
        if items:
            self.items += items
            self.vectors = np.vstack([self.vectors, np.array([(i[2], 1, i[3]) for i in items], float) / self.limits])

    def _take(self, k: int):
        item = self.items.pop(k)
        self.vectors = np.delete(self.vectors, k, axis=0)
        return item

    def _fill(self, last: bool = False) -> Iterator[tuple]:
        """One sequence."""
        target = int(self.limits[0])
        if last and self.cut and (waiting := sum(i[2] for i in self.items)) < target:
            target = 1 << (waiting.bit_length() - 1)
        sequence, offset = self._new_id(), 0
        left = np.array([target / self.limits[0], 1.0, 1.0])
        while self.items and offset < target:
            fits = (self.vectors <= left + 1e-12).all(axis=1)
            if fits.any():
                gain = np.where(fits, self.vectors @ left, -1.0)
                item = self._take(int(gain.argmax()))
                n = item[2]
            elif self.cut and left[1] * self.limits[1] > 0.5 and left[2] * self.limits[2] > 0.5:
                item = self._take(int(self.vectors[:, 0].argmax()))
                n = min(target - offset, item[2], int(left[2] * self.limits[2] + 1e-6) if item[3] else target)
                rest = item[2] - n
                loss = min(item[3], rest)
                if rest:
                    self._pool([(item[0], item[1] + n, rest, loss, *item[4:])])
                item = (item[0], item[1], n, item[3] - loss, *item[4:])
            else:
                break
            yield item, item[1], n, sequence, offset
            offset += n
            left = left - np.array([n, 1, item[3]]) / self.limits


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _emit(pieces: list, schema: str) -> pa.RecordBatch:
    """Placed pieces of items (key, start, tokens, loss tokens, ids) as rows of `PIECES`, and of the
    further columns of the schema: loss_tokens, ids."""
    names = [c.split()[0] for c in schema.split(", ")]
    longs = [
        [p[0][0] for p in pieces],
        [p[1] for p in pieces],
        [p[2] for p in pieces],
        [zlib.crc32(p[0][4][p[1] : p[1] + p[2]].tobytes()) for p in pieces],
        [len(p[0][4]) for p in pieces],
        [p[3] for p in pieces],
        [p[4] for p in pieces],
    ]
    if "loss_tokens" in names:
        longs.append([p[0][3] for p in pieces])
    columns = [pa.array([v if v is None else int(v) for v in column], pa.int64()) for column in longs]
    if "ids" in names:
        columns.append(pa.array([p[0][4][p[1] : p[1] + p[2]].astype(np.int32) for p in pieces], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names=names)


def pack_documents(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT, segments: int = SEGMENTS, with_ids: bool = False) -> DataFrame:
    """One row per piece of each input row: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with `with_ids` the ids themselves.

    Defined results: a null text packs as the empty one, which is the end id alone; repeated
    rows are packed each; ties in the dot product go to the example that came first; an empty
    table gives an empty table; other columns are not read.  A very long text is encoded whole
    and cut.  A sequence id holds the task's number, so ids of different tasks never meet, and
    a task that runs again on the same rows gives the same pieces.
    """
    schema = PIECES + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((limit, segments, limit), first_id=TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                items = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.append(encode(text.as_py() or "", tokenizer_path), np.uint32(END_ID)).astype("<u4", copy=False)
                    items.append((key, 0, len(ids), len(ids), ids))
                if pieces := list(packer.add(items)):
                    yield _emit(pieces, schema)
        if pieces := list(packer.finish()):
            yield _emit(pieces, schema)

    return map_arrow(documents.select("doc_id", "text"), run, schema)


def instruction_examples(conversations: DataFrame) -> DataFrame:
    """example_id, prompt, reply: every assistant turn with the turn before it (none: null).

    Turns meet by (conv_id, turn), so a long conversation is no group.  Defined results: rows with
    a null conv_id or turn have no turn before them; of several rows before a turn the one with the
    smallest text counts; repeated assistant rows are examples each, with the same id."""
    known = conversations.select("conv_id", "turn", "role", "text")
    before = known.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    replies = known.where("role = 'assistant'").withColumnRenamed("text", "reply").join(before, ["conv_id", "turn"], "left")
    return replies.select(F.xxhash64("conv_id", "turn").alias("example_id"), "prompt", "reply")


def pack_examples(examples: DataFrame, tokenizer_path: str, limits: tuple[int, int, int] = INSTRUCTION_LIMITS, with_ids: bool = False) -> DataFrame:
    """One row per piece of each example (example_id, prompt, reply): as `pack_documents`, example_id
    in doc_id's place and with loss_tokens, the loss-bearing ones of the piece.

    A prompt's ids bear no loss, those of the reply and the end id do; a sequence holds at most
    `limits` tokens, examples and loss-bearing tokens.  An example that fits is never cut; a larger
    one is cut into examples that fit, prompt first.  Defined results: null texts are empty ones;
    repeated rows are packed each; an empty table gives an empty table; other columns are not read.
    """
    schema = PIECES.replace("doc_id", "example_id") + ", loss_tokens long" + ", ids array<int>" * with_ids
    most, _, most_loss = limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut=False, first_id=TaskContext.get().partitionId() << 40)
        for batch in batches:
            for half in byte_slices(batch, "reply"):
                for part in byte_slices(half, "prompt"):
                    items = []
                    for key, prompt, reply in zip(*(part.column(i) for i in range(3)), strict=True):
                        asked, said = encode(prompt.as_py() or "", tokenizer_path), encode(reply.as_py() or "", tokenizer_path)
                        ids = np.concatenate([asked, said, [END_ID]]).astype("<u4")
                        at = 0
                        while at < len(ids):
                            n = min(most, len(ids) - at, max(0, len(asked) - at) + most_loss)
                            items.append((key.as_py(), at, n, max(0, at + n - max(at, len(asked))), ids))
                            at += n
                    if pieces := list(packer.add(items)):
                        yield _emit(pieces, schema)
        if pieces := list(packer.finish()):
            yield _emit(pieces, schema)

    return map_arrow(examples.select("example_id", "prompt", "reply"), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def instruction_query(spark, sf_dir: str) -> DataFrame:
    """All assistant turns of `conversations`, packed under the three limits."""
    import public_tokenizers

    return pack_examples(instruction_examples(read_table(spark, sf_dir, "conversations")), public_tokenizers.path("byte_bpe_50k.json"))
