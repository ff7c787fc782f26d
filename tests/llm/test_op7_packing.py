import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures_path import fx
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ferrule.llm import op7_packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, texts, limit=2048):
    """Every id in exactly one piece, right checksums, gapless sequences, no padding."""
    whole = {k: ids_of(t) for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(whole[r.doc_id])
    for k, ids in whole.items():
        at = 0
        for start, n in sorted(pieces[k]):
            assert start == at and n > 0
            at += n
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= limit and at & (at - 1) == 0


def test_round_trip_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op.query(spark, sf).collect(), texts)


def test_odd_rows(spark):
    rows = [(i, r[1], "en", "a") for i, r in enumerate(fx.odd_rows())]
    check(op.pack_documents(fx.documents(spark, rows), PATH).collect(), {i: t for i, t, *_ in rows})
    check(op.pack_documents(fx.documents(spark, rows), PATH, limit=64).collect(), {i: t for i, t, *_ in rows}, 64)


def test_empty_table(spark):
    assert op.pack_documents(fx.empty(spark), PATH).collect() == []


def test_ids_come_along(spark):
    row = op.pack_documents(fx.documents(spark, [(1, "a b c", "en", "a")]), PATH, with_ids=True).first()
    assert row.ids == ids_of("a b c").astype(int).tolist()[: len(row.ids)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_both_libraries_give_the_same_ids(text):
    assert op.encode(text, PATH).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [(100, 5, 60), (64, 3, 64)])
def test_all_limits_hold_without_cutting(limits):
    rng = np.random.default_rng(1)
    items = [(i, 0, n := int(rng.integers(1, 50)), int(rng.integers(0, n + 1))) for i in range(400)]
    packer = op.Packer(limits, pool=50, cut=False)
    placed = [*packer.add(items), *packer.finish()]
    assert sorted(p[0][0] for p in placed) == list(range(400))
    load = defaultdict(lambda: np.zeros(3))
    for item, _, n, sequence, _ in placed:
        load[sequence] += (n, 1, item[3])
    assert all((v <= limits).all() for v in load.values())
    lower = max(sum(i[2] for i in items) / limits[0], 400 / limits[1], sum(i[3] for i in items) / limits[2])
    assert len(load) <= 1.25 * lower + 2


def test_an_example_over_the_limits_is_refused():
    with pytest.raises(ValueError):
        list(op.Packer((10, 2, 10), cut=False).add([(1, 0, 11, 0)]))


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "p") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, example_id long, prompt string")


def check_examples(spark, conversations, limits):
    """Every id in one piece, loss counts right, all three limits held; returns the sequences' loads."""
    table = op.instruction_examples(conversations)
    rows = op.pack_examples(table, PATH, limits, with_ids=True).collect()
    want = defaultdict(list)
    for r in table.collect():
        asked, said = PLAIN.encode(r.prompt or "", add_special_tokens=False).ids, PLAIN.encode(r.reply or "", add_special_tokens=False).ids
        want[r.example_id].append([(i, False) for i in asked] + [(i, True) for i in said] + [(1, True)])
    pieces, loads = defaultdict(list), defaultdict(lambda: np.zeros(3))
    for r in rows:
        pieces[r.example_id].append(r)
        loads[r.sequence_id] += (r.length, 1, r.loss_tokens)
        assert any([i for i, _ in w[r.start : r.start + r.length]] == r.ids and sum(b for _, b in w[r.start : r.start + r.length]) == r.loss_tokens for w in want[r.example_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert all(sum(len(w) for w in want[k]) == sum(p.length for p in pieces[k]) for k in want)
    assert pieces.keys() == want.keys() and all((v <= limits).all() for v in loads.values())
    return loads


def test_all_three_limits_act_on_conversations(spark, sf):
    loads = check_examples(spark, spark.read.parquet(f"{sf}/conversations.parquet"), (480, 2, 300))
    full = np.array(list(loads.values()))
    assert (full[:, 0] > 440).any() and (full[:, 1] == 2).any() and (full[:, 2] > 280).any()
    assert op.instruction_query(spark, sf).where("loss_tokens > 1024 OR length > 2048").count() == 0


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "fine " * 400), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, 1, "assistant", "x"), (3, None, "assistant", ""), (4, 0, "user", "a b " * 900), (4, 0, "user", "twice"), (4, 1, "assistant", "yes"), (5, 7, None, "no role"), (5, 8, "assistant", "日本 <|endoftext|>")]
    check_examples(spark, turns(spark, rows), (64, 5, 40))
    assert op.pack_examples(op.instruction_examples(turns(spark, [])), PATH).collect() == []
