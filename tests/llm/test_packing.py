"""Packing and training order against the tokenizer itself; the Hilbert curve against its definition."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from athanor.llm import tokens
from athanor.llm.packing import hilbert_keys, pack_documents
from athanor.llm.training_order import Order, feistel, read_slots, write_training_order

TEXTS = [None, "", "a", "Grüße, <|endoftext|> and\n\nmore  spaces", "word " * 3000, "y" * 5000, " " * 5000, "日本語のテキスト" * 600] + [f"document number {i} says {i * i}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(tokens.default_path())
    return {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(TEXTS)}


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_point_by_unit_steps(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_pieces_cover_every_id_once(docs, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, length=64).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, own in ids.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum((list(np.frombuffer(bytes(p.ids), "<u4")) for p in pieces), []) == own
        for p in pieces:
            piece = np.array(own[p.start : p.start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(piece) and p.doc_tokens == len(own)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
        used += at == 64
    assert used >= len(by_sequence) - 1  # one range here: only its last sequence can be short


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(count):
    slots = feistel(np.arange(count), count, 7, 6)
    assert sorted(slots.tolist()) == list(range(count))
    if count > 100:
        assert (slots != np.arange(count)).mean() > 0.9
        assert (slots != feistel(np.arange(count), count, 8, 6)).any()


def test_shards_hold_every_sequence_at_its_slot(docs, ids, tmp_path):
    o, folder = Order(length=128, shard_slots=16), f"file://{tmp_path}/shards"
    rows = write_training_order(docs, folder, o=o).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    whole = read_slots(folder, 0, len(rows), o=o)
    assert whole.shape == (len(rows), 128)
    seen = defaultdict(list)
    for r in rows:
        assert r.shard == r.slot // 16 and r.position == r.slot % 16 * 256
        own = whole[r.slot][: r.length].astype("<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and not whole[r.slot][r.length :].any()
        for k, (i, start, at) in enumerate(zip(r.doc_ids, r.doc_starts, r.offsets)):
            end = r.offsets[k + 1] if k + 1 < len(r.offsets) else r.length
            seen[i].append((start, own[at:end].tolist()))
    for i, own in ids.items():
        assert sum((x for _, x in sorted(seen[i])), []) == own
    assert (read_slots(folder, 10, 20, o=o) == whole[10:30]).all()  # across a shard's end
