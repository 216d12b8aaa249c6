import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geoloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = packing.WordEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aZéÉßœŒñ'sStT.,!?09 \n\t’…“×²ªµ\x1c\x85\xa0ΣσİǅÅ̊", max_size=40)), max_size=6))
def test_ids_equal_the_tokenizer(texts):
    got = [x.tolist() for x in ENCODER.encode(texts)]
    assert got == [WHOLE.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder = packing.WordEncoder(PATH)
    texts = ["one two three", "four five one", "", "two " * 5]
    assert [x.tolist() for x in encoder.encode(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids + [0] for t in texts]


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_plan_holds_every_constraint(by):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 3000)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.plan_bins(counts, 64, 5, 4096, by)
    length = np.concatenate([np.full(n, k) for k, n in counts.items()])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    seq, off = plan.place(length, rank)
    for s in np.unique(seq):
        own = np.flatnonzero(seq == s)
        own = own[np.argsort(off[own])]
        assert off[own].tolist() == np.concatenate([[0], np.cumsum(length[own])[:-1]]).tolist()
        assert length[own].sum() <= 64 and len(own) <= 5 and (length[own] ** 2).sum() <= 4096
    if by == "dot":
        assert len(np.unique(seq)) == plan.sequences


def test_a_piece_that_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan_bins({10: 1}, 64, 5, 50)


def test_pack(spark):
    texts = [None, "", "hello world", "word " * 5000, "hello world", "x"] + ["some words here " * k for k in range(1, 60)]
    docs = spark.createDataFrame([(i if i else None, t, "extra") for i, t in enumerate(texts)] + [(2, "hello world", "again")], "doc_id long, text string, length string").repartition(3)
    rows = packing.pack(docs, PATH, capacity=256, with_ids=True).collect()
    want = sorted((i or -1, t or "") for i, t in enumerate(texts)) + [(2, "hello world")]
    pieces = []
    for i, t in want:
        ids = WHOLE.encode(t, add_special_tokens=False).ids + [0]
        pieces += [(i, p, s, tuple(ids[s : s + 256])) for p, s in enumerate(range(0, len(ids), 256))]
    assert sorted((r.doc_id or -1, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == sorted(pieces)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 256
    assert len(by) <= -(-sum(r.length for r in rows) // 256) + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0
