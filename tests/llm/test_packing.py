import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from memlake.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp long, tier int"


def check(got, data):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d[0]: t.encode(d[1] or "", add_special_tokens=False).ids + [2] for d in data}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    repeats = defaultdict(int)
    for d in data:
        repeats[d[0]] += 1
    for d, own in by_doc.items():
        assert sum(r.length for r in own) == len(ids[d]) * repeats[d]
        if repeats[d] == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    assert set(by_doc) == set(ids)
    pad = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    return pad


def test_round_trip(spark, tables, monkeypatch):
    rng = random.Random(6)
    words = ["été", "idiot", "don't", "x<|endoftext|>y", "naïve word", "ÁB", "...", "42nd", "日本語", "a\x1cb", "it's", "ΣΊΣΥΦΟΣ,", "İstanbul!!", "word.,", "e\u0301té", "ǅem|", "we'll.", "ﬁne,", "straße?!", "1st.", "<|startoftext|>", "q\u00a0r"]
    data = [(i, rng.choice([" ", "\n", "\t ", "\r\n"]).join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 400, 3000]))), "en", "s", 1, 1, 1) for i in range(120)]
    data += [(500, None, "en", "s", 0, 1, 1), (501, "", "en", "s", 0, 1, 1), (502, " \n", "en", "s", 0, 1, 1), (503, "word " * 30_000, "en", "s", 0, 1, 1), (504, "é" * 5000, None, None, 0, 1, 1)]
    data += [data[3], data[3]]
    monkeypatch.setattr(packing, "GROUP_DOCS", 50)
    assert check(packing.op6_packing(spark, tables(documents=(data, DOCS))).collect(), data) == 0


def test_plan_properties():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.randrange(0, rng.choice([2, 40, 5000])) for _ in range(rng.randrange(0, 60))]
        seen = [0] * len(lengths)
        for size, parts in packing.plan(lengths):
            assert sum(n for *_, n in parts) == size and size & (size - 1) == 0
            for i, s, n in parts:
                seen[i] += n
                assert s + n <= lengths[i]
        assert seen == lengths


def test_steps_have_like_tokens():
    sizes = [4096] * 70 + [2048] * 33 + [512] * 57
    total = defaultdict(int)
    for w, s in enumerate(packing.steps(sizes)):
        total[s] += sizes[w]
    assert max(total.values()) - min(total.values()) <= 4096


def test_null_ids_and_empty(spark, tables):
    assert packing.op6_packing(spark, tables(documents=([], DOCS))).collect() == []
    got = packing.op6_packing(spark, tables(documents=([(None, "one two", None, None, None, 1, 1)] * 3, DOCS))).collect()
    assert [r.doc_id for r in got] and sum(r.length for r in got) == 9


def test_encoding_a_slice_takes_little_memory():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts = pa.array([" ".join(rng.choices(words, k=400)) for _ in range(1500)])
    packing.encode(texts)  # words are known and the tokenizer is loaded
    tracemalloc.start()
    try:
        ids, at = packing.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(at) == 1501 and at[-1] == len(ids)
    assert peak < 12 * len(ids), peak / len(ids)
