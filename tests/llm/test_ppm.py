import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from memlake.llm import ppm

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part long, held_out boolean"
K = ppm.ORDER


def is_held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def trie(streams):
    counts = defaultdict(Counter)
    for s in streams:
        s = b"\n" * K + s
        for i in range(K, len(s)):
            for j in range(K + 1):
                counts[s[i - j : i]][s[i]] += 1
    return counts


def plain_log10(counts, ctx, sym):
    lp, out = 0.0, set()
    for j in range(K, -1, -1):
        own = counts.get(ctx[K - j :])
        if not own:
            continue
        left = {s: n for s, n in own.items() if s not in out}
        if left:
            total = sum(left.values())
            if sym in left:
                return lp + math.log10((left[sym] - 0.5) / total)
            lp += math.log10(len(left) / 2 / total)
        out |= set(own)
    return lp - math.log10(max(256 - len(counts.get(b"", ())), 1))


def brute(data):
    words = lambda t: (t or "").encode().lower().split()
    stream = lambda t: b"".join(w + b" " for w in words(t)) + b"\n"
    learn = [t for i, t in data if not is_held(i)]
    c = Counter(w for t in learn for w in [*words(t), b"\n"])
    n, v, counts = sum(c.values()), len(c), trie(stream(t) for t in learn)
    out = []
    for i, t in data:
        tokens = [*words(t), b"\n"]
        s = b"\n" * K + stream(t)
        lp = sum(plain_log10(counts, s[k - K : k], s[k]) for k in range(K, len(s)))
        out.append((i, is_held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), lp))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[5], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-5 * max(1, abs(w[6]))


def test_against_a_plain_trie(spark, tables, monkeypatch):
    rng = random.Random(9)
    vocab = ["abra", "cadabra", "été", "The", "the", "日本", "x", "\x00y", "end.", "ABRA"]
    data = [(i, rng.choice([" ", "\n\t"]).join(rng.choice(vocab) for _ in range(rng.randrange(25)))) for i in range(90)]
    data += [(None, None), (None, "abra"), (200, ""), (201, " \n "), (202, "zebra quux " * 40), (3, "abra"), (3, "abra"), (205, "w" * 3000)]
    d = tables(documents=([(i, t, "en", "s", 1, 1, True) for i, t in data], DOCS))
    want = brute(data)
    same(ppm.op8_ppm(spark, d).collect(), want)
    for name, value in (("PART_BYTES", 300), ("SHARD_BYTES", 500), ("FAN", 8)):
        monkeypatch.setattr(ppm, name, value)
    assert ppm.levels(40, 30) == (2, 7, 6)
    same(ppm.op8_ppm(spark, d).collect(), want)


def test_no_training_documents_and_no_documents(spark, tables):
    held = next(i for i in range(99) if is_held(i))
    got = ppm.op8_ppm(spark, tables(documents=([(held, "ab", "en", "s", 1, 1, True)], DOCS))).collect()
    assert abs(got[0].score + 4 * math.log10(256)) < 1e-5 and got[0].train_tokens == 0 and got[0].n_known == 0
    assert ppm.op8_ppm(spark, tables(documents=([], DOCS))).collect() == []


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(2)
    s = rng.choice(np.frombuffer(b"abcde \n", np.uint8), 4000)
    g = sum(s[ORD : len(s) - K + ORD].astype(np.uint64) << np.uint64(8 * (K - ORD)) for ORD in range(K + 1))
    grams, n = np.unique(g, return_counts=True)
    shard = (grams >> np.uint64(8)) & np.uint64(0xFFFFFF)
    low, of = np.unique(grams & np.uint64(0xFFFFFF), return_inverse=True)
    short = ppm.Short(low, np.bincount(of, n))
    for ctx in (grams[0] >> np.uint64(8), grams[len(grams) // 2] >> np.uint64(8), np.uint64(0x7A7A7A6162)):
        own = shard == (ctx & np.uint64(0xFFFFFF))
        q = (np.uint64(ctx) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        p = 10 ** ppm.code_lengths(grams[own], n[own], short, q)
        assert abs(p.sum() - 1) < 1e-9


def test_rows_on_the_way_grow_with_the_input(monkeypatch):
    """Rows that a part writes, and nodes of each level, for ever more parts."""
    monkeypatch.setattr(ppm, "FAN", 16)
    for parts in (17, 85, 350, 5000, 100_000):
        depth, joined, branches = ppm.levels(parts, parts * 3 // 2)
        assert joined <= 16 and branches <= 16 and joined**depth >= parts and branches**depth >= parts * 3 // 2
        for level in range(1, depth + 1):  # nodes of a level times the rows that each splits into
            assert joined ** (depth - level) * branches**level <= 40 * parts, (parts, level)


def test_shards_of_a_level_are_within_those_before():
    keys = np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64)
    for kind in "gw":
        assert (ppm.shard_of(kind, keys << np.uint64(16 * (kind == "w")), 60) // 12 == ppm.shard_of(kind, keys << np.uint64(16 * (kind == "w")), 5)).all()


def test_the_shared_trie_is_made_once_a_worker(monkeypatch):
    made = []
    monkeypatch.setattr(ppm, "Short", lambda *a: made.append(a) or object())
    monkeypatch.setattr(ppm, "_kept", [None, None])
    one, two = (type("Shared", (), {"value": (np.zeros(1), np.zeros(1))})() for _ in range(2))
    assert len({id(ppm._short(one)) for _ in range(50)}) == 1 and len(made) == 1
    assert ppm._short(two) is not None and len(made) == 2 and made[1] is not None
