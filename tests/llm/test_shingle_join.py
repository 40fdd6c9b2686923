import random

import numpy as np
import pytest

from memlake.llm import shingle_join as sj

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component long, key long"


def plain(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(data, num=85, den=100, k=4):
    sets = [(i, plain(t, k)) for i, t in data]
    parent = {i: i for i, _ in data if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else None) for i, s in sets)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    data = []
    while len(data) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 5, 30, 80, 200]))]
        if rng.random() < 0.3:
            base += passage.split()
        for _ in range(rng.choice([1, 1, 2, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            data.append((len(data), rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return data


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, tables, monkeypatch, small):
    if small:
        monkeypatch.setattr(sj, "HOT_KEY", 6)
        monkeypatch.setattr(sj, "CELL_DOCS", 5)
    data = corpus(random.Random(11 + small), 260)
    data += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one"), (906, "x " * 50_000), (907, "X " * 50_000)]
    d = tables(documents=([(i, t, "en", "s", 1, 1, 1) for i, t in data], DOCS))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in sj.op10_shingle_join(spark, d).collect())
    assert got == brute(data)


def test_five_words_at_four_fifths_and_empty(spark, tables):
    data = corpus(random.Random(5), 150)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in sj.join(docs, 5, 80, 100).collect())
    assert got == brute(data, 80, 100, 5)
    assert sj.op10_shingle_join(spark, tables(documents=([], DOCS))).collect() == []


def test_repeated_ids_join_each_for_itself(spark):
    data = corpus(random.Random(21), 120)
    data = [(i % 100, t) for i, t in data] + [(None, data[0][1])]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in sj.join(spark.createDataFrame(data, "doc_id long, text string")).collect())
    rows = [(at if i is not None else None, t) for at, (i, t) in enumerate(data)]  # each row is a node of its own
    of_row = {at: c for at, _, c in brute(rows) if at != -1}
    least = {}
    for at, c in of_row.items():
        least[c] = min(least.get(c, data[at][0]), data[at][0])
    want = [(i if i is not None else -1, len(plain(t)), None if i is None else least[of_row[at]]) for at, (i, t) in enumerate(data)]
    assert got == sorted(want)


def test_tree_keeps_every_qualifying_pair():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)) for _ in range(6)]
        sets = [np.unique(np.where(rng.random(len(b)) < rng.random() * 0.15, rng.integers(0, 2**63, len(b), dtype=np.uint64), b)) for b in (base[i] for i in rng.integers(0, 6, 70))]
        size = np.array([len(s) for s in sets])
        found = set()
        for a, b, cap in sj.SignatureTree(np.stack([sj.bitmap(s) for s in sets]), size, np.arange(len(sets))).pairs():
            for x, y, c in zip(a, b, cap):
                assert c >= sj.overlap(sets[x], sets[y])
                found.add((x, y))
        for x in range(len(sets)):
            for y in range(x + 1, len(sets)):
                o = len(np.intersect1d(sets[x], sets[y]))
                if 100 * o >= 85 * (size[x] + size[y] - o):
                    assert (x, y) in found
