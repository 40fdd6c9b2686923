import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from memlake.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out int"
LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(rng, n):
    syllables = ["ta", "ro", "mi", "ne", "lu", "ka", "so", "re"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = [word() for _ in range(rng.choice([20, 60, 300]))]
        for _ in range(max(2, len(w) // 30) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zorkfool", "gripscum", "zorkmoron" + rng.choice(syllables)]))
        docs.append((i, " ".join(w), "en", "s", 1, 0.1, 5))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_contract(spark, tables):
    docs, labels = corpus(random.Random(2), 600)
    docs += [(5000, None, None, None, None, None, None), (5001, "", "en", "s", 0, 0.0, 0), (None, "ta ro", None, None, None, None, None), (5002, "mi" * 100_000, "en", "s", 1, 0.0, 0), (5003, "gripscum " * 60_000, "en", "s", 1, 0.0, 0), docs[1]]
    d = tables(documents=(docs, DOCS), labels=(labels + [(9999, 1, 1), (None, 0, 1), (7, None, None)], LABELS))
    got = tx.op2_toxicity(spark, d).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    toxic = {i: t for i, _, t in labels}
    mine = [r for r in got if r.doc_id in toxic and held(r.doc_id)]
    assert all(r.held_out == held(r.doc_id) for r in got if r.doc_id is not None)
    assert sum(r.predicted == toxic[r.doc_id] for r in mine) / len(mine) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == by[5001].predicted == 0 and by[5003].predicted == 1
    assert [r.score for r in got if r.doc_id == 1][0] == [r.score for r in got if r.doc_id == 1][1]


def test_held_out_labels_teach_nothing(spark, tables):
    docs, labels = corpus(random.Random(3), 300)
    flipped = [(i, q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    score = lambda lab: {r.doc_id: r.score for r in tx.op2_toxicity(spark, tables(documents=(docs, DOCS), labels=(lab, LABELS))).collect()}
    assert score(labels) == score(flipped)


def test_no_labels_one_class_and_no_documents(spark, tables):
    docs, labels = corpus(random.Random(4), 30)
    for lab in ([], [x for x in labels if x[2] == 0]):
        got = tx.op2_toxicity(spark, tables(documents=(docs, DOCS), labels=(lab, LABELS))).collect()
        assert len(got) == 30 and {r.predicted for r in got} == {0}
    assert tx.op2_toxicity(spark, tables(documents=([], DOCS), labels=(labels, LABELS))).collect() == []


def test_unseen_expressions_count_for_neither_class():
    words = ["tar", "tarn", "scum", "lore"]
    kn = tx.KneserNey().fit(words, np.array([5.0, 2, 4, 0]), np.array([40.0, 16, 0, 8]))
    fresh, bad, good = kn.ratios(["qqqq", "scum", "lore"])
    assert bad > 1 > good and abs(fresh) < 1 and tx.KneserNey().fit([], np.zeros(0), np.zeros(0)).ratios(["x"])[0] == 0


def plain_gain(words, toxic, ordinary, word, order=tx.ORDER, d=tx.DISCOUNT):
    """The gain of one word by dictionaries of letters, straight from the definition."""
    least = min(sum(toxic), sum(ordinary))
    spelled = ["\x01" + w + "\x02" for w in words]
    classes = [Counter(), Counter()]
    for w, a, b in zip(spelled, toxic, ordinary):
        for j in range(1, len(w)):
            classes[0][w[: j + 1]] += a * least / sum(toxic)
            classes[1][w[: j + 1]] += b * least / sum(ordinary)
    grams = [set() for _ in range(order + 2)]  # the last k marks up to each place; fewer at the start
    for w in spelled:
        for j in range(1, len(w)):  # the start mark is given
            for k in range(1, order + 2):
                grams[k].add((w[max(0, j + 1 - k) : j + 1], max(0, k - j - 1)))
    letters = {c for w in spelled for c in w} | {"\x00"}

    def shared(w, j):
        p = 1 / max(len(letters), 2)
        for k in range(1, order + 1):
            left = Counter(g[max(0, len(g) - k) :] for g, _ in grams[k + 1])
            gram, ctx = w[max(0, j + 1 - k) : j + 1], w[max(0, j + 1 - k) : j]
            peers = [n for g, n in left.items() if (g[:-1] == ctx if k > 1 else True)]
            p = (max(left[gram] - d, 0) + d * len(peers) * p) / sum(peers)
        return p

    out, w = 0.0, "\x01" + word + "\x02"
    for j in range(1, len(w)):
        ctx, key = w[:j], w[: j + 1]
        if not any(c[g] for c in classes for g in c if g[:-1] == ctx):
            continue
        p, left = [], []
        known = any(key in c for c in classes)
        for c in classes:
            own = {g: n for g, n in c.items() if g[:-1] == ctx and n > 0}
            total = sum(own.values())
            left.append(sum(min(n, d) for n in own.values()) / total if total else 1.0)
            p.append((max(own.get(key, 0) - d, 0) / total if total else 0) + left[-1] * (shared(w, j) if known else 1.0))
        out += math.log(p[0] / p[1])
    return math.log(1 - tx.MIX + tx.MIX * math.exp(out))


def test_gains_against_the_definition():
    words = ["tar", "tarn", "scum", "lore", "scar", "a"]
    toxic, ordinary = [5.0, 2, 9, 0, 1, 3], [40.0, 16, 0, 8, 2, 30]
    kn = tx.KneserNey().fit(words, np.array(toxic), np.array(ordinary))
    for w in [*words, "scumlord", "tart", "zz", "lo"]:
        assert abs(kn.gains([w])[0] - plain_gain(words, toxic, ordinary, w)) < 1e-5, w


def test_words_of_any_length_are_spelled_whole(monkeypatch):
    words = ["x" * n for n in (1, 3, 40, 3000)] + ["ab"]
    want = tx.KneserNey().fit(words, np.arange(5) + 1.0, np.arange(5) + 2.0)
    monkeypatch.setattr(tx, "MARKS", 50)
    got = tx.KneserNey().fit(words, np.arange(5) + 1.0, np.arange(5) + 2.0)
    assert np.allclose(want.ratios(words), got.ratios(words)) and tx.words_of("x" * 3000) == ["x" * 3000]


def test_training_on_words_takes_little_memory():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 12))) for _ in range(30_000)})
    tracemalloc.start()
    try:
        places = len(tx.KneserNey().spelling(words)["keys"])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 340 * places, peak / places
