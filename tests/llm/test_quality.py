import numpy as np
import pyarrow as pa

from memlake.llm import quality as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_passages int"
LABELS = "doc_id long, quality int, toxic int"


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("aeioutnrsl"), 2 + rng.integers(6))) for _ in range(n)).capitalize() + "."


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        good = "\n".join(sentence(rng, 12) for _ in range(int(rng.integers(1, 30))))
        kind = i % 8
        bad = {0: good.upper(), 1: " ".join(w + "$$" for w in good.split()), 2: " ".join(w for w in good.split() for _ in range(6))}.get(kind)
        rows.append((i, good if bad is None else sentence(rng, 80) + "\n" + bad, int(bad is None)))  # junk comes after a good passage
    return rows


def test_held_out_documents(spark, tables):
    rows = made(800)
    extra = [(5000, "", 1), (5001, None, 0), (5002, "x" * 200_000, 1), (5003, " \n\t", 1), (6, rows[6][1], 1), (6, "other text", 1), (None, "some text", 1)]
    docs = [(i, t, "en", None, 1, "kept", 9) for i, t, _ in rows + extra]
    labels = [(i, y, 0) for i, _, y in rows] + [(7, None, 0), (None, 1, 0), (9, 3, 0), (10, 0, 0), (10, 1, 0), (99999, 1, 0)]
    got = q.op13_quality(spark, tables(documents=(docs, DOCS), labels=(labels, LABELS))).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 800}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in by.items())
    unseen = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out and i != 6]
    assert len(unseen) > 100 and np.mean([a == b for a, b in unseen]) > 0.97


def test_score_reads_the_text_only_and_finds_the_passage(spark):
    rows = made(400)
    docs = spark.createDataFrame([(i, t, i % 2) for i, t, _ in rows], "doc_id long, text string, source int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = q.fit(docs, labels)
    one = {r.doc_id: r for r in q.score(docs, model).collect()}
    two = {r.doc_id - 10_000: r.score for r in q.score(docs.selectExpr("doc_id + 10000 as doc_id", "text", "99 as source", "'x' as score"), model).collect()}
    assert all(abs(r.score - two[i]) < 1e-12 for i, r in one.items())
    for i, text, y in rows:
        span = text.encode()[one[i].focus_start : one[i].focus_start + one[i].focus_bytes].decode()
        assert one[i].n_passages == max(1, -(-len(text.split()) // q.PASSAGE_WORDS)) and 0 < len(span.split()) <= q.PASSAGE_WORDS
    junk = [r for i, r in one.items() if i % 8 == 1 and r.n_passages > 4]
    assert np.mean([r.focus_start > 0 for r in junk]) > 0.8  # what weighs most is not the good beginning


def test_no_labels_one_class_and_no_rows(spark, tables):
    docs = [(i, "some words here", "en", "s", 1, "x", 1) for i in range(20)]
    one = q.op13_quality(spark, tables(documents=(docs, DOCS), labels=([(i, 1, 0) for i in range(20)], LABELS))).collect()
    assert len({r.score for r in one}) == 1 and one[0].predicted == 1
    none = q.op13_quality(spark, tables(documents=(docs, DOCS), labels=([], LABELS))).collect()
    assert {r.score for r in none} == {0.5}
    assert q.op13_quality(spark, tables(documents=([], DOCS), labels=([], LABELS))).collect() == []


def test_passages_against_plain_counts():
    texts = ["Ab ab ab!! x\ny " * 40, None, "", "é ñ\tZ 7", "one two three four one two three four"]
    got, bags, low, size = q.encode(pa.array(texts))
    assert got.shape[1] == q.FEATURES and not got[bags[1]].any() and not got[bags[2]].any()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        own = range(bags[i], bags[i + 1])
        assert b"".join(data[low[p] : low[p] + size[p]] for p in own) == data
        for p in own:
            part = data[low[p] : low[p] + size[p]]
            for name, kind in (("lower", 0), ("upper", 1), ("digit", 2), ("line end", 3), ("blank", 4), ("other", 5)):
                test = {"lower": lambda c: 97 <= c <= 122, "upper": lambda c: 65 <= c <= 90, "digit": lambda c: 48 <= c <= 57, "line end": lambda c: c == 10, "blank": lambda c: c in b" \t\r\x0b\x0c", "other": lambda c: c > 127}[name]
                assert abs(got[p, kind] ** 2 - sum(map(test, part)) / max(len(part), 1)) < 1e-6, name
    words = q._KINDS + q._COARSES**2
    assert abs(got[bags[4], words + 2] - 1 / 8) < 1e-6 and abs(got[bags[4], words + 3] - 4 / 8) < 1e-6  # one run of four, four words said before
    ab = [w for w in texts[0].split()][: q.PASSAGE_WORDS]
    assert abs(got[bags[0], words] - sum(a == b for a, b in zip(ab[1:], ab, strict=False)) / len(ab)) < 1e-6
    alone = [q.encode(pa.array([t]))[0] for t in texts]
    assert np.array_equal(np.concatenate(alone), got)  # a text's features don't depend on its neighbours


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    bags, d = np.array([0, 3, 4, 9]), 6
    x, y, weight = rng.normal(size=(9, d)), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    w = {"dense": rng.normal(size=(d, 5)), "dense_bias": rng.normal(size=5), "tanh": rng.normal(size=(5, 4)), "gate": rng.normal(size=(5, 4)), "attend": rng.normal(size=4), "out": rng.normal(size=5), "out_bias": np.array([0.3])}
    _, got = q.gradient(w, x, bags, y, weight)
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            up, down = {**w, k: v.copy()}, {**w, k: v.copy()}
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((q.gradient(up, x, bags, y, weight)[0] - q.gradient(down, x, bags, y, weight)[0]) / 2e-6 - got[k][at]) < 1e-6
    shares = q.forward(w, x, bags)["a"]
    assert np.allclose(np.add.reduceat(shares, bags[:-1]), 1)
