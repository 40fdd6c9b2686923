"""Text queries without SQL twins, row by row against plain Python over the same tables."""

import math
import re
from collections import Counter
from datetime import date

import numpy as np
import pandas as pd
import pytest

from memlake.functions import chunks, dates, extract, questions, screening, words
from memlake.operators import recall
from memlake.plans import catalog
from memlake.plans import texts  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def got(spark, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()]


def test_terms_and_anchors(spark, docs):
    for name, f in (("document_terms", words.terms), ("document_anchors", words.anchors)):
        assert dict(got(spark, name)) == Counter(x for t in docs.text for x in f(t))


def test_coverage(spark, docs):
    want = {(q, i): round(words.coverage(asked, t), 6) for q, asked in catalog.QUESTIONS for i, t in zip(docs.doc_id, docs.text)}
    assert {(q, i): c for q, i, c in got(spark, "query_coverage")} == {k: c for k, c in want.items() if c > 0.3}


def plain_embedding(text, dim=256):
    """The method as documented, feature by feature."""
    from hashlib import blake2b

    said = words.segment(re.sub(r"(\w)['’]s\b", r"\1", text.lower()))
    topic = [w for w in said if w not in words.STOP] or said
    features = Counter(f"w:{w}" for w in topic) + Counter(f"b:{a} {b}" for a, b in zip(topic, topic[1:])) + Counter(f"c:{f'<{w}>'[i : i + 3]}" for w in topic for i in range(len(w)))
    v = np.zeros(dim)
    for f, n in features.items():
        h = int.from_bytes(blake2b(f.encode(), digest_size=8).digest(), "little")
        v[h % dim] += (-1 if h >> 63 else 1) * (0.5 if f[0] == "c" else 1) * (1 + math.log(n))
    return v / np.linalg.norm(v) if v.any() else v


def test_embeddings(spark, docs):
    rows = dict(got(spark, "document_embeddings"))
    for i, t in zip(docs.doc_id, docs.text):
        assert np.allclose(rows[i], plain_embedding(t))
    odd = ["", "the of", "日本語 and 😀", "O'Hara's  x_y", "a"]
    assert np.allclose(words.embed_all(odd), [plain_embedding(t) for t in odd])


def test_chunks_pages_and_dates(spark, docs):
    assert sorted(got(spark, "document_chunks")) == sorted((i, *c) for i, t, s in zip(docs.doc_id, docs.text, docs.source) for c in chunks.chunk(t, s))
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    assert sorted(got(spark, "page_texts")) == sorted((i, chunks.html_text(h)) for i, h in zip(pages.page_id, pages.html))
    want = [(i, *(d[:3] if d else (None,) * 3)) for i, t in zip(docs.doc_id, docs.text) for d in dates.find_dates(t, date(2026, 10, 15)) or [None]]
    assert Counter(got(spark, "document_dates")) == Counter(want)


def test_policy_and_facts(spark, docs):
    want = []
    for i, t in zip(docs.doc_id, docs.text):
        clean, kinds = screening.redact(t, pii=True)
        reasons = screening.screen(clean)
        want.append((i, kinds, reasons, not reasons))
    assert sorted(got(spark, "write_policy")) == sorted(want)
    want = [(i, *f) for i, t in zip(docs.doc_id, docs.text) for f in extract.facts(t) or [(None, None, None)]]
    assert Counter(got(spark, "stated_facts")) == Counter(want)


def test_question_classes(spark):
    turns = pd.read_parquet(f"{SF}/conversations.parquet")
    turns = turns[turns.role == "user"]
    want = set()
    for c, t, q in zip(turns.conv_id, turns.turn, turns.text):
        k = questions.classify(q)
        want.add((c, t, k["policy"], k["complexity"], k["depth"], questions.time_asked(q)))
    assert set(got(spark, "question_classes")) == want


def plain_hybrid(asked, docs, priors, depth=50, k=10):
    """BM25, hash embeddings, ranks, relevance and priors for one question over all documents."""
    tokens = {i: re.findall(r"\w+", t.lower()) for i, t in docs.items()}
    terms = set(re.findall(r"\w+", asked.lower()))
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {t: sum(t in set(w) for w in tokens.values()) for t in terms}
    score, cover = {}, {}
    for i, w in tokens.items():
        tf = {t: w.count(t) for t in terms if t in w}
        if tf:
            score[i] = sum(max(1e-6, math.log((n - df[t] + 0.5) / (df[t] + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in tf.items())
            cover[i] = len(tf) / len(terms)
    q = plain_embedding(asked)
    cosine = {i: float(plain_embedding(t) @ q) for i, t in docs.items()}
    rrf = Counter()
    for channel in (score, cosine):
        for r, i in enumerate(sorted(channel, key=lambda i: (-round(channel[i], 9), i))[:depth], 1):
            rrf[i] += 1 / (60 + r)
    rows = []
    for i, s in rrf.items():
        relevance = min(1.0, max(0.0, cosine[i], cover.get(i, 0.0)))
        seed = 0.5 * min(1, s / (2 / 61)) + 0.5 * relevance
        rows.append((-round(seed * (0.75 + 0.25 * (0.55 * priors[i][0] + 0.2 * priors[i][1] + 0.125)), 6), i, relevance))
    top = sorted(rows)[:k]
    return [(r, i, rel, max(x[2] for x in top[r - 1 :])) for r, (_, i, rel) in enumerate(top, 1)]


def test_hybrid_recall(spark, docs):
    from memlake.sources import tables as src

    priors = {r.id: (r.importance, r.confidence) for r in src.fragments(spark, SF).select("id", "importance", "confidence").collect()}
    rows = got(spark, "recall_hybrid")
    for q, asked in catalog.QUESTIONS:
        want = plain_hybrid(asked, dict(zip(docs.doc_id, docs.text)), priors)
        own = sorted((rank, i, rel, shown) for query, rank, i, rel, shown in rows if query == q)
        assert [x[:2] for x in own] == [x[:2] for x in want]
        assert np.allclose([x[2:] for x in own], [x[2:] for x in want], atol=1e-5)


def test_a_document_without_a_word_of_the_question_is_found_by_its_letters(spark):
    rows = spark.createDataFrame([(1, "gardening gloves and gardeners"), (2, "harbour cranes at dawn"), (3, None), (4, "")], "id long, content string")
    asked = spark.createDataFrame([(7, "garden glove")], "query_id long, query string")
    lexical, vector = recall.bm25(rows, asked), recall.text_cosines(rows, asked)
    assert lexical.count() == 0 and {r.id for r in vector.collect()} == {1, 2, 4}
    best = recall.hybrid(lexical, vector).orderBy("rrf", ascending=False).first()
    assert best.id == 1 and 0 < best.relevance < 1


def test_greedy_seeds(spark):
    v = pd.read_parquet(f"{SF}/embeddings.parquet")
    m = np.stack(v.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    seeds, want = [], {}
    for i in np.argsort(v.vec_id.to_numpy()):
        near = next((s for s in seeds if v.label[s] == v.label[i] and m[s] @ m[i] >= 0.95), None)
        want[v.vec_id[i]] = v.vec_id[i if near is None else near]
        if near is None:
            seeds.append(i)
    assert dict(got(spark, "dedup_greedy")) == want
