import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlake.functions.words import CJK, stem
from memlake.operators import lexical


def said(text, stems=True):
    out = []
    for part in re.findall(rf"[{CJK}]+|[^\W{CJK}]+", (text or "").lower()):
        out += ([part[i : i + 2] for i in range(len(part) - 1)] or [part]) if re.match(f"[{CJK}]", part) else [stem(part) if stems else part]
    return out


def plain(docs, queries, k):
    """{query: [(id, score, coverage)]} by scoring every document."""
    held = {i: Counter(said(t) + [w for tag in tags or [] for w in said(tag)]) for i, t, tags in docs}
    n, avg = len(held), sum(sum(c.values()) for c in held.values()) / max(len(held), 1)
    df, out = Counter(w for c in held.values() for w in c), {}
    for q, text in queries:
        asked, rows = set(said(text)), []
        for i, c in held.items():
            met = asked & c.keys()
            score = sum(max(lexical.CONFIG.least_idf, math.log((n - df[w] + 0.5) / (df[w] + 0.5))) * c[w] * (lexical.CONFIG.k1 + 1) / (c[w] + lexical.CONFIG.k1 * (1 - lexical.CONFIG.b + lexical.CONFIG.b * sum(c.values()) / avg)) for w in met)
            if met:
                rows.append((i, round(score, 9), round(len(met) / len(asked), 6)))
        out[q] = [(i, round(s, 6), c) for i, s, c in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]]
    return {q: r for q, r in out.items() if r}


def same(got, want, every):
    """Equal but for the order of scores that rounding makes equal: places by score, and each id with its own score."""
    assert got.keys() == want.keys()
    for q in got:
        assert [s for _, s, _ in got[q]] == pytest.approx([s for _, s, _ in want[q]], abs=2e-6) and len({i for i, _, _ in got[q]}) == len(got[q])
        known = {i: (s, c) for i, s, c in every[q]}
        assert all(known[i] == pytest.approx((s, c), abs=2e-6) for i, s, c in got[q])


def found(index, queries, k):
    out = {}
    for r in sorted(index.search(queries, k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 6), round(r.coverage, 6)))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("moor", "sail", "ferry", "lantern") for b in ("", "ed", "ing", "s") for c in ("", "x", "yz")] + ["東京駅", "京都", "駅", "ROPE", "rope_end"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))), [f"kind:{rng.choice(words[:9])}"] if i % 3 else None) for i in range(400)]
    docs += [(1000, None, None), (1001, "", []), (1002, "rope " * 5000, ["tide"]), (1003, "東京駅前の京都", None)]
    queries = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for q in range(40)] + [(100, "kind tide"), (101, ""), (102, None), (103, "unheardof"), (104, "京都駅")]
    return docs, queries


DOCS, ASKED = "id long, content string, tags array<string>", "query_id long, query string"


def test_equal_to_scoring_everything(spark, corpus):
    docs, queries = corpus
    index = lexical.build(spark.createDataFrame(docs, DOCS), tags_col="tags", range_docs=20)
    assert index.ranges > 15 and lexical.load(spark, index.path) == index
    for k in (1, 5, 600):
        same(found(index, spark.createDataFrame(queries, ASKED), k), plain(docs, queries, k), plain(docs, queries, 10**6))


def test_follows_changes(spark, corpus):
    docs, queries = corpus
    index = lexical.build(spark.createDataFrame(docs, DOCS), tags_col="tags", range_docs=20)
    before = spark.read.parquet(f"{index.path}/postings").withColumn("f", F.input_file_name()).select("f").distinct().count()
    later = [(i, "lantern " + (t or ""), tags) if i in (5, 6) else (i, t, tags) for i, t, tags in docs if i not in (7, 8, 1002)] + [(2000, "moorings of the ferry", ["kind:rope"])]
    changed = spark.createDataFrame([(i,) for i in (5, 6, 7, 8, 1002, 2000)], "id long")
    kept = {r.f for r in spark.read.parquet(f"{index.path}/postings").select(F.input_file_name().alias("f")).distinct().collect()}
    index.update(spark.createDataFrame(later, DOCS), changed)
    now = {r.f for r in spark.read.parquet(f"{index.path}/postings").select(F.input_file_name().alias("f")).distinct().collect()}
    assert before - 6 <= len(kept & now) < before  # the files of other ranges stay
    same(found(index, spark.createDataFrame(queries, ASKED), 7), plain(later, queries, 7), plain(later, queries, 10**6))
    index.update(spark.createDataFrame([], DOCS), spark.createDataFrame([(i,) for i, _, _ in later], "id long"))
    assert found(index, spark.createDataFrame(queries, ASKED), 7) == {}


def test_empty_index_and_ids_of_text(spark):
    none = lexical.build(spark.createDataFrame([], DOCS), tags_col="tags")
    assert none.search(spark.createDataFrame([(1, "rope")], ASKED), 3).collect() == []
    named = lexical.build(spark.createDataFrame([("a", "ropes"), (None, "rope"), ("b", "roped in")], "name string, said string"), "name", "said")
    assert [r.id for r in named.search(spark.createDataFrame([(1, "rope")], ASKED), 3).orderBy("rank").collect()] == ["a", "b"]


def test_most_ranges_are_passed_over(spark):
    docs = [(i, "common " * 3 + ("rare find " * 9 if i < 12 else "words of no interest here")) for i in range(3000)]
    index = lexical.build(spark.createDataFrame(docs, "id long, content string"), range_docs=30)
    got = index.search(spark.createDataFrame([(1, "rare common")], ASKED), 3)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]
