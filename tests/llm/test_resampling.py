import hashlib
import math
import re
import zlib
from collections import Counter

from memlake.llm import resampling as rs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, depth):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, depth + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, depth=1, buckets=rs.BUCKETS):
    """{doc_id or row: (n_features, weight, score, rank)} by plain counting."""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    count = [Counter(place(f) for t in texts for f in features(t, depth)[1]) for texts in ([t for _, t in docs], target)]
    s_all, t_all = (sum(c.values()) for c in count)
    out = []
    for i, t in docs:
        n, fs = features(t, depth)
        weight = sum(math.floor(1000 * math.log((count[1][b] + 1) * (s_all + buckets) / ((count[0][b] + 1) * (t_all + buckets)))) for b in map(place, fs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= rs.LEAST_WORDS), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place_, r in enumerate(able[: len(able) * rs.SHARE_NUM // rs.SHARE_DEN], 1):
        r[4] = place_
    return sorted((tuple(r[:5]) for r in out), key=str)


def texts(n):
    some = [" ".join(f"w{(i * 7 + j * j) % (5 + i % 40)}" for j in range(i % 60)) for i in range(n)]
    some[3], some[4], some[5] = "", "É É É ñandú-ÑANDÚ 123 ABC_abc\tx\n" * 9, "ÀB " * 30
    return some


def test_the_query_against_plain_counts(spark, tables):
    docs = [(i, t) for i, t in enumerate(texts(300))] + [(7, "w1 w2 " * 15), (7, "w1 w2 " * 15), (None, "w1 w3 " * 20), (900, None), (901, "w4 " * 30_000)]
    target = ["w1 w2 w3 w4", "É abc", None, ""]
    path = tables(documents=([(i, t, "en", None, 1) for i, t in docs], DOCS), benchmark=([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    got = rs.op11_resampling(spark, path).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, target)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(features(t, 1)[0] >= 20 for _, t in docs) // 10))


def test_longer_runs_and_small_tries(spark, monkeypatch):
    docs, target = [(i, t) for i, t in enumerate(texts(120))], ["w1 w2 w3 w1 w2", "w4 w5"]
    monkeypatch.setattr(rs, "SLICE_ROWS", 7)
    monkeypatch.setattr(rs, "MOST_NODES", 50)  # captured by the tasks with the module, if they import it anew
    batches = lambda rows: iter(spark.createDataFrame(rows, "doc_id long, text string").toArrow().to_batches())
    tries = {id(t): t for _, _, t, _ in rs.walked(batches(docs), 3, "text")}
    assert len(tries) > 3
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = rs.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), depth=3, buckets=97)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == plain(docs, target, 3, 97)


def test_nodes_hold_the_state_of_their_path():
    import numpy as np

    trie = rs.WordTrie(3)
    list(trie.walk(np.array([0, 4]), np.array([0, 1, 0, 2]), [b"on", b"the", b"sea"]))
    assert {zlib.crc32(f.encode()) for f in features("on the on sea", 3)[1]} == set(trie.state[1:])


def test_empty_tables_and_clashing_columns(spark, tables):
    none = tables(documents=([], DOCS), benchmark=([], "item_id long, text string"))
    assert rs.op11_resampling(spark, none).collect() == []
    docs = spark.createDataFrame([(i, "a b " * 20, 5, "x", 1, 2, 3) for i in range(20)], "doc_id long, text string, score int, rank string, weight int, n_words int, other int")
    got = rs.resample(docs, docs.limit(0).select("text")).collect()
    assert sorted(got[0].asDict()) == ["doc_id", "n_features", "n_words", "other", "rank", "score", "weight"] and sorted(r.rank for r in got if r.rank) == [1, 2]
    assert {(r.other, r.n_features, r.n_words) for r in got} == {(3, 40, 40)}
