import math
import random
from collections import Counter

from memlake.llm import topk

V = "vec_id long, embedding array<float>, label int, rank int, score int"


def brute(data, k=20):
    """Every row whose id is divisible by 20 against all other rows."""
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, v) in enumerate(ok):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(ok) if j != at)
            out.update((q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1))
    return out


def test_against_brute_force(spark, tables, monkeypatch):
    rng = random.Random(1)
    quarter = lambda: rng.randrange(-200, 200) / 64
    data = [(i, [quarter() for _ in range(6)], 1, 0, 0) for i in range(260)]
    data += [(300 + i, [0.5] * 6, 1, 0, 0) for i in range(60)]
    data += [(400, None, 1, 0, 0), (401, [None] * 6, 1, 0, 0), (402, [float("nan")] * 6, 1, 0, 0), (403, [float("inf")] * 6, 1, 0, 0), (None, [1.0] * 6, 1, 0, 0), (404, [], 1, 0, 0)]
    data += [(20, data[20][1], 1, 0, 0), (20, [1.0] * 6, 1, 0, 0), (21, [2.0] * 6, 1, 0, 0), (21, [2.0] * 6, 1, 0, 0), (40, [3.0] * 5, 1, 0, 0)] + [(60, [0.25] * 6, 1, 0, 0)] * 30 + [(500, [1e9] * 6, 1, 0, 0), (420, [-1e9, 1e9, 5.0, 1.0, 1.0, 1.0], 1, 0, 0)]
    d = tables(embeddings=(data, V))
    import struct

    data = [(i, v and [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v, *_ in data]
    want = brute(data)
    assert Counter(tuple(r) for r in topk.op7_topk(spark, d).select("query_id", "rank", "vec_id", "score").collect()) == want
    rows = topk.scaled(spark.read.parquet(d + "/embeddings.parquet"), "vec_id", "embedding")
    small = topk.search(rows.filter("vec_id % 20 = 0"), rows, 20, 320, query_block=5, shard_rows=10)
    assert Counter(tuple(r) for r in small.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_another_row_of_the_same_id_is_a_candidate(spark, tables):
    d = tables(embeddings=([(0, [1.0, 1.0], 1, 0, 0), (1, [5.0, 5.0], 1, 0, 0), (1, [1.0, 1.0], 1, 0, 0), (0, [2.0, 2.0], 1, 0, 0)], V))
    got = Counter(tuple(r) for r in topk.op7_topk(spark, d).select("query_id", "rank", "vec_id", "score").collect())
    assert got == Counter([(0, 1, 1, 40960), (0, 2, 0, 16384), (0, 3, 1, 8192), (0, 1, 1, 81920), (0, 2, 0, 16384), (0, 3, 1, 16384)])


def test_few_and_none(spark, tables):
    assert topk.op7_topk(spark, tables(embeddings=([], V))).collect() == []
    one = tables(embeddings=([(0, [1.0], 1, 0, 0), (1, [2.0], 1, 0, 0)], V))
    assert [tuple(r) for r in topk.op7_topk(spark, one).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 64 * 128)]
