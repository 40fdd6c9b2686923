import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from memlake.llm.common import connected_components, seeded_unit
from memlake.llm.sharding import SEED, interleave, op3_sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, __u long"


def rows(spark, tables, data):
    return op3_sharding(spark, tables(documents=(data, DOCS))).collect()


def test_counts_mixture_slots_and_checksums(spark, tables):
    data = [(i, f"text {i % 7} é", "en", f"s{min(i % 9, 3)}", 1, 5, 6) for i in range(900)]
    got = rows(spark, tables, data)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {d[0]: d[3] for d in data}
    total = Counter(source.values())
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for s, n in Counter(source[r.doc_id] for r in own).items():
            assert abs(n - total[s] / 8) <= 2
    for r in got:
        t = f"text {r.doc_id % 7} é".encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
    assert {(r.doc_id, r.shard, r.slot) for r in rows(spark, tables, data[::-1])} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_nulls_repeats_and_empty(spark, tables):
    data = [(None, None, None, None, None, 1, 1)] * 5 + [(1, "", "en", "a", 0, 1, 1)] * 9 + [(2, "x" * 100_000, "en", None, 0, 1, 1)]
    got = rows(spark, tables, data)
    assert len(got) == 15 and Counter(Counter(r.shard for r in got).values()) == {2: 7, 1: 1}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id != 2} == {(1, 0)}
    assert rows(spark, tables, []) == []


def test_against_a_plain_sort(spark, tables):
    data = [(i, f"t{i}", "en", f"s{i % 5}" if i % 7 else None, 1, 5, 6) for i in range(400)]
    got = rows(spark, tables, data)
    source = {d[0]: ("1" if d[3] is None else "0" + d[3]) for d in data}
    hashed = spark.createDataFrame([(r.doc_id, r["size"], r.text_crc32, source[r.doc_id]) for r in got], "doc_id long, size long, text_crc32 long, skey string")
    unit = lambda *c: seeded_unit(SEED, *[F.col(x) for x in c])
    hashed = [tuple(r) for r in hashed.select("doc_id", "skey", unit("doc_id", "size", "text_crc32").alias("u"), (unit("skey") / 2.0**53).alias("o")).collect()]
    by = defaultdict(list)
    for i, k, u, o in hashed:
        by[k].append((u, i, o))
    order = sorted(((r + 1 - o) / len(own), k, r, i) for k, own in by.items() for r, (_, i, o) in enumerate(sorted(own)))
    n, want = len(order), {}
    for pos, (*_, i) in enumerate(order):
        shard = pos * 8 // n
        want[i] = (shard, pos - -(-shard * n // 8))
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_many_sources_of_one_row_spread_over_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("skey"))
    ranks = df.select((1 - seeded_unit(SEED, F.col("skey")) / 2.0**53).alias("f")).groupBy(F.floor(F.col("f") * 10)).count().collect()
    assert len(ranks) == 10 and max(r["count"] for r in ranks) < 450
    placed = interleave(df, ["doc_id"])
    assert Counter(Counter(r.shard for r in placed.collect()).values()) == {375: 8}


def test_connected_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    for edges in ([], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 3), (5, 5)]):
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {(r.node, r.component) for r in got} == {(x, find(x)) for x in list(parent)}
