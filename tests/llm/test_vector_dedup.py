import math
import random

from memlake.llm import vector_dedup

V = "vec_id long, embedding array<float>, label int, component_id long, cell int"


def brute(data, t=0.93):
    ok = [(i, v, l) for i, v, l in data if i is not None and v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    links, parent = {i: 0 for i, *_ in data}, {i: i for i, *_ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, v, a) in enumerate(ok):
        for j, w, b in ok[:n]:
            if a == b and len(v) == len(w) and cos(v, w) >= t:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, links[i], find(i), i == find(i)) for i in links}


def test_against_brute_force(spark, tables, monkeypatch):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    data = []
    for i in range(420):
        c = rng.choice(centres)
        data.append((i, [float(round(x + rng.gauss(0, 0.35), 3)) for x in c], rng.choice([1, 1, 2])))
    data += [(600 + i, data[0][1], data[0][2]) for i in range(30)] + [(700, [0.0] * 8, 1), (701, None, 1), (702, [None] * 8, 1), (703, [float("nan")] * 8, 1), (704, [], 1), (705, data[1][1], None)]
    import struct

    data = [(i, v and [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v], l) for i, v, l in data]
    d = tables(embeddings=([(i, v, l, 1, 1) for i, v, l in data], V))
    got = lambda: {tuple(r) for r in vector_dedup.op9_vector_dedup(spark, d).select("vec_id", "n_links", "component_id", "kept").collect()}
    want = brute(data)
    assert got() == want
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", 16)
    assert got() == want


def test_empty(spark, tables):
    assert vector_dedup.op9_vector_dedup(spark, tables(embeddings=([], V))).collect() == []


def test_repeated_and_null_ids_and_labels_of_any_type(spark, tables):
    a, b, far = [1.0, 0.0], [0.99, 0.1], [0.0, 1.0]
    rows = [(1, a, 1), (1, far, 1), (2, b, 1), (3, far, 1), (4, a, 2), (None, a, 1), (5, a, 1), (5, a, 1), (6, [-1.0, 0.0], 1)]
    got = vector_dedup.op9_vector_dedup(spark, tables(embeddings=([(*r, 1, 1) for r in rows], V))).select("vec_id", "n_links", "component_id", "kept").collect()
    want = [(1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 1, 1, False), (4, 0, 4, True), (None, 0, None, None), (5, 3, 1, False), (5, 3, 1, False), (6, 0, 6, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    named = spark.createDataFrame([(i, v, f"l{k}") for i, v, k in rows if i is not None], "vec_id long, embedding array<float>, label string")
    assert sorted(map(tuple, vector_dedup.near_duplicates(named).select("vec_id", "n_links", "component_id", "kept").collect()), key=str) == sorted([w for w in want if w[0] is not None], key=str)


def test_nearly_equal_vectors_in_cells_apart(spark, monkeypatch):
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    rows = [(2 * i + s, [x * (1 + s * 1e-9) for x in v], 1) for i, v in enumerate(base) for s in (0, 1)]
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in vector_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()} == brute(rows)
