import heapq
import random

import pytest

from memlake.operators import graph, spans
from memlake.plans import catalog
from memlake.sources import tables as src

EDGES, NODES, SEEDS = "src string, dst string, relation string, weight double", "node string, weight double", "origin string, node string, score double"


def walk(edges, nodes, seeds, hops, k=None):
    """{origin: {node: score}} by a heap, one node at a time."""
    held, near = dict(nodes), {}
    for a, b, relation, w in edges:
        if relation != "contradicts":
            for x, y in ((a, b), (b, a)):
                if y in held:
                    near.setdefault(x, {})[y] = max(near.get(x, {}).get(y, 0.0), w * held[y])
    out = {}
    for origin in {s[0] for s in seeds}:
        best, heap, gone = {}, [], set()
        for _, node, score in sorted(s for s in seeds if s[0] == origin):
            if score > best.get(node, -1.0):
                best[node] = score
                heapq.heappush(heap, (-score, node, 0))
        while heap:
            score, node, depth = heapq.heappop(heap)
            if node in gone or depth >= hops:
                continue
            gone.add(node)
            for other, gain in near.get(node, {}).items():
                reach = -score * (gain * 0.5)
                if other not in gone and reach > best.get(other, 0.0):
                    best[other] = reach
                    heapq.heappush(heap, (-reach, other, depth + 1))
        out[origin] = dict(sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k])
    return out


def told(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.origin, {})[r.node] = r.score
    return out


def made(seed, n=60, m=150):
    rng = random.Random(seed)
    name = lambda: f"v{min(rng.randrange(n), rng.randrange(n)):02d}"  # noqa: E731  a few nodes have many edges
    weight = lambda: rng.choice([0.05, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0])
    edges = [(name(), name(), rng.choice(["refines", "manages", "contradicts"]), weight()) for _ in range(m)]
    nodes = [(f"v{i:02d}", weight()) for i in range(n) if i != 7]  # an edge may lead to a node that is not there
    seeds = [(f"o{i}", name(), rng.choice([0.1, 0.4, 0.8, 1.0])) for i in range(3) for _ in range(i + 1)] + [("o0", "nowhere", 1.0)]
    return edges, nodes, seeds


@pytest.mark.parametrize(("seed", "hops", "k", "hot"), [(1, 1, None, 10**6), (2, 3, None, 1), (3, 3, 8, 10**6)])
def test_equal_to_a_walk_of_one_node_at_a_time(spark, monkeypatch, seed, hops, k, hot):
    monkeypatch.setattr(spans, "HOT_ROWS", hot)
    edges, nodes, seeds = made(seed)
    got = told(graph.best_first(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(seeds, SEEDS), hops, k))
    want = walk(edges, nodes, seeds, hops, k)
    assert got.keys() == want.keys() and all(got[o] == pytest.approx(want[o]) for o in want)


def test_a_better_deep_path_hides_a_worse_one(spark):
    """d is met by a-b-c-d, three steps deep and better, and by a-e-d, found later: nothing goes on from d."""
    edges = [("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "d", "r", 1.0), ("a", "e", "r", 0.22), ("e", "d", "r", 1.0), ("d", "f", "r", 1.0)]
    nodes, seeds = [(x, 1.0) for x in "abcdef"], [("o", "a", 1.0)]
    got = told(graph.best_first(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(seeds, SEEDS), 3))
    assert got == {"o": {"a": 1.0, "b": 0.5, "c": 0.25, "e": 0.11, "d": 0.125}} == walk(edges, nodes, seeds, 3)
    with pytest.raises(ValueError, match="lower"):
        graph.best_first(spark.createDataFrame([("a", "b", "r", 2.0)], EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(seeds, SEEDS), 2)
    assert told(graph.best_first(spark.createDataFrame([], EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(seeds, SEEDS), 2)) == {"o": {"a": 1.0}}


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    edges = [tuple(r) for r in src.edges(spark, sf).select("src", "dst", "relation", "weight").collect()]
    nodes = [tuple(r) for r in src.nodes(spark, sf).select("node", "weight").collect()]
    seeds = [(r.node, r.node, 1.0) for r in src.nodes(spark, sf).filter("node_type = 'nation'").collect()]
    got, want = told(catalog.QUERIES["graph_best_first"](spark, sf)), walk(edges, nodes, seeds, 3, 20)
    assert got.keys() == want.keys() and all(sorted(got[o].values()) == pytest.approx(sorted(want[o].values()), abs=2e-6) for o in want)
