import random
import re
from collections import defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np

from memlake.llm.mixing import op5_mixing, subset_counts
from memlake.sources.shared import ensure_checkpoint_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target double"


def levels(size):
    """Weights by rank, capped at three times the size, the excess reshared."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, held = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        t = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if t[s] > 3 * size[s]]
        if not over:
            return t | held
        held |= {s: 3.0 * size[s] for s in over}


def test_against_plain_shares(spark, tables):
    rng = random.Random(2)
    data = []
    for i in range(700):
        s = rng.choice(["a", "b", "b", "b", "b", "b", "é", None, "z"])
        n = 10 if i % 3 == 0 else rng.randrange(60)
        data.append((i, " \t".join(["w"] * n) if i % 11 else None, "en", s, 1, 0.0))
    data += [(1000 + i, "one two three", "en", "tiny", 1, 0.0) for i in range(2)] + [(2000, "", "en", "void", 0, 0.0)] + [data[5]] * 2
    d = tables(documents=(data, DOCS))
    got = op5_mixing(spark, d).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = {x[0]: x for x in data}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for x in data:
        total[x[3]] += size(x[1])
    for r in got:
        s = own[r.doc_id][3]
        assert r["size"] == size(own[r.doc_id][1]) and r.source_size == total[s]
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
        target[s] = r.target
    assert len(got) == len(data)
    want = levels(total)
    for s in want:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= 10, (s, taken[s], want[s])
    again = op5_mixing(spark, d).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_subset_counts_is_best(spark):
    rng = random.Random(4)
    for _ in range(200):
        n = np.array([rng.randrange(1, 40) for _ in range(rng.randrange(1, 5))])
        spare, budget = np.array([rng.randrange(4) for _ in n]), rng.randrange(150)
        sums = {0}
        for a, k in zip(n, spare):
            sums = {s + a * j for s in sums for j in range(k + 1)}
        take = subset_counts(n, spare, budget)
        assert (take <= spare).all() and int((take * n).sum()) == max(s for s in sums if s <= budget)
        near = subset_counts(n, spare, budget, most=30)
        assert (near <= spare).all() and int((near * n).sum()) <= budget


def test_a_large_budget_misses_less_than_the_shortest_left_out():
    rng = random.Random(5)
    for _ in range(300):
        n = np.array(sorted({rng.randrange(1, 900) for _ in range(rng.randrange(1, 9))}))
        spare, budget = np.array([rng.randrange(60) for _ in n]), rng.randrange(40_000)
        take = subset_counts(n, spare, budget, most=2000)
        miss, left = budget - int((take * n).sum()), n[take < spare]
        assert (take <= spare).all() and miss >= 0 and (not len(left) or miss < left.min())


def test_ids_that_are_null_or_repeated_are_each_taken_whole(spark, tables):
    data = [(None, "w " * 7, "en", "a", 1, 0.0)] * 4 + [(3, "w " * 5, "en", None, 1, 0.0)] * 3 + [(3, "w", "en", None, 1, 0.0), (None, None, None, None, None, None)]
    got = op5_mixing(spark, tables(documents=(data, DOCS))).collect()
    assert len(got) == 9 and sum(r["size"] for r in got) == 44 and all(r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"] for r in got)


def test_a_little_over_is_nearer_than_far_below(spark, tables):
    data = [(i, "w " * n, "en", s, 1, 0.0) for i, (n, s) in enumerate([(100, "a"), (90, "a"), (80, "a"), (269, "b"), (270, "b")])]
    got = op5_mixing(spark, tables(documents=(data, DOCS))).collect()
    target = {r.source_size: r.target for r in got}
    taken = {k: sum(r.taken for r in got if r.source_size == k) for k in target}
    assert target[270] == 809 / 3 and taken[270] == 270 and abs(taken[539] - target[539]) <= 270


def test_empty(spark, tables):
    assert op5_mixing(spark, tables(documents=([], DOCS))).collect() == []


def test_a_large_budget_is_shared_out_at_every_length():
    lengths = np.arange(1, 400)
    spare = np.full(len(lengths), 900)
    for budget in (10**5, 10**6, 10**7 + 1):
        take = subset_counts(lengths, spare, budget)
        share = budget / (lengths * spare).sum()
        assert (take * lengths).sum() == budget
        assert np.abs(take - share * spare).max() <= 3  # no length is favoured
    odd = subset_counts(np.array([70_000, 100_000]), np.array([5, 5]), 180_000)
    assert (odd * [70_000, 100_000]).sum() == 170_000


def test_few_rows_make_few_files_in_any_number_of_partitions(spark, tables, tmp_path):
    data = [(i, "w " * (i % 50), "en", f"s{i % 3}", 1, 0.0) for i in range(600)]
    d = tables(documents=(data, DOCS))
    want = sorted(map(str, op5_mixing(spark, d).collect()))
    shared = Path(urlparse(ensure_checkpoint_dir(spark)).path)
    files = lambda: {x for x in shared.rglob("part-*")}
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        old = files()
        op5_mixing(spark, d).write.parquet(f"{tmp_path}/out")
        new = files() - old
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(new) <= 12 and len([*(tmp_path / "out").glob("part-*")]) == 1
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == want
