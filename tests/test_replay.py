import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from memlake.streaming import replay
from memlake.streaming.replay import ReplayStore

ROWS = "agent_id string, id long, weight double"


def made(n=900, seed=6):
    rng = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None, *map(str, range(20))]), i, rng.choice([0.1, 0.5, 1.0, 0.0, -1.0, None, math.inf, math.nan])) for i in range(n)]
    return rows


def key(i, w, seed):
    if w is None or not 0 < w < math.inf:
        return None
    return math.log((int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / w


def plain(rows, n, seed):
    out = {}
    for agent, i, w in set(rows):
        if (k := key(i, w, seed)) is not None:
            out.setdefault(agent, []).append((-k, i))
    return {a: sorted(i for _, i in sorted(r)[:n]) for a, r in out.items()}


def told(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.agent_id, []).append(r.id)
    return {a: sorted(ids) for a, ids in out.items()}


def keyed(spark, rows, seed=5):
    return spark.createDataFrame(rows, ROWS).withColumn("key", replay.priority("id", F.col("weight"), seed))


def test_sample_against_the_definition(spark):
    rows = made()
    for n in (1, 12, 10_000):
        assert told(replay.greatest(keyed(spark, rows), "agent_id", "id", n)) == plain(rows, n, 5)
    assert told(replay.greatest(keyed(spark, rows, 9), "agent_id", "id", 12)) == plain(rows, 12, 9) != plain(rows, 12, 5)
    assert told(replay.greatest(keyed(spark, []), "agent_id", "id", 3)) == {}


def test_draws_follow_the_weights(spark):
    """Of many first draws among weights 1, 2 and 5, each wins in proportion."""
    trials = spark.range(30_000).select(F.col("id").cast("string").alias("agent_id"), F.explode(F.array(*[F.struct((F.col("id") * 3 + j).alias("id"), F.lit(float(w)).alias("weight")) for j, w in enumerate((1, 2, 5))])).alias("x")).select("agent_id", "x.*")
    first = replay.greatest(trials.withColumn("key", replay.priority("id", F.col("weight"), 3)), "agent_id", "id", 1)
    share = {r.weight: r["count"] / 30_000 for r in first.groupBy("weight").count().collect()}
    assert [share[w] for w in (1.0, 2.0, 5.0)] == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.012)


def test_store_merges_batches_in_any_order(spark, tmp_path):
    rows = made()
    parts = [rows[i::4] for i in range(4)]
    random.Random(2).shuffle(parts)
    store = ReplayStore(spark, f"{tmp_path}/kept", 10, buckets=4)
    assert store.rows() is None
    for i, part in enumerate(parts):
        batch = keyed(spark, part + part[:9] + parts[0][:5])
        assert store.put(batch, f"s{i}") and not store.put(batch, f"s{i}")
    assert told(store.rows()) == plain(rows, 10, 5)
    assert store.put(keyed(spark, []), "nothing") and told(store.rows()) == plain(rows, 10, 5)


def test_stream_keeps_the_newest(spark, tmp_path):
    rows = [(a, i, None) for a, i, _ in made(300)]
    for n, part in enumerate((rows[200:], rows[:120], rows[120:200])):
        spark.createDataFrame(part, ROWS).withColumn("key", F.col("id").cast("double")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROWS + ", key double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = ReplayStore(spark, f"{tmp_path}/kept", 4, buckets=3)
    store.follow(stream, f"{tmp_path}/at").awaitTermination(120)
    want = {}
    for a, i, _ in rows:
        want.setdefault(a, []).append(i)
    assert told(store.rows()) == {a: sorted(ids)[-4:] for a, ids in want.items()}


def test_valid_experiences(spark):
    good = ("a", [0.1, 0.2], "FAST", 0.5, [0.3, 0.1])
    bad = [("", *good[1:]), (None, *good[1:]), ("a", [], "FAST", 0.5, []), ("a", [0.1], "FAST", 0.5, [0.1, 0.2]), ("a", [0.1], "SLOW", 0.5, [0.1]), ("a", [0.1], "DEEP", 1.5, [0.1]), ("a", [0.1], "DEEP", None, [0.1]), ("a", None, "DEEP", 0.1, None), ("a", [0.1], "DEEP", float("nan"), [0.1])]
    frame = spark.createDataFrame([good, *bad], "agent_id string, state array<double>, action string, reward double, next_state array<double>")
    assert [tuple(r)[:1] + tuple(r)[2:4] for r in replay.valid(frame).collect()] == [("a", "FAST", 0.5)]
