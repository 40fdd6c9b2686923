import datetime
import random

from pyspark.sql import functions as F

from memlake.operators import facts
from memlake.streaming.fact_store import FactStore

EVENTS = "subject string, attribute string, value string, valid_from timestamp, recorded_at timestamp, seq long"


def made(n, seed=2):
    rng, start = random.Random(seed), datetime.datetime(2026, 1, 1)
    return [(rng.choice(["a", "b", None, *map(str, range(20))]), rng.choice("xy"), str(rng.randrange(5)), start + datetime.timedelta(minutes=rng.randrange(300)), start + datetime.timedelta(minutes=rng.randrange(9)), i) for i in range(n)]


def rows(df):
    return sorted(map(str, df.select("subject", "attribute", "value", "valid_from", "valid_to", "seq").collect()))


def test_batches_in_any_order_and_repeated(spark, tmp_path):
    every = made(400)
    parts = [every[i::5] for i in range(5)]
    random.Random(1).shuffle(parts)
    store = FactStore(spark, f"{tmp_path}/facts", buckets=8)
    assert store.facts() is None
    for i, part in enumerate(parts):
        batch = spark.createDataFrame(part + part[:7] + (parts[0][:5] if i == 3 else []), EVENTS)
        assert store.put(batch, f"s{i}") and not store.put(batch, f"s{i}")
    assert rows(store.facts()) == rows(facts.chain(spark.createDataFrame(every, EVENTS)))
    assert store.put(spark.createDataFrame([], EVENTS), "nothing") and len(rows(store.facts())) == 400


def test_untouched_buckets_stay_and_broken_batches_do_not_show(spark, tmp_path):
    store = FactStore(spark, f"{tmp_path}/facts", buckets=8)
    store.put(spark.createDataFrame(made(200), EVENTS), "one")
    before = {r.f for r in store.facts().select(F.input_file_name().alias("f")).distinct().collect()}
    moment = datetime.datetime(2026, 2, 1)
    store.put(spark.createDataFrame([("new", "x", "1", moment, moment, 9000)], EVENTS), "two")
    after = {r.f for r in store.facts().select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(before - after) <= 4 and len(after & before) >= len(before) - 4
    shown = rows(store.facts())
    spark.createDataFrame([("lost", "x", "1", moment, moment, 9001, None)], EVENTS + ", valid_to timestamp").write.parquet(f"{tmp_path}/facts/data/0000000003/bucket=1")  # no manifest names it
    assert rows(store.facts()) == shown
    assert store.put(spark.createDataFrame([("new", "x", "2", moment + datetime.timedelta(days=1), moment, 9002)], EVENTS), "three")
    got = {r.seq: r.valid_to for r in store.facts().filter("subject = 'new'").collect()}
    assert got == {9000: moment + datetime.timedelta(days=1), 9002: None} and store.facts().filter("subject = 'lost'").isEmpty()


def test_a_stream_fills_the_store(spark, tmp_path):
    every = made(120)
    for i in range(3):
        spark.createDataFrame(every[i::3], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = FactStore(spark, f"{tmp_path}/facts", buckets=4)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for turn in range(2):  # a second checkpoint replays all batches under their numbers
        query = store.follow(stream, f"{tmp_path}/cp{turn}")
        query.awaitTermination(120)
        assert query.exception() is None
    assert rows(store.facts()) == rows(facts.chain(spark.createDataFrame(every, EVENTS)))
