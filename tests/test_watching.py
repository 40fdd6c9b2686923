import datetime
import random

import pytest
from pyspark.sql import functions as F

from memlake.functions.words import anchors
from memlake.operators import context
from memlake.streaming import watching

TURNS = "conv_id long, turn long, text string, at timestamp"
START = datetime.datetime(2026, 3, 1)


@pytest.fixture()
def timers(spark):
    before = spark.conf.get(watching.PROVIDER, None)
    spark.conf.set(watching.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(watching.PROVIDER, before) if before else spark.conf.unset(watching.PROVIDER)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def stream_of(spark, path, rows, schema, files):
    """A stream of one file a batch, in the order of rows."""
    size = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def told(spark, frame, name, path):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name)


def test_names_in_view_do_not_depend_on_the_order_of_arrival(spark, tmp_path, timers):
    rng = random.Random(6)
    names = ["svc-one", "svc-two", "Ana", "port-9", "Mara", "db_main"]
    said = [(c, t, rng.choice([None, "fine", f"ask about {rng.choice(names)}", f"so {rng.choice(names)} and {rng.choice(names)}"]), at(3 * t + c % 3)) for c in range(4) for t in range(14)]
    stored = spark.createDataFrame([(c, t, anchors(x or "")) for c, t, x, _ in said], "conv_id long, turn long, names array<string>")
    want = {(r.conv_id, r.turn): r.names for r in context.names_in_view(stored, 4).collect()}
    # Arrival within half an hour of the order of times, so that none is later than the watermark; one row at the end moves it on.
    arrival = sorted(said, key=lambda r: r[3] + datetime.timedelta(minutes=rng.randrange(30)))
    rows = [*arrival, (None, 0, "svc-two", at(1)), (1, 99, "svc-two", None), (77, 0, "the end", at(900))]
    got = told(spark, watching.watch(stream_of(spark, f"{tmp_path}/in", rows, TURNS, 4), 4, "2 hours", "40 minutes"), "in_view", f"{tmp_path}/c").collect()
    assert {(r.conv_id, r.turn): r.names for r in got if r.conv_id != 77} == want and len(got) == len(want)


def test_a_conversation_is_forgotten_when_idle(spark, tmp_path, timers):
    rows = [(1, 0, "ask svc-one", at(0)), (9, 0, "x", at(30)), (9, 1, "x", at(300)), (1, 1, "so?", at(310)), (9, 2, "x", at(900))]
    got = told(spark, watching.watch(stream_of(spark, f"{tmp_path}/in", rows, TURNS, 5), 6, "1 hour", "1 minute"), "forgotten", f"{tmp_path}/c")
    assert {(r.turn): r.names for r in got.collect() if r.conv_id == 1} == {0: ["svc-one"], 1: []}


def test_the_store_without_timers_is_refused(spark):
    spark.conf.set(watching.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="RocksDB"):
        watching.watch(spark.createDataFrame([], TURNS))
    spark.conf.unset(watching.PROVIDER)


def test_corrected_claims_as_in_a_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "subject string, value string, at timestamp"
    claims = [(f"s{i % 7}", str(rng.randrange(3)), at(i * 4)) for i in range(60)] + [("end", "0", at(2000))]
    fixes = [(f"s{rng.randrange(7)}", str(rng.randrange(3)), at(rng.randrange(240))) for _ in range(40)] + [("end", "1", at(2000))]
    fixes = sorted(fixes, key=lambda r: r[2])
    ask = lambda a, b: watching.corrected(a, b, ["subject"], within="20 minutes", late="30 minutes")
    want = sorted(map(str, ask(spark.createDataFrame(claims, schema), spark.createDataFrame(fixes, schema)).filter("subject <> 'end'").collect()))
    got = told(spark, ask(stream_of(spark, f"{tmp_path}/a", claims, schema, 3), stream_of(spark, f"{tmp_path}/b", fixes, schema, 3)), "fixed", f"{tmp_path}/c").filter(F.col("subject") != "end")
    assert sorted(map(str, got.collect())) == want and len(want) >= 60
