import datetime
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import facts, spans, timeline

EVENTS = "subject string, attribute string, value string, valid_from timestamp, recorded_at timestamp, seq long"


def at(minute):
    return None if minute is None else datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)


@pytest.fixture(scope="module")
def events(spark):
    """Half of the rows belong to one subject; times repeat, some are null, and so are some subjects."""
    rng = random.Random(8)
    rows = []
    for i in range(2000):
        subject = "hot" if i % 2 else rng.choice(["a", "b", None, *map(str, range(30))])
        rows.append((subject, rng.choice(["x", "y"]) if i % 2 == 0 else "x", rng.choice(["1", "2", None]), at(rng.choice([None, *range(400)])), at(rng.randrange(50)), i))
    return spark.createDataFrame(rows, EVENTS)


def both(monkeypatch, make):
    """What make() gives with whole groups, and with all groups split."""
    whole = sorted(map(str, make().collect()))
    monkeypatch.setattr(spans, "HOT_ROWS", 5)
    return whole, sorted(map(str, make().collect()))


@pytest.mark.parametrize("name", ["chain", "history"])
def test_facts_of_a_hot_subject(events, monkeypatch, name):
    whole, split = both(monkeypatch, lambda: getattr(facts, name)(events))
    assert whole == split and len(whole) > 1000


def test_chain_against_plain_python(events, monkeypatch):
    monkeypatch.setattr(spans, "HOT_ROWS", 5)
    rows = [tuple(r) for r in events.collect()]
    low = datetime.datetime.min
    order = lambda r: (r[3] is not None, r[3] or low, r[4], r[5])
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=order)
        want |= {r[5]: nxt[3] for r, nxt in zip(own, [*own[1:], (None,) * 6], strict=True)}
    assert {r.seq: r.valid_to for r in facts.chain(events).collect()} == want


def test_as_of_a_hot_subject(events, spark, monkeypatch):
    asked = spark.createDataFrame([(i, s, "x", at(7 * i % 450)) for i in range(300) for s in [["hot", "a", None, "nobody"][i % 4]]], "question_id long, subject string, attribute string, at timestamp")
    whole, split = both(monkeypatch, lambda: facts.as_of(asked, events))
    assert whole == split and len(whole) == 300


def test_timelines_and_sessions_of_a_hot_subject(events, monkeypatch):
    rows = events.select("subject", F.col("valid_from").alias("declared"), F.col("recorded_at").alias("stored"), "seq")
    whole, split = both(monkeypatch, lambda: timeline.two_clock(rows, "subject", "declared", "stored", "seq"))
    assert whole == split and len(whole) == 2000
    seen = events.select(F.col("subject").alias("user_id"), F.col("recorded_at").alias("ts"), F.col("seq").alias("event_id"))
    monkeypatch.setattr(spans, "HOT_ROWS", 10**6)
    whole, split = both(monkeypatch, lambda: timeline.sessions(seen, 60))
    assert whole == split


def test_a_hot_group_lies_in_many_parts(events):
    parts = spans.spans(events, ("subject", "attribute"), (F.col("valid_from"), F.col("seq")), 100)
    sizes = [r["n"] for r in parts.rows.groupBy("__p", "subject", "attribute").agg(F.count("*").alias("n")).collect()]
    assert parts.split and max(sizes) <= 2 * 2000 / 4 and parts.rows.filter("subject = 'hot'").select("__p").distinct().count() >= 2
    none = spans.spans(events.limit(0), ("subject", "attribute"), (F.col("valid_from"),))
    assert not none.split and none.carry({"n": F.count("*")}, {"m": lambda w: F.lag("n").over(w)}).count() == 0
