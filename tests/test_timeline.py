import datetime
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import spans, timeline

MEMORIES = "subject string, id long, text string, declared timestamp, stored timestamp"
FACTS = "subject string, id long, source long, text string, valid_from timestamp, recorded_at timestamp"
START = datetime.datetime(2026, 3, 1)


def at(hour):
    return None if hour is None else START + datetime.timedelta(hours=hour)


def plain(memories, facts, since=None, until=None, limit=None):
    """{subject: [(kind, memory, fact, basis, same day, truncated)]} one subject after the other."""
    out = {}
    for subject in {r[0] for r in memories + facts} - {None}:
        mine = [m for m in memories if m[0] == subject]
        ids, fold, events = {m[1] for m in mine}, {}, []
        for _, i, source, _, valid, noted in sorted((f for f in facts if f[0] == subject), key=lambda f: (f[4], f[5] or f[4], f[1])):
            if source in ids and source not in fold:
                fold[source] = i
            else:
                events.append(("fact", None, i, valid, noted or valid))
        events += [("memory", m[1], fold.get(m[1]), m[3], m[4]) for m in mine]
        tie = lambda e: (e[0], e[1] is not None, e[1] or 0, e[2] is not None, e[2] or 0)
        dated = sorted((e for e in events if e[3]), key=lambda e: (e[3], e[4], tie(e)))
        loose = sorted((e for e in events if not e[3]), key=lambda e: (e[4], tie(e)))
        last = max((e[4] for e in dated), default=None)
        late = [e for e in loose if last and e[4] > last]
        line = [(e, "declared") for e in dated] + [(e, "unknown" if last else "stored") for e in loose if e not in late] + [(e, "stored_after_dated") for e in late]
        days = [e[3].date() for e in dated]
        label = lambda n, e, b: (n + 1 - days.index(e[3].date()), days.count(e[3].date())) if b == "declared" and days.count(e[3].date()) > 1 else (None, None)
        rows = [(e[3] or e[4], (*e[:3], b, *label(n, e, b))) for n, (e, b) in enumerate(line)]
        rows = [r for when, r in rows if (since is None or when >= since) and (until is None or when <= until)]
        cut = 0 if limit is None else max(0, len(rows) - limit)
        out[subject] = [(*r, cut) for r in rows[cut:]]
    return {s: r for s, r in out.items() if r}


def told(df):
    out = {}
    for r in sorted(df.filter("subject is not null").collect(), key=lambda r: (r.subject, r.position)):
        out.setdefault(r.subject, []).append((r.kind, r.memory_id, r.fact_id, r.basis, r.k, r.m, r.truncated))
    return out


def made(seed=4, n=500):
    rng = random.Random(seed)
    who = lambda: "hot" if rng.random() < 0.4 else rng.choice(["undated", None, *"abcdefgh"])
    memories = [(s := who(), i, f"text {i}", None if s == "undated" else at(rng.choice([None, *range(200)])), at(rng.randrange(220))) for i in range(n)]
    facts = []
    for i in range(n):
        source = rng.choice([None, rng.randrange(n), rng.randrange(n), 10**6])
        subject = memories[source][0] if source is not None and source < n and rng.random() < 0.8 else who()
        if subject != "undated":
            facts.append((subject, i, source, f"fact {i}", at(rng.randrange(200)), at(rng.choice([None, 5, 210]))))
    facts += [(f[0], f[1] + 10_000, f[2], f[3], f[4], f[5]) for f in facts[:60]]  # further facts of the same memories
    return memories, facts


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_against_one_subject_after_the_other(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(spans, "HOT_ROWS", hot_rows)
    memories, facts = made()
    frames = spark.createDataFrame(memories, MEMORIES), spark.createDataFrame(facts, FACTS)
    assert told(timeline.folded(*frames)) == plain(memories, facts)
    assert told(timeline.folded(*frames, F.lit(at(40)), F.lit(at(150)), 7)) == plain(memories, facts, at(40), at(150), 7)


def test_folds_once_and_only_within_a_subject(spark):
    memories = [("ann", 1, "ann moved to Oslo", at(5), at(6)), ("bob", 2, "bob says hello", None, at(50)), ("bob", 3, "bob was early", None, at(1))]
    facts = [("ann", 10, 1, "ann city = Oslo", at(4), None), ("ann", 11, 1, "ann country = Norway", at(4), None), ("bob", 12, 1, "bob city = Oslo", at(9), at(10)), (None, 13, 1, "nobody", at(1), None)]
    got = told(timeline.folded(spark.createDataFrame(memories, MEMORIES), spark.createDataFrame(facts, FACTS)))
    assert got == {
        "ann": [("fact", None, 11, "declared", 1, 2, 0), ("memory", 1, 10, "declared", 2, 2, 0)],
        "bob": [("fact", None, 12, "declared", None, None, 0), ("memory", 3, None, "unknown", None, None, 0), ("memory", 2, None, "stored_after_dated", None, None, 0)],
    }


def test_one_side_or_both_empty(spark):
    memories, facts = made(n=40)
    m, f = spark.createDataFrame(memories, MEMORIES), spark.createDataFrame(facts, FACTS)
    assert told(timeline.folded(m.limit(0), f)) == plain([], facts)
    assert told(timeline.folded(m, f.limit(0))) == plain(memories, [])
    assert told(timeline.folded(m.limit(0), f.limit(0), limit=3)) == {}
