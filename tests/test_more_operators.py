import json

from pyspark.sql import functions as F

from memlake.functions import chunks, extract, screening, words
from memlake.operators import brief, facts, lifecycle, recall, scope, text
from memlake.plans import texts


def test_segments():
    assert words.segment("naïve_x 東京都に 都 🦉€ a-b") == ["naïve_x", "東京", "京都", "都に", "都", "🦉", "€", "a", "b"]
    assert words.embed("東京都") != words.embed("東京")


def test_json_is_redacted_by_structure():
    got = json.loads(screening.redact_json('{"db_password": "x", "max_tokens": 5, "n": [{"api_key": "k"}, "AKIA' + 'IOSFODNN7EXAMPLE"], "é": null}'))
    assert got["db_password"] == "[REDACTED:secret]" and got["max_tokens"] == 5 and got["n"] == [{"api_key": "[REDACTED:secret]"}, "[REDACTED:aws_access_key_id]"] and got["é"] is None
    assert "Hunter2" not in screening.redact_json("password=Hunter2!xyz {")


def test_labels_and_event_times(spark):
    rows = spark.createDataFrame([(1, "[2026-03-01 10:00] TODO: x", None), (2, "Bug: y", "2026-01-05"), (3, "plain: z", None), (4, "[2026-99-99] note: q", None)], "id long, content string, d string")
    got = {r.id: (r.k, str(r.t)) for r in rows.select("id", scope.labelled_kind(F.col("content")).alias("k"), scope.event_time(F.col("content"), F.col("d").cast("timestamp"), F.lit("2020-01-01").cast("timestamp")).alias("t")).collect()}
    assert got == {1: ("todo", "2026-03-01 10:00:00"), 2: ("bug", "2026-01-05 00:00:00"), 3: (None, "2020-01-01 00:00:00"), 4: ("note", "2020-01-01 00:00:00")}


def test_closed_todos_against_all_pairs(spark):
    import random

    rng, vocab = random.Random(1), [f"w{i}" for i in range(14)]
    rows = [(i, i % 2, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 8))), f"2026-01-{1 + i % 28:02d}") for i in range(70)]
    df = spark.createDataFrame(rows, "id long, g long, content string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    s = {i: set(c.split()) for i, _, c, _ in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] % 5 == 0 and a[0] != b[0] and a[1] == b[1] and b[3] > a[3] and len(s[a[0]] & s[b[0]]) >= 0.6 * len(s[a[0]])}
    assert {(r.todo, r.closer) for r in lifecycle.closed_todos(df.filter("id % 5 = 0"), df, "g").collect()} == want and want


def test_facts_named_by_questions(spark):
    q = spark.createDataFrame([(1, "What port does atlas-core use?"), (2, "tell me about Mara")], "query_id long, query string")
    known = spark.createDataFrame([("atlas core", "owner", "Bo"), ("atlas core", "port", "80"), ("atlas", "port", "1"), ("core", "x", "2"), ("mara", "role", "lead")], "subject string, attribute string, value string")
    got = {(r.query_id, r.subject, r.attribute) for r in facts.matching(q, known, most=1).collect()}
    assert got == {(1, "atlas core", "port"), (1, "atlas", "port"), (1, "core", "x"), (2, "mara", "role")}


def test_dates_kinds_and_floor_shape_the_list(spark):
    rows = spark.createDataFrame([(1, 1, "What happened in March 2026?", "2026-03-05", 0.8, ["kind:todo", "open"]), (1, 2, "What happened in March 2026?", "2026-04-05", 1.0, ["kind:note"]), (2, 1, "open todos", "2026-01-01", 1.0, ["kind:todo", "resolved"]), (2, 2, "open todos", "2026-01-01", 0.8, ["kind:todo", "open"]), (3, 1, "in May 2026", "2026-01-01", 1.0, ["open"])], "query_id long, rank long, query string, t string, seed double, tags array<string>")
    rows = rows.withColumn("event_time", F.col("t").cast("timestamp"))
    got = {(r.query_id, r["rank"]): (round(r.seed, 2), r.window_gap) for r in recall.in_dates(rows, "2026-10-01").collect()}
    assert got == {(1, 1): (0.8, False), (1, 2): (0.7, False), (2, 1): (1.0, False), (2, 2): (0.8, False), (3, 1): (0.7, True)}
    assert {(r.query_id, r["rank"]): r.seed for r in recall.of_kind(rows).collect()}[2, 1] == 0.5
    assert [r.seed for r in recall.running_floor(rows, "seed").orderBy("query_id", "rank").collect()] == [0.8, 0.8, 1.0, 0.8, 1.0]


def test_statements_of_users_and_of_the_past():
    got = extract.statements("I live in Lisbon. I used to work at Acme. My favourite colour is blue. I like tea.")
    assert {("add", "user", "location", "Lisbon"), ("previous", "user", "employer", "Acme"), ("add", "user", "favourite colour", "blue"), ("add", "user", "likes", "tea"), ("retract", "user", "dislikes", "tea")} <= set(got)
    assert ("retract", "billing", "uses", "MySQL") in extract.statements("Billing no longer uses MySQL.")
    assert {("previous", "billing", "uses", "MySQL"), ("add", "billing", "uses", "Postgres")} <= set(extract.statements("Billing switched from MySQL to Postgres."))


def test_statements_become_a_chain(spark):
    rows = spark.createDataFrame([(1, "Billing switched from MySQL to Postgres.", "2026-01-02"), (2, "Billing no longer uses Postgres.", "2026-01-05"), (3, "Billing no longer uses Oracle.", "2026-01-06")], "id long, content string, t string")
    said = text.statements(rows, "id", "content").join(rows.select("id", F.col("t").cast("timestamp").alias("at")), "id").withColumn("seq", F.col("id"))
    got = [(r.value, str(r.valid_to)[:10]) for r in facts.chain(facts.from_statements(said)).orderBy("valid_from").collect()]
    assert got == [("MySQL", "2026-01-02"), ("Postgres", "2026-01-05"), (None, "None")]


def test_briefings_fill_sections_in_order_and_fit(spark):
    frags = spark.createDataFrame([(i, "a", f"TODO: thing {i}", ["open"], f"2026-01-{i:02d}") for i in range(1, 10)] + [(50, "a", "Decision: go", ["kind:decision", "resolved"], "2026-01-01"), (51, "b", "note", ["kind:note"], "2026-01-01")], "id long, agent_id string, content string, tags array<string>, t string")
    frags = frags.withColumn("created_at", F.col("t").cast("timestamp"))
    events = spark.createDataFrame([("svc", "port", "80", "2026-01-01", 1), ("svc", "port", "81", "2026-01-02", 2)], "subject string, attribute string, value string, t string, seq long")
    events = events.withColumn("valid_from", F.col("t").cast("timestamp")).withColumn("recorded_at", F.col("valid_from"))
    rows = brief.lines(frags, events, F.lit("a"), F.lit("2026-06-01").cast("timestamp"))
    assert rows.groupBy("section").count().orderBy("section").collect() == [("fact", 1), ("todo", 6)]
    got = brief.briefing(rows, 24).collect()
    assert [r.agent_id for r in got] == ["a"] and got[0].text.split("\n")[:2] == ["svc port is 81", "- TODO: thing 9"] and len(got[0].text) <= 24 * 4


def test_a_briefing_takes_every_line_that_fits(spark, tables):
    docs = [(i, f"{i} " + "long " * 40 if i < 60 else f"note {i}" * (i % 5), "en", "a", 0) for i in range(1, 120)]
    labels = [(i, 1, 0) for i in range(1, 60)]
    path = tables(documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels=(labels, "doc_id long, quality int, toxic int"))
    still = sorted((0.2 if i < 60 else 0.5, i, t[:160]) for i, t, *_ in docs if i % 10)
    want = [still[k][2] for k in chunks.fit([(p, t) for p, _, t in still], 200)]
    got = sorted(texts.briefing(spark, path).collect(), key=lambda r: r.place)
    assert [r.line for r in got] == want and any(t.startswith("note") for t in want) and not any(t.startswith("10 ") for t in want)
