import pytest
from pyspark.sql import functions as F

from memlake.functions import questions as q
from memlake.operators import ordering


@pytest.mark.parametrize(
    "text, want",
    [
        ("Which plan is in force now?", "current"), ("the newest colour of the door", "current"), ("is she still vegetarian", "current"), ("where does the heron nest these days", "current"),
        ("What did we initially call it?", "original"), ("the earliest draft", "original"), ("where did he use to live before?", "original"), ("she used to cycle", "original"),
        ("who arrived first", "none"), ("what is her last name", "none"), ("what peak current does the fuse bear", "none"), ("is first aid taught here", "none"), ("what's our present supplier of rope", "current"), ("Mara's former berth", "original"), ("the rope was used to moor", "none"), ("which sales did we close last month?", "none"), ("colour of the door", "none"),
        ("did the initial colour change, and which is it now?", "current"),
    ],
)
def test_time_asked(text, want):
    assert q.time_asked(text) == want


@pytest.mark.parametrize("text, want", [("show pending tasks", ("todo", True)), ("are any bugs not fixed?", ("bug", True)), ("which snippets do you have", ("snippet", False)), ("List all the preferences", ("preference", False)), ("write a fix for the parser", None), ("who made the decision about paint?", None), ("remaining action items", ("todo", True)), ("", None)])
def test_kind_asked(text, want):
    assert q.kind_asked(text) == want


def test_classes():
    easy = q.classify("Where is the spare key?")
    assert easy["policy"] == "fast" and easy["factual"] and easy["depth"] == 1 and not easy["temporal"] and "spare" in easy["keywords"] and "the" not in easy["keywords"]
    hard = q.classify("Explain why Heron beats Osprey in detail, then contrast their costs before and after April 2025, without naming suppliers")
    assert hard["policy"] == "deep" and hard["depth"] == 3 and all(hard[x] for x in ("multi_hop", "multi_entity", "comparison", "temporal", "negation", "reasoning"))
    assert q.classify("Why did the pump stop?")["policy"] == "balanced" and q.classify("")["complexity"] == 0
    assert q.classify("the mill doesn't turn")["negation"] and not q.classify("What does Ana wear?")["multi_entity"]


@pytest.mark.parametrize(
    "new, old, want",
    [
        ("The bakery relocated from Elm Street to Mill Lane", "The bakery is on Elm Street", True), ("mill-two changed to weekly cleaning shifts", "mill-one has weekly cleaning shifts", False),
        ("The soup was salty", "The bakery is on Elm Street", False), ("CORRECTION: choir practice starts Tuesday evening", "choir practice starts Monday evening", True),
        ("We use oat milk instead of cow milk", "the café buys cow milk", True), ("Updated the poster", "choir practice starts Monday evening", False),
    ],
)
def test_supersedes(new, old, want):
    assert q.supersedes(new, old) is want


def test_replaced_values():
    assert q.replaced("Moved from the old barn to town; uses chalk rather than paint, and no longer sells hay.") == ["the old barn", "paint", "sells hay"]
    assert q.replaced("a letter from home") == []


def test_lists_are_reordered(spark):
    rows = [(1, 10, 1, "The api lives in Lisbon", "2026-01-01", "none"), (1, 11, 2, "Lunch at noon", "2026-01-02", "none"), (1, 12, 3, "We moved the api from Lisbon to Porto", "2026-01-03", "none")]
    df = spark.createDataFrame(rows + [(2, *r[1:5], "original") for r in rows], "query_id long, id long, rank int, content string, event_time string, asked string").withColumn("event_time", F.col("event_time").cast("timestamp"))
    got = {(r.query_id, r.id): (r.place, r.state) for r in ordering.by_supersession(df).collect()}
    assert got[1, 12] == (1, "current") and got[1, 10] == (2, "outdated") and got[1, 11] == (3, None) and got[2, 10][0] == 1
    band = ordering.temporal_band(df.filter("query_id = 1").withColumn("asked", F.lit("current")).withColumn("band", F.col("id") != 11))
    assert [r.id for r in band.orderBy("place").collect()] == [12, 10, 11]


def test_hops_render_and_reinforce(spark):
    frags = spark.createDataFrame([(1, "Ask about svc-alpha owner"), (2, "notes: svc-alpha belongs to Mara"), (3, "unrelated"), (4, "more on svc-alpha"), (5, "again svc-alpha")], "id long, content string")
    src = spark.createDataFrame([(7, 1, 1, 0.8, "who owns it", "Ask about svc-alpha owner")], "query_id long, id long, rank int, relevance double, query string, content string")
    assert sorted((r.id, r.bridge, round(r.relevance, 2)) for r in ordering.hops(src, frags).collect()) == [(2, "svc alpha", 0.56), (4, "svc alpha", 0.56)]
    full = frags.withColumn("importance", F.lit(0.98)).withColumn("access_count", F.lit(1).cast("long"))
    res = spark.createDataFrame([(2, 0.9), (3, 0.1), (2, 0.2)], "id long, relevance double")
    got = {r.id: (round(r.importance, 2), r.access_count) for r in ordering.reinforce(full, res, 0.4, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got == {1: (0.98, 1), 2: (1.0, 2), 3: (0.98, 2), 4: (0.98, 1), 5: (0.98, 1)}
    text = ordering.render(frags.withColumn("g", F.lit(1)), "g", "id", F.col("content"), 20).first().text
    assert text == "1. Ask about svc-alpha owner\n2. notes: svc-alpha belongs to Mara"
