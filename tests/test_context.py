from pyspark.sql import functions as F

from memlake.operators import context


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_number_words(spark):
    said = ["seven", "Forty", "twenty-one", "ninety nine", "third", "fortieth", "sixty-second", "hundred", "one two", "", "forty-twenty"]
    assert col(spark, said, context.number_of) == [7, 40, 21, 99, 3, 40, 62, None, None, None, None]


def test_sequences_stand_together(spark):
    assert [x and tuple(x) for x in col(spark, ["Step four of the recipe", "on day 12", "a step back", "no part"], context.sequence_unit)] == [("step", 4), ("day", 12), None, None]
    rows = spark.createDataFrame([(1, 1, "intro"), (1, 2, "step 3: bake"), (1, 3, "aside"), (1, 4, "Step one: mix"), (1, 5, "step two: rest")], "query_id long, rank int, content string")
    assert [r.content for r in context.in_sequence(rows).orderBy("place").collect()] == ["intro", "Step one: mix", "step two: rest", "step 3: bake", "aside"]


def test_escapes(spark):
    assert col(spark, ["<a href=\"x\">it's & so</a>", None], context.escape_tags) == ["&lt;a href=&quot;x&quot;&gt;it&#x27;s &amp; so&lt;/a&gt;", None]
    assert col(spark, ["50%_\\"], context.like_pattern) == ["50\\%\\_\\\\"] and col(spark, ['say "hi"'], context.quoted_phrase) == ['"say ""hi"""']
    assert col(spark, ["<|im_start|>go</b>", "a < b"], context.defused) == ["‹|im_start|›go</b>", "a < b"]


def test_relations_that_memory_lacks(spark):
    asked = spark.createDataFrame([(1, "When does my sister visit my Mother?"), (2, "my sisters"), (3, None)], "query_id long, query string")
    known = spark.createDataFrame([("Sister",)], "attribute string")
    assert [tuple(r) for r in context.missing_relations(asked, known).select("query_id", "relation").collect()] == [(1, "mother")]


def test_provenance_pairs_and_states(spark):
    rows = [("assistant", "Is it?"), ("user", "Is it? "), ("user", "Please look"), ("user", "it failed again"), ("user", "pleased to see"), ("user", None)]
    df = spark.createDataFrame(rows, "role string, text string")
    assert [r.p for r in df.select(context.provenance(F.col("role"), F.col("text")).alias("p")).collect()] == ["assistant", "question", "request", "error", "statement", "statement"]
    fixes = spark.createDataFrame([(1, "a", 1, ["kind:bug"]), (2, "a", 2, ["kind:bug"]), (3, "a", 3, ["kind:note"]), (4, "a", 4, ["kind:fix"]), (5, "b", 5, ["kind:fix"])], "id long, g string, created_at long, tags array<string>")
    assert [(r.id, r.bug) for r in context.paired_fixes(fixes, ["g"]).collect()] == [(4, 2)]


def test_outliers_and_floor(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.3), (2, 1, 0.5), (2, 2, 0.45), (3, 1, 0.4), (4, 1, 0.8), (4, 2, 0.8)], "query_id long, id long, cosine double")
    assert {r.query_id: r.outlier for r in context.outliers(rows).collect()} == {1: True, 2: False, 3: True, 4: False}
    ranked = spark.createDataFrame([(1, 1, 0.8, 1.0), (1, 2, 0.4, 0.2), (1, 3, 0.39, 1.0), (1, 4, 0.7, 0.0)], "query_id long, id long, relevance double, shared double")
    assert sorted(r.id for r in context.above_floor(ranked, "shared").collect()) == [1, 2]
    v = col(spark, [3.0, 0.0], lambda c: context.encoded([c, F.lit(4.0) * F.signum(c)], 5), "double")
    assert v == [[0.6, 0.8, 0.0, 0.0, 0.0], [0.0] * 5] and col(spark, [5.0, -2.0, 0.25], context.clamped, "double") == [1.0, -1.0, 0.25]


def test_best_window_against_all_windows():
    import random

    from memlake.functions.passages import best_window
    from memlake.functions.words import WORD, stem

    rng = random.Random(4)
    vocab = ["harbour", "crane", "gull", "rope", "tide", "buoy", "a", "the"]
    weights = {stem("crane"): 3.0, stem("tide"): 2.0, stem("buoy"): 2.5}
    for _ in range(60):
        text = " ".join(rng.choice(vocab) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randrange(1, 60)))
        begin, end = best_window(text, weights, 60)
        assert 0 <= begin <= end <= len(text) and end - begin <= 60
        value = lambda a, b: sum({stem(m[0]): weights.get(stem(m[0]), 0) for m in WORD.finditer(text) if a <= m.start() and m.end() <= b}.values())  # noqa: E731, B023
        starts = [m.start() for m in WORD.finditer(text)]
        assert value(begin, end) >= max(value(a, a + 60) for a in starts) - 1e-9
    assert best_window("", weights) == (0, 0) and best_window("x" * 900, weights) == (0, 400)


def test_more_facts():
    from memlake.functions.extract import facts

    text = "Ana works as a baker. Bo is 41 years old. Bo speaks Dutch, Frisian and German. The desk costs $120. Ana's boss is Eve. Eve is allergic to [REDACTED:pin].\nexport DB_HOST=db1.local\nEmails for Ana: a@x.org, b@x.org\nBo has an appointment with Dr Kim."
    want = {("ana", "occupation", "baker"), ("bo", "age", "41"), ("bo", "language", "Dutch"), ("bo", "language", "Frisian"), ("bo", "language", "German"), ("desk", "price", "$120"), ("ana", "manager", "Eve"), ("environment", "db host", "db1.local"), ("ana", "email", "a@x.org"), ("ana", "email", "b@x.org"), ("bo", "appointment", "Dr Kim")}
    assert want <= set(facts(text)) and not any(a == "allergy" for _, a, _ in facts(text))
    assert facts("Ana uses " + "v" * 300 + ".") == [("ana", "uses", "v" * 300)]
