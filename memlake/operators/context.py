"""What a briefing and its lists need: tests of relevance and state, pairs of bugs and fixes, provenance, escapes, number words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The share of the best relevance that a briefing's line needs, and when a best vector stands out alone.
BRIEF_FLOOR, OUTLIER_LEAST, OUTLIER_MARGIN, OUTLIER_RATIO = 0.5, 0.25, 0.15, 2.0
LEAST_DEPTH, DEPTH_TIMES = 50, 5
UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}


def depth(top_k: Column) -> Column:
    """Rows that each channel fetches for so many results."""
    return F.greatest(F.lit(LEAST_DEPTH).cast("long"), top_k * DEPTH_TIMES)


def above_floor(ranked: DataFrame, shared: str, least: float = BRIEF_FLOOR) -> DataFrame:
    """Rows with at least half of the query's best relevance that share a word with it.

    The best is pre-aggregated and joined back, so no task holds all rows of a query.
    """
    best = ranked.groupBy("query_id").agg(F.max("relevance").alias("__best"))
    return ranked.join(best, "query_id").filter((F.col("relevance") >= least * F.col("__best")) & (F.col(shared) > 0)).drop("__best")


def outliers(scored: DataFrame, score: str = "cosine") -> DataFrame:
    """(query_id, outlier): whether the best score stands out: high enough, and far enough above the second.

    The two largest are found by pre-aggregation: the largest, then the largest of the others.
    """
    best = scored.groupBy("query_id").agg(F.max_by("id", F.struct(score, -F.col("id"))).alias("__id"), F.max(score).alias("best"))
    rest = scored.join(best.select("query_id", "__id"), "query_id").filter("id <> __id").groupBy("query_id").agg(F.max(score).alias("second"))
    both = best.join(rest, "query_id", "left").withColumn("second", F.coalesce("second", F.lit(0.0)))
    alone = (F.col("best") >= OUTLIER_LEAST) & (F.col("best") - F.col("second") >= OUTLIER_MARGIN) & (F.col("best") >= OUTLIER_RATIO * F.col("second"))
    return both.select("query_id", "best", "second", alone.alias("outlier"))


def fact_states(events: DataFrame) -> DataFrame:
    """state of each fact: current, or by the next of its subject and attribute repeated or outdated."""
    w = Window.partitionBy("subject", "attribute").orderBy("valid_from", "seq")
    after = F.lead(F.struct("value", "seq")).over(w)
    state = F.when(F.col("__n").isNull(), "current").when(F.col("__n.value").eqNullSafe(F.col("value")), "repeated").otherwise("outdated")
    return events.withColumn("__n", after).withColumn("state", state).drop("__n")


# Own rules: how a user's turn begins that asks for something, and words of a report of an error.
REQUEST = r"^\s*(please|can you|could you|show|list|give|write|add|make|tell)(\W|$)"
ERROR = r"\b(error|exception|traceback|failed)\b"


def provenance(role: Column, text: Column) -> Column:
    """Who speaks, and how: assistant, question, request, error or statement."""
    low = F.lower(text)
    return F.when(role == "assistant", "assistant").when(text.rlike(r"\?\s*$"), "question").when(low.rlike(REQUEST), "request").when(low.rlike(ERROR), "error").otherwise("statement")


def paired_fixes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Fixes with bug: the newest bug of the same agent or session (by) before them.

    One pass in time order carries the last bug along, so fixes never meet all bugs of a session.
    """
    rows = rows.filter(F.arrays_overlap("tags", F.array(F.lit("kind:bug"), F.lit("kind:fix"))))
    w = Window.partitionBy(*by).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    bug = F.last(F.when(F.array_contains("tags", "kind:bug"), F.col("id")), ignorenulls=True).over(w)
    return rows.withColumn("bug", bug).filter(F.array_contains("tags", "kind:fix") & F.col("bug").isNotNull())


def encoded(features: list[Column], size: int) -> Column:
    """Features padded with zeros to a vector of the size, scaled to length one."""
    values = F.array(*[f.cast("double") for f in features], *[F.lit(0.0)] * (size - len(features)))
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(values, lambda x: F.when(length > 0, x / length).otherwise(x))


def clamped(score: Column) -> Column:
    """A reward between -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def escape_tags(text: Column) -> Column:
    """Text in which no tag is one."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def like_pattern(text: Column) -> Column:
    """A pattern of LIKE that matches the text itself."""
    for mark in ("\\", "%", "_"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def quoted_phrase(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def defused(text: Column) -> Column:
    """Marks of a prompt's boundaries with other brackets."""
    return F.regexp_replace(text, r"<(\|?/?(?:system|assistant|user|im_start|im_end|endoftext)\|?)>", "‹$1›")


def addresses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\w.+-]+@[\w-]+\.[\w.]+)"), F.lit(1))


def spelled(n: Column) -> Column:
    """Numbers from 1 to 99 as words."""
    unit = F.element_at(F.array(*map(F.lit, UNITS)), F.when(n < 20, n).otherwise(F.greatest(n % 10, F.lit(1))))
    ten = F.element_at(F.array(*map(F.lit, TENS)), F.greatest((n / 10).cast("int") - 1, F.lit(1)))
    return F.when(n < 20, unit).when(n % 10 == 0, ten).otherwise(F.concat_ws("-", ten, unit))


def number_of(words: Column) -> Column:
    """The number below a hundred that words say, as cardinals or ordinals; else null."""
    names = {w: i + 1 for i, w in enumerate(UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)} | ORDINALS
    names |= {w + "th": n for w, n in names.items() if w not in ORDINALS} | {w[:-1] + "ieth": n for w, n in names.items() if w.endswith("ty")}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.split(F.lower(F.trim(words)), r"[\s-]+")
    value = F.transform(parts, lambda w: F.try_element_at(known, w))
    good = F.forall(value, lambda v: v.isNotNull()) & ((F.size(value) == 1) | ((F.size(value) == 2) & (value[0] >= 20) & (value[0] % 10 == 0) & (F.try_element_at(value, F.lit(2)) < 10)))
    return F.when(good, F.aggregate(value, F.lit(0), lambda s, v: s + v))


def sequence_unit(text: Column) -> Column:
    """(unit, number) of a text such as "Step four of" or "day 2"."""
    found = F.lower(F.regexp_extract(text, r"(?i)\b(step|day|part|phase|chapter|week)\s+(\d+|[a-z-]+)\b", 1))
    number = F.lower(F.regexp_extract(text, r"(?i)\b(step|day|part|phase|chapter|week)\s+(\d+|[a-z-]+)\b", 2))
    n = F.when(number.rlike(r"^\d{1,9}$"), number.try_cast("int")).otherwise(number_of(number))
    return F.when((found != "") & n.isNotNull(), F.struct(found.alias("unit"), n.alias("number")))


def in_sequence(ranked: DataFrame) -> DataFrame:
    """place: rows of a sequence (query_id, rank, content) stand in its order where the first of them stood; the others keep theirs."""
    rows = ranked.withColumn("__u", sequence_unit(F.col("content")))
    w = Window.partitionBy("query_id", "__u.unit")
    start = F.when(F.col("__u").isNotNull(), F.min("rank").over(w)).otherwise(F.col("rank"))
    rows = rows.withColumn("__at", start)
    order = Window.partitionBy("query_id").orderBy("__at", F.coalesce(F.col("__u.number"), F.lit(0)), "rank")
    return rows.withColumn("place", F.row_number().over(order)).drop("__u", "__at")


# People one may speak of as one's own.
RELATIONS = "mother father sister brother son daughter wife husband partner friend boss colleague aunt uncle cousin".split()


def missing_relations(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, relation) that a question names as the asker's own and no fact (attribute) knows."""
    named = F.regexp_extract_all(F.lower("query"), F.lit(rf"\bmy ({'|'.join(RELATIONS)})\b"), F.lit(1))
    asked = queries.select("query_id", F.explode(F.array_distinct(named)).alias("relation"))
    return asked.join(facts.select(F.lower("attribute").alias("relation")).distinct(), "relation", "left_anti")


def names_in_view(turns: DataFrame, view: int) -> DataFrame:
    """(conv_id, turn, names) of stored turns (conv_id, turn, names mentioned): what was mentioned in so many turns up to each."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-(view - 1), 0)
    return turns.select("conv_id", "turn", F.array_sort(F.array_distinct(F.flatten(F.collect_list("names").over(w)))).alias("names"))


def corrections(claims: DataFrame, chained: DataFrame) -> DataFrame:
    """Claims (subject, attribute, value) that were so once and are not any more, with the value that holds now.

    chained has valid_to; a value that holds again is no mistake.
    """
    key = ["subject", "attribute"]
    now = chained.filter("valid_to is null").select(*key, F.col("value").alias("current"))
    ended = chained.filter("valid_to is not null").select(*key, "value").distinct()
    return claims.select(*key, "value").distinct().join(ended, [*key, "value"], "left_semi").join(now, key).filter("value <> current")


# Fixed value: memories that a query's dates may bring in.
DATED = 50


def dated_candidates(fragments: DataFrame, ranges: DataFrame, most: int = DATED) -> DataFrame:
    """(query_id, id): the most important memories whose day lies in a range (query_id, start, end), in a store of any size.

    Ranges are as few as the queries and travel to the memories; each task keeps `most` rows a query before the shuffle.
    """
    day = F.to_date("created_at")
    inside = fragments.join(F.broadcast(ranges), (day >= F.col("start")) & (day <= F.col("end")))
    w = Window.partitionBy("query_id").orderBy(F.col("importance").desc(), F.col("created_at").desc(), F.col("id").desc())
    found = inside.select("query_id", "id", "importance", "created_at").dropDuplicates(["query_id", "id"])
    return found.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).select("query_id", "id")
