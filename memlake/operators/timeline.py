"""Timelines, conversations and histories as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.spans import spans


# What an event's place in a timeline rests on.
BASES = ("declared", "stored", "stored_after_dated", "unknown")


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[Column, ...], out: str) -> DataFrame:
    """out: the place of a row within its group, from 1; groups of any size."""
    parts = spans(rows, keys, order)
    rows = parts.carry({"__n": F.count("*")}, {"__ahead": lambda w: F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.withColumn(out, (F.row_number().over(parts.part) + F.coalesce("__ahead", F.lit(0))).cast("int")).drop("__p", "__ahead")


def two_clock(rows: DataFrame, subject: str, declared: str, stored: str, tie: str) -> DataFrame:
    """position and basis by two clocks that are never compared with each other: dated rows by declared time, then rows
    without one by storage: first those of unknown place, stored no later than the last dated row was, then those stored
    after it. Where a subject has no dated row, storage alone decides."""
    dated = F.col(declared).isNotNull()
    last = rows.groupBy(F.col(subject).alias("__s")).agg(F.max(F.when(dated, F.col(stored))).alias("__last"), F.bool_or(dated).alias("__dated"))
    rows = rows.join(last, F.col(subject).eqNullSafe(F.col("__s")), "left").drop("__s")
    basis = F.when(dated, "declared").when(~F.col("__dated"), "stored").when(F.col(stored) > F.col("__last"), "stored_after_dated").otherwise("unknown")
    rows = rows.withColumn("basis", basis).withColumn("__last", F.col("basis") == "stored_after_dated").drop("__dated")
    return numbered(rows, (subject,), (F.col(declared).asc_nulls_last(), F.col("__last"), F.col(stored), F.col(tie)), "position").drop("__last")


def folded(memories: DataFrame, known: DataFrame, since: Column | None = None, until: Column | None = None, limit: int | None = None) -> DataFrame:
    """One timeline a subject of memories (subject, id, text, declared, stored) and facts (subject, id, source, text,
    valid_from, recorded_at); ids are distinct.

    The first fact taken from a memory of its subject (by valid_from, recorded_at, id) folds into that memory's event;
    any other fact is an event of its own, dated by valid_from. Gives (subject, position, kind, memory_id, fact_id, text,
    at, basis, k, m, truncated): at is declared time or else storage time; k of m are set where several dated events
    share a day, and count what since and until (inclusive) or limit (the newest of each subject) cut away later;
    truncated tells how many events of the subject the limit cut. Null subjects have no timeline.
    """
    facts_in = known.filter("subject is not null").select("subject", "source", F.col("id").alias("fact_id"), F.col("text").alias("said"), "valid_from", F.coalesce("recorded_at", "valid_from").alias("noted"))
    kept = memories.filter("subject is not null").select("subject", F.col("id").alias("memory_id"), "text", "declared", "stored")
    # One pass over both tables, reduced before the shuffle: a memory's key meets the first of its facts.
    key = ["subject", "source"]
    first = F.min(F.when(F.col("fact_id").isNotNull(), F.struct(F.col("valid_from").isNull().alias("open"), "valid_from", "noted", "fact_id")))
    both = facts_in.select(*key, "valid_from", "noted", "fact_id").filter("source is not null").unionByName(kept.select("subject", F.col("memory_id").alias("source"), F.lit(True).alias("held")), allowMissingColumns=True)
    folds = both.groupBy(*key).agg(first.alias("first"), F.bool_or("held").alias("held")).filter("held and first is not null").select(*key, F.col("first.fact_id").alias("fact_id"))
    alone = facts_in.join(folds.select("subject", "fact_id"), ["subject", "fact_id"], "left_anti")
    events = kept.join(folds.withColumnRenamed("source", "memory_id"), ["subject", "memory_id"], "left").withColumn("kind", F.lit("memory"))
    own = alone.select("subject", "fact_id", F.col("said").alias("text"), F.col("valid_from").alias("declared"), F.col("noted").alias("stored"), F.lit("fact").alias("kind"))
    events = events.unionByName(own, allowMissingColumns=True).withColumn("at", F.coalesce("declared", "stored")).withColumn("__tie", F.struct("kind", "memory_id", "fact_id"))
    placed = two_clock(events, "subject", "declared", "stored", "__tie")
    # A day's dated events follow each other, so their first place and their number tell k of m.
    day = F.when(F.col("basis") == "declared", F.to_date("declared"))
    placed = placed.withColumn("__day", day)
    days = placed.filter("__day is not null").groupBy("subject", "__day").agg(F.min("position").alias("__first"), F.count("*").cast("int").alias("m")).filter("m > 1")
    placed = placed.join(days, ["subject", "__day"], "left").withColumn("k", F.col("position") - F.col("__first") + 1)
    if since is not None:
        placed = placed.filter(F.col("at").isNull() | (F.col("at") >= since))
    if until is not None:
        placed = placed.filter(F.col("at").isNull() | (F.col("at") <= until))
    placed = placed.withColumn("truncated", F.lit(0).cast("long"))
    if limit is not None:
        total = placed.groupBy("subject").agg(F.greatest(F.lit(0).cast("long"), F.count("*") - limit).alias("truncated"))
        newest_first = Window.partitionBy("subject").orderBy(F.desc("position"))
        placed = placed.drop("truncated").withColumn("__r", F.row_number().over(newest_first)).filter(F.col("__r") <= limit).join(total, "subject")
    return placed.select("subject", "position", "kind", "memory_id", "fact_id", "text", "at", "basis", "k", "m", "truncated")


def same_day(rows: DataFrame, subject: str, at: str, tie: str) -> DataFrame:
    """k and m of "k of m that day", where more than one event shares the day."""
    day = Window.partitionBy(subject, F.to_date(at))
    rows = rows.withColumn("k", F.row_number().over(day.orderBy(at, tie))).withColumn("m", F.count("*").over(day))
    return rows.filter("m > 1")


def newest(rows: DataFrame, subject: str, at: str, tie: str, n: int) -> DataFrame:
    """The newest n of each subject."""
    w = Window.partitionBy(subject).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def exchanges(turns: DataFrame) -> DataFrame:
    """One row for each user turn and the assistant turn that follows it at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = F.lead(F.struct("role", "text")).over(w)
    rows = turns.withColumn("__n", nxt).filter("role = 'user'")
    return rows.select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("__n.role") == "assistant", F.col("__n.text")).alias("answer"))


def keep_last(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, and its system turns."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("__r", F.row_number().over(w)).filter((F.col("__r") <= n) | (F.col("role") == "system")).drop("__r")


def unseen(turns: DataFrame) -> DataFrame:
    """Turns whose role and text did not occur earlier in the conversation."""
    w = Window.partitionBy("conv_id", "role", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy("turn")
    return turns.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Runs of a user's events with no longer gap between them."""
    parts = spans(events, ("user_id",), (F.col("ts"), F.col("event_id")))
    rows = parts.carry({"__end": F.max("ts")}, {"__prior": lambda w: F.lag("__end").over(w)})
    before = F.coalesce(F.lag("ts").over(parts.part), F.col("__prior"))
    rows = rows.withColumn("__far", F.coalesce((F.unix_micros("ts") - F.unix_micros(before) > gap_seconds * 1_000_000).cast("int"), F.lit(0))).drop("__prior")
    parts = parts.on(rows)
    rows = parts.carry({"__gaps": F.sum("__far")}, {"__ahead": lambda w: F.sum("__gaps").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    runs = rows.withColumn("__s", F.sum("__far").over(parts.so_far()) + F.coalesce("__ahead", F.lit(0)))
    return runs.groupBy("user_id", F.col("__s").alias("session")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def label(k: Column, m: Column) -> Column:
    return F.concat(k.cast("string"), F.lit(" of "), m.cast("string"))
