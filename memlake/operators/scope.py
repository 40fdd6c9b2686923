"""Filters that decide which memories a query may see, and set operations over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.schema import RETIRED_TAGS, RETRIEVABLE, TRANSITIONS


@dataclass(frozen=True)
class SessionFilter:
    """Conditions that all must hold; empty ones are not asked."""

    session_id: str | None = None
    session_prefix: str | None = None
    tags: Sequence[str] = field(default_factory=tuple)
    exclude_tags: Sequence[str] = field(default_factory=tuple)
    tier: str | None = None
    block_ids: Sequence[str] = field(default_factory=tuple)
    since: str | None = None
    until: str | None = None

    def column(self) -> Column:
        c = F.lit(True)
        if self.session_id is not None:
            c &= F.col("session_id") == self.session_id
        if self.session_prefix is not None:
            c &= F.col("session_id").startswith(self.session_prefix)
        for tag in self.tags:
            c &= F.array_contains("tags", tag)
        if self.exclude_tags:
            c &= ~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, self.exclude_tags))), F.lit(False))
        if self.tier is not None:
            c &= F.col("tier") == self.tier
        if self.block_ids:
            c &= F.col("block_id").isin(*self.block_ids)
        if self.since is not None:
            c &= F.col("created_at") >= F.lit(self.since).cast("timestamp")
        if self.until is not None:  # a bare date covers its day
            end = F.lit(self.until).cast("timestamp")
            c &= (F.col("created_at") < end + F.expr("interval 1 day")) if len(self.until) == 10 else (F.col("created_at") <= end)
        return c


def live(now: Column) -> Column:
    """Within its time to live; a memory without one, or without a date, stays."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return F.col("ttl_seconds").isNull() | F.coalesce(age <= F.col("ttl_seconds"), F.lit(True))


def retrievable(fragments: DataFrame, quarantined_blocks: DataFrame, now: Column, where: SessionFilter = SessionFilter()) -> DataFrame:
    """Memories recall may return: state, time to live and filter first, then not in a quarantined block."""
    seen = fragments.filter(F.col("state").isin(*RETRIEVABLE)).filter(live(now)).filter(where.column())
    return seen.join(quarantined_blocks.select("block_id"), "block_id", "left_anti")


def open_memories(fragments: DataFrame) -> DataFrame:
    return fragments.filter(~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, RETIRED_TAGS))), F.lit(False)))


def kind(tags: Column) -> Column:
    """The first kind tag's name."""
    found = F.filter(tags, lambda t: t.startswith("kind:"))
    return F.regexp_replace(F.try_element_at(found, F.lit(1)), "^kind:", "")


# Labels at the start of a memory, and the kinds they name.
LABELS = {"todo": "todo", "task": "todo", "bug": "bug", "issue": "bug", "fix": "fix", "fixed": "fix", "decision": "decision", "decided": "decision", "note": "note", "preference": "preference"}
STAMP = r"^\s*(?:\[(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)\]\s*)?"


def labelled_kind(content: Column) -> Column:
    """The kind that a leading label names, after an optional date stamp; or null."""
    label = F.lower(F.regexp_extract(content, STAMP + r"([A-Za-z]+)\s*:", 2))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), label)


def event_time(content: Column, declared: Column, stored: Column) -> Column:
    """When a memory's event was: as declared, else by its leading stamp, else when it was stored."""
    stamp = F.nullif(F.regexp_extract(content, STAMP, 1), F.lit(""))
    return F.coalesce(declared, F.try_to_timestamp(stamp), stored)


def page(fragments: DataFrame, offset: int, limit: int) -> DataFrame:
    return fragments.orderBy(F.col("importance").desc(), F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def allowed(spark, changes: DataFrame) -> DataFrame:
    """changes (id, state, new_state) with ok: whether the state machine has that step."""
    steps = spark.createDataFrame(list(TRANSITIONS), "state string, new_state string").withColumn("ok", F.lit(True))
    return changes.join(F.broadcast(steps), ["state", "new_state"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def missing(wanted: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return wanted.join(known.select(on), on, "left_anti")


def sync_delta(fragments: DataFrame, since: Column, synced: DataFrame) -> DataFrame:
    """Rows changed at or after the mark, without those already sent at that instant and quarantined ones."""
    changed = fragments.filter((F.col("created_at") >= since) & (F.col("state") != "quarantined"))
    return changed.join(synced.select("id", "created_at"), ["id", "created_at"], "left_anti")
