"""Writes, revisions, forgetting, membership and messages as table rewrites: frames in, frames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import digests
from memlake.functions.arrow import over
from memlake.functions.words import STOP
from memlake.operators.text import validated, write_policy
from memlake.schema import TRUST


def remember(rows: DataFrame, known: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(new memories, report) of a batch (agent_id, key, content).

    Ids follow from agent, key, the repeat's number and the text, so a batch written
    twice adds nothing. The report names each row: stored, existing, rejected or
    quarantined, with the reason.
    """
    checked = validated(rows, text)
    w = Window.partitionBy("agent_id", "key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).orderBy(F.lit(0))
    numbered = checked.withColumn("index", F.row_number().over(w))
    given = numbered.withColumn("id", over(digests.write_id, "string", "agent_id", "key", "index", F.coalesce(F.col(text), F.lit(""))))
    screened = write_policy(given, text)
    marked = screened.join(known.select("id", F.lit(True).alias("__known")), "id", "left")
    what = F.when(F.col("reject_reason").isNotNull(), "rejected").when(F.col("__known"), "existing").when(~F.col("accepted"), "quarantined").otherwise("stored")
    why = F.coalesce("reject_reason", F.nullif(F.array_join("reasons", ","), F.lit("")))
    marked = marked.withColumn("outcome", what).withColumn("reason", why).drop("__known")
    stored = marked.filter(F.col("outcome").isin("stored", "quarantined")).withColumn("state", F.when(F.col("outcome") == "stored", "unverified").otherwise("quarantined"))
    return stored.select("id", "agent_id", text, "kinds", "state"), marked.select("id", "agent_id", "outcome", "reason")


def supersede(fragments: DataFrame, updates: DataFrame) -> DataFrame:
    """fragments after updates (old_id, id, content): old rows are tagged and name their successor, new ones inherit."""
    old = fragments.join(updates.select(F.col("old_id").alias("id"), F.col("id").alias("superseded_by")), "id", "left")
    old = old.withColumn("tags", F.when(F.col("superseded_by").isNotNull(), F.array_union("tags", F.array(F.lit("superseded")))).otherwise(F.col("tags")))
    base = fragments.drop("content").withColumnRenamed("id", "old_id")
    new = updates.join(base, "old_id").drop("old_id").withColumn("superseded_by", F.lit(None).cast(fragments.schema["id"].dataType))
    return old.unionByName(new.select(*old.columns))


def resolve(fragments: DataFrame, ids: DataFrame) -> DataFrame:
    """Todos and bugs of ids get the tag resolved, once; other kinds stay."""
    hit = fragments.join(ids.select("id", F.lit(True).alias("__hit")), "id", "left")
    ok = F.col("__hit") & F.arrays_overlap("tags", F.array(F.lit("kind:todo"), F.lit("kind:bug")))
    return hit.withColumn("tags", F.when(F.coalesce(ok, F.lit(False)), F.array_union(F.array_except("tags", F.array(F.lit("open"))), F.array(F.lit("resolved")))).otherwise(F.col("tags"))).drop("__hit")


def matching(fragments: DataFrame, phrase: str, most: int = 50) -> DataFrame:
    """Preview of what forgetting a phrase would take: whole words, whatever the case; too short or empty phrases match nothing."""
    words = phrase.lower().split()
    if len(phrase.strip()) < 3 or all(w in STOP for w in words):
        return fragments.limit(0)
    quoted = r"\Q" + phrase.strip().replace(r"\E", "") + r"\E"
    hit = fragments.filter(F.col("content").rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])"))
    return hit.orderBy("id").limit(most)


def forget(fragments: DataFrame, facts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the forgotten memories and the facts drawn from them; facts chain anew when read."""
    gone = ids.select("id").distinct()
    return fragments.join(gone, "id", "left_anti"), facts.join(gone.withColumnRenamed("id", "source_fragment_id"), "source_fragment_id", "left_anti")


def store_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose content is not stored yet, the first of each content."""
    rows = docs.withColumn("digest", F.sha2("content", 256))
    first = rows.groupBy("digest").agg(F.min("id").alias("id"))
    return rows.join(first, ["digest", "id"]).join(known.select("digest"), "digest", "left_anti")


def join_block(blocks: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) members (block_id, id): only open blocks take members, unknown ones are refused too."""
    state = members.join(blocks.select("block_id", "status"), "block_id", "left")
    ok = F.coalesce(F.col("status") == "open", F.lit(False))
    why = F.when(F.col("status").isNull(), "unknown block").otherwise(F.concat(F.lit("block is "), "status"))
    return state.filter(ok).drop("status"), state.filter(~ok).withColumn("reason", why).drop("status")


def protected(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Members of sealed blocks, which pruning and merging leave alone."""
    return members.join(blocks.filter("status = 'sealed'").select("block_id"), "block_id", "left_semi").select("id").distinct()


def signed_trust(messages: DataFrame, secret: str) -> DataFrame:
    """trust as published where the signature is right, else unknown; with its rank."""
    right = over(lambda p, t, s: s == digests.signature(secret, p, t or ""), "boolean", "publisher", "trust", "signature")
    trust = F.when(F.coalesce(right, F.lit(False)), F.col("trust")).otherwise("unknown")
    rank = F.element_at(F.create_map(*[x for k, v in TRUST.items() for x in (F.lit(k), F.lit(v))]), F.col("trust"))
    return messages.withColumn("trust", trust).withColumn("rank", F.coalesce(rank, F.lit(0)))


def lowest_trust(messages: DataFrame, by: str) -> DataFrame:
    return messages.groupBy(by).agg(F.min_by("trust", "rank").alias("trust"), F.min("rank").alias("rank"))


def sketched(fragments: DataFrame, key: str = "") -> DataFrame:
    """id and keyed sketch of each memory's words, for search over text that is kept encrypted."""
    return fragments.select("id", over(lambda t: digests.sketch(sorted(set(t.lower().split())), key), "binary", "content").alias("sketch"))


def may_hold(sketches: DataFrame, words: list[str], key: str = "") -> DataFrame:
    asked = digests.sketch([w.lower() for w in words], key)
    return sketches.filter(over(lambda s: digests.may_hold(s, asked), "boolean", "sketch")).select("id")


def verified(fragments: DataFrame) -> DataFrame:
    """state: contradicted where the content no longer has its digest."""
    ok = F.sha2("content", 256) == F.col("content_hash")
    return fragments.withColumn("state", F.when(F.coalesce(ok, F.lit(True)), F.col("state")).otherwise("contradicted"))


def audit(events: DataFrame, by: str, passed: Column) -> DataFrame:
    """passed and rejected counts by reason."""
    return events.groupBy(by).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("rejected"))


def percentiles(rows: DataFrame, value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.agg(p.alias("p")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))
