"""Queries of scans, writes, membership, messages, files and signals, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import context, facts, graph, lifecycle, recall, scope, store, timeline
from memlake.plans.catalog import FUSE_SQL, _reranked, now, query, six
from memlake.sources import portability
from memlake.sources import tables as src
from memlake.sources.shared import ensure_checkpoint_dir
from memlake.streaming import replay

FRAGS = src.FRAGMENTS_SQL
WORD_SQL = r"'[\p{L}\p{N}_]+'"


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}_{uuid.uuid4().hex}"


# Scans.


@query("SELECT id, state, tier FROM fragments WHERE id = 42", FRAGS)
def point_lookup(spark, sf):
    return src.fragments(spark, sf).filter("id = 42").select("id", "state", "tier")


@query("SELECT id, agent_id FROM fragments WHERE id IN (1, 5, 8, 13, 21, 34, 55, 89, 144)", FRAGS)
def multi_get(spark, sf):
    wanted = spark.createDataFrame([(i,) for i in (1, 5, 8, 13, 21, 34, 55, 89, 144)], "id long")
    return src.fragments(spark, sf).join(F.broadcast(wanted), "id", "left_semi").select("id", "agent_id")


@query("SELECT id, session_id, importance, access_count FROM fragments", FRAGS)
def full_scan(spark, sf):
    return src.fragments(spark, sf).select("id", "session_id", "importance", "access_count")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id > 50 ORDER BY vec_id LIMIT 100")
def keyset_page(spark, sf):
    """The page of a hundred vectors behind the last id that was seen."""
    return src.table(spark, sf, "embeddings").filter("vec_id > 50").orderBy("vec_id").limit(100).select("vec_id", "label")


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'license')")
def content_scan(spark, sf):
    return src.table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("license"))).select(F.col("doc_id").alias("id"))


@query("SELECT id FROM fragments WHERE starts_with(id::VARCHAR, '12')", FRAGS)
def id_prefix(spark, sf):
    return src.fragments(spark, sf).filter(F.col("id").cast("string").startswith("12")).select("id")


@query("SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source, lang")
def document_rows(spark, sf):
    return src.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def event_log(spark, sf):
    at = lambda day: F.lit(day).cast("timestamp")
    return src.table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("ts") >= at("2024-01-10")) & (F.col("ts") < at("2024-01-12"))).select("event_id", "user_id")


# Files.


@query("SELECT id, agent_id, length(content) AS chars, state, len(tags)::INT AS tags FROM fragments", FRAGS)
def jsonl_round_trip(spark, sf):
    """Every memory written as a JSON line and read back."""
    path = scratch(spark, "export")
    portability.export_jsonl(src.fragments(spark, sf).select("id", "agent_id", "content", "state", "tags"), path)
    rows, _ = portability.import_jsonl(spark, path, "id long, agent_id string, content string, state string, tags array<string>")
    return rows.select("id", "agent_id", F.length("content").alias("chars"), "state", F.size("tags").alias("tags"))


@query("SELECT id FROM fragments WHERE id % 2 = 1", FRAGS)
def jsonl_import_known(spark, sf):
    """An import beside memories that are known already (those of even ids) brings the others only."""
    path = scratch(spark, "export")
    frags = src.fragments(spark, sf).select("id", "state")
    portability.export_jsonl(frags, path)
    rows, _ = portability.import_jsonl(spark, path, "id long, state string", frags.filter("id % 2 = 0"))
    return rows.select("id")


@query(r"SELECT sha256(line) AS id, length(line) AS chars FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents) WHERE trim(line) <> ''")
def line_ingest(spark, sf):
    """Each distinct line of the texts, from text files, under its digest."""
    path = scratch(spark, "lines")
    src.table(spark, sf, "documents").filter("text is not null").select("text").write.text(path)
    return portability.ingest_lines(spark, path).select("id", F.length("content").alias("chars"))


# Predicates.


@query("SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM fragments WHERE state IN ('unverified', 'verified', 'promoted') AND (ttl_seconds IS NULL OR epoch(TIMESTAMP '2026-01-02') - epoch(created_at) <= ttl_seconds)", FRAGS)
def retrievable_ids(spark, sf):
    none = spark.createDataFrame([], "block_id string")
    return scope.retrievable(src.fragments(spark, sf), none, now()).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT id, epoch(TIMESTAMP '2026-01-02') - epoch(created_at) - ttl_seconds AS over FROM fragments WHERE ttl_seconds IS NOT NULL AND epoch(TIMESTAMP '2026-01-02') - epoch(created_at) > ttl_seconds", FRAGS)
def expired(spark, sf):
    """Memories past their time to live, and by how many seconds."""
    rows = src.fragments(spark, sf).filter(~scope.live(now()))
    return rows.select("id", (F.unix_timestamp(now()) - F.unix_timestamp("created_at") - F.col("ttl_seconds")).cast("double").alias("over"))


@query(
    "SELECT conv_id, turn, CASE lower(regexp_extract(said, '^\\s*([A-Za-z]+)\\s*:', 1)) WHEN 'todo' THEN 'todo' WHEN 'bug' THEN 'bug' WHEN 'decided' THEN 'decision' END AS kind FROM labelled",
    "labelled AS (SELECT conv_id, turn, (['TODO: ', 'bug : ', 'Decided: ', 'so: ', ''])[turn % 5 + 1] || text AS said FROM conversations)",
)
def labelled_kinds(spark, sf):
    """Kinds that a leading label names, over turns that were given one."""
    label = F.element_at(F.array(*map(F.lit, ("TODO: ", "bug : ", "Decided: ", "so: ", ""))), (F.col("turn") % 5 + 1).cast("int"))
    turns = src.table(spark, sf, "conversations").withColumn("said", F.concat(label, "text"))
    return turns.select("conv_id", "turn", F.when(F.col("turn") % 5 < 3, scope.labelled_kind(F.col("said"))).alias("kind"))


@query(r"SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])license([^\p{L}\p{N}_]|$)') ORDER BY doc_id LIMIT 50")
def forget_preview(spark, sf):
    """The first fifty memories that forgetting a phrase would take."""
    frags = src.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return store.matching(frags, "license").select("id")


@query("SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN TIMESTAMP '2025-05-01' END, created_at) AS at FROM fragments", FRAGS)
def event_times(spark, sf):
    """When a memory's event was: as declared, else when it was stored (no text begins with a stamp here)."""
    declared = F.when(F.col("id") % 4 == 0, F.lit("2025-05-01").cast("timestamp"))
    frags = src.fragments(spark, sf)
    return frags.select("id", scope.event_time(F.substring("content", 1, 40), declared, F.col("created_at")).alias("at"))


@query("SELECT id, CASE WHEN id % 9 = 0 THEN 'contradicted' ELSE state END AS state FROM fragments", FRAGS)
def tamper_check(spark, sf):
    """Every ninth memory's text no longer has the digest under which it was stored."""
    digest = F.sha2(F.when(F.col("id") % 9 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256)
    return store.verified(src.fragments(spark, sf).withColumn("content_hash", digest)).select("id", "state")


# Writes.

UPDATES_SQL = "updates AS (SELECT id AS old_id, id + 1000000 AS id, 'revised' AS content FROM fragments WHERE list_contains(tags, 'resolved'))"


@query("SELECT f.id, len(f.tags)::INT + CASE WHEN u.old_id IS NULL THEN 0 ELSE 1 END AS tags, coalesce(u.id, 0) AS superseded_by FROM fragments f LEFT JOIN updates u ON u.old_id = f.id UNION ALL SELECT u.id, len(f.tags)::INT, 0 FROM updates u JOIN fragments f ON f.id = u.old_id", FRAGS, UPDATES_SQL)
def superseded_rows(spark, sf):
    """Resolved memories revised: the old rows name their successors, which inherit everything else."""
    frags = src.fragments(spark, sf).withColumn("content", F.substring("content", 1, 80))
    updates = frags.filter(F.array_contains("tags", "resolved")).select(F.col("id").alias("old_id"), (F.col("id") + 1_000_000).alias("id"), F.lit("revised").alias("content"))
    return store.supersede(frags, updates).select("id", F.size("tags").alias("tags"), F.coalesce("superseded_by", F.lit(0)).alias("superseded_by"))


@query("SELECT id, list_contains(tags, 'resolved') OR (access_count = 3 AND list_has_any(tags, ['kind:todo', 'kind:bug'])) AS resolved FROM fragments", FRAGS)
def resolved_rows(spark, sf):
    frags = src.fragments(spark, sf).select("id", "tags", "access_count")
    return store.resolve(frags, frags.filter("access_count = 3")).select("id", F.array_contains("tags", "resolved").alias("resolved"))


@query("SELECT (SELECT count(*) FROM fragments WHERE session_id <> 'en') AS memories, (SELECT count(*) FROM facts f JOIN fragments g ON g.id = f.seq % 200 AND g.session_id <> 'en') AS facts", FRAGS, src.FACTS_SQL)
def forget_cascade(spark, sf):
    """What is left when all English memories and the facts drawn from them are forgotten."""
    frags = src.fragments(spark, sf).select("id", "session_id")
    drawn = src.fact_events(spark, sf).withColumn("source_fragment_id", F.col("seq") % 200)
    left, held = store.forget(frags, drawn, frags.filter("session_id = 'en'"))
    return left.agg(F.count("*").alias("memories")).join(held.agg(F.count("*").alias("facts")))


@query("SELECT min(doc_id) AS id FROM documents WHERE doc_id >= 20 AND text NOT IN (SELECT text FROM documents WHERE doc_id < 20) GROUP BY text")
def stored_documents(spark, sf):
    """The first of each text that is not stored yet; the first twenty documents are."""
    docs = src.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).filter("content is not null")
    known = docs.filter("id < 20").select(F.sha2("content", 256).alias("digest"))
    return store.store_documents(docs.filter("id >= 20"), known).select("id")


BLOCKS = [("b0", "open"), ("b1", "sealed"), ("b2", "open"), ("b3", "quarantined"), ("b4", "sealed")]
BLOCKS_SQL = "blocks AS (SELECT * FROM (VALUES ('b0', 'open'), ('b1', 'sealed'), ('b2', 'open'), ('b3', 'quarantined'), ('b4', 'sealed')) b(block_id, status))"


def blocks(spark):
    return spark.createDataFrame(BLOCKS, "block_id string, status string")


@query("SELECT f.id, block_id, CASE WHEN status = 'open' THEN NULL WHEN status IS NULL THEN 'unknown block' ELSE 'block is ' || status END AS reason FROM fragments f LEFT JOIN blocks USING (block_id)", FRAGS, BLOCKS_SQL)
def block_membership(spark, sf):
    """Which memories their blocks take in, and why the others are refused."""
    accepted, refused = store.join_block(blocks(spark), src.fragments(spark, sf).select("block_id", "id"))
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(refused).select("id", "block_id", "reason")


@query("SELECT id FROM fragments JOIN blocks USING (block_id) WHERE status = 'sealed'", FRAGS, BLOCKS_SQL)
def protected_members(spark, sf):
    return store.protected(src.fragments(spark, sf).select("block_id", "id"), blocks(spark))


@query("SELECT block_id FROM (SELECT block_id FROM fragments UNION SELECT block_id FROM blocks)", FRAGS, BLOCKS_SQL)
def block_ids_union(spark, sf):
    return src.fragments(spark, sf).select("block_id").union(blocks(spark).select("block_id")).distinct()


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' ELSE 'missing' END AS change FROM (SELECT id FROM fragments WHERE importance <= 0.5) a FULL JOIN (SELECT id FROM fragments WHERE importance >= 0.5) b USING (id) WHERE a.id IS NULL OR b.id IS NULL", FRAGS)
def snapshot_diff(spark, sf):
    """What came and went between two snapshots of ids."""
    rows = src.fragments(spark, sf).select(F.lit("all").alias("block_id"), "id", F.lit("").alias("hash"), "importance")
    return graph.member_changes(rows.filter("importance <= 0.5"), rows.filter("importance >= 0.5"), "block_id").select("id", "change")


# Messages and logs.

TRUSTS = ("system", "verified_agent", "raw_agent", "external", "unknown")


@query("SELECT conv_id, min(4 - (conv_id + turn * turn) % 5)::INT AS rank, arg_min((['system', 'verified_agent', 'raw_agent', 'external', 'unknown'])[(conv_id + turn * turn) % 5 + 1], 4 - (conv_id + turn * turn) % 5) AS trust FROM conversations GROUP BY conv_id")
def conversation_trust(spark, sf):
    """The least trusted publisher of each conversation's turns."""
    place = ((F.col("conv_id") + F.col("turn") * F.col("turn")) % 5).cast("int")
    turns = src.table(spark, sf, "conversations").select("conv_id", F.element_at(F.array(*map(F.lit, TRUSTS)), place + 1).alias("trust"), (4 - place).alias("rank"))
    return store.lowest_trust(turns, "conv_id").select("conv_id", "rank", "trust")


@query("SELECT session_id, count(*) FILTER (WHERE state IN ('unverified', 'verified', 'promoted')) AS passed, count(*) FILTER (WHERE state NOT IN ('unverified', 'verified', 'promoted')) AS rejected FROM fragments GROUP BY session_id", FRAGS)
def audit_counts(spark, sf):
    return store.audit(src.fragments(spark, sf), "session_id", F.col("state").isin("unverified", "verified", "promoted"))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def value_percentiles(spark, sf):
    return store.percentiles(src.table(spark, sf, "events"), "value").select(six(F.col("p50")).alias("p50"), six(F.col("p95")).alias("p95"))


@query("SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id")
def activity_summary(spark, sf):
    rows = src.table(spark, sf, "events").groupBy("user_id")
    return rows.agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY event_type")
def trace_summary(spark, sf):
    return src.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), six(F.avg("value")).alias("mean"), six(F.max("value")).alias("most"))


@query("SELECT count(*) AS memories, count(DISTINCT agent_id) AS agents, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE ttl_seconds IS NOT NULL) AS mortal, sum(length(content))::BIGINT AS chars FROM fragments", FRAGS)
def store_stats(spark, sf):
    return src.fragments(spark, sf).agg(
        F.count("*").alias("memories"), F.count_distinct("agent_id").alias("agents"), F.count_distinct("session_id").alias("sessions"),
        F.count("ttl_seconds").alias("mortal"), F.sum(F.length("content")).alias("chars"),
    )


@query(
    "SELECT t.conv_id, t.turn AS todo, o.turn AS closer FROM said t JOIN said o ON o.conv_id = t.conv_id AND o.turn > t.turn WHERE len(t.w) > 0 AND len(list_intersect(t.w, o.w)) / len(t.w)::DOUBLE >= 0.3",
    f"said AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), {WORD_SQL})) AS w FROM conversations)",
)
def closing_turns(spark, sf):
    """Turns and later turns of the conversation that hold at least three in ten of their words."""
    turns = src.table(spark, sf, "conversations").select(F.col("turn").alias("id"), "conv_id", F.timestamp_seconds("turn").alias("created_at"), F.col("text").alias("content"))
    return lifecycle.closed_todos(turns, turns, "conv_id", 0.3).select(F.col("g").alias("conv_id"), "todo", "closer")


# Lists.


@query("SELECT query_id, id, round(min(score) OVER (PARTITION BY query_id ORDER BY relevance DESC, id ROWS UNBOUNDED PRECEDING), 6) AS score FROM ranked", *FUSE_SQL)
def running_floors(spark, sf):
    """Scores made non-increasing in the order of relevance."""
    return recall.running_floor(recall.rank(_reranked(spark, sf), "relevance")).select("query_id", "id", six(F.col("score")).alias("score"))


@query("SELECT query_id, id, round(0.9::DOUBLE * coalesce(cosine, least) / most + 0.1::DOUBLE * coalesce(coverage, 0), 6) AS seed FROM (SELECT f.query_id, f.id, v.cosine, b.coverage FROM fused f LEFT JOIN bm b USING (query_id, id) LEFT JOIN vs v USING (query_id, id)) JOIN (SELECT f.query_id, max(cosine) AS most, min(cosine) AS least FROM fused f JOIN vs USING (query_id, id) GROUP BY f.query_id) USING (query_id)", *FUSE_SQL)
def score_seeds(spark, sf):
    """Candidates seeded by normalised cosine and coverage in place of ranks."""
    from memlake.plans.catalog import _fused, _word_cosines, questions

    fused, _ = _fused(spark, sf)
    docs = src.spread(src.table(spark, sf, "documents").select("doc_id", "text"))
    known = fused.select("query_id", "id").join(_word_cosines(spark, sf), ["query_id", "id"], "left").join(recall.bm25(docs, questions(spark), "doc_id", "text").select("query_id", "id", "coverage"), ["query_id", "id"], "left")
    seeded = recall.score_seed(recall.normalised(known).withColumn("coverage", F.coalesce("coverage", F.lit(0.0))))
    return seeded.select("query_id", "id", six(F.col("seed")).alias("seed"))


@query("SELECT id, round(importance * (0.75 + 0.25 * (0.5 * (0.55 * importance + 0.20 * confidence + 0.25 * 0.5) + 0.5 * exp(-ln(2.0::DOUBLE) * greatest((epoch(TIMESTAMP '2026-01-02') - epoch(created_at)) / 86400, 0) / 30))), 6) AS score FROM fragments", FRAGS)
def recency_prior(spark, sf):
    rows = src.fragments(spark, sf).withColumn("seed", F.col("importance")).withColumn("node_weight", F.lit(0.5)).withColumn("demotion", F.lit(1.0))
    return recall.rerank(rows, now()).select("id", "score")


@query("SELECT id, made, r AS place FROM (SELECT id, created_at AS made, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id DESC) AS r FROM fragments) WHERE r <= 5", FRAGS)
def newest_memories(spark, sf):
    """Each agent's five newest memories, newest first."""
    rows = timeline.newest(src.fragments(spark, sf).select("id", "agent_id", "created_at"), "agent_id", "created_at", "id", 5)
    w = Window.partitionBy("agent_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rows.select("id", F.col("created_at").alias("made"), F.row_number().over(w).alias("place"))


@query("SELECT src, dst, round(CASE WHEN src IN (SELECT node FROM nodes WHERE weight >= 0.5) AND dst IN (SELECT node FROM nodes WHERE weight >= 0.5) THEN least(1.0::DOUBLE, e.weight + 0.03) ELSE e.weight END, 6) AS weight FROM edges e", src.GRAPH_SQL)
def coactivated_edges(spark, sf):
    """Edges between nodes of weight 0.5 and more after these were used together."""
    used = src.nodes(spark, sf).filter("weight >= 0.5").select("node")
    return lifecycle.coactivate(src.edges(spark, sf), used).select("src", "dst", six(F.col("weight")).alias("weight"))


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN epoch(TIMESTAMP '2026-01-02') - epoch(created_at) > ttl_seconds THEN 'expire' WHEN importance * exp(-ln(2.0::DOUBLE) * greatest((epoch(TIMESTAMP '2026-01-02') - epoch(created_at)) / 3600, 0) / 48.0) >= 0.7 AND importance * exp(-ln(2.0::DOUBLE) * greatest((epoch(TIMESTAMP '2026-01-02') - epoch(created_at)) / 3600, 0) / 48.0) > 0.05 THEN 'promote' ELSE 'keep' END AS action FROM fragments WHERE tier = 'working') GROUP BY action", FRAGS)
def maintenance_cycle(spark, sf):
    """Decay, then consolidation of the working memories."""
    rows = lifecycle.consolidate(lifecycle.decay(src.fragments(spark, sf), now()), now())
    return rows.groupBy("action").agg(F.count("*").alias("n"))


# Texts as columns.


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tokens FROM documents WHERE text IS NOT NULL")
def chunk_tokens(spark, sf):
    """Words and marks of each text, as chunks are measured."""
    return src.table(spark, sf, "documents").filter("text is not null").select("doc_id", F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("long").alias("tokens"))


@query("SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS text FROM conversations")
def escaped_tags(spark, sf):
    return src.table(spark, sf, "conversations").select("conv_id", "turn", context.escape_tags(F.col("text")).alias("text"))


@query(r"SELECT doc_id, replace(replace(replace(source, '\', '\\'), '%', '\%'), '_', '\_') AS pattern, chr(34) || replace(source, chr(34), chr(34) || chr(34)) || chr(34) AS phrase FROM documents")
def quoted_terms(spark, sf):
    """Names as patterns of LIKE and as quoted phrases."""
    docs = src.table(spark, sf, "documents")
    return docs.select("doc_id", context.like_pattern(F.col("source")).alias("pattern"), context.quoted_phrase(F.col("source")).alias("phrase"))


@query("SELECT conv_id, turn, (conv_id + turn) % 99 + 1 AS number FROM conversations")
def number_words(spark, sf):
    """A number below a hundred for every turn, spelled and read back."""
    rows = src.table(spark, sf, "conversations").select("conv_id", "turn", context.spelled(((F.col("conv_id") + F.col("turn")) % 99 + 1).cast("int")).alias("words"))
    return rows.select("conv_id", "turn", context.number_of(F.col("words")).cast("long").alias("number"))


@query("SELECT doc_id, greatest(50, 5 * (doc_id % 30)) AS depth FROM documents")
def channel_depth(spark, sf):
    """Rows that a channel fetches for so many results."""
    return src.table(spark, sf, "documents").select("doc_id", context.depth(F.col("doc_id") % 30).alias("depth"))


# Relevance of lists.


@query("SELECT query_id, id FROM (SELECT *, max(relevance) OVER (PARTITION BY query_id) AS top FROM ranked JOIN (SELECT query_id, id, coverage FROM bm) USING (query_id, id)) WHERE relevance >= 0.5 * top AND coverage > 0", *FUSE_SQL)
def above_floor(spark, sf):
    from memlake.plans.catalog import questions

    docs = src.spread(src.table(spark, sf, "documents").select("doc_id", "text"))
    shared = recall.bm25(docs, questions(spark), "doc_id", "text").select("query_id", "id", "coverage")
    return context.above_floor(_reranked(spark, sf).join(shared, ["query_id", "id"]), "coverage").select("query_id", "id")


@query("SELECT query_id, CASE WHEN best >= 0.25 AND best - second >= 0.15 AND best >= 2 * second THEN true ELSE false END AS outlier FROM (SELECT query_id, max(cosine) AS best, coalesce(max(cosine) FILTER (WHERE r = 2), 0) AS second FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS r FROM vs) GROUP BY query_id)", *FUSE_SQL)
def vector_outliers(spark, sf):
    """Questions whose best vector stands out from the second."""
    from memlake.plans.catalog import _word_cosines

    return context.outliers(_word_cosines(spark, sf)).select("query_id", "outlier")


@query("SELECT user_id, event_id, CASE WHEN lead(event_id) OVER w IS NULL THEN 'current' WHEN lead(round(value, 1)) OVER w = round(value, 1) THEN 'repeated' ELSE 'outdated' END AS state FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def fact_states(spark, sf):
    """What a list shows beside a fact: current, repeated by the next, or outdated."""
    rows = context.fact_states(src.fact_events(spark, sf))
    return rows.select(F.col("subject").alias("user_id"), F.col("seq").alias("event_id"), "state")


@query(r"SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' WHEN regexp_matches(text, '\?\s*$') THEN 'question' WHEN regexp_matches(lower(text), '^\s*(please|can you|could you|show|list|give|write|add|make|tell)(\W|$)') THEN 'request' WHEN regexp_matches(lower(text), '\b(error|exception|traceback|failed)\b') THEN 'error' ELSE 'statement' END AS provenance FROM conversations")
def turn_provenance(spark, sf):
    return src.table(spark, sf, "conversations").select("conv_id", "turn", context.provenance(F.col("role"), F.col("text")).alias("provenance"))


@query(
    "SELECT id, bug FROM (SELECT f.id, b.id AS bug, row_number() OVER (PARTITION BY f.id ORDER BY b.created_at DESC, b.id DESC) AS r FROM fragments f JOIN fragments b ON f.session_id = b.session_id AND b.created_at < f.created_at WHERE list_contains(f.tags, 'kind:fix') AND list_contains(b.tags, 'kind:bug')) WHERE r = 1",
    FRAGS,
)
def bug_fixes(spark, sf):
    """Each fix and the newest bug before it in its session."""
    rows = src.fragments(spark, sf).select("id", "session_id", "created_at", "tags")
    return context.paired_fixes(rows, ["session_id"]).select("id", "bug")


@query(
    "SELECT id, round(f1 / norm, 6) AS f1, round(f2 / norm, 6) AS f2, round(f3 / norm, 6) AS f3 FROM (SELECT *, sqrt(f1 * f1 + f2 * f2 + f3 * f3) AS norm FROM (SELECT id, importance AS f1, confidence AS f2, least(1.0::DOUBLE, access_count / 10.0::DOUBLE) AS f3 FROM fragments))",
    FRAGS,
)
def encoded_states(spark, sf):
    """Three features of each memory as a vector of 64 of length one; the first three components."""
    state = context.encoded([F.col("importance"), F.col("confidence"), F.least(F.lit(1.0), F.col("access_count") / 10)], 64)
    rows = src.fragments(spark, sf).select("id", state.alias("v"))
    return rows.select("id", *[six(F.col("v")[i]).alias(f"f{i + 1}") for i in range(3)])


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+')) FROM documents) GROUP BY doc_id")
def listed_values(spark, sf):
    """Addresses that a text lists."""
    rows = src.table(spark, sf, "documents").select("doc_id", F.explode(context.addresses(F.col("text"))).alias("value"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT subject, attribute, value, valid_from, valid_to FROM (SELECT *, lead(valid_from) OVER (PARTITION BY subject, attribute ORDER BY valid_from, seq) AS valid_to FROM facts) WHERE valid_to IS NOT NULL", src.FACTS_SQL)
def ended_values(spark, sf):
    """Values that ended, with their original start and their end."""
    chained = facts.chain(src.fact_events(spark, sf))
    return chained.filter("valid_to is not null").select("subject", "attribute", "value", "valid_from", "valid_to")


@query(
    "SELECT DISTINCT c.subject, c.attribute, c.value, n.value AS current FROM (SELECT subject, attribute, value FROM (SELECT *, row_number() OVER (PARTITION BY subject, attribute ORDER BY valid_from, seq) AS r FROM facts) WHERE r = 1) c JOIN (SELECT subject, attribute, value FROM (SELECT *, row_number() OVER (PARTITION BY subject, attribute ORDER BY valid_from DESC, seq DESC) AS r FROM facts) WHERE r = 1) n USING (subject, attribute) WHERE c.value <> n.value",
    src.FACTS_SQL,
)
def claim_corrections(spark, sf):
    """Claims of each subject's first values that no longer hold, and what holds now."""
    chained = facts.chain(src.fact_events(spark, sf))
    w = Window.partitionBy("subject", "attribute").orderBy("valid_from", "seq")
    claims = src.fact_events(spark, sf).withColumn("r", F.row_number().over(w)).filter("r = 1")
    return context.corrections(claims, chained)


@query(
    "SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, created_at DESC, id DESC) AS r FROM (VALUES (1, DATE '2026-01-01', DATE '2026-01-01'), (2, DATE '2026-01-02', DATE '2026-01-05')) q(query_id, s, e) JOIN fragments ON created_at::DATE BETWEEN s AND e) WHERE r <= 50",
    FRAGS,
)
def dated_memories(spark, sf):
    """Memories that the days of two questions bring in."""
    ranges = spark.createDataFrame([(1, "2026-01-01", "2026-01-01"), (2, "2026-01-02", "2026-01-05")], "query_id int, start string, end string")
    ranges = ranges.select("query_id", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    return context.dated_candidates(src.fragments(spark, sf).select("id", "importance", "created_at"), ranges)


# Experiences.

REPLAY_SQL = (
    "drawn AS (SELECT user_id::VARCHAR AS agent_id, event_id AS id, ln((('0x' || substr(sha256('7:' || event_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (value / 500) AS key FROM events WHERE value > 0)",
    "replayed AS (SELECT agent_id, id, round(key, 6) AS key FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY key DESC, id) AS r FROM drawn) WHERE r <= 8)",
)


def _experiences(spark, sf):
    """Events as experiences of their users, drawn by value."""
    e = src.table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("agent_id"), F.col("event_id").alias("id"), "event_type", replay.priority("event_id", F.col("value") / 500, 7).alias("key"))


@query("SELECT * FROM replayed", *REPLAY_SQL)
def replay_sample(spark, sf):
    """Eight experiences of each user, drawn without replacement in proportion to their value."""
    return replay.greatest(_experiences(spark, sf).drop("event_type"), "agent_id", "id", 8).select("agent_id", "id", six(F.col("key")).alias("key"))


@query("SELECT * FROM replayed", *REPLAY_SQL)
def replay_store(spark, sf):
    """The same sample by a store that the events reach in batches by type, one of them twice."""
    kept = replay.ReplayStore(spark, scratch(spark, "replay"), 8)
    rows = _experiences(spark, sf)
    for kind in ("view", "error", "signup", "error"):
        kept.put(rows.filter(F.col("event_type") == kind).drop("event_type"), kind)
    kept.put(rows.filter(F.coalesce(~F.col("event_type").isin("view", "error", "signup"), F.lit(True))).drop("event_type"), "others")
    return kept.rows().select("agent_id", "id", six(F.col("key")).alias("key"))
