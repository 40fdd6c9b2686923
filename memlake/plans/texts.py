"""Queries of the text operators; those that SQL can express have twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import brief, lifecycle, ordering, recall, scope, similarity, text
from memlake.plans.catalog import FUSE_SQL, _reranked, query, questions, six
from memlake.sources import tables as src

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", F.ceil(F.length("text") / 4).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[REDACTED:email]', 'g') AS text FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def redact_email(spark, sf):
    docs = src.table(spark, sf, "documents").filter(F.col("text").rlike(EMAIL))
    return docs.select("doc_id", F.regexp_replace("text", EMAIL, "[REDACTED:email]").alias("text"))


@query("SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(lower(line), 'licen[sc]e|copyright') GROUP BY doc_id")
def license_lines(spark, sf):
    lines = src.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.lower("line").rlike("licen[sc]e|copyright")).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'not text' WHEN trim(text) = '' THEN 'blank' WHEN strlen(text) > 20000 THEN 'too long' END AS reject_reason FROM documents")
def write_validation(spark, sf):
    return text.validated(src.table(spark, sf, "documents"), "text", 20_000).select("doc_id", "reject_reason")


@query("SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations WHERE role = 'user'")
def query_words(spark, sf):
    """The words of every user turn."""
    return src.table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))


@query()
def document_terms(spark, sf):
    docs = src.table(spark, sf, "documents").select(F.explode(text.stems("text")).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("documents"))


@query()
def query_coverage(spark, sf):
    """Each question's best covered documents; the questions are few and broadcast."""
    docs = src.table(spark, sf, "documents").join(F.broadcast(questions(spark)))
    scored = docs.select("query_id", F.col("doc_id").alias("id"), six(text.coverage("query", "text")).alias("coverage"))
    return scored.filter("coverage > 0.3")


@query()
def document_embeddings(spark, sf):
    return src.spread(src.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.embed("text").alias("embedding"))


@query()
def document_anchors(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", F.explode(text.anchors("text")).alias("anchor")).groupBy("anchor").agg(F.count("*").alias("documents"))


@query()
def document_chunks(spark, sf):
    return text.chunked(src.spread(src.table(spark, sf, "documents").select("doc_id", "text", "source")), "doc_id", "text", "source")


@query()
def page_texts(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", text.html_text("html").alias("text"))


@query()
def document_dates(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", F.explode_outer(text.find_dates("text", "2026-10-15")).alias("d"))
    return docs.select("doc_id", "d.start", "d.end", "d.expression")


@query()
def write_policy(spark, sf):
    docs = text.write_policy(src.spread(src.table(spark, sf, "documents").select("doc_id", "text")), "text", pii=True)
    return docs.select("doc_id", "kinds", "reasons", "accepted")


@query()
def stated_facts(spark, sf):
    """Facts stated in conversations, documents and pages' texts, with an empty row where nothing is stated."""
    docs = src.spread(src.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id").join(text.stated_facts(docs, "doc_id", "text").withColumnRenamed("id", "doc_id"), "doc_id", "left")


@query(
    "SELECT t.conv_id, t.turn, coalesce(p.against, -1) AS against FROM conversations t LEFT JOIN pairs p USING (conv_id, turn)",
    r"said AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 3)) AS w FROM conversations)",
    "pairs AS (SELECT a.conv_id, a.turn, b.turn AS against FROM said a JOIN said b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.w) > 0 AND len(b.w) > 0 AND list_has_any(list_concat(a.w, b.w), ['not', 'never', 'without', 'cannot', 'stopped']) AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE >= 0.4)",
)
def conversation_contradictions(spark, sf):
    """Turns and the later turns of their conversation that they contradict (-1: none); a turn is named by (conv_id, turn)."""
    turns = src.table(spark, sf, "conversations").select(F.col("turn").alias("id"), "conv_id", F.col("text").alias("content"))
    pairs = lifecycle.contradictions(turns, "conv_id").select(F.col("g").alias("conv_id"), F.col("a").alias("turn"), F.col("b").alias("against"))
    return turns.select("conv_id", F.col("id").alias("turn")).join(pairs, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("against", F.lit(-1)).alias("against"))


@query()
def dedup_greedy(spark, sf):
    """Near vectors of a label (cosine 0.95 or more) merged into seeds, in order of the id."""
    v = src.table(spark, sf, "embeddings")
    return similarity.greedy_seeds(v, "vec_id", "vec_id", similarity.similar_pairs(v, "vec_id", "label", "embedding", 0.95))


@query()
def briefing(spark, sf):
    """Each agent's most important open memories as lines that fit 200 tokens.

    Of lines of equal cost no more than the budget holds can be chosen, so the rest
    goes before fitting, and nothing that fits is lost. place counts what is left.
    """
    from pyspark.sql import Window

    rows = scope.open_memories(src.fragments(spark, sf, 160)).select("agent_id", "id", "importance", F.col("content").alias("line"))
    rows = rows.withColumn("cost", F.ceil(F.length("line") / 4) + 1)
    order = F.col("importance").desc(), F.col("id")
    could = rows.withColumn("r", F.row_number().over(Window.partitionBy("agent_id", "cost").orderBy(*order))).filter(F.col("r") <= 200).filter(F.col("r") * F.col("cost") <= 200)
    top = could.withColumn("place", F.row_number().over(Window.partitionBy("agent_id").orderBy(*order)))
    lines = top.select("agent_id", "place", (1 - F.col("importance")).alias("priority"), "line")
    return text.fit_budget(lines, "agent_id", "priority", "line", "place", 200)


@query()
def question_classes(spark, sf):
    """Policy and signs of every user turn read as a question."""
    turns = src.table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    got = ordering.classified(turns).withColumn("asked", ordering.time_asked("query"))
    return got.select("conv_id", "turn", "policy", "complexity", "depth", "asked")


def _listed(spark, sf):
    """The ten best memories of each question with their texts and times."""
    top = recall.top_k(_reranked(spark, sf), 10)
    return top.join(src.fragments(spark, sf).select("id", "content", "agent_id", F.col("created_at").alias("event_time")), "id")


@query()
def supersession_order(spark, sf):
    rows = _listed(spark, sf).select("query_id", "id", "rank", "content", "event_time", F.lit("none").alias("asked"))
    return ordering.by_supersession(rows).select("query_id", "id", "rank", "place", "state")


@query()
def temporal_band_order(spark, sf):
    rows = ordering.shared_terms(_listed(spark, sf).withColumn("asked", F.lit("current")), "agent_id")
    return ordering.temporal_band(rows).select("query_id", "id", "rank", "band", "place")


@query(
    "SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS text FROM (SELECT *, sum(ceil(length(line) / 4.0) + 1) OVER (PARTITION BY query_id ORDER BY rank) AS cost FROM (SELECT query_id, rank, rank || '. ' || substr(text, 1, 120) AS line FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ranked) JOIN documents ON doc_id = id WHERE rank <= 10)) WHERE cost <= 200 GROUP BY query_id",
    *FUSE_SQL,
)
def rendered_results(spark, sf):
    return ordering.render(_listed(spark, sf), "query_id", "rank", F.substring("content", 1, 120), 200)


@query("SELECT id, round(least(1.0::DOUBLE, importance + CASE WHEN relevance >= 0.4 THEN 0.05 WHEN relevance IS NULL THEN 0 ELSE 0 END), 6) AS importance, access_count + CASE WHEN relevance IS NULL THEN 0 ELSE 1 END AS access_count FROM fragments LEFT JOIN (SELECT id, max(relevance) AS relevance FROM (SELECT id % 500 AS id, (id % 10) / 10.0::DOUBLE AS relevance FROM fragments) GROUP BY id) r USING (id)", src.FRAGMENTS_SQL)
def reinforce_reads(spark, sf):
    frags = src.fragments(spark, sf)
    results = frags.select((F.col("id") % 500).alias("id"), (F.col("id") % 10 / 10).alias("relevance"))
    got = ordering.reinforce(frags, results, 0.4, F.lit("2026-02-01").cast("timestamp"))
    return got.select("id", six(F.col("importance")).alias("importance"), "access_count")


@query()
def session_briefings(spark, sf):
    """Every agent's current facts and open memories in 300 tokens; a user's facts belong to one of twenty agents."""
    agent = F.concat(F.lit("src"), (F.col("subject") % 20).cast("string"))
    rows = brief.lines(src.fragments(spark, sf), src.fact_events(spark, sf), agent, F.lit("2030-01-01").cast("timestamp"))
    return brief.briefing(rows, 300)
