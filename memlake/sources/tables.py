"""The driver's tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: a small table in one file gives one otherwise.

    A table of more partitions than cores is left as it is, so no text is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fragments(spark: SparkSession, sf_dir: str, chars: int | None = None) -> DataFrame:
    """Documents as memories: the source is the agent, the language the session; labels give state and importance.

    With chars given, content is that many first characters, and no more is shuffled.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    if chars is not None:
        docs = docs.withColumn("text", F.substring("text", 1, chars))
    i = F.col("doc_id")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        i.alias("id"), F.col("source").alias("agent_id"), F.col("lang").alias("session_id"), F.col("text").alias("content"),
        F.concat(F.lit("b"), (i % 12).cast("string")).alias("block_id"),
        F.when(i % 3 == 0, "working").when(i % 3 == 1, "session").otherwise("episodic").alias("tier"),
        F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("importance"),
        F.when(F.col("toxic") == 1, 0.2).otherwise(0.7).alias("confidence"),
        F.when(F.col("toxic") == 1, "quarantined").when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "unverified").otherwise("raw").alias("state"),
        F.when(i % 7 == 0, 86_400).cast("int").alias("ttl_seconds"),
        F.timestamp_add("MINUTE", i * 10, F.lit(EPOCH).cast("timestamp")).alias("created_at"),
        F.array(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("kind:"), F.element_at(F.array(*map(F.lit, ("todo", "bug", "note", "decision", "fix"))), (i % 5 + 1).cast("int"))), F.when(i % 10 == 0, "resolved").otherwise("open")).alias("tags"),
        (i % 23).alias("access_count"),
    )


FRAGMENTS_SQL = """fragments AS (
  SELECT d.doc_id AS id, d.source AS agent_id, d.lang AS session_id, d.text AS content, 'b' || (d.doc_id % 12) AS block_id,
    CASE d.doc_id % 3 WHEN 0 THEN 'working' WHEN 1 THEN 'session' ELSE 'episodic' END AS tier,
    (CASE WHEN l.quality = 1 THEN 0.8 WHEN l.quality = 0 THEN 0.3 ELSE 0.5 END)::DOUBLE AS importance,
    (CASE WHEN l.toxic = 1 THEN 0.2 ELSE 0.7 END)::DOUBLE AS confidence,
    CASE WHEN l.toxic = 1 THEN 'quarantined' WHEN l.quality = 1 THEN 'verified' WHEN l.quality = 0 THEN 'unverified' ELSE 'raw' END AS state,
    CASE WHEN d.doc_id % 7 = 0 THEN 86400 END AS ttl_seconds,
    TIMESTAMP '2026-01-01 00:00:00' + to_minutes(d.doc_id * 10) AS created_at,
    ['lang:' || d.lang, 'kind:' || (['todo', 'bug', 'note', 'decision', 'fix'])[d.doc_id % 5 + 1], CASE WHEN d.doc_id % 10 = 0 THEN 'resolved' ELSE 'open' END] AS tags,
    d.doc_id % 23 AS access_count
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as asserted facts: subject user, attribute type, value, event time and sequence."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("attribute"), F.round("value", 1).cast("string").alias("value"),
        F.col("ts").alias("valid_from"), F.col("ts").alias("recorded_at"), F.col("event_id").alias("seq"),
    )


FACTS_SQL = """facts AS (SELECT user_id AS subject, event_type AS attribute, round(value, 1)::VARCHAR AS value, ts AS valid_from, ts AS recorded_at, event_id AS seq FROM events)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers as graph nodes with weights."""
    t = lambda n: table(spark, sf_dir, n)
    weight = lambda c: F.floor(F.pmod(F.col(c), F.lit(1000.0))) / 1000
    parts = [
        t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("region").alias("node_type"), F.lit(1.0).alias("weight")),
        t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("nation").alias("node_type"), F.lit(0.9).alias("weight")),
        t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit("customer").alias("node_type"), weight("c_acctbal").alias("weight")),
        t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit("supplier").alias("node_type"), weight("s_acctbal").alias("weight")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as typed weighted edges."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, a, x, b, y, r, w: df.select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit(r).alias("relation"), F.lit(w).alias("weight"))
    return (
        edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "part_of", 0.8)
        .unionByName(edge(t("customer"), "c", "c_custkey", "n", "c_nationkey", "located_in", 0.6))
        .unionByName(edge(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "contradicts", 0.7))
    )


GRAPH_SQL = """nodes AS (
  SELECT 'r' || r_regionkey AS node, 'region' AS node_type, 1.0::DOUBLE AS weight FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'nation', 0.9::DOUBLE FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'customer', floor(((c_acctbal % 1000.0::DOUBLE) + 1000.0::DOUBLE) % 1000.0::DOUBLE) / 1000 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier', floor(((s_acctbal % 1000.0::DOUBLE) + 1000.0::DOUBLE) % 1000.0::DOUBLE) / 1000 FROM supplier),
edges AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'part_of' AS relation, 0.8::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in', 0.6::DOUBLE FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'contradicts', 0.7::DOUBLE FROM supplier)"""
