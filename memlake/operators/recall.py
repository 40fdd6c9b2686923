"""Retrieval for many queries at once: channels, fusion, reranking and display, as one plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions import words
from memlake.functions.arrow import batched
from memlake.schema import POLICIES, Recall
from memlake.sources.shared import ensure_checkpoint_dir

CONFIG = Recall()
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct tokens of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def postings(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None) -> DataFrame:
    """(id, len, term, tf); with terms given, only theirs leave the scan."""
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("__t"))
    rows = rows.select("id", F.size("__t").alias("len"), F.explode("__t").alias("term"))
    if terms is not None:
        rows = rows.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.coalesce(F.col(text_col), F.lit("")))).cast("double")).alias("avg_len"))


def term_hits(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, len, hits) of every document: its number of tokens, and those of them that are asked for.

    Texts are read and split once and stay in the task; the narrow rows are cut from their lineage, for counts and
    scores both start from them. terms is a bounded batch and travels as one row.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    asked = terms.agg(F.collect_set("term").alias("__asked"))
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("__t")).join(F.broadcast(asked))
    return rows.select("id", F.size("__t").alias("len"), F.filter("__t", lambda t: F.array_contains("__asked", t)).alias("hits")).checkpoint()


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "content", c: Recall = CONFIG) -> DataFrame:
    """(query_id, id, score, coverage) of every document that holds a term of the query; coverage is the share of the
    query's distinct terms that it holds.

    queries is a bounded batch: its terms are broadcast, documents are scanned once
    and only hits are shuffled.
    """
    terms = query_terms(queries)
    found = term_hits(docs, terms, id_col, text_col)
    post = found.filter(F.size("hits") > 0).select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    stats = found.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    asked = terms.join(terms.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id")
    idf = F.greatest(F.lit(c.least_idf), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("len") / F.col("avg_len")))
    # df has a row a term and stats one: both are as bounded as the batch of queries.
    hits = post.join(F.broadcast(df), "term").join(F.broadcast(asked), "term").join(F.broadcast(stats))
    return hits.groupBy("query_id", "id").agg(F.sum(weight).alias("score"), (F.count("*") / F.max("asked")).alias("coverage"))


def text_cosines(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(query_id, id, cosine) of the hash embeddings of every document with those of a bounded batch of queries.

    The queries are embedded on the driver and travel with the task; a batch of documents is embedded and multiplied
    with them at once, and only numbers leave the task. Texts without words have cosine 0, null ones none.
    """
    asked = [(r.query_id, r.query) for r in queries.select("query_id", "query").collect()]
    vectors = words.embed_all([q for _, q in asked])
    cosines = batched(lambda texts: words.embed_all(texts) @ vectors.T, "array<double>", F.col(text_col))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), cosines.alias("__c"))
    ids = F.array(*[F.lit(q) for q, _ in asked])
    return rows.select("id", F.explode(F.arrays_zip(ids.alias("q"), F.col("__c").alias("c"))).alias("x")).select(F.col("x.q").alias("query_id"), "id", F.col("x.c").alias("cosine"))


def word_cosines(docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(query_id, id, cosine) as text_cosines, by hashed words: split in Spark, numbered and added up a batch at once."""
    asked = queries.select("query_id", tokens(F.col("query")).alias("t")).collect()
    sums = words.hash_sums(pa.array([r.t for r in asked], pa.list_(pa.string())))

    @F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
    def cosines(said: pa.Array) -> pa.Array:
        return pa.array(list(words.sum_cosines(words.hash_sums(said), sums)), pa.list_(pa.float64()))

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), cosines(tokens(F.col(text_col))).alias("__c"))
    ids = F.array(*[F.lit(r.query_id) for r in asked])
    return rows.select("id", F.explode(F.arrays_zip(ids.alias("q"), F.col("__c").alias("c"))).alias("x")).select(F.col("x.q").alias("query_id"), "id", F.col("x.c").alias("cosine"))


def hybrid(lexical: DataFrame, vector: DataFrame, depth: int = 50, c: Recall = CONFIG) -> DataFrame:
    """(query_id, id, rrf, relevance, seed) of the candidates of two channels, depth rows a query each.

    lexical (query_id, id, score, coverage) and vector (query_id, id, cosine) rank their own rows; the sums of
    1 / (60 + rank) order the union. Relevance is the larger of cosine and coverage, between 0 and 1. Both channels are
    cut from their lineage, so texts are read and embedded once.
    """
    ensure_checkpoint_dir(lexical.sparkSession)
    lexical, vector = lexical.checkpoint(), vector.checkpoint()
    ranked = lambda df, by: top_k(df.withColumn(by, F.round(by, 9)), depth, by).select("query_id", "id", "rank")
    fused = rrf(ranked(lexical, "score").unionByName(ranked(vector, "cosine")), c)
    known = fused.join(lexical.select("query_id", "id", "coverage"), ["query_id", "id"], "left").join(vector.select("query_id", "id", "cosine"), ["query_id", "id"], "left")
    return relevant(known, c)


def relevant(fused: DataFrame, c: Recall = CONFIG) -> DataFrame:
    """Adds relevance, the larger of cosine and coverage between 0 and 1 (null: 0), and the seed made with it."""
    best = F.greatest(F.coalesce("cosine", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0)))
    return rrf_seed(fused.withColumn("relevance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), best))).drop("cosine", "coverage"), c=c)


def rank(scored: DataFrame, score: str = "score", out: str = "rank", by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col("id"))
    return scored.withColumn(out, F.row_number().over(w))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The rank limit goes below the shuffle, so each task sends k rows a query."""
    return rank(scored, score).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rrf(channels: DataFrame, c: Recall = CONFIG) -> DataFrame:
    """(query_id, id, rrf) from (query_id, channel, id, rank)."""
    return channels.groupBy("query_id", "id").agg(F.sum(1.0 / (c.rrf_k + F.col("rank"))).alias("rrf"))


def rrf_seed(fused: DataFrame, n_channels: int = 2, c: Recall = CONFIG) -> DataFrame:
    """seed = half the share of the best possible sum, half the calibrated relevance."""
    best = n_channels / (c.rrf_k + 1)
    return fused.withColumn("seed", 0.5 * F.least(F.lit(1.0), F.col("rrf") / best) + 0.5 * F.col("relevance"))


def normalised(scored: DataFrame, score: str = "cosine") -> DataFrame:
    """Adds norm: the score over the query's largest; rows without one take the query's least.

    The largest and the least are pre-aggregated, so no task holds all rows of a query.
    """
    ends = scored.groupBy("query_id").agg(F.max(score).alias("__max"), F.min(score).alias("__min"))
    rows = scored.join(ends, "query_id")
    return rows.withColumn("norm", F.coalesce(F.col(score), F.col("__min")) / F.col("__max")).drop("__max", "__min")


def score_seed(scored: DataFrame, share: float = CONFIG.lexical_share) -> DataFrame:
    return scored.withColumn("seed", (1 - share) * F.col("norm") + share * F.col("coverage"))


def rerank(candidates: DataFrame, now: Column | None = None, c: Recall = CONFIG) -> DataFrame:
    """score * (0.75 + 0.25 * prior) * demotion; prior mixes importance, confidence and node weight,
    or, with now given, half of it recency."""
    prior = 0.55 * F.col("importance") + 0.20 * F.col("confidence") + 0.25 * F.coalesce("node_weight", F.lit(0.5))
    if now is not None:
        age = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 86_400
        prior = 0.5 * prior + 0.5 * F.exp(-F.log(F.lit(2.0)) * F.greatest(age, F.lit(0.0)) / c.half_life_days)
    return candidates.withColumn("score", F.round(F.col("seed") * (0.75 + 0.25 * prior) * F.coalesce("demotion", F.lit(1.0)), 6))


def floor(ranked: DataFrame, c: Recall = CONFIG) -> DataFrame:
    """Drops rows under 0.3 of the query's best relevance or under 0.1; those at 0.9 or more stay."""
    top = F.max("relevance").over(Window.partitionBy("query_id"))
    return ranked.withColumn("__t", top).filter((F.col("relevance") >= c.pinned) | ((F.col("relevance") >= c.relative_floor * F.col("__t")) & (F.col("relevance") >= c.absolute_floor))).drop("__t")


def diversify(ranked: DataFrame, group: str, c: Recall = CONFIG) -> DataFrame:
    """At most two rows of a document for each query, in rank order."""
    w = Window.partitionBy("query_id", group).orderBy("rank", "id")
    return ranked.withColumn("__d", F.row_number().over(w)).filter(F.col("__d") <= c.per_document).drop("__d")


def display(ranked: DataFrame) -> DataFrame:
    """shown: the relevance, made non-increasing down the list."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn("shown", F.max("relevance").over(w))


def keep_best_content(scored: DataFrame, text: str = "content") -> DataFrame:
    """Of candidates whose text is the same but for case and white space, the best stays."""
    same = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    w = Window.partitionBy("query_id", F.sha2(same, 256)).orderBy(F.col("score").desc(), "id")
    return scored.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def gap(ranked: DataFrame, queries: DataFrame, policy: str = "balanced") -> DataFrame:
    """severity of what memory lacks: none, medium, high (under 3/4 of the threshold) or critical (nothing found)."""
    t = POLICIES[policy].min_confidence
    best = ranked.groupBy("query_id").agg(F.max("relevance").alias("best"))
    level = F.when(F.col("best").isNull(), "critical").when(F.col("best") < 0.75 * t, "high").when(F.col("best") < t, "medium").otherwise("none")
    return queries.select("query_id").join(best, "query_id", "left").withColumn("severity", level)


def running_floor(ranked: DataFrame, score: str = "score") -> DataFrame:
    """score made non-increasing down the list: each row shows at most what the rows above it do."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(score, F.min(score).over(w))


def in_dates(candidates: DataFrame, reference: str, outside: float = 0.7) -> DataFrame:
    """seed times 0.7 for rows outside the days that the query names; a query without dates changes nothing.

    candidates hold query, seed, event_time. adds window_gap: whether no row of the query lies inside.
    """
    from memlake.operators.text import find_dates

    day = F.to_date("event_time")
    rows = candidates.withColumn("__d", find_dates("query", reference))
    hit = F.exists("__d", lambda d: (d["start"] <= day) & (day <= d["end"]))
    dated = F.size("__d") > 0
    rows = rows.withColumn("seed", F.when(dated & ~F.coalesce(hit, F.lit(False)), F.col("seed") * outside).otherwise(F.col("seed")))
    gap = F.max((~dated | F.coalesce(hit, F.lit(False))).cast("int")).over(Window.partitionBy("query_id")) == 0
    return rows.withColumn("window_gap", gap).drop("__d")


def of_kind(candidates: DataFrame, off_kind: float = 0.5) -> DataFrame:
    """seed halved for rows that are not of the kind (or not open) that the query asks to list. candidates hold query, seed, tags."""
    from memlake.operators.ordering import kind_asked

    rows = candidates.withColumn("__k", kind_asked("query"))
    good = F.array_contains("tags", F.concat(F.lit("kind:"), F.col("__k.kind"))) & (~F.col("__k.only_open") | ~F.arrays_overlap("tags", F.array(F.lit("resolved"), F.lit("superseded"))))
    return rows.withColumn("seed", F.when(F.col("__k").isNotNull() & ~F.coalesce(good, F.lit(False)), F.col("seed") * off_kind).otherwise(F.col("seed"))).drop("__k")
