"""A corpus pipeline of five stages over documents; each is written as Parquet and read again by the next.

1. toxicity: documents that the class-conditional models score as toxic go.
2. line_dedup: lines that too many documents of a source hold go from their texts.
3. shingle_join: one document of each group of near copies stays (5 words, Jaccard 0.8 or more).
4. mixing: documents are repeated or left out so that sources come near their target words.
5. packing: what remains is packed into windows of several context sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import line_dedup as lines
from memlake.llm import mixing as mixer
from memlake.llm import packing as packer
from memlake.llm import shingle_join as near
from memlake.llm import toxicity as toxic
from memlake.llm.common import cut, ensure_checkpoint_dir, source_key, table

WORDS, NUM, DEN = 5, 80, 100


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose score reaches the threshold; a null or empty text stays."""
    model = toxic.fit(docs, table(spark, sf_dir, "labels"))
    slim = docs.withColumnRenamed("score", "__own")  # a column of that name is kept apart
    kept = toxic.score(slim, model).filter(F.col("score") < toxic.THRESHOLD).drop("score")
    return kept.withColumnRenamed("__own", "score").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes a source's boilerplate lines out of its texts, and counts their characters anew; every document stays."""
    out = lines.drop_boilerplate(docs, "source", "text")
    return out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def shingle_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group; documents without words or id stay.

    Of rows that repeat an id and its text one stays; those of an id with other texts all do.
    """
    joined = near.join(docs, WORDS, NUM, DEN).filter("doc_id = component_id and n_shingles > 0").select("doc_id")
    joined = cut(joined.groupBy("doc_id").agg(F.count("*").alias("__rows")))
    alone = F.col("doc_id").isNull() | (mixer.words(F.col("text")) == 0)
    kept = near.with_cells(docs.filter(~alone), joined)
    if not joined.filter("__rows > 1").isEmpty():
        once, more = kept.filter("__rows = 1"), kept.filter("__rows > 1")
        digests = [F.xxhash64(F.lit(i), "text").alias(f"__t{i}") for i in (1, 2)]
        kept = once.unionByName(more.select("*", *digests).dropDuplicates(["doc_id", "__t1", "__t2"]).drop("__t1", "__t2"))
    return kept.select(*docs.columns).unionByName(docs.filter(alone))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times.

    Rows of equal id, source and text are one document whose copies are taken together.
    """
    text, source = F.coalesce("text", F.lit("")), source_key(F.col("source"))
    keyed = docs.withColumn("__k1", F.xxhash64("doc_id", source, text)).withColumn("__k2", F.xxhash64(F.lit(7), "doc_id", source, text))
    slim = keyed.select("__k1", "__k2", mixer.words(F.col("text")).alias("size"), source.alias("skey"))
    times = mixer.mix(slim, ["__k1", "__k2"]).groupBy("__k1", "__k2").agg(F.sum("times").cast("int").alias("__times"), F.count("*").alias("__rows"))
    times = cut(times.filter("__times > 0"))
    joined = keyed.join(times, ["__k1", "__k2"])
    if not times.filter("__rows > 1").isEmpty():
        joined = joined.filter("__rows = 1").unionByName(joined.filter("__rows > 1").dropDuplicates(["__k1", "__k2"]))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, repeats included, and their sequences."""
    return packer.pack(docs.select("doc_id", "text"), docs.count())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("shingle_join", shingle_join), ("mixing", mixing), ("packing", packing)]

#: The models, components and plans of the stages are beyond SQL; tests compare run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline_{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{i}_{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path.toString())
        docs = spark.read.parquet(path.toString())
        if before is not None:  # what it was made from is not needed any more
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
        before = path
    return docs
