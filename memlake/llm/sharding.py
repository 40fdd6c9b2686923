"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seed within each source, ranked, and sorted over all
sources by fractional rank (rank - offset) / source rows. The offset, between 0
and 1, is the source's own, drawn by the seed: a source still has its rows at
equal distances, and many sources of equal sizes do not meet at the same ranks.
Consecutive cuts of that order have every source in its overall share, and
counts at most one apart (law "rows").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.common import UNIT, cut, group_rank, join_counted, seeded_unit, source_key, table

SHARDS = 8
SEED = 1303
#: Ranges of the fractional rank: at most so many meet in one window, whatever the input. A range of a table of a
#: hundred billion rows holds 1.5 million, which a task sorts.
MOST_RANGES = 65_536
RANGE_ROWS = 256


def interleave(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to rows.

    rows must hold skey (never null, the stratum) and keys, whose values decide
    the shuffle and the ties; repeated rows are each placed. Few rows leave the
    last shards with one row less, or empty; no rows give no rows.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = cut(rows.withColumn("__u", seeded_unit(seed, *[F.col(k) for k in keys])))
    counts = cut(rows.groupBy("skey").agg(F.count("*").alias("__n")))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    ranked = group_rank(join_counted(rows, counts, ["skey"]), ["skey"], "__u", keys, "__n", "__r")
    offset = seeded_unit(seed, F.col("skey")) / F.lit(UNIT)
    ranked = ranked.withColumn("__f", (F.col("__r") - offset) / F.col("__n"))
    ranges = max(1, min(MOST_RANGES, -(-total // RANGE_ROWS)))
    ranked = cut(ranked.withColumn("__range", F.least(F.floor(F.col("__f") * ranges), F.lit(ranges - 1))))
    # At most MOST_RANGES rows meet in this one window.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("__range").agg(F.count("*").alias("__k")).select("__range", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__before"))
    offsets = cut(offsets)
    placed = ranked.withColumn("__i", F.row_number().over(Window.partitionBy("__range").orderBy("__f", "skey", "__r")) - 1)
    placed = join_counted(placed, offsets, ["__range"], rows=ranges).withColumn("__pos", F.col("__i") + F.col("__before"))
    n = F.lit(max(total, 1)).cast("long")
    placed = placed.withColumn("shard", F.expr(f"cast(__pos * {shards} div {max(total, 1)} as int)"))
    placed = placed.withColumn("slot", F.col("__pos") - F.floor((F.col("shard") * n + (shards - 1)) / F.lit(shards)).cast("long"))
    return placed.drop("__u", "__n", "__r", "__f", "__range", "__i", "__before", "__pos")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the law "rows"; sources are the strata.

    size is the text's UTF-8 bytes plus 1; a null text has no bytes and, like
    the empty one, the checksum 0. A null source is a stratum of its own.
    Repeated rows each get a place. Equal texts form no groups here: a group
    larger than a shard could not be kept together with equal counts.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), source_key(F.col("source")).alias("skey")
    )
    placed = interleave(docs, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
