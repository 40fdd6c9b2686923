"""The same operators over streams: deduplicated messages, windows with late data, and incremental facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.operators import facts


def unseen(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Messages not seen within the watermark; state is dropped when it passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, at: str, width: str, late: str = "10 minutes") -> DataFrame:
    w = F.window(at, width)
    counted = stream.withWatermark(at, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("started"), "event_type", "n", "total")


def user_sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ends"), "events")


def subscribed(stream: DataFrame, topics: list[str], tags: list[str], least_trust: int) -> DataFrame:
    """Messages of any of the topics with all of the tags from publishers of enough trust."""
    from memlake.schema import TRUST

    rank = F.element_at(F.create_map(*[x for k, v in TRUST.items() for x in (F.lit(k), F.lit(v))]), F.col("trust"))
    ok = F.coalesce(rank, F.lit(0)) >= least_trust
    if topics:
        ok &= F.col("topic").isin(*topics)
    for t in tags:
        ok &= F.array_contains("tags", t)
    return stream.filter(ok)


def keep_facts(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends fact events batch by batch, each under its own folder, so a replayed batch replaces itself;
    late facts fall into place because validity is derived when read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then is not None:
            then(batch, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_chain(spark, path: str) -> DataFrame:
    """The chained facts of all batches kept so far."""
    return facts.chain(spark.read.parquet(path).drop("batch"))
