"""Chained facts kept up to date batch by batch.

Facts lie in buckets by a hash of (subject, attribute), so a key is whole in one
bucket. A batch chains its own keys anew, copies the other keys of the buckets
that it touches, writes these buckets to a folder of their own and then one small
manifest that names the folder of every bucket and the sources done. The
manifest is what commits: readers follow the newest complete one, a batch that
comes twice is known by its source, and one that broke off leaves the old facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.operators import facts
from memlake.sources.manifest import Manifest

#: Folders are listed on the driver, so buckets are few; a bucket holds any number of keys.
BUCKETS = 64


class FactStore:
    """Facts below path; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.parts = Manifest(spark, path, "bucket")

    def put(self, events: DataFrame, source: str) -> bool:
        """Adds the events (subject, attribute, value, valid_from, recorded_at, seq) of a source; False if it was there.

        An event that repeats a seq counts once, within a batch and against what is kept. Batches may come in any order.
        """
        version, held, sources = self.parts.newest()
        if source in sources:
            return False
        bucket = F.pmod(F.xxhash64(*facts.KEY), F.lit(self.buckets)).cast("int")
        events = events.select(*facts.KEY, "value", "valid_from", "recorded_at", "seq").withColumn("bucket", bucket)
        touched = sorted(r[0] for r in events.select("bucket").distinct().collect())
        schema = events.drop("bucket").withColumn("valid_to", F.col("valid_from")).schema
        old = self.parts.read({b: held[b] for b in touched if b in held}, schema)
        keys = events.select(*[F.col(k).alias(f"__{k}") for k in facts.KEY]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in facts.KEY]
        rest = old.join(keys, same, "left_anti")
        known = old.join(keys, same, "left_semi").drop("valid_to")
        own = known.unionByName(events.drop("bucket")).dropDuplicates(["seq"])
        name = f"{version + 1:010d}"
        if touched:
            out = facts.chain(own).select(*schema.names).unionByName(rest.select(*schema.names)).withColumn("bucket", bucket)
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        self.parts.commit(version + 1, held | dict.fromkeys(touched, name), sources | {source})
        return True

    def facts(self) -> DataFrame | None:
        """All facts with valid_to; None before the first batch."""
        _, held, _ = self.parts.newest()
        if not held:
            return None
        first = next(iter(sorted(held.items())))
        schema = self.spark.read.parquet(f"{self.path}/data/{first[1]}/bucket={first[0]}").schema
        return self.parts.read(held, schema)

    def follow(self, stream: DataFrame, checkpoint: str, name: str = "stream") -> StreamingQuery:
        """Puts the batches of a stream; a batch replayed after a failure is known by its number."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.put(batch, f"{name}/{number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
