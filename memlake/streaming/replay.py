"""Bounded buffers of experiences: the newest of each agent, or a sample drawn by priority.

Both keep the rows of greatest key: a sequence number, or ln(u) / weight with u
from a seeded hash of the id (rows of a weighted reservoir, without replacement).
The greatest of a union are among the greatest of its parts, so tasks cut
their own rows before the shuffle, and a store merges batch after batch to the
same rows that one pass over everything gives, in whatever order batches come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.sources.manifest import Manifest

#: What a routing policy may be called.
ACTIONS = ("FAST", "BALANCED", "DEEP")
#: Buckets of a store, by a hash of the agent; each holds any number of agents.
BUCKETS = 16


def valid(rows: DataFrame) -> DataFrame:
    """Experiences (agent_id, state, action, reward, next_state) that can be learnt from: states of one length, not empty,
    a known action, a reward from 0 to 1 and an agent; nulls are not valid."""
    ok = (F.size("state") > 0) & (F.size("state") == F.size("next_state")) & F.col("action").isin(*ACTIONS) & F.col("reward").between(0, 1) & (F.length("agent_id") > 0)
    return rows.filter(F.coalesce(ok, F.lit(False)))


def priority(id_col: str, weight: Column, seed: int) -> Column:
    """The key of a weighted draw: the greatest n of any set are a sample of it, each next row drawn in proportion to its
    weight. Null for weights that are null, not finite or not above 0: such rows are never drawn."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(16**13)
    w = weight.cast("double")
    return F.when((w > 0) & (w < float("inf")), F.log(u) / w)


def greatest(rows: DataFrame, per: str, id_col: str, n: int, key: str = "key") -> DataFrame:
    """The n rows of greatest key for each value of per (nulls are one), ties to the smaller id; rows without key are left out."""
    best = Window.partitionBy(per).orderBy(F.desc(key), F.col(id_col))
    return rows.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= n).drop("__r")


class ReplayStore:
    """The n greatest rows of each agent below path; one writer at a time, any number of readers.

    A row that comes again (same agent and id) counts once, as it came with the greatest key.
    """

    def __init__(self, spark: SparkSession, path: str, n: int, per: str = "agent_id", id_col: str = "id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.n, self.per, self.id_col, self.buckets = spark, path, n, per, id_col, buckets
        self.parts = Manifest(spark, path, "bucket")

    def put(self, rows: DataFrame, source: str) -> bool:
        """Merges rows, which hold a column key; False if the source was there."""
        version, held, sources = self.parts.newest()
        if source in sources:
            return False
        bucket = F.pmod(F.xxhash64(self.per), F.lit(self.buckets)).cast("int")
        # Cut first: what is merged is at most n rows an agent, whatever the batch holds.
        own = greatest(self._once(rows), self.per, self.id_col, self.n).persist()
        touched = sorted(r[0] for r in own.select(bucket).distinct().collect())
        name = f"{version + 1:010d}"
        if touched:
            old = self.parts.read({b: held[b] for b in touched if b in held}, own.schema)
            merged = greatest(self._once(old.unionByName(own)), self.per, self.id_col, self.n)
            merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        own.unpersist()
        self.parts.commit(version + 1, held | dict.fromkeys(touched, name), sources | {source})
        return True

    def _once(self, rows: DataFrame) -> DataFrame:
        """One row for each agent and id, that of the greatest key."""
        same = Window.partitionBy(self.per, self.id_col).orderBy(F.desc_nulls_last("key"))
        return rows.withColumn("__r", F.row_number().over(same)).filter("__r = 1").drop("__r")

    def rows(self) -> DataFrame | None:
        """What is kept; None before the first rows."""
        _, held, _ = self.parts.newest()
        if not held:
            return None
        bucket, name = min(held.items())
        return self.parts.read(held, self.spark.read.parquet(f"{self.path}/data/{name}/bucket={bucket}").schema)

    def follow(self, stream: DataFrame, checkpoint: str, name: str = "stream") -> StreamingQuery:
        """Puts the batches of a stream; a batch replayed after a failure is known by its number."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.put(batch, f"{name}/{number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
