"""Windows over groups of any size.

A window puts a whole group into one task. Where a group has more than HOT_ROWS
rows, all rows are dealt out by ranges of (keys, order) instead, so a hot group
lies in many tasks, each with a run of it. Windows then run within a task's part
of a group, and what they need of the parts before or after (the last row, a
sum) is carried over in a table of one row for each part of a split group: as
many as there are tasks, whatever the groups' sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from memlake.sources.shared import ensure_checkpoint_dir

#: Rows of a group from which it is split.
HOT_ROWS = 100_000


@dataclass(frozen=True)
class Spans:
    """Rows with their part (__p), the keys of their groups, and the order within."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    split: bool

    @property
    def part(self) -> WindowSpec:
        """The rows of a group that one task has, in order."""
        return Window.partitionBy("__p", *self.keys).orderBy(*self.order)

    def so_far(self) -> WindowSpec:
        return self.part.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def on(self, rows: DataFrame) -> Spans:
        """The same parts with other columns."""
        return Spans(rows, self.keys, self.order, self.split)

    def carry(self, told: dict[str, Column], carried: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
        """rows with the columns `carried`, which look over the parts of a group in order at what each part told.

        They are null for a group that lies in one part.
        """
        by_part = self.rows.groupBy(*self.keys, "__p").agg(*[c.alias(name) for name, c in told.items()])
        parts = Window.partitionBy(*self.keys).orderBy("__p")
        table = by_part.select(*self.keys, "__p", F.count("*").over(Window.partitionBy(*self.keys)).alias("__parts"), *[f(parts).alias(name) for name, f in carried.items()])
        if not self.split:
            return self.rows.withColumns({name: F.lit(None).cast(table.schema[name].dataType) for name in carried})
        # A part's ends are the only places where a group may be split: no more rows than twice the parts.
        table = table.filter("__parts > 1").drop("__parts")
        names = [*self.keys, "__p"]
        table = table.select(*[F.col(n).alias(f"__k{i}") for i, n in enumerate(names)], *carried)
        same = [F.col(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(names)]
        return self.rows.join(F.broadcast(table), same, "left").drop(*[f"__k{i}" for i in range(len(names))])


def spans(rows: DataFrame, keys: tuple[str, ...], order: tuple[Column, ...], hot_rows: int | None = None) -> Spans:
    """rows in parts: whole groups, or ranges of groups and order where a group has more than hot_rows rows (HOT_ROWS)."""
    most = HOT_ROWS if hot_rows is None else hot_rows
    if rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most).isEmpty():
        return Spans(rows.withColumn("__p", F.lit(0)), keys, order, False)
    ensure_checkpoint_dir(rows.sparkSession)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *[F.col(k) for k in keys], *order).withColumn("__p", F.spark_partition_id())
    return Spans(dealt.checkpoint(), keys, order, True)
