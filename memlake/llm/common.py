"""Shared pieces of the corpus operators: tables, lineage cuts, ranks, components.

Every operator works on DataFrames whose partitions are bounded; state that
must outlive a stage goes to the reliable checkpoint folder of the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.sources.shared import ensure_checkpoint_dir

#: A side of a join is broadcast only when it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 20_000
#: Rows of one rank bucket, on average; larger groups are split by their seeded hash.
RANK_BUCKET = 128
UNIT = float(2**53)
#: Rounds of contraction by least id, before random orders.
ID_ROUNDS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there, with columns of its own."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    return done.select(*[F.col(c).alias(c) for c in done.columns])


def join_counted(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Joins with a side that is broadcast when it counts few rows, and shuffled otherwise.

    small should be cheap to count (a lineage cut or a small aggregate).
    """
    n = small.count() if rows is None else rows
    return df.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def source_key(source: Column) -> Column:
    """A never-null key that keeps null apart from every string and sorts it last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def seeded_unit(seed: int, *cols: Column) -> Column:
    """53 random-looking bits of the given columns, as a non-negative long."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)


def bucket_of(unit: Column, buckets: Column) -> Column:
    """Monotone in unit, so ranks over (bucket, unit) are ranks over unit."""
    return F.least(F.floor(unit / F.lit(UNIT) * buckets).cast("long"), buckets.cast("long") - 1)


def group_rank(df: DataFrame, keys: list[str], unit: str, ties: list[str], count: str, out: str) -> DataFrame:
    """Adds out: the exact rank (from 1) by (unit, ties) within keys.

    A group of more than RANK_BUCKET rows is split into ranges of unit, so no
    task sorts a whole hot group: rank = rows of earlier ranges + rank in the
    range. df must hold the group's row count and be cheap to read twice.
    """
    df = df.withColumn("__bucket", bucket_of(F.col(unit), F.ceil(F.col(count) / RANK_BUCKET)))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.filter(F.col(count) > RANK_BUCKET).groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
        .select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy(*keys, "__bucket").orderBy(unit, *ties)
    ranked = df.withColumn("__rank", F.row_number().over(within)).join(offsets, [*keys, "__bucket"], "left")
    return ranked.withColumn(out, F.col("__rank") + F.coalesce("__before", F.lit(0))).drop("__bucket", "__rank", "__before")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Contraction in rounds: each node points to its least neighbour (or itself),
    edges are renamed to those heads, loops and repeats go. The first rounds take
    the least id, which settles stars at once; later ones a random order that is
    new each round, in which a constant share of the nodes goes whatever the
    graph. Every step is a pre-aggregated group or an equi-join whose skewed side
    the adaptive planner may split. Null ends and loops are ignored; an empty
    input gives an empty result.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label, turn = None, 0
    while not edges.isEmpty():
        if turn == 500:
            raise RuntimeError("contraction did not end")
        by = (lambda c: F.lit(0).cast("long")) if turn < ID_ROUNDS else (lambda c, t=turn: F.xxhash64(F.lit(t), F.col(c)))
        prio = lambda c: F.struct(by(c).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(prio("b")).alias("p"))
        head = cut(least.select(F.col("a").alias("node"), F.least(F.col("p"), prio("a"))["n"].alias("head")))
        # The first heads name every node; later ones rename those heads in turn.
        label = head if label is None else label.join(head.select(F.col("node").alias("head"), F.col("head").alias("next")), "head", "left").select("node", F.coalesce("next", "head").alias("head"))
        if turn % 6 == 5:
            label = cut(label)
        left = edges.join(head.select(F.col("node").alias("a"), F.col("head").alias("ha")), "a")
        left = left.join(head.select(F.col("node").alias("b"), F.col("head").alias("hb")), "b").filter("ha <> hb")
        edges = cut(left.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct())
        turn += 1
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if turn <= ID_ROUNDS:
        return label.select("node", F.col("head").alias("component"))
    label = cut(label)
    names = label.groupBy("head").agg(F.min("node").alias("component"))
    return label.join(names, "head").select("node", "component")


def merge_components(comp: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """comp (node, component) after more edges; only components that the edges touch are looked at."""
    name = lambda c: F.coalesce(F.col(f"c{c}"), F.col(c))
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    named = edges.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    more = cut(connected_components(named.select(name("a").alias("a"), name("b").alias("b"))))
    moved = comp.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(more.join(comp.select("node"), "node", "left_anti"))
