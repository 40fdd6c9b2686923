"""Concept graph and block chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.spans import spans
from memlake.schema import Recall
from memlake.sources.shared import ensure_checkpoint_dir


def both_ways(edges: DataFrame, direction: str = "both") -> DataFrame:
    out = edges.select("src", "dst", "relation", "weight")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "weight")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighborhood(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(origin, node, depth): nodes within so many steps, at their least depth."""
    ensure_checkpoint_dir(edges.sparkSession)
    steps = both_ways(edges, direction).select("src", "dst").distinct()
    seen = frontier = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        nxt = frontier.join(steps, frontier["node"] == steps["src"]).select("origin", F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct()
        frontier = nxt.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").checkpoint()  # else each level would be made again by the next
        seen = seen.unionByName(frontier)
    return seen


def expand(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int, c: Recall = Recall()) -> DataFrame:
    """(origin, node, score): best product of weights over paths, score * edge * node * 0.5 a hop."""
    steps = both_ways(edges).filter("relation <> 'contradicts'").join(nodes.select(F.col("node").alias("dst"), F.col("weight").alias("node_weight")), "dst")
    steps = steps.groupBy("src", "dst").agg(F.max(F.col("weight") * F.col("node_weight")).alias("gain"))
    best = level = seeds.select("origin", "node", "score")
    for _ in range(hops):
        level = level.join(steps, level["node"] == steps["src"]).groupBy("origin", F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("gain") * c.hop_decay).alias("score"))
        best = best.unionByName(level)
    return best.groupBy("origin", "node").agg(F.max("score").alias("score"))


def best_first(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int, k: int | None = None, direction: str = "both", c: Recall = Recall()) -> DataFrame:
    """(origin, node, score): what a walk finds that always goes on from the best node it knows, at most hops steps deep.

    A step multiplies by edge weight, node weight (each from 0 to 1) and the decay of a hop. A node is entered again only
    by a better path, goes on once, and from its best entry that is not hops deep: a better but deeper path hides a
    worse one found after it, as in the walk of one node at a time. With k, the k best nodes of each origin.

    No step keeps more than the largest factor of a score, so nodes whose scores lie within that factor of an origin's
    best open one cannot lead to each other's place: each round walks all of them, for all origins at once, and only
    the rounds follow one another. With k, nodes that cannot lead into the k best stay where they are.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    steps = both_ways(edges, direction).filter("relation <> 'contradicts'").join(nodes.select(F.col("node").alias("dst"), F.col("weight").alias("node_weight")), "dst")
    steps = steps.groupBy("src", "dst").agg((F.max(F.col("weight") * F.col("node_weight")) * c.hop_decay).alias("gain")).filter("gain > 0").checkpoint()
    factor = steps.agg(F.max("gain")).first()[0] or 0.0
    if factor >= 1:
        raise ValueError("a step must lower the score: weights are from 0 to 1")
    key = ["origin", "node"]
    entry = F.struct(F.col("score"), (-F.col("depth")).alias("rise"))
    start = seeds.filter("origin is not null and node is not null and score is not null").groupBy(*key).agg(F.max("score").alias("score"))
    state = start.select(*key, F.col("score").alias("best"), F.struct("score", F.lit(0).alias("rise")).alias("open"), F.lit(hops < 1).alias("walked")).checkpoint()
    while True:
        tops = state.filter("not walked and open is not null").groupBy("origin").agg(F.max("open.score").alias("top"))
        if k is not None:
            place = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("best")))
            bars = state.withColumn("__r", place).filter(F.col("__r") == k).select("origin", F.col("best").alias("bar"))
            tops = tops.join(bars, "origin", "left").filter(F.col("bar").isNull() | (F.col("top") * factor >= F.col("bar")))
        band = state.filter("not walked and open is not null").join(tops, "origin").filter(F.col("open.score") > F.col("top") * factor)
        band = band.select("origin", F.col("node").alias("src"), F.col("open.score").alias("from_score"), (1 - F.col("open.rise")).alias("depth")).checkpoint()
        if band.isEmpty():
            break
        told = band.join(steps, "src").select("origin", F.col("dst").alias("node"), "src", "from_score", "depth", (F.col("from_score") * F.col("gain")).alias("score"))
        told = told.join(state.select(*key, "best", "walked"), key, "left").filter("walked is null or not walked").filter(F.col("score") > F.coalesce("best", F.lit(0.0)))
        # Entries in the order of the walk; one that does not better all before it was never made.
        parts = spans(told, tuple(key), (F.desc("from_score"), F.col("src")))
        rows = parts.carry({"__m": F.max("score")}, {"__ahead": lambda w: F.max("__m").over(w.rowsBetween(Window.unboundedPreceding, -1))})
        before = F.greatest(F.max("score").over(parts.part.rowsBetween(Window.unboundedPreceding, -1)), F.col("__ahead"))
        made = rows.withColumn("__b", before).filter(F.col("__b").isNull() | (F.col("score") > F.col("__b")))
        made = made.groupBy(*key).agg(F.max("score").alias("__best"), F.max(F.when(F.col("depth") < hops, entry)).alias("__open"))
        went = band.select("origin", F.col("src").alias("node"), F.lit(True).alias("__went"))
        both = state.join(made, key, "full_outer").join(went, key, "left")
        state = both.select(*key, F.greatest("best", "__best").alias("best"), F.greatest("open", "__open").alias("open"), (F.coalesce("walked", F.lit(False)) | F.col("__went").isNotNull()).alias("walked")).checkpoint()
    found = state.select(*key, F.col("best").alias("score"))
    if k is None:
        return found
    w = Window.partitionBy("origin").orderBy(F.desc("score"), "node")
    return found.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def contradicted_by(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes across a contradicting edge from a seed."""
    against = both_ways(edges.filter("relation = 'contradicts'"))
    return seeds.join(against, seeds["node"] == against["src"]).select("origin", F.col("dst").alias("node")).distinct()


#: Digits of the digest of a member's id that name its leaf: 65,536 leaves a block, so one of a billion members has leaves of a megabyte.
LEAF_DIGITS = 4


def seal(members: DataFrame, block: str, sealed_at: str) -> DataFrame:
    """Blocks with the digest of their (id, hash) members, chained to the block sealed before.

    The digest has two levels, so no task holds a block: members are dealt to leaves by the first digits of
    their id's MD5, a leaf's digest is that of its sorted id:hash joined by commas, and the block's that of its sorted
    leaf:digest joined likewise. Blocks are few, so one ordered window chains them.
    """
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ","), 256)
    leaf = F.substring(F.md5(F.col("id").cast("string")), 1, LEAF_DIGITS).alias("__leaf")
    leaves = members.groupBy(block, leaf).agg(joined(F.concat_ws(":", "id", "hash")).alias("__d"), F.max(sealed_at).alias("__at"), F.count("*").alias("__n"))
    blocks = leaves.groupBy(block).agg(joined(F.concat_ws(":", "__leaf", "__d")).alias("content_hash"), F.max("__at").alias("sealed_at"), F.sum("__n").alias("members"))
    order = Window.orderBy("sealed_at", block)
    return blocks.withColumn("prev_block", F.lag(block).over(order)).withColumn("prev_hash", F.lag("content_hash").over(order))


def verify(sealed: DataFrame, members: DataFrame, block: str, sealed_at: str) -> DataFrame:
    """ok for each sealed block: its members still give its digest, and its link names the digest before it."""
    fresh = seal(members, block, sealed_at).select(block, F.col("content_hash").alias("__h"))
    order = Window.orderBy("sealed_at", block)
    linked = F.col("prev_hash").eqNullSafe(F.lag("content_hash").over(order))
    return sealed.withColumn("__l", linked).join(fresh, block, "left").select(block, (F.col("content_hash").eqNullSafe(F.col("__h"))).alias("content_ok"), F.col("__l").alias("link_ok"))


def member_changes(sealed_members: DataFrame, members: DataFrame, block: str) -> DataFrame:
    """missing, added and corrupted members of each block, by a full outer join of their hashes."""
    a, b = sealed_members.select(block, "id", F.col("hash").alias("__a")), members.select(block, "id", F.col("hash").alias("__b"))
    what = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "added").when(F.col("__a") != F.col("__b"), "corrupted")
    return a.join(b, [block, "id"], "full").withColumn("change", what).filter("change is not null").select(block, "id", "change")
