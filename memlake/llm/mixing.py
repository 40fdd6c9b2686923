"""Mixing sources to target weights by subset-sum budget fitting.

Targets share the corpus by weight, no source above MOST_TIMES its size. A
source's whole passes come off its target; the remaining budget is fitted on
the histogram of its document lengths: every length gives its proportional
share (less, where the rest could not be met), and a bounded knapsack over the
lengths' spare documents fills the rest. Documents of a length are then drawn in seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.common import cut, group_rank, join_counted, seeded_unit, source_key, table

SEED, MOST_TIMES, WEIGHTS = 505, 3, (1, 2, 3)
#: The knapsack's table: sums up to so many words are told apart exactly (8 bytes each). A larger rest is first shared
#: out among the lengths again, by largest fractions, so that no length is favoured at any size.
TABLE_WORDS = 1 << 16
#: Narrow rows of one part, on average, where a table has fewer than its shuffle's partitions could hold. For each file that a
#: task writes, Hadoop's local file system starts processes, which briefly count as much memory as the executor itself.
PART_ROWS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame) -> DataFrame:
    """Adds target (double) to (skey, source_size): the level at which weight times level, held at
    MOST_TIMES the source's size, adds up to all sizes. Sources rank by key; empty ones get 0.

    One row a source meets in the ordered windows: names of sources are few (thousands), their documents are not here.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (((F.row_number().over(Window.orderBy("skey")) - 1) % len(WEIGHTS)) + 1).cast("int"))
    rows = sources.withColumn("__w", w).withColumn("__cap", (F.col("source_size") * MOST_TIMES).cast("double"))
    order = Window.orderBy((F.col("__cap") / F.col("__w")), "skey")
    rows = rows.withColumn("__before", F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("__rest", F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("__all", F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("__level", (F.col("__all") - F.col("__before")) / F.col("__rest"))
    # The first source in this order whose cap is not below the level: it and all later ones stand at that level.
    free = F.col("__level") * F.col("__w") <= F.col("__cap")
    rows = rows.withColumn("__final", F.min(F.when(free, F.struct((F.col("__cap") / F.col("__w")).alias("r"), F.col("skey").alias("k"), F.col("__level").alias("v")))).over(everything)["v"])
    return rows.withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("__final"), F.lit(float("inf"))) * F.col("__w"))).drop("__w", "__cap", "__before", "__rest", "__all", "__level", "__final")


def proportional(lengths: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """Each length's share of the budget in documents, rounded down, and one more for those of the largest fractions that still fit."""
    total = int((lengths * spare).sum())
    if total <= budget:
        return spare.copy()
    share = [divmod(int(k) * budget, total) for k in spare]
    take = np.array([k for k, _ in share], np.int64)
    left = budget - int((take * lengths).sum())
    for i in sorted(range(len(share)), key=lambda i: (-share[i][1], i)):
        if share[i][1] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    return take


def subset_counts(lengths: np.ndarray, spare: np.ndarray, budget: int, most: int = TABLE_WORDS) -> np.ndarray:
    """How many documents of each length come nearest below or at budget (bounded knapsack).

    Exact for budgets up to `most`. Of a larger one every length first gets its proportional share, again and again
    until `most` words are left or less. In both cases the miss is less than the shortest document left out, or all
    are taken.
    """
    take = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    while budget > most:
        fits = np.where((lengths > 0) & (lengths <= budget), spare - take, 0)
        if not fits.any():
            return take
        part = proportional(lengths, fits, budget)
        take += part
        budget -= int((part * lengths).sum())
    # The step that first reached each sum; a step takes k documents of a length, and powers of two make up every count.
    first = np.full(budget + 1, -1, np.int64)
    first[0], steps = 0, [(0, 0)]
    for i in order:
        left, power = int(min(spare[i] - take[i], budget // lengths[i])) if 0 < lengths[i] <= budget else 0, 1
        while left > 0 and first[budget] < 0:
            k = min(power, left)
            size = k * int(lengths[i])
            new = np.flatnonzero((first[: len(first) - size] >= 0) & (first[size:] < 0)) + size
            first[new] = len(steps)
            steps.append((int(i), k))
            left, power = left - k, power * 2
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, k = steps[first[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size").reset_index(drop=True)
    size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes, take = 0, np.zeros(len(pdf), np.int64)
    if total > 0:
        whole = int(np.floor(target + 0.5))
        passes = min(whole // total, MOST_TIMES)
        budget = whole - passes * total if passes < MOST_TIMES else 0
        # Every length gives its share, and the knapsack what is left; where too few documents are left to
        # meet the budget, the shares make room for it.
        gap = None
        for share in (10, 9, 5, 0):
            part = np.array([int(k) * budget * share // (total * 10) for k in n], np.int64)
            got = part + subset_counts(size, n - part, budget - int((part * size).sum()))
            left = budget - int((got * size).sum())
            if gap is None or left < gap:
                take, gap = got, left
            if gap * 1000 <= budget:
                break
        else:  # what is left out may come nearer to its own budget, and so a little over this one
            leave = subset_counts(size, n, total - budget)
            if total - int((leave * size).sum()) - budget < gap:
                take = n - leave
    return pdf.assign(passes=np.int64(passes), extra=take)[["skey", "size", "passes", "extra", "n"]]


def parts(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def mix(rows: DataFrame, keys: list[str], seed: int = SEED) -> DataFrame:
    """Adds source_size, target and times (long, 0 to MOST_TIMES) to rows with skey and size.

    The same rows always give the same result: ties of the seeded order fall to
    keys. Documents without words weigh nothing and follow the passes of their
    source; an empty table gives no rows. Few rows come in few parts, however
    many partitions a shuffle has.
    """
    rows = cut(rows.withColumn("__u", seeded_unit(seed, *[F.col(k) for k in keys])))
    n = rows.count()
    lengths = cut(rows.groupBy("skey", "size").agg(F.count("*").alias("n")).coalesce(parts(n)))
    sources = cut(targets(lengths.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))))
    kinds = sources.count()
    plan = join_counted(lengths, sources, ["skey"], rows=kinds).groupBy("skey").applyInPandas(_fit, "skey string, size long, passes long, extra long, n long")
    plan = cut(plan.coalesce(max(1, kinds)))
    rows = join_counted(join_counted(rows, plan, ["skey", "size"]), sources, ["skey"], rows=kinds)
    ranked = group_rank(rows, ["skey", "size"], "__u", keys, "n", "__r").coalesce(parts(n))
    return ranked.withColumn("times", F.col("passes") + (F.col("__r") <= F.col("extra")).cast("long")).drop("__u", "n", "passes", "extra", "__r")


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document.

    A null text has size 0; a null source is the last one. taken = size * times.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("size"), source_key(F.col("source")).alias("skey"))
    mixed = mix(docs, ["doc_id", "size"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
