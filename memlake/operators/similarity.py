"""Vectors of a group that are near each other, and greedy dedup by seeds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.sources.shared import ensure_checkpoint_dir

TILE = 1024


def similar_pairs(vectors: DataFrame, id_col: str, group: str, vector: str, least: float, tile: int = TILE) -> DataFrame:
    """(a, b) with a < b of a group whose cosine reaches least, by matrix products over tiles of bounded size.

    Each group is cut into parts by a hash of the id; every pair of parts is one
    tile, so a hot group becomes many tasks. Null and zero vectors have no pairs.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(vector).alias("v")).filter(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    parts = rows.groupBy("g").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    dealt = rows.join(parts, "g").withColumn("p", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    spread = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.select("g", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "id", "v", "p")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["p"].to_numpy() == pdf["i"].iloc[0]
        last = pdf["p"].to_numpy() == pdf["j"].iloc[0]
        m = np.stack(pdf["v"].to_list()).astype(np.float64)
        m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
        x, y = np.nonzero(m[first] @ m[last].T >= least)
        ids = pdf["id"].to_numpy()
        a, b = ids[first][x], ids[last][y]
        keep = a < b if pdf["i"].iloc[0] == pdf["j"].iloc[0] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return spread.groupBy("g", "i", "j").applyInPandas(run, "a long, b long")


def greedy_seeds(rows: DataFrame, id_col: str, order: str, pairs: DataFrame) -> DataFrame:
    """(id, seed): the outcome of taking rows in order, each joining the first earlier seed near it or else becoming one.

    In rounds: a row with an earlier near seed is a member; a row all of whose
    earlier near rows are members is a seed. order must tell all rows apart.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    rank = rows.select(F.col(id_col).alias("id"), F.col(order).alias("r"))
    ends = pairs.join(rank.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(rank.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    early, late = F.when(F.col("ra") < F.col("rb"), F.struct("a", "ra")).otherwise(F.struct(F.col("b").alias("a"), F.col("rb").alias("ra"))), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a"))
    before = ends.select(late.alias("id"), early.alias("e")).select("id", F.col("e.a").alias("near"), F.col("e.ra").alias("near_rank")).checkpoint()
    told = rank.join(before.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("seed")).checkpoint()
    while True:
        open_rows = before.join(told.select("id"), "id", "left_anti")
        state = open_rows.join(told.select(F.col("id").alias("near"), (F.col("id") == F.col("seed")).alias("is_seed")), "near", "left")
        by_id = state.groupBy("id").agg(F.min(F.when(F.col("is_seed"), F.struct("near_rank", "near"))).alias("s"), F.min(F.struct("near_rank", F.coalesce("is_seed", F.lit(True)).alias("x"))).alias("first"), F.count_if(F.col("is_seed").isNull()).alias("unknown"), F.min(F.when(F.col("is_seed").isNull(), F.col("near_rank"))).alias("first_unknown"))
        member = F.col("s").isNotNull() & (F.col("first_unknown").isNull() | (F.col("s.near_rank") < F.col("first_unknown")))
        seed = F.col("s").isNull() & (F.col("unknown") == 0)
        new = by_id.filter(member | seed).select("id", F.when(member, F.col("s.near")).otherwise(F.col("id")).alias("seed")).checkpoint()
        if new.isEmpty():
            return told
        told = told.unionByName(new).checkpoint()
