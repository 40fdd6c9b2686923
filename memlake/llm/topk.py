"""Exact top-k search: tiled integer matrix products, partial selection, tree merging."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.common import cut, table

SCALE, K = 64, 20
QUERY_BLOCK, SHARD_ROWS, FAN_IN = 1024, 4096, 8
#: Tasks that the tiles make at least, where there are so many tiles.
LEAST_TASKS = 64
PACKED = "block int, dim int, ids binary, times binary, comps binary"
PART = "qblock int, grp int, q int, vec_id long, score long"
EXACT = 2**53


def scaled(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double> of floor(SCALE * x), times): distinct rows and how often each occurs.

    Null vectors, and those with null or non-finite components, are left out, as
    are rows without id. Rows that repeat an id with another vector stay apart.
    """
    v = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    ok = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).filter(ok)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("times"))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a block and length of vectors; components are doubles, whole numbers all."""
    out = []
    for dim, own in pdf.sort_values("vec_id").groupby(pdf["v"].map(len)):
        m = np.stack(own["v"].to_list()) if dim else np.zeros((len(own), 0))
        out.append((int(pdf["block"].iloc[0]), int(dim), own["vec_id"].to_numpy(np.int64).tobytes(), own["times"].to_numpy(np.int64).tobytes(), np.ascontiguousarray(m, np.float64).tobytes()))
    return pd.DataFrame(out, columns=["block", "dim", "ids", "times", "comps"])


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks of about equal size, dealt by a hash of id and vector."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(_pack, PACKED)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by BLAS where doubles hold them, by Python's integers
    otherwise (kept within the range of a long)."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    if d == 0:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    exact = whole(q).dot(whole(c).T)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to smaller ids, in order."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= least)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep].astype(object) if score.min(initial=0) == -(2**63) else -score[keep]))][:k]


def _tile(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                qi, ci, n = np.frombuffer(t.q_ids, np.int64), np.frombuffer(t.ids, np.int64), np.frombuffer(t.times, np.int64)
                qv, cv = np.frombuffer(t.q_comps, np.float64).reshape(len(qi), t.q_dim), np.frombuffer(t.comps, np.float64).reshape(len(ci), t.dim)
                s = scores(qv, cv)
                found = []
                for i, own in enumerate(qi):
                    row, ids, times = s[i], ci, n
                    same = [j for j in np.flatnonzero(ci == own) if t.q_dim == t.dim and (cv[j] == qv[i]).all()]
                    if same:  # the query's own row takes no part, its copies do
                        times = n.copy()
                        times[same[0]] -= 1
                        if not times[same[0]]:
                            row, ids, times = (np.delete(x, same[0]) for x in (row, ids, times))
                    top = best(row, ids, k)
                    top = np.repeat(top, np.minimum(times[top], k))[:k]
                    found.append((np.full(len(top), i), ids[top], row[top]))
                cols = [np.concatenate([f[j] for f in found]) for j in range(3)]
                # Vectors of another length in the same query block count on from those before.
                yield pd.DataFrame({"qblock": np.int32(t.qblock), "grp": np.int32(t.block), "q": (cols[0] + t.q_first).astype(np.int32), "vec_id": cols[1], "score": cols[2]})

    return run


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return pdf[pdf.groupby("q").cumcount() < k]

    return run


def search(queries: DataFrame, vectors: DataFrame, n_queries: int, n_vectors: int, k: int = K, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of vectors for each query row, itself left out.

    Both inputs come from scaled(); a query row that occurs twice has its list
    twice, and other rows of its id are candidates like any. Query blocks travel
    to the shards, which are copied only where there are too few of them to keep
    LEAST_TASKS tasks busy. Each tile keeps k a query, and lists of FAN_IN shards
    merge until one is left. Vectors of different lengths compare over the shorter
    one (the rest is 0).
    """
    qblocks, shards = max(1, math.ceil(n_queries / query_block)), max(1, math.ceil(n_vectors / shard_rows))
    teams = max(1, min(qblocks, math.ceil(LEAST_TASKS / shards)))
    rows_of = (F.octet_length("ids") / 8).cast("int")
    first = F.coalesce(F.sum(rows_of).over(Window.partitionBy("block").orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    q = cut(packed(queries, qblocks).withColumn("q_first", first))
    sent = q.select(F.col("block").alias("qblock"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("comps").alias("q_comps"), "q_first", F.pmod("block", F.lit(teams)).alias("team"))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    c = packed(vectors, shards).withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))
    tasks = min(shards * teams, 4096)
    tiles = sent.repartition(tasks, "block", "team").join(c.repartition(tasks, "block", "team").hint("shuffle_hash"), ["block", "team"])
    part = tiles.mapInPandas(_tile(k), PART)
    while True:
        shards = math.ceil(shards / FAN_IN)
        grouped = part.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("int")).groupBy("qblock", "grp")
        part = cut(grouped.applyInPandas(_merge(k), PART))
        if shards == 1:
            break

    def ranks(left: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("q_first")
        ids = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in own["ids"])])
        times = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in own["times"])])
        left = left.sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
        left = left.assign(rank=(left.groupby("q").cumcount() + 1).astype("int32"), query_id=ids[left["q"]], times=times[left["q"]])
        return left[["query_id", "rank", "vec_id", "score", "times"]]

    named = part.groupBy("qblock").cogroup(q.groupBy("block")).applyInPandas(ranks, "query_id long, rank int, vec_id long, score long, times long")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return named.withColumn("times", copies).drop("times")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 by integer inner product for each row whose vec_id is divisible by 20.

    Null vectors and those with null or non-finite components take no part; an
    empty table gives no rows; fewer than 20 candidates are all returned. Every
    row but the query's own is a candidate, those of the same id too.
    """
    rows = cut(scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    queries = rows.filter(F.col("vec_id") % 20 == 0)
    return search(queries, rows, queries.count(), rows.count())
