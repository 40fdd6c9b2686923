"""Near-duplicate vectors by an exact metric range join.

Equal vectors are one class with a count. Pivots of each label partition its
classes; a vector is copied to another pivot's cell only where the triangle
inequality (cell radius plus range) and the distance to the bisecting plane
allow a partner there. Cells join on their own, in tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import connected_components, cut, table

COSINE = 0.93
#: A label gets a pivot for so many classes; a cell is cut into tiles of so many rows. The pivots of a label travel with
#: each of its parts (2 MB of 64 components at most); beyond 8 million classes of a label its cells grow.
CELL_ROWS, TILE_ROWS, MOST_PIVOTS = 2048, 1024, 4096
#: The square root of 2 - 2xy loses about 1.5e-8 to rounding where vectors are nearly equal.
SLACK = 1e-6
CELLS = "label long, cell int, cid long, m long, home boolean, v array<double>"


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cid) of the vectors that can link, and (label, cid, m, v, first) of their classes.

    A class is the equal vectors of a label, and first its least vec_id; cid numbers the classes, so no two share one,
    and rows that repeat an id with other vectors are classes of their own. Rows whose label or vector is null, zero, or holds null or
    non-finite components link with nothing.
    """
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(ok)
    kind = vectors.schema["label"].dataType
    label = F.col("label").cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(F.col("label").cast("string"))
    rows = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v")))
    found = rows.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
    found = cut(found.withColumn("cid", F.monotonically_increasing_id()))
    member = rows.join(found.select("label", "v", "cid"), ["label", "v"]).select("vec_id", "cid")
    return member, found


def _none(*columns: str) -> pd.DataFrame:
    """No rows; the column of vectors holds objects."""
    return pd.DataFrame({c: pd.Series([], dtype=object if c == "v" else "int64") for c in columns})


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_list()).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # keeps squares in range
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def assigned(found: DataFrame, pivots: DataFrame) -> DataFrame:
    """Home cell, distance and every pivot distance, label by label, in batches of bounded rows."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _none("label", "cell", "cid", "m", "v", "d", "dim")
        right = right.sort_values("cid")
        x, p = _unit(left["v"]), _unit(right["v"])
        d = _distance(x, p)
        home = d.argmin(axis=1)
        return left.assign(cell=home.astype("int32"), d=d[np.arange(len(left)), home])[["label", "cell", "cid", "m", "v", "d", "dim"]]

    dealt = found.withColumn("part", F.pmod(F.xxhash64("cid"), F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.lit(1))))
    spread = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)).cast("long") - 1)))
    return dealt.groupBy("label", "dim", "part").cogroup(spread.groupBy("label", "dim", "part")).applyInPandas(run, "label long, cell int, cid long, m long, v array<double>, d double, dim int")


def copies(homes: DataFrame, pivots: DataFrame, reach: float) -> DataFrame:
    """Each class in its home cell and in every cell that may hold a partner of it."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return _none("label", "dim", "cell", "cid", "m", "home", "v")
        right = right.sort_values("cid")
        x, p = _unit(left["v"]), _unit(right["v"])
        d, between = _distance(x, p), _distance(p, p)
        home = left["cell"].to_numpy()
        own = d[np.arange(len(x)), home][:, None]
        radius = right["radius"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between[home] > 0, (d * d - own * own) / (2 * between[home]), 0)
        go = (d <= radius + reach + SLACK) & (plane <= reach + SLACK) & ~np.isnan(radius)
        go[np.arange(len(x)), home] = True
        i, j = np.nonzero(go)
        out = left.iloc[i][["label", "dim", "cid", "m", "v"]].assign(cell=j.astype("int32"), home=home[i] == j)
        return out[["label", "dim", "cell", "cid", "m", "home", "v"]]

    n = F.greatest(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)).cast("long")
    dealt = homes.withColumn("part", F.pmod(F.xxhash64("cid"), n))
    spread = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return dealt.groupBy("label", "dim", "part").cogroup(spread.groupBy("label", "dim", "part")).applyInPandas(run, "label long, dim int, cell int, cid long, m long, home boolean, v array<double>")


def _tile(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of the tile's left rows (at home here) with its right rows; each left row's
        weighted count, and the edges of a spanning forest."""
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "links": [], "other": []})
        x, y = np.stack(left["v"].to_list()), np.stack(right["v"].to_list())
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        cos = (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :])
        a, b, m = left["cid"].to_numpy(), right["cid"].to_numpy(), right["m"].to_numpy()
        on = (cos >= cosine) & (a[:, None] != b[None, :])
        links = on @ m
        label = b.copy()  # label of each right row: the least id met so far
        mine = a.copy()
        big = np.int64(2**63 - 1)
        while True:
            to = np.minimum(mine, np.where(on, label[None, :], big).min(axis=1))
            back = np.minimum(label, np.where(on, to[:, None], big).min(axis=0))
            if (to == mine).all() and (back == label).all():
                break
            mine, label = to, back
        out = pd.DataFrame({"cid": a, "links": links, "other": mine})
        more = label != b
        return pd.concat([out, pd.DataFrame({"cid": b[more], "links": 0, "other": label[more]})], ignore_index=True)

    return run


def range_join(found: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(cid, links, other) rows: counted links to other classes, and edges cid - other that connect them."""
    reach = math.sqrt(2 - 2 * cosine)
    found = found.drop("first").withColumn("dim", F.size("v"))
    size = found.groupBy("label", "dim").agg(F.count("*").alias("n"))
    found = cut(found.join(size, ["label", "dim"]))
    # Pivots: the first of a seeded order, found among those below a hash bound so that no task sorts a label.
    want = F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(MOST_PIVOTS))
    low = (F.shiftrightunsigned(F.xxhash64(F.lit(9), F.col("cid")), 11) / F.lit(float(2**53))) * F.col("n") < want * 4 + 40
    first = Window.partitionBy("label", "dim").orderBy(F.xxhash64(F.lit(9), F.col("cid")), "cid")
    pivots = cut(found.filter(low).withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= want).select("label", "dim", "cid", "v", "n"))
    homes = cut(assigned(found, pivots).join(size, ["label", "dim"]))
    radius = homes.groupBy("label", "dim", "cell").agg(F.max("d").alias("radius"))
    numbered = pivots.withColumn("cell", (F.row_number().over(Window.partitionBy("label", "dim").orderBy("cid")) - 1).cast("int"))
    with_radius = numbered.join(radius, ["label", "dim", "cell"], "left").select("label", "dim", "cid", "v", "n", "radius")
    placed = cut(copies(homes, with_radius, reach))
    key = ["label", "dim", "cell"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("__all"), F.sum(F.col("home").cast("int")).alias("__home"))
    tiles = placed.join(counts, key)
    parts = lambda c: F.greatest(F.ceil(F.col(c) / TILE_ROWS), F.lit(1)).cast("int")
    tiles = tiles.withColumn("__i", F.pmod(F.xxhash64(F.lit(3), F.col("cid")), parts("__home")).cast("int")).withColumn("__j", F.pmod(F.xxhash64(F.lit(4), F.col("cid")), parts("__all")).cast("int"))
    left = tiles.filter("home").withColumn("j", F.explode(F.sequence(F.lit(0), parts("__all") - 1))).select(*key, F.col("__i").alias("i"), "j", F.lit(0).alias("side"), "cid", "m", "v")
    right = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), parts("__home") - 1))).select(*key, "i", F.col("__j").alias("j"), F.lit(1).alias("side"), "cid", "m", "v")
    return left.unionByName(right).groupBy(*key, "i", "j").applyInPandas(_tile(cosine), "cid long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors.

    A repeated id is one row for each repeat, and each of them links as its own vector does. Rows that can't link are
    their own component. Null ids come back with null component and kept.
    """
    member, found = classes(vectors)
    member = cut(member)
    got = cut(range_join(found, cosine))
    links = got.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(got, "cid", "other")
    of_class = found.select("cid", "m", "first").join(links, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    of_class = cut(of_class.withColumn("component", F.coalesce("component", "cid")))
    least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(least, "component").select("cid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    linked = member.join(of_class, "cid").select("vec_id", "n_links", "component_id")
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    v = F.col("embedding")
    ok = v.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    alone = alone.filter(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings: linked at cosine 0.93 or more when labels are equal and not null."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
