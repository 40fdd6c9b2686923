"""N-gram Jaccard join with signature trees.

Documents become sets of hashed word shingles; equal sets are one class. In any
fixed order of all shingles, two sets at or above the threshold share l of the
first size - ceil(threshold * size) + l shingles of either. So a class whose
beginning (with l - 1 a twentieth of its size) shares too few shingles with
others has no partner and goes, and the others meet in cells made of shared
shingles; common shingles come last in the order. In a cell, a signature tree holds OR-combined token bitmaps and size ranges;
a dual traversal drops pairs of nodes whose largest possible overlap is too
small, or that are connected already, and the rest is checked exactly.

Stage 1 joins whole sets that share their first shingle, in cells of bounded
size, and connects most copies. Stage 2 makes the result complete: it takes
every shingle whose classes are not all connected yet, and only pairs that are
not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import connected_components, cut, merge_components, table
from memlake.llm.text import tidy, word_codes

WORDS, NUM, DEN = 4, 85, 100
BITS = 1024
LEAF, FAN = 8, 8
#: A beginning is longer by a share of the set, which a partner must share in turn.
EXTRA = 20
CELL_DOCS, HOT_KEY, CROWD = 512, 512, 64
#: Shingles that at least one document in so many holds count as common and come last in the order.
COMMON_SHARE = 500
BATCH_DOCS = 500
#: Ids of documents still in play are broadcast up to this number of them; beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000
_MUL = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each whole text's sorted distinct 64-bit shingle hashes (A-Z lower-cased); a text with fewer
    words has its whole sequence as one shingle, one without words none."""
    offsets, codes, names = word_codes(texts, lower=True)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[codes]
    n = max(len(w) - words + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            h = (h ^ (h >> np.uint64(31))) * _MUL[4] + w[k : n + k] * _MUL[k % 4]
        h ^= h >> np.uint64(32)
        h *= _MUL[3]
        h ^= h >> np.uint64(29)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(h[a : b - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, num: int = NUM, den: int = DEN) -> int:
    """So many first shingles of n hold 1 + n // EXTRA that a partner of no smaller size shares."""
    return min(n, n - -(-num * n // den) + 1 + n // EXTRA)


def bitmap(h: np.ndarray) -> np.ndarray:
    on = np.zeros(BITS, np.uint8)
    on[(h >> np.uint64(17)) & np.uint64(BITS - 1)] = 1
    return np.packbits(on).view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class SignatureTree:
    """Levels of nodes over documents in the given order; the last level is one root."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, comp: np.ndarray) -> None:
        self.bits, self.size, self.comp = bits, size, comp
        self.surplus = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        level = {"or": bits, "lo": size, "hi": size, "surplus": self.surplus, "comp": comp}
        self.levels, fan = [], LEAF
        while True:
            at = np.arange(0, len(level["lo"]), fan)
            up = {"or": np.bitwise_or.reduceat(level["or"], at, axis=0), "lo": np.minimum.reduceat(level["lo"], at), "hi": np.maximum.reduceat(level["hi"], at), "surplus": np.maximum.reduceat(level["surplus"], at)}
            low, high = np.minimum.reduceat(level["comp"], at), np.maximum.reduceat(level["comp"], at)
            up["comp"] = np.where(low == high, low, -1)  # -1: not all in one component
            self.levels.append(up)
            if len(at) == 1:
                break
            level, fan = up, FAN

    def pairs(self, num: int = NUM, den: int = DEN, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Dual traversal: (a, b, largest possible overlap) of document pairs a < b that may reach the threshold."""
        stack = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while stack:
            k, i, j = stack.pop()
            if len(i) > most:
                half = len(i) // 2
                stack += [(k, i[half:], j[half:]), (k, i[:half], j[:half])]
                continue
            t = self.levels[k]
            both = np.bitwise_count(t["or"][i] & t["or"][j]).sum(axis=1).astype(np.int64)
            cap = np.minimum(np.minimum(t["hi"][i], t["hi"][j]), both + np.minimum(t["surplus"][i], t["surplus"][j]))
            ok = (num + den) * cap >= num * (t["lo"][i] + t["lo"][j])
            ok &= den * np.minimum(t["hi"][i], t["hi"][j]) >= num * np.maximum(t["lo"][i], t["lo"][j])
            ok &= (t["comp"][i] != t["comp"][j]) | (t["comp"][i] < 0)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            fan = FAN if k else LEAF
            below = len(self.levels[k - 1]["lo"]) if k else len(self.size)
            ci = (i[:, None, None] * fan + np.arange(fan)[None, :, None]).repeat(fan, axis=2).ravel()
            cj = (j[:, None, None] * fan + np.arange(fan)[None, None, :]).repeat(fan, axis=1).ravel()
            keep = (ci < below) & (cj < below) & ((ci < cj) if not k else (ci <= cj))
            ci, cj = ci[keep], cj[keep]
            if k:
                stack.append((k - 1, ci, cj))
                continue
            for s in range(0, len(ci), most):
                a, b = ci[s : s + most], cj[s : s + most]
                only_a = np.bitwise_count(self.bits[a] & ~self.bits[b]).sum(axis=1).astype(np.int64)
                only_b = np.bitwise_count(self.bits[b] & ~self.bits[a]).sum(axis=1).astype(np.int64)
                cap = np.minimum(self.size[a] - only_a, self.size[b] - only_b)
                ok = ((num + den) * cap >= num * (self.size[a] + self.size[b])) & (self.comp[a] != self.comp[b])
                if ok.any():
                    yield a[ok], b[ok], cap[ok]


def _common(words: int):
    """Shingles that three documents of a batch hold, with their number there. They decide an order only: the
    result does not depend on which are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), BATCH_DOCS):
                texts = b.column("text").slice(s, BATCH_DOCS)
                sets = shingle_sets(texts, words)
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                on = n >= max(3, len(texts) // COMMON_SHARE)
                yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(n[on])], names=["h", "n"])
            tidy()

    return run


def _describe(words: int, num: int, den: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), BATCH_DOCS):
                part = b.slice(s, BATCH_DOCS)
                n, digest, keys, bits = [], [], [], []
                for h in shingle_sets(part.column("text"), words):
                    n.append(len(h))
                    digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    if len(h):
                        p = prefix_size(len(h), num, den)
                        if len(common):
                            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                            late = common[at] == h
                            order = np.concatenate((h[~late], h[late]))[:p]
                        else:
                            order = h[:p]
                        keys.append(order.view(np.int64))
                        bits.append(bitmap(h).tobytes())
                    else:
                        keys.append(np.zeros(0, np.int64))
                        bits.append(b"")
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), flat, pa.array(bits, pa.binary())], names=["doc_id", "n", "digest", "keys", "bits"])
            tidy()

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), BATCH_DOCS):
                part = b.slice(s, BATCH_DOCS)
                got = [h.tobytes() for h in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lo"), part.column("hi"), pa.array(got, pa.binary())], names=["doc_id", "lo", "hi", "h"])
            tidy()

    return run


def _join_cell(num: int, den: int):
    """Components of the exact links within a cell: (a, b = its least id, links checked for a), for those of two or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(h, np.uint64) for h in pdf["h"]]
        size = np.array([len(h) for h in sets], np.int64)
        order = np.lexsort((size, pdf["key"].to_numpy()))
        sets, size, ids = [sets[i] for i in order], size[order], pdf["doc_id"].to_numpy()[order]
        _, comp = np.unique(pdf["comp"].to_numpy()[order], return_inverse=True)
        tree = SignatureTree(np.stack([bitmap(h) for h in sets]), size, comp)
        root = [int(x) for x in np.unique(comp, return_index=True)[1][comp]]
        degree = np.zeros(len(sets), np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b, cap in tree.pairs(num, den):
            for i in np.argsort(-cap, kind="stable"):
                x, y = int(a[i]), int(b[i])
                rx, ry = find(x), find(y)
                if rx == ry:
                    continue
                o = overlap(sets[x], sets[y])
                if den * o >= num * (size[x] + size[y] - o):
                    root[max(rx, ry)] = min(rx, ry)
                    degree[x] += 1
                    degree[y] += 1
        got = pd.DataFrame({"a": ids, "root": [find(x) for x in range(len(sets))], "d": degree})
        got["b"] = got.groupby("root")["a"].transform("min")
        return got.loc[got["d"] > 0, ["a", "b", "d"]].astype("int64")

    return run


def _candidates(num: int, den: int):
    """Pairs of classes in a cell that share some of its shingles, aren't connected, and may reach the threshold:
    (a, b, shingles shared here, shingles needed in all cells together). Each shingle's classes have a tree; one of
    at most CROWD classes is a single leaf, and leaves of a size are tested together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "shared": [], "need": []}, dtype="int64")
        docs = pdf.drop_duplicates("doc_id").sort_values(["n", "comp", "doc_id"])
        if len(docs) < 2:
            return none
        ids, size, comp = (docs[c].to_numpy() for c in ("doc_id", "n", "comp"))
        bits = np.frombuffer(b"".join(docs["bits"]), np.uint64).reshape(len(docs), -1)
        side = docs["side"].to_numpy() if "side" in docs else np.full(len(docs), -1)
        place = pd.Series(np.arange(len(docs)), ids)
        rows = pd.DataFrame({"key": pdf["key"].to_numpy(), "at": place[pdf["doc_id"].to_numpy()].to_numpy()}).drop_duplicates().sort_values(["key", "at"])
        at = rows["at"].to_numpy()
        _, start, crowd = np.unique(rows["key"].to_numpy(), return_index=True, return_counts=True)
        found = []

        def test(a: np.ndarray, b: np.ndarray) -> None:
            for s in range(0, len(a), 100_000):
                x, y = a[s : s + 100_000], b[s : s + 100_000]
                ok = (comp[x] != comp[y]) & ((side[x] != side[y]) | (side[x] < 0)) & (den * size[x] >= num * size[y])  # size[x] <= size[y]
                x, y = x[ok], y[ok]
                only_x, only_y = np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1), np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1)
                cap = np.minimum(size[x] - only_x, size[y] - only_y)
                ok = (num + den) * cap >= num * (size[x] + size[y])
                found.append(x[ok].astype(np.int64) * len(ids) + y[ok])

        for g in np.unique(crowd[(crowd > 1) & (crowd <= CROWD)]):
            members = at[start[crowd == g][:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            for s in range(0, len(members), max(1, 400_000 // len(i))):
                m = members[s : s + max(1, 400_000 // len(i))]
                test(m[:, i].ravel(), m[:, j].ravel())
        for k in np.flatnonzero(crowd > CROWD):
            own = at[start[k] : start[k] + crowd[k]]
            for a, b, _ in SignatureTree(bits[own], size[own], comp[own]).pairs(num, den):
                test(own[a], own[b])
        pair, shared = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        x, y = np.divmod(pair, len(ids))
        return pd.DataFrame({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "shared": shared, "need": 1 + np.minimum(size[x], size[y]) // EXTRA}).astype("int64")

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["ha"], pdf["hb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                o = overlap(x, y)
                ok.append(den * o >= num * (len(x) + len(y) - o))
            yield pdf.loc[ok, ["a", "b"]]

    return run


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """At most COMMON_SHARE times the mean set size of them, whatever the number of documents."""
    n = docs.count()
    counted = docs.select("text").mapInArrow(_common(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = counted.filter(F.col("n") >= max(16, n / COMMON_SHARE)).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    return np.sort(got)


def with_cells(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """docs that have a cell, by a broadcast of counted ids or a shuffle."""
    return docs.join(F.broadcast(cells) if cells.count() <= BROADCAST_IDS else cells, "doc_id")


def join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Rows without words or text link with nothing, and neither do null ids (their
    component is null). Of repeated ids with different texts each row joins for
    itself, under a number of its id and text, and takes the least id of its component.
    An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return join_unique(docs, words, num, den)
    # Numbers for what differs in id or text; texts of one id are told apart by 128 bits.
    digests = [F.xxhash64(F.lit(i), "text").alias(f"t{i}") for i in (1, 2)]
    keyed = docs.filter("doc_id is not null").select("doc_id", "text", *digests)
    numbers = cut(keyed.select("doc_id", "t1", "t2").distinct().withColumn("own", F.monotonically_increasing_id()))
    keyed = keyed.join(numbers, ["doc_id", "t1", "t2"])
    named = keyed.select("own", F.col("doc_id").alias("name"))
    got = join_unique(keyed.select(F.col("own").alias("doc_id"), "text").unionByName(docs.filter("doc_id is null")), words, num, den)
    known = cut(named.join(got.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "own"), "own"))
    least = known.groupBy("component_id").agg(F.min("name").alias("least"))
    rows = known.join(least, "component_id").select(F.col("name").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    return rows.unionByName(got.filter("doc_id is null"))


def join_unique(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """join() of rows whose ids stand for one text each."""
    common = common_shingles(docs, words)
    schema = "doc_id long, n long, digest binary, keys array<long>, bits binary"
    told = cut(docs.mapInArrow(_describe(words, num, den, common), schema))
    live = told.filter("n > 0 and doc_id is not null")
    rep = cut(live.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    copies = cut(live.select("digest", "doc_id").join(rep, "digest").filter("doc_id <> rep").select("digest", "doc_id"))
    classes = live.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, ["digest", "doc_id"], "left_anti")
    keyed = classes.select("doc_id", F.explode("keys").alias("key"))
    crowds = lambda r: r.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    rows = cut(keyed.join(crowds(keyed), "key"))
    # Classes that share enough shingles to have a partner; then the shingles that these share.
    need = F.lit(1) + F.floor(F.ceil(F.col("n") * num / den) / EXTRA)
    able = classes.select("doc_id", "n").join(rows.groupBy("doc_id").agg(F.count("*").alias("c")), "doc_id").filter(F.col("c") >= need).select("doc_id")
    rows = cut(rows.drop("df").join(able, "doc_id"))
    rows = cut(rows.join(crowds(rows), "key"))

    # Stage 1: whole sets that share their least shared shingle, then those not connected that share their greatest.
    ends = cut(rows.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")))
    n_cells = max(1, -(-ends.count() // CELL_DOCS))
    sets = cut(with_cells(docs, ends).mapInArrow(_sets(words), "doc_id long, lo long, hi long, h binary"))
    link = "a long, b long, d long"

    def cells(some: DataFrame, key: str, seed: int) -> DataFrame:
        """Classes that share the key in one cell, or in as many as hold their crowd."""
        crowd = some.groupBy(key).agg(F.count("*").alias("__crowd"))
        chunk = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.ceil(F.col("__crowd") / CELL_DOCS))
        cell = F.pmod(F.xxhash64("__key", chunk), F.lit(n_cells))
        return some.withColumnRenamed(key, "__key").join(crowd.withColumnRenamed(key, "__key"), "__key").select("doc_id", F.col("__key").alias("key"), cell.alias("cell"), "comp", "h")

    def with_comp(some: DataFrame) -> DataFrame:
        return some.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")

    links = cut(cells(sets.withColumn("comp", F.col("doc_id")), "lo", 1).groupBy("cell").applyInPandas(_join_cell(num, den), link))
    comp = cut(connected_components(links))
    comp = cut(merge_components(comp, cells(with_comp(sets), "hi", 2).groupBy("cell").applyInPandas(_join_cell(num, den), link)))

    # Where crowds were cut into several cells, the class with most links of each component meets its like.
    if not ends.groupBy("lo").count().filter(F.col("count") > CELL_DOCS).isEmpty():
        lead = links.join(comp.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.max(F.struct("d", "a"))["a"].alias("doc_id")).select("doc_id")
        comp = cut(merge_components(comp, cells(with_comp(sets.join(lead, "doc_id")), "lo", 3).groupBy("cell").applyInPandas(_join_cell(num, den), link)))

    # Stage 2: shingles whose classes are not all connected.
    named = cut(with_comp(rows.select("doc_id", "key", "df")))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_rows = named.join(open_keys, "key").join(classes.select("doc_id", "n", "bits"), "doc_id")
    open_rows = cut(open_rows.select("doc_id", "key", "df", "comp", "n", "bits"))
    n_open = max(1, -(-open_rows.count() // (4 * CELL_DOCS)))
    small = open_rows.filter(F.col("df") <= HOT_KEY).withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(n_open))).drop("df")
    pair = "a long, b long, shared long, need long"
    pairs = small.groupBy("cell").applyInPandas(_candidates(num, den), pair)
    # A hot shingle's classes meet in tiles, each pair of parts in one.
    parts = F.ceil(F.col("df") / HOT_KEY).cast("int")
    hot = open_rows.filter(F.col("df") > HOT_KEY).withColumn("part", F.pmod(F.xxhash64(F.lit(8), "doc_id"), parts).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    hot = hot.withColumn("side", F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise((F.col("part") < F.col("other")).cast("int")))
    hot = hot.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("df", "part", "other")
    tiles = hot.groupBy("key", "i", "j").applyInPandas(_candidates(num, den), pair)
    pairs = pairs.unionByName(tiles).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
    pairs = cut(pairs.filter("shared >= need").select("a", "b"))
    checked = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb")), "b")
    more = checked.select("a", "b", "ha", "hb").mapInPandas(_verify(num, den), "a long, b long")
    comp = merge_components(comp, more)

    of_rep = rep.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = told.select("doc_id", "n", "digest").join(of_rep, "digest", "left")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 4-word shingles, linked at Jaccard 0.85 or more."""
    return join(table(spark, sf_dir, "documents"))
