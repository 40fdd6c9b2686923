"""Importance resampling towards a target distribution, by partition-local word tries.

A feature is a run of 1 to `depth` consecutive words; its bucket is the CRC-32
of its bytes modulo BUCKETS. Each task keeps a trie whose edges are words: a
node holds the CRC state of the path to it, so that a longer run goes on from
the state of the shorter one, and a count. Full tries are folded into bucket
totals, and these alone are merged over tasks. A second pass walks the same
kind of trie with each bucket's gain attached to the nodes and adds up the gains
along every document's paths. A Gumbel number from the id makes the highest
sums a draw without replacement, in proportion to the importance weights.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import cut, table
from memlake.llm.text import coded_words, slices, spread, tidy

BUCKETS, DEPTH, SEED = 10_000, 1, 2024
#: Documents of fewer words are not drawn; of the others this share is, rounded down.
LEAST_WORDS, SHARE_NUM, SHARE_DEN = 20, 10, 100
#: A trie of more nodes is folded into its totals and begun anew, so memory does not grow with the partition.
MOST_NODES = 1 << 19
#: Texts walked at once: so many, and so many bytes unless one alone has more.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20
_ABOVE = -1000.0  # thousandths, as gains are, and the sign of the Gumbel number

# Bytes that words consist of: ASCII letters and digits, and all bytes of other characters; A-Z count as a-z.
_BYTES = np.full(256, 32, np.uint8)
_BYTES[128:] = np.arange(128, 256)
for _c in string.ascii_letters + string.digits:
    _BYTES[ord(_c)] = ord(_c.lower())


def feature_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(offsets, codes, words): text i has the words codes[offsets[i]:offsets[i + 1]]; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = texts.take(pa.array(np.arange(len(texts))))  # offsets that begin at 0
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)]) if data is not None else pa.py_buffer(b"")
    got, codes, words = coded_words(pa.LargeStringArray.from_buffers(len(texts), offsets, data))
    return got, codes, words.cast(pa.large_binary()).to_pylist()


class WordTrie:
    """Nodes by (parent, word); a node holds the CRC state of its path's bytes."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.labels: dict[bytes, int] = {}
        self.child: list[dict[int, int]] = [{} for _ in range(depth)]
        self.names: list[bytes] = []
        self.state: list[int] = [0]  # of the root: nothing read

    def children(self, level: int, parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The nodes below parents by labels; those not yet there are made."""
        keys, inverse = np.unique(parents << 32 | labels, return_inverse=True)
        edges, state, out = self.child[level], self.state, np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            node = edges.get(key)
            if node is None:
                name = self.names[key & 0xFFFFFFFF]
                node = edges[key] = len(state)
                state.append(zlib.crc32(b" " + name if level else name, state[key >> 32]))
            out[i] = node
        return out[inverse]

    def walk(self, offsets: np.ndarray, codes: np.ndarray, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level the nodes of all paths, text by text, and the offsets of the texts among them."""
        labels = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            label = self.labels.get(w)
            if label is None:
                label = self.labels[w] = len(self.names)
                self.names.append(w)
            labels[i] = label
        nodes = self.children(0, np.zeros(len(words), np.int64), labels)[codes]
        yield nodes, offsets
        for level in range(1, self.depth):
            size = np.maximum(np.diff(offsets) - level, 0)  # the paths of level + 1 words
            begin = spread(offsets[:-1], size)  # their first words
            paths = np.full(len(codes), -1, np.int64)
            paths[begin] = self.children(level, nodes[begin], labels[codes[begin + level]])
            nodes = paths
            yield paths[begin], np.concatenate(([0], np.cumsum(size)))


def walked(batches: Iterator[pa.RecordBatch], depth: int, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, WordTrie, list]]:
    """(slice of a batch, number of words of its texts, trie, its levels); a trie that grew beyond MOST_NODES is replaced."""
    trie = WordTrie(depth)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        for at, n in slices(texts, SLICE_BYTES, SLICE_ROWS):
            offsets, codes, words = feature_words(texts.slice(at, n))
            yield batch.slice(at, n), np.diff(offsets), trie, list(trie.walk(offsets, codes, words))
            if len(trie.state) > MOST_NODES:
                trie = WordTrie(depth)
        tidy()


def bucket_totals(docs: DataFrame, text: str = "text", depth: int = DEPTH, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket.

    A task sends one number a bucket at most; `buckets` numbers come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, known, counts = np.zeros(buckets, np.int64), None, np.zeros(0, np.int64)

        def fold(trie: WordTrie, counts: np.ndarray) -> np.ndarray:
            place = np.array(trie.state, np.int64)[: len(counts)] % buckets
            return np.bincount(place, counts, buckets).astype(np.int64)

        for _, _, trie, levels in walked(batches, depth, text):
            if trie is not known:
                totals += fold(known, counts) if known is not None else 0
                known, counts = trie, np.zeros(0, np.int64)
            counts = np.concatenate((counts, np.zeros(len(trie.state) - len(counts), np.int64)))  # counts of the nodes
            for nodes, _ in levels:
                counts += np.bincount(nodes, minlength=len(counts))
        totals += fold(known, counts) if known is not None else 0
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(totals[held], pa.int64())], names=["bucket", "n"])

    merged = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in merged.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket in the target and in the corpus, rounded down."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """docs without text, with n_words, n_features and weight (long), which replace columns of these names.

    weight is the sum of the gains of a text's features, repeats counted; a text without words has 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    fields = [c for c in docs.columns if c not in (text, "n_words", "n_features", "weight")]
    schema = T.StructType([*(docs.schema[c] for c in fields), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, known, attached = shared.value, None, np.zeros(0, np.int64)
        for part, n_words, trie, levels in walked(batches, depth, text):
            if trie is not known:
                known, attached = trie, np.zeros(0, np.int64)
            new = np.array(trie.state[len(attached) :], np.int64) % len(by_bucket)
            attached = np.concatenate((attached, by_bucket[new]))
            weight, features = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for nodes, offsets in levels:
                run_of = np.concatenate(([0], np.cumsum(attached[nodes])))
                weight += run_of[offsets[1:]] - run_of[offsets[:-1]]
                features += np.diff(offsets)
            columns = [part.column(part.schema.get_field_index(c)) for c in fields]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n_words, features, weight))], names=[f.name for f in schema])

    return docs.select(*fields, text).mapInArrow(run, schema)


def gumbel(key: str, seed: int = SEED) -> F.Column:
    """Thousandths of a Gumbel number made from seed and key, rounded down; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(_ABOVE) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(rows: DataFrame, key: str, least: int = LEAST_WORDS, num: int = SHARE_NUM, den: int = SHARE_DEN) -> DataFrame:
    """Adds rank: 1, 2, ... by falling score, ties to the smaller key (null last), for the share num / den of the rows
    with at least so many words; null for all others.

    Rows are sorted over all tasks once; a row's place is its place in its task plus the rows of the tasks before,
    one number a task.
    """
    able = F.col("n_words") >= least
    placed = cut(rows.filter(able).orderBy(F.desc("score"), F.asc_nulls_last(key)).withColumn("__at", F.monotonically_increasing_id()))
    task, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    sizes = cut(sizes.select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), "__n"))
    most = (sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0] * num) // den
    place = F.col("__before") + within + 1
    ranked = placed.withColumn("__task", task).join(F.broadcast(sizes.drop("__n")), "__task")
    ranked = ranked.withColumn("rank", F.when(place <= most, place).cast("long")).drop("__at", "__task", "__before")
    return ranked.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs without text, with n_words, n_features, weight, score and rank.

    Null texts have no features; null keys share one Gumbel number and come last among ties; repeated rows count and
    are ranked each; empty tables give no rows (an empty target gives every bucket the gain of its corpus count).
    Columns of the names that are added are replaced.
    """
    docs = docs.drop("score", "rank")
    gain = gains(bucket_totals(docs, text, depth, buckets), bucket_totals(target, text, depth, buckets))
    rows = cut(weighed(docs, gain, text, depth).withColumn("score", F.col("weight") + gumbel(key, seed)))
    return drawn(rows, key)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, drawn towards the texts of benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_FEATURES = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_BYTE = "('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::INT::BIGINT"
OP11_SQL = f"""
WITH RECURSIVE steps(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
words AS (SELECT DISTINCT w FROM dw UNION SELECT DISTINCT w FROM bw),
buckets AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, octet_length(encode(w)) + 1), lambda i: {_BYTE}),
    lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % {BUCKETS} AS b
  FROM words, crc_table),
s AS (SELECT b, count(*) AS n FROM dw JOIN buckets USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN buckets USING (w) GROUP BY b),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
        / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN buckets USING (w) JOIN g USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(len(ws), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {SHARE_NUM} * n // {SHARE_DEN} THEN place END AS rank
FROM scored LEFT JOIN able USING (r)
"""
