"""Token counts as delta-maintained rollups.

A batch holds signed rows: an insert counts +1, a delete -1, a revision -1 for
the old text and +1 for the new one. Each batch is reduced to additive deltas
by source, language and tokenizer version and committed once under its id as
a Parquet folder whose _SUCCESS marker makes it visible; a repeated commit
changes nothing, and one that broke off is written anew. Totals are the sums
of all committed deltas, so batches may come in any order.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import ensure_checkpoint_dir, table

VOCABULARY = "byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k@1"
KEYS = ("source", "lang", "tokenizer_version")
SIGNED = "source string, lang string, tokenizer_version string, docs long, tokens long"
_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file (a path, or a name among the public ones), one a worker."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


#: Texts beyond this many characters are encoded in pieces cut before a space that follows a letter or
#: digit, where the tokenizer's pattern always begins a new piece; counts stay exact and memory bounded.
LONG_TEXT = 1 << 20
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text; a null or empty one has none."""
    if not text:
        return 0
    enc, at, n = encoder(vocabulary), 0, 0
    while len(text) - at > LONG_TEXT:
        found = _SAFE.search(text, at + LONG_TEXT)
        if not found:
            break
        n += len(enc.encode_ordinary(text[at : found.start()]))
        at = found.start()
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def signed_rows(changes: DataFrame) -> DataFrame:
    """(sign, source, lang, text) from changes with op and the values before and after.

    op: insert (source, lang, text), delete (old_source, old_lang, old_text) or
    revise (all six). Other values of op, and null, are an error when the rows
    are read.
    """
    new = F.struct(F.lit(1).alias("sign"), "source", "lang", "text")
    old = F.struct(F.lit(-1).alias("sign"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_text").alias("text"))
    rows = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(old, new)).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    return changes.select(F.explode(rows).alias("r")).select("r.*")


def deltas(rows: DataFrame, version: str = VERSION, vocabulary: str = VOCABULARY) -> DataFrame:
    """Additive deltas of signed rows, summed within each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count_tokens(t, vocabulary) for t in b.column("text").to_pylist()], pa.int64())
            sign = b.column("sign").cast(pa.int64())
            part = pa.table({"source": b.column("source"), "lang": b.column("lang"), "docs": sign, "tokens": pc.multiply(sign, n)})
            part = part.group_by(["source", "lang"]).aggregate([("docs", "sum"), ("tokens", "sum")])
            out = pa.table({"source": part["source"], "lang": part["lang"], "tokenizer_version": pa.array([version] * len(part), pa.string()), "docs": part["docs_sum"], "tokens": part["tokens_sum"]})
            yield from out.to_batches()

    counted = rows.select("sign", "source", "lang", "text").mapInArrow(run, SIGNED)
    return counted.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """The committed batches under a folder of a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError("a batch id has letters, digits, _ and - only")
        return f"{self.path}/batch_id={batch_id}"

    def committed(self, batch_id: str) -> bool:
        p, fs = self._fs(self._folder(batch_id) + "/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Writes the deltas of a batch unless it is there; True if this call did.

        One writer commits a batch at a time: two that write the same id at once are not told apart, so the caller
        gives each id to one of them.
        """
        if self.committed(batch_id):
            return False
        changes.coalesce(1).write.mode("overwrite").parquet(self._folder(batch_id))
        return True

    def batches(self) -> list[str]:
        p, fs = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n.partition("=")[2] for n in names if n.startswith("batch_id=") and self.committed(n.partition("=")[2]))

    def totals(self) -> DataFrame:
        """docs and tokens by key over all committed batches; keys whose sums are all 0 are gone."""
        found = self.batches()
        rows = self.spark.read.schema(SIGNED).parquet(*[self._folder(b) for b in found]) if found else self.spark.createDataFrame([], SIGNED)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, lang and tokenizer_version of all documents, reached through signed batches.

    A tenth of the documents is loaded under another source and language and revised later; another tenth is loaded
    twice over and deleted once. The batches are committed out of order and each of them twice, so the totals are those
    of the documents as they are. Null sources and languages are keys of their own.
    """
    ensure_checkpoint_dir(spark)
    rollup = Rollup(spark, f"{spark.sparkContext.getCheckpointDir()}/token_counts_{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(10)).alias("tenth"))
    moved, twice = F.col("tenth") == 0, F.col("tenth") == 1
    null = F.lit(None).cast("string")
    blank = [null.alias(f"old_{c}") for c in ("source", "lang", "text")]
    load = docs.select(F.lit("insert").alias("op"), F.when(moved, F.lit("unsorted")).otherwise(F.col("source")).alias("source"), F.when(moved, null).otherwise(F.col("lang")).alias("lang"), "text", *blank)
    again = docs.filter(twice).select(F.lit("insert").alias("op"), "source", "lang", "text", *blank)
    gone = docs.filter(twice).select(F.lit("delete").alias("op"), *[null.alias(c) for c in ("source", "lang", "text")], *[F.col(c).alias(f"old_{c}") for c in ("source", "lang", "text")])
    sorted_in = docs.filter(moved).select(F.lit("revise").alias("op"), "source", "lang", "text", F.lit("unsorted").alias("old_source"), null.alias("old_lang"), F.col("text").alias("old_text"))
    for batch_id, changes in (("revised", sorted_in.unionByName(gone)), ("load", load.unionByName(again))):
        batch = deltas(signed_rows(changes))
        rollup.commit(batch_id, batch)
        rollup.commit(batch_id, batch)
    return rollup.totals()
