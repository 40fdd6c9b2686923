"""Line formats in and out: JSONL export and import, text lines, files by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1


def export_jsonl(rows: DataFrame, path: str, kind: str = "memory") -> None:
    """One JSON object a line, each naming its kind and format version; vectors stay behind."""
    keep = [c for c, t in rows.dtypes if not t.startswith("array<float") and not t.startswith("array<double")]
    line = F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(FORMAT_VERSION).alias("version"), *keep))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def import_jsonl(spark: SparkSession, path: str, schema: str, known: DataFrame | None = None, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): rows whose id is not known yet, each id once; lines that do not parse are reported."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col(f"r.{id_col}").isNull()
    rows = parsed.filter(~broken).select("r.*").drop("_bad").dropDuplicates([id_col])
    if known is not None:
        rows = rows.join(known.select(id_col), id_col, "left_anti")
    return rows, parsed.filter(broken).select("value")


def ingest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line that is not blank is a memory; its id is a digest, so a repeated ingest adds nothing."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.sha2("value", 256).alias("id"), F.col("value").alias("content")).dropDuplicates(["id"])


def media_type(content: Column) -> Column:
    """Kind of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    starts = lambda *h: F.greatest(*[head.startswith(x) for x in h]) if len(h) > 1 else head.startswith(h[0])
    return (
        F.when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg").when(starts("474946383761", "474946383961"), "image/gif")
        .when(starts("25504446"), "application/pdf").when(starts("504B0304"), "application/zip")
        .when(starts("52494646") & head.substr(17, 8).eqNullSafe("57454250"), "image/webp")
        .when(F.lower(F.decode(F.substring(content, 1, 200), "ISO-8859-1")).rlike(r"^\s*<(!doctype html|html)"), "text/html").otherwise("text/plain")
    )


def png_size(content: Column) -> Column:
    """width and height from a PNG's header."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(media_type(content) == "image/png", F.struct(number(17).alias("width"), number(21).alias("height")))


def decoded(content: Column) -> Column:
    """Text of bytes: by its mark UTF-8 or UTF-16, else UTF-8 where it is valid, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head.startswith("EFBBBF"), F.expr("substring(decode({c}, 'UTF-8'), 2)".format(c="content")))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    )


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with digest, kind and text (HTML as its text)."""
    from memlake.operators.text import html_text

    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("digest"))
    files = files.withColumn("kind", media_type(F.col("content")))
    text = F.when(F.col("kind").startswith("text/"), decoded(F.col("content")))
    return files.withColumn("text", text).withColumn("text", F.when(F.col("kind") == "text/html", html_text("text")).otherwise(F.col("text"))).drop("content")
