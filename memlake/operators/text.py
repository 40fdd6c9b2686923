"""Text functions over columns: table functions by explode, scalars as Arrow UDFs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import chunks, dates, extract, screening, words
from memlake.functions.arrow import batched, over


def stems(text: Column | str) -> Column:
    return over(words.terms, "array<string>", text)


def coverage(query: Column | str, text: Column | str) -> Column:
    return over(lambda q, t: words.coverage(q, t or ""), "double", query, text)


def embed(text: Column | str, dim: int = 256) -> Column:
    """The hash embedding; null for a null text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), batched(lambda values: words.embed_all(values, dim), "array<double>", c))


def anchors(text: Column | str) -> Column:
    return over(words.anchors, "array<string>", text)


def redact(text: Column | str, pii: bool = False) -> Column:
    def run(t):
        out, kinds = screening.redact(t, pii)
        return {"text": out, "kinds": kinds}

    return over(run, "struct<text:string,kinds:array<string>>", text)


def screen(text: Column | str) -> Column:
    return over(screening.screen, "array<string>", text)


def html_text(html: Column | str) -> Column:
    return over(chunks.html_text, "string", html)


def find_dates(text: Column | str, reference: str) -> Column:
    ref = datetime.date.fromisoformat(reference)
    run = lambda t: [{"start": a, "end": b, "expression": x, "place": p} for a, b, x, p in dates.find_dates(t, ref)]
    return over(run, "array<struct<start:date,end:date,expression:string,place:int>>", text)


def chunked(docs: DataFrame, id_col: str, text: str, title: str | None = None, budget: int = 300, overlap: int = 40) -> DataFrame:
    """One row for each chunk of a document: id, index, path, body."""
    run = lambda t, name: [{"index": i, "path": p, "body": b} for i, p, b in chunks.chunk(t, name, budget=budget, overlap=overlap)]
    made = over(run, "array<struct<index:int,path:string,body:string>>", F.col(text), F.col(title) if title else F.lit(None).cast("string"))
    return docs.select(F.col(id_col).alias("id"), F.explode(made).alias("c")).select("id", "c.*")


def stated_facts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row for each fact a text states."""
    run = lambda t: [{"subject": s, "attribute": a, "value": v} for s, a, v in extract.facts(t)]
    made = over(run, "array<struct<subject:string,attribute:string,value:string>>", F.col(text))
    return docs.select(F.col(id_col).alias("id"), F.explode(made).alias("f")).select("id", "f.*")


def statements(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row for each statement, with its op: add, retract or previous."""
    run = lambda t: [{"op": o, "subject": s, "attribute": a, "value": v} for o, s, a, v in extract.statements(t)]
    made = over(run, "array<struct<op:string,subject:string,attribute:string,value:string>>", F.col(text))
    return docs.select(F.col(id_col).alias("id"), F.explode(made).alias("f")).select("id", "f.*")


def write_policy(rows: DataFrame, text: str, pii: bool = False) -> DataFrame:
    """Redacts, then screens: adds kinds, reasons and accepted (false sends the row to quarantine)."""
    cleaned = rows.withColumn("__r", redact(text, pii)).withColumn(text, F.col("__r.text")).withColumn("kinds", F.col("__r.kinds")).drop("__r")
    return cleaned.withColumn("reasons", screen(text)).withColumn("accepted", F.size("reasons") == 0)


def validated(rows: DataFrame, text: str, most_bytes: int = 1_000_000) -> DataFrame:
    """Adds reject_reason: why a write may not pass, or null."""
    c = F.col(text)
    why = F.when(c.isNull(), "not text").when(F.trim(c) == "", "blank").when(F.octet_length(c) > most_bytes, "too long")
    return rows.withColumn("reject_reason", why)


def fit_budget(lines: DataFrame, by: str, priority: str, text: str, order: str, budget: int) -> DataFrame:
    """Lines of each briefing that fit its budget; a briefing is a bounded list, packed by itself."""
    from pyspark.sql.types import StructType

    schema = StructType(lines.schema.fields)

    def run(pdf):
        pdf = pdf.sort_values(order).reset_index(drop=True)
        return pdf.iloc[chunks.fit(list(zip(pdf[priority], pdf[text], strict=True)), budget)]

    return lines.groupBy(by).applyInPandas(run, schema)
