"""Line dedup by site-relative frequency, with built-in functions only.

For each host, the share of its other pages that contain a page's line is
compared with a ratio; lines above it are that site's boilerplate and go from
all its pages. Pages of equal text are one page here, and a line of fewer than
LEAST pages is never boilerplate, however small the site: copies of a page, and
what two pages share, keep their text. A line of a few words may recur by
chance and needs a larger share than one as long as a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import BROADCAST_ROWS, cut, source_key, table

#: The share above which a line is boilerplate, and that for lines of at least so many words, which do not recur by chance.
RATIO, LONG_RATIO, LONG_WORDS = 0.1, 0.01, 5
#: A share of few texts says little: a line stands in so many different texts of its host before it can be boilerplate.
LEAST = 3
#: Ways that the pages of a host are spread over where the lines are too many to broadcast.
SALTS = 16
BLANKS = " \t\r"
#: Matches once in each line that is not blank.
NONBLANK = r"[^ \t\r\n][^\n]*"

# Parts of a page that hold no text, and elements that end a line.
NO_TEXT = "(?is)<(?:script.*?</script|style.*?</style|head.*?</head|!--.*?--)>"
LINE_END = "(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?:[ /][^>]*)?>"
ANY_TAG = "<[^>]*>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_keys(line: Column) -> list[Column]:
    """128 bits of a trimmed line: two seeded 64-bit hashes."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(77), line).alias("b")]


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, long_ratio: float = LONG_RATIO, least: int = LEAST) -> DataFrame:
    """(host, two lists of keys) of the lines that stand in `least` different texts of the host, and in more than ratio
    of its other texts, seen from one that holds them.

    Equal texts of a host count as one, so that copies of a page don't make its lines boilerplate. Blank lines never
    count. A text counts a line once. Hosts may be null (one site of its own).
    """
    pages = pages.select(source_key(F.col(host)).alias("__host"), F.col(text).alias("__text"))
    # The hashes are taken once a text, before its lines are dealt out. Every text has one blank line more: the texts
    # that hold it are all texts of the host. A null text has no lines.
    pages = pages.select("__host", "__text", F.xxhash64("__text").alias("t"), F.hash("__text").alias("u"))
    own = pages.select("__host", "t", "u", F.explode(F.concat(F.split("__text", "\n"), F.array(F.lit("")))).alias("__l")).withColumn("__l", bare(F.col("__l")))
    spaces = F.length("__l") - F.length(F.replace("__l", F.lit(" "), F.lit("")))
    own = own.select("__host", *line_keys(F.col("__l")), (spaces >= LONG_WORDS - 1).alias("long"), (F.col("__l") == "").alias("blank"), "t", "u")
    key = ["__host", "a", "b", "long", "blank"]
    lines = own.select(*key, "t", "u").distinct().groupBy(*key).agg(F.count("*").alias("n"))
    lines = cut(lines.filter(F.col("blank") | (F.col("n") >= least)))
    total = lines.filter("blank").select("__host", F.col("n").alias("pages"))
    share = F.when(F.col("long"), F.lit(long_ratio)).otherwise(F.lit(ratio))
    over = lines.filter(~F.col("blank")).join(total, "__host").filter(F.col("n") - 1 > (F.col("pages") - 1) * share)
    # One site has no more such lines than a page has on average, divided by the smaller ratio.
    return over.groupBy("__host").agg(F.collect_list("a").alias("__a"), F.collect_list("b").alias("__b"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, long_ratio: float = LONG_RATIO, least: int = LEAST) -> DataFrame:
    """pages with the site's boilerplate lines taken out of text; adds __lines and __dropped (which replace columns of these names).

    A text all of whose lines are boilerplate becomes empty; null stays null; no
    page goes. Copies of a page keep or lose the same lines and count as one.
    Blanks, tabs and carriage returns at the ends of a line do not tell lines apart.
    """
    pages = pages.drop("__lines", "__dropped")
    known = cut(boilerplate(pages, host, text, ratio, long_ratio, least))
    rows = known.agg(F.coalesce(F.sum(F.size("__a")), F.lit(0))).first()[0]
    keyed = pages.withColumn("__host", source_key(F.col(host)))
    if rows <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(known), "__host", "left")
    else:  # a hot site's pages are dealt over SALTS keys, each with the site's lines
        salted = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("__salt", F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left").drop("__salt")

    def stays(line: Column) -> Column:
        """The second hash is looked at only where the first is found."""
        a, b = line_keys(bare(line))
        return ~(F.array_contains("__a", a) & F.array_contains("__b", b))

    split = F.split(text, "\n")
    out = joined.withColumn("__kept", F.when(F.col("__a").isNull(), split).otherwise(F.filter(split, stays)))
    out = out.withColumn("__lines", F.coalesce(F.regexp_count(text, F.lit(NONBLANK)), F.lit(0)))
    out = out.withColumn("__dropped", F.greatest(F.coalesce(F.size(split) - F.size("__kept"), F.lit(0)), F.lit(0)))
    return out.withColumn(text, F.when(F.col("__dropped") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text))).drop("__kept", "__a", "__b", "__host")


def page_text(html: Column) -> Column:
    """Text of a page, a line for each block element; entities stay as written."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NO_TEXT, ""), LINE_END, "\n"), ANY_TAG, "")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the remaining text of every page.

    A null url has the host null; a null html has no lines and a null text.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), page_text(F.col("html")).alias("text"))
    out = drop_boilerplate(pages, "host", "text")
    return out.select("page_id", "host", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")


_TRIM = "trim(x, ' ' || chr(9) || chr(13))"
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, coalesce(lower(regexp_extract(url, '{HOST}', 1)), chr(1)) AS hk,
         regexp_replace(regexp_replace(regexp_replace(html, '{NO_TEXT}', '', 'g'), '{LINE_END}', chr(10), 'g'), '{ANY_TAG}', '', 'g') AS text
  FROM pages),
bodies AS (SELECT DISTINCT hk, text FROM p WHERE text IS NOT NULL),
l AS (SELECT hk, line, count(*) AS n FROM (
  SELECT hk, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM}), lambda x: x <> ''))) AS line FROM bodies) GROUP BY hk, line),
t AS (SELECT hk, count(*) AS pages FROM bodies GROUP BY hk),
b AS (SELECT l.hk, list(l.line) AS boiler FROM l JOIN t USING (hk)
      WHERE l.n >= {LEAST} AND l.n - 1 > (t.pages - 1) * CASE WHEN length(l.line) - length(replace(l.line, ' ', '')) >= {LONG_WORDS - 1} THEN {LONG_RATIO}::DOUBLE ELSE {RATIO}::DOUBLE END GROUP BY l.hk),
k AS (SELECT page_id, host, string_split(text, chr(10)) AS lines,
             list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(b.boiler, []), {_TRIM})) AS kept
      FROM p LEFT JOIN b USING (hk))
SELECT page_id, host, coalesce(len(list_filter(lines, lambda x: {_TRIM} <> '')), 0)::INT AS n_lines,
       coalesce(len(lines) - len(kept), 0)::INT AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM k
"""
