"""Line dedup by site-relative frequency: a line that stands on more than a
given share of its site's pages is boilerplate and goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm.common import stored, table

RATIO = 0.1       # of a host's pages
LEAST_PAGES = 2   # pages that hold a line before it can be boilerplate: what stands on one page repeats nowhere

# What ends a line in HTML, and what is no text.
BLOCKS = (r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
          r"|</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|meta|nav"
          r"|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>|<!doctype[^>]*>")
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column | str) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    c = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), HOST, 1))


def html_lines(html: Column | str) -> Column:
    """The text lines of a page: block tags end a line, other tags vanish, empty lines are left out."""
    c = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    text = F.regexp_replace(F.regexp_replace(c, BLOCKS, "\n"), TAGS, "")
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def text_lines(text: Column | str) -> Column:
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.split(c, "\n", -1)


def boilerplate(pages: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """(site, line_key) of lines on at least ``least_pages`` pages and on more
    than ``ratio`` of the pages of their site.  ``pages``: site, keys (array).

    Counts combine before the shuffle, so neither a site nor a line that
    holds much of all rows gathers in one task.
    """
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    held = (
        pages.select("site", F.explode(F.array_distinct("keys")).alias("line_key"))
        .groupBy("site", "line_key").agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") >= least_pages)
    )
    return (
        held.join(totals.withColumnRenamed("site", "s"), F.col("site") == F.col("s"))
        .where(F.col("held") / F.col("pages") > ratio).select("site", "line_key")
    )


def drop_boilerplate(pages: DataFrame, site: Column, lines: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES,
                     raw: Sequence[str] = (), copies_once: bool = False) -> DataFrame:
    """All columns of ``pages`` but the ``raw`` ones, whose text the lines hold, and
    __site, __lines (kept, in order), __n_lines and __n_dropped.

    A page is a row: repeated rows count as pages of their own, unless
    ``copies_once``: then the rows of a site with the same lines count as one
    page, so that copies do not make their own lines boilerplate.  A null site
    counts as the empty one, a null text has no lines (or, split at line
    ends, one empty line); blank lines are never boilerplate.  Kept and
    dropped lines depend on the page's site and lines alone, which is the
    key that carries the positions to drop back to the rows.
    """
    keyed = pages.withColumn("__site", F.coalesce(site, F.lit(""))).withColumn("__lines", lines).drop(*raw)
    blank = lambda x: F.when(F.trim(x) == "", F.lit(None)).otherwise(F.xxhash64(x, F.octet_length(x)))
    keyed = stored(
        keyed.withColumn("__keys", F.transform("__lines", blank))
        .withColumn("__page", F.md5(F.concat_ws("\n", "__lines").cast("binary")))
    )
    pages_of = keyed.select(F.col("__site").alias("site"), F.col("__page").alias("page"), F.filter("__keys", lambda x: x.isNotNull()).alias("keys"))
    if copies_once:
        pages_of = pages_of.dropDuplicates(["site", "page"])
    junk = stored(boilerplate(pages_of, ratio, least_pages))
    at = keyed.select("__site", "__page", F.posexplode("__keys").alias("at", "key")).where("key is not null")
    drops = (
        at.join(junk, (F.col("__site") == F.col("site")) & (F.col("key") == F.col("line_key")), "left_semi")
        .groupBy(F.col("__site").alias("__s"), F.col("__page").alias("__p")).agg(F.collect_set("at").alias("__drops"))
    )
    found = keyed.join(drops, (F.col("__site") == F.col("__s")) & (F.col("__page") == F.col("__p")), "left")
    dropped = F.coalesce("__drops", F.array().cast("array<int>"))
    kept = F.when(F.size(dropped) == 0, F.col("__lines")).otherwise(
        F.filter("__lines", lambda x, i: ~F.array_contains(F.col("__drops"), i))
    )
    return (
        found.withColumn("__n_lines", F.size("__lines")).withColumn("__n_dropped", F.size(dropped))
        .withColumn("__lines", kept).drop("__keys", "__page", "__s", "__p", "__drops")
    )


def clean_documents(docs: DataFrame, text: str = "text", site: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
                    copies_once: bool = False) -> DataFrame:
    """The rows and columns of ``docs``; their texts without boilerplate lines,
    and ``n_chars``, where there is one, counted anew for texts that changed.
    No row is dropped; null texts stay null.  ``copies_once`` as in ``drop_boilerplate``."""
    marked = docs.withColumn("__null", F.col(text).isNull())
    found = drop_boilerplate(marked, F.col(site).cast("string"), text_lines(text), ratio, least_pages, raw=[text], copies_once=copies_once)
    found = found.withColumn(text, F.when(~F.col("__null"), F.array_join("__lines", "\n")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def op9_site_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages", "page_id", "url", "html")
    return drop_boilerplate(pages, host_of("url"), html_lines("html"), raw=["url", "html"]).select(
        "page_id", F.col("__site").alias("host"), F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_dropped").cast("long").alias("n_dropped"),
        F.array_join("__lines", "\n").alias("text"),
    )


def op9_sql(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    quoted = BLOCKS.replace("'", "''")
    return f"""
WITH pages_of AS (
  SELECT row_number() OVER () AS page, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '{quoted}', chr(10), 'g'), '{TAGS}', '', 'g'),
                                                 chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS n FROM pages_of GROUP BY host),
each_line AS (SELECT page, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM pages_of),
junk AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT page) AS held FROM each_line GROUP BY host, line) JOIN totals USING (host)
  WHERE held >= {least_pages} AND held / n > {ratio}),
kept AS (
  SELECT page, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM each_line ANTI JOIN junk USING (host, line) GROUP BY page)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       coalesce(text, '') AS text
FROM pages_of LEFT JOIN kept USING (page)"""
