"""Line deduplication by site-relative frequency (operator 4), in DataFrame functions only.

A line is boilerplate of a host if the pages that contain it are more than
``ratio`` of the host's pages, whatever the host's size. A line on one page
only repeats nothing and stays: on a host of fewer than 1 / ratio pages it
would else be over the ratio by itself. Lines are counted by host and MD5, so whole
lines never move; a host has at most (mean different lines a page) / ratio such
lines, whatever its number of pages, and that short list goes to its pages: by
broadcast where the lists of all hosts were measured to be small, else by a
shuffle in which a host with a third of all pages is split into SALTS parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.1
#: Pages that make a line a repeated one.
REPEATED = 2
#: Parts that a host's lines and pages are dealt to when they meet the host's total and boilerplate.
SALTS = 16
#: Hosts whose numbers of pages are broadcast at most.
BROADCAST_HOSTS = 100_000
#: Boilerplate marks (of 32 bytes) of all hosts that are broadcast at most.
BROADCAST_MARKS = 200_000

#: Not text: scripts, styles and comments.
HIDDEN = r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->)"
#: Where a rendered line ends.
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>|[\r\n]+"
#: Other tags, and white space within a line.
TAGS, BLANKS = r"<[^>\n]*>", r"[\x20\x09\x0B\x0C]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def page_lines(html):
    """The visible lines of a page, trimmed, white space runs as one space, empty ones left out."""
    text = F.coalesce(html, F.lit(""))
    for what, by in ((HIDDEN, " "), (BREAKS, "\n"), (TAGS, ""), (BLANKS, " ")):
        text = F.regexp_replace(text, what, by)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def url_host(url):
    """The lower-case host of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def boilerplate(rows: DataFrame, ratio: float, min_pages: int = REPEATED) -> DataFrame:
    """(host, lines) rows to one row for each host with boilerplate: host, marks (MD5 of each such line)."""
    pages = rows.where(F.col("host").isNotNull())
    marks = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), lambda x: F.md5(x)))
    seen = pages.select("host", F.explode(marks).alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    total = saved(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), rows.count())
    frequent = _with_pages(seen.where(F.col("n") >= min_pages), total).where(F.col("n") / F.col("pages") > ratio)
    return frequent.groupBy("host").agg(F.collect_set("mark").alias("marks"))


def _with_pages(seen: DataFrame, total: DataFrame) -> DataFrame:
    """``seen`` with its host's pages. All lines of a host never meet in one task: the totals are broadcast where they are few, else sent to each part of a host."""
    if total.count() <= BROADCAST_HOSTS:
        return seen.join(F.broadcast(total), "host")
    there = total.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return seen.withColumn("_salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")).join(there, ["host", "_salt"]).drop("_salt")


def drop_boilerplate(rows: DataFrame, ratio: float = RATIO, min_pages: int = REPEATED) -> DataFrame:
    """``rows`` (any columns besides host and lines) with ``kept``: the lines that are not their host's boilerplate.

    A line goes if more than ``ratio`` of the host's pages, and ``min_pages`` at
    least, contain it; a share of just ``ratio`` keeps it. Blank lines are
    neither counted nor dropped; a line counts once a page. Rows without a host
    keep all lines, rows whose lines are null keep null. Each repeated row
    counts as a page. An empty table gives no rows.
    """
    marks = saved(boilerplate(rows.select("host", "lines"), ratio, min_pages), rows.count())
    if (marks.agg(F.sum(F.size("marks"))).first()[0] or 0) <= BROADCAST_MARKS:
        out = rows.join(F.broadcast(marks.withColumnRenamed("host", "_host")), F.col("host") == F.col("_host"), "left")
    else:
        there = marks.select(F.col("host").alias("_host"), "marks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_to"))
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("lines"), F.lit(SALTS)).cast("int"))
        out = dealt.join(there, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_to")), "left")
    kept = F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("marks"), F.md5(x)))
    return out.select(*rows.columns, F.when(F.col("marks").isNull(), F.col("lines")).otherwise(kept).alias("kept"))


def dedup_page_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = REPEATED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, text (the kept lines).

    Lines are those that :func:`page_lines` sees; null and empty html have none,
    and their page counts for its host all the same. Pages whose URL is null or
    has no host keep all lines. A line goes as in :func:`drop_boilerplate`: on
    more than ``ratio`` of the host's pages and on two at least, so a host of
    one page keeps all; a share of just ``ratio`` keeps the line. Repeated rows
    are pages each; null ids are pages like others. Columns besides the three
    are not read. A very long page is one row like any other: only its lines'
    MD5 move. An empty table gives no rows.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url_host(F.col(url_col)).alias("host"), page_lines(F.col(html_col)).alias("lines"))
    out = drop_boilerplate(rows, ratio, min_pages)
    n = F.size("lines").cast("bigint")
    return out.select("page_id", "host", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def dedup_document_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = REPEATED, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs``, all its columns, without the boilerplate lines of each text's site. Null texts stay null, and a null site loses nothing."""
    prepare(docs.sparkSession)
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(site_col).cast("string").alias("host"), F.split(F.col(text_col), "\n").alias("lines"))
    out = drop_boilerplate(rows, ratio, min_pages)
    return out.select(*[F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
