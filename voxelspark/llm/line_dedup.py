"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host; for each line the pages of the host that contain it are divided by all pages of
the host; lines above the boilerplate ratio are dropped from every page of the host. Lines are compared
without surrounding spaces; a line counts once a page however often it stands there. A host can have at
most (lines a page / ratio) such lines, so the list a page needs is short whatever the host's size, and
texts are never shuffled unless the lists of all hosts together outgrow ``BROADCAST_LINES``; then the lists of
hosts with a large part of all pages are sent to the pages all the same, and no task gets such a host's texts.

Defined results: blank lines are kept and never counted; a null text stays null with 0 lines; a null host
is a host of its own; a line needs ``min_pages`` pages (a ratio says nothing on a host of two pages);
repeated rows count as pages each; a page whose lines all go keeps its row with an empty text; extra
columns are kept; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.hot import join_hot
from voxelspark.llm.storage import table

RATIO, MIN_PAGES = 0.1, 5
#: Boilerplate lines of all hosts together up to which their lists (16 bytes a line) are broadcast.
BROADCAST_LINES = 200_000


def _lines(text: str | Column) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits that stand for a line; null for a blank one."""
    return F.when(F.trim(line) != "", F.unhex(F.md5(F.trim(line).cast("binary"))))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """``host, pages, lines``: the keys of each host's boilerplate lines."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    once = F.filter(F.array_distinct(F.transform(_lines("text"), _key)), lambda k: k.isNotNull())
    counts = pages.select("host", F.explode(once).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") / F.col("pages") > ratio)
    return frequent.groupBy(F.col("c.host").alias("host")).agg(F.first("pages").alias("pages"), F.collect_list("line").alias("lines"))


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``docs`` without boilerplate lines; with ``counts`` also ``n_lines`` and ``n_removed``."""
    found = table(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    total = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    names = [f"_line{k}" for k in range(len(docs.columns))]
    held, text, host = docs.toDF(*names), names[docs.columns.index(text_col)], names[docs.columns.index(host_col)]
    found = found.toDF(host, "_pages", "_listed")
    if total <= BROADCAST_LINES:
        listed = F.broadcast(found.select(F.col(host).alias("_host"), "_listed"))
        both = held.join(listed, F.col(host).eqNullSafe(F.col("_host")), "left")
    else:
        both = join_hot(held, found, [host], "_pages", held.count(), "left", null_safe=True)
    kept = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains(F.col("_listed"), _key(x)), F.lit(False)))
    clean = F.when(F.col("_listed").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = [clean if n == text else F.col(n) for n in names]
    if counts:
        n_lines = F.coalesce(F.size(_lines(text)), F.lit(0))
        n_kept = F.when(F.col("_listed").isNull(), n_lines).otherwise(F.coalesce(F.size(kept), F.lit(0)))
        out += [F.when(F.col(text).isNull(), 0).otherwise(n).cast("long") for n in (n_lines, n_lines - n_kept)]
    # names come last: an alias beside the expressions could be taken for one of their columns
    return both.select(*[c.alias(f"_out{k}") for k, c in enumerate(out)]).toDF(*docs.columns, *(["n_lines", "n_removed"] if counts else []))


ORACLE = r"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
each AS (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM p WHERE text IS NOT NULL),
counts AS (SELECT source, line, count(*) AS n FROM each WHERE line <> '' GROUP BY source, line),
bad AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.n >= 5 AND CAST(c.n AS DOUBLE) / t.pages > 0.1 GROUP BY c.source),
k AS (SELECT p.doc_id, p.text, p.lines, bad.bad,
        list_filter(p.lines, lambda x: NOT coalesce(list_contains(bad.bad, trim(x, ' ')), false)) AS kept
      FROM p LEFT JOIN bad ON p.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN bad IS NULL THEN text ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN text IS NULL OR bad IS NULL THEN 0 ELSE len(lines) - len(kept) END AS BIGINT) AS n_removed FROM k
"""
