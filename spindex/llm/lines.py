"""Line dedup by site-relative frequency, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindex.llm.common import fresh, saved

#: Boilerplate lines that may be broadcast, about 40 bytes each; beyond that pages are joined by a shuffle on host and shard.
MOST_LINES = 500_000
#: Shards of a host's pages in that join.
SHARDS = 64


def _mark(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("x"), F.hash(line).alias("y"))


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.01, least: int = 3, distinct: bool = False) -> DataFrame:
    """host, lines: for each host the marks of its lines that lie on ``least`` pages or more and on more than ``ratio`` of its pages.

    A page counts once for a line however often it repeats it; with ``distinct`` so do
    all pages of a host with the same text, for its lines and among its pages, so that
    copies don't make each other boilerplate. Empty lines never count.
    A host has at most (lines a page) / ratio of them. Pages of a host are pre-aggregated
    before the shuffle and keyed by host and line, so a hot host is many keys.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda s: s != ""), _mark))
    hosted, host = pages.where(F.col(f"`{host_col}`").isNotNull()), F.col(f"`{host_col}`").alias("host")
    number = F.count_distinct("page") if distinct else F.count(F.lit(1))
    page = _mark(F.col(f"`{text_col}`")) if distinct else F.lit(True)
    rows = hosted.select(host, page.alias("page"), F.explode(lines).alias("line"))
    seen = rows.groupBy("host", "line").agg(number.alias("n")).where(F.col("n") >= least)
    total = hosted.select(host, page.alias("page")).groupBy("host").agg(number.alias("pages"))
    return seen.join(total, "host").where(F.col("n") > F.col("pages") * F.lit(ratio)).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.01, least: int = 3, distinct: bool = False) -> DataFrame:
    """The pages, all columns, with the boilerplate lines of their host taken out of the text; adds n_lines and n_dropped.

    Lines are what newlines separate; every occurrence of a boilerplate line goes, all
    others stay in order and unchanged. No page is dropped: one of boilerplate alone
    keeps an empty text. A null text stays null and has 0 lines; an empty text has one,
    empty line; a page of null host is left as it is. Repeated rows count as pages of
    their own, or once with ``distinct`` (see ``boilerplate``). An empty table gives an
    empty result. Columns may have any names; one called n_lines or n_dropped is replaced.
    """
    used = set(pages.columns)
    h, l, k, shard = (fresh(c, used) for c in ("host", "lines", "kept", "shard"))
    found = saved(boilerplate(pages, host_col, text_col, ratio, least, distinct), "boilerplate")
    total = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    found = found.select(F.col("host").alias(h), F.col("lines").alias(l))
    same = F.col(f"`{host_col}`") == F.col(h)
    if total <= MOST_LINES:
        joined = pages.join(F.broadcast(found), same, "left")
    else:  # a host's lines are sent to each of its shards
        split = pages.withColumn(shard, F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(SHARDS)).cast("int"))
        joined = split.join(found.withColumn(f"{shard}_", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))), same & (F.col(shard) == F.col(f"{shard}_")), "left")
    own = F.split(F.col(f"`{text_col}`"), "\n", -1)
    kept = F.when(F.col(l).isNull(), own).otherwise(F.filter(own, lambda s: (s == "") | ~F.array_contains(l, _mark(s))))
    cut = joined.withColumn(k, kept)
    columns = [F.when(F.col(l).isNull(), F.col(f"`{c}`")).otherwise(F.array_join(k, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    n = F.coalesce(F.size(own), F.lit(0))
    return cut.select(*columns, n.cast("long").alias("n_lines"), (n - F.coalesce(F.size(k), F.lit(0))).cast("long").alias("n_dropped"))
