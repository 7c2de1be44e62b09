"""Breadth-first crawl over a table of pages, level by level.

The order is that of a queue: by depth, then by the parent's place, then by the link's place on it. A level is one
join, one anti-join against what was admitted and one sort; it is written to the shared folder, which ends its
lineage. Ranks grow with the order and needn't be consecutive, so no step runs in a single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import robots as rb
from ..sources.tables import stored

ADMITTED = "url string, depth int, rank long"


@dataclass(frozen=True)
class CrawlParams:
    max_depth: int = 3  # 0: no limit
    max_pages: int = 100  # 0: no limit
    same_host: bool = True
    resolve_against_page: bool = False


def _ranked(candidates: DataFrame, base: int) -> DataFrame:
    # sorted ranges are numbered in their order
    return stored(candidates.orderBy("parent", "ord").withColumn("rank", F.monotonically_increasing_id() + F.lit(base)).select("url", "depth", "rank"))


def crawl(links: DataFrame, seed: str, params: CrawlParams = CrawlParams(), ruled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, skipped) from links (url, links array<string>), a row a page, in canonical form.

    admitted is (url, depth, rank), with the URLs that no page answers to; skipped is (url, depth, reason) of those
    that robots rules (``ruled``, see operators.robots.rules) keep out, once for each time they were met.
    """
    spark = links.sparkSession
    # sorted by url within its files, and narrow: a level that is small is broadcast to it at run time, a large one joined by merge
    pages = stored(links.groupBy(urls.canonical("url").alias("url")).agg(F.min("links").alias("links")).sortWithinPartitions("url"))
    start = spark.createDataFrame([(seed,)], "raw string").select(urls.canonical("raw").alias("url"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("parent"), F.lit(0).alias("ord"))
    host = start.select(urls.host("url")).first()[0]
    skipped = spark.createDataFrame([], "url string, depth int, reason string")

    def admit(found: DataFrame) -> DataFrame:
        nonlocal skipped
        if ruled is None:
            return found
        decided = stored(rb.decide(found, ruled))
        skipped = skipped.unionByName(decided.filter("not allowed").select("url", "depth", "reason"))
        return decided.filter("allowed").select(found.columns)

    level = _ranked(admit(start), 0)
    visited, depth = level, 0
    count, top = level.agg(F.count(F.lit(1)), F.coalesce(F.max("rank"), F.lit(0))).first()
    while True:
        depth += 1
        room = params.max_pages - count if params.max_pages else None
        if (params.max_depth and depth > params.max_depth) or (room is not None and room <= 0):
            break
        out = level.join(pages, "url").select(F.col("rank").alias("parent"), "url", F.posexplode("links").alias("ord", "raw"))
        base = F.regexp_replace(urls.path("url"), r"[^/]*$", "") if params.resolve_against_page else F.lit("")
        raw = F.when(~urls.is_absolute("raw") & ~F.col("raw").startswith("/"), F.concat(base, "raw")).otherwise(F.col("raw"))
        found = out.select(urls.resolve_on(raw, "url").alias("to"), "parent", "ord")
        if params.same_host:
            found = found.filter(urls.same_host("to", F.lit(host)))
        found = admit(found.select(urls.canonical("to").alias("url"), F.lit(depth).alias("depth"), "parent", "ord"))
        fresh = found.join(visited.select("url"), "url", "left_anti").groupBy("url").agg(F.min("depth").alias("depth"), F.min(F.struct("parent", "ord")).alias("at")).select("url", "depth", "at.parent", "at.ord")
        if room is not None:
            fresh = fresh.orderBy("parent", "ord").limit(room)
        level = _ranked(fresh, top + 1)
        new, last = level.agg(F.count(F.lit(1)), F.max("rank")).first()
        if not new:
            break
        count, top = count + new, last
        visited = visited.unionByName(level)
    return visited, skipped


def progress(admitted: DataFrame, done: DataFrame) -> DataFrame:
    """(depth, admitted, waiting) of a crawl, given the urls that are done: the lowest depth with any waiting is the one in work."""
    marked = admitted.join(done.select("url").distinct().withColumn("_done", F.lit(True)), "url", "left")
    return marked.groupBy("depth").agg(F.count(F.lit(1)).alias("admitted"), F.count(F.when(F.col("_done").isNull(), 1)).alias("waiting"))
