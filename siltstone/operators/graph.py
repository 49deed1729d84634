"""Link tables: broken targets, and breadth-first search by levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.html import HREF, host_of, links, path_of
from ..sources.tables import dealt, written


def broken_links(pages: DataFrame) -> DataFrame:
    """host, href, n_links: absolute paths that pages of a host link to and that the host has no page of."""
    wanted = links(pages).where("startswith(href, '/')").withColumn("path", F.regexp_extract("href", r"^([^?#]*)", 1))
    wanted = wanted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_links"))
    have = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return wanted.join(have, ["host", "path"], "left_anti").select("host", F.col("path").alias("href"), "n_links")


def addresses(pages: DataFrame) -> DataFrame:
    """page_id, page, href, url: each page's own URL and its links, as written (href) and absolute (url)."""
    hrefs = pages.select("page_id", F.col("url").alias("page"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href")).where("href <> '' and not startswith(href, '#')")
    own = pages.select("page_id", F.col("url").alias("page"), F.col("url").alias("href"), F.col("url").alias("url"))
    return own.unionByName(hrefs.select("page_id", "page", "href", urls.resolved(F.col("href"), F.col("page")).alias("url")))


def page_reach(pages: DataFrame) -> DataFrame:
    """origin, node, depth: what a crawl from each origin's root reaches by links that it would follow, until no link is new.

    One join and one written frontier a level; the levels end when a frontier is empty.
    """
    src, dst = urls.normalised(F.col("page")), urls.normalised(F.col("url"))
    edges = addresses(pages).where(urls.crawlable(F.col("url"), urls.origin(F.col("page")))).select(src.alias("src"), dst.alias("dst")).distinct()
    starts = pages.select(urls.origin(F.col("url")).alias("origin")).where("origin <> ''").distinct()
    seen = starts.select("origin", F.concat("origin", F.lit("/")).alias("node"), F.lit(0).alias("depth"))
    # dealt by source once: a frontier comes to the edges
    edges, seen = dealt(edges, "src"), written(seen, "seen")
    frontier, level = seen, 0
    while not frontier.isEmpty():
        level += 1
        step = edges.join(frontier, edges["src"] == frontier["node"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, depth: nodes within so many steps of the starts (node), with the least number of steps. One join and one written frontier a level."""
    edges, seen = dealt(edges.select("src", "dst"), "src"), written(starts.select("node").distinct().withColumn("depth", F.lit(0)), "seen")
    frontier = seen
    for level in range(1, depth + 1):
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def neighbourhoods(edges: DataFrame, hops: int = 2, cap: int = 40) -> DataFrame:
    """start, node, place: of each source of an edge (src, dst) itself and what its links reach in `hops` steps, `cap` nodes at most, in breadth-first order with each node's targets in order of name.

    A list that takes in another's targets needs `2 * cap` of them at most, as what it has already is under `cap`: of a hub's targets only so many, its least,
    are kept, and no list is longer. Null ends are no nodes.
    """
    targets = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    near = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    short = targets.withColumn("at", near).where(F.col("at") <= 2 * cap)
    lists = written(short.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets")), "targets")
    reached = lists.select(F.col("src").alias("start"), F.array("src").alias("nodes"), F.array("src").alias("edge"))
    for _ in range(hops):
        asked = reached.select("start", F.posexplode("edge").alias("at", "node"))
        told = asked.join(lists, F.col("node") == F.col("src")).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "targets"))).alias("told"))
        joined = reached.join(told.withColumnRenamed("start", "s"), F.col("start") == F.col("s"), "left")
        more = F.coalesce(F.flatten(F.transform("told", lambda x: x["targets"])), F.array().cast("array<string>"))
        fresh = F.slice(F.array_except(more, F.col("nodes")), 1, F.greatest(F.lit(cap) - F.size("nodes"), F.lit(0)))
        reached = written(joined.select("start", F.concat("nodes", fresh).alias("nodes"), fresh.alias("edge")), "reached")
    return reached.select("start", F.posexplode("nodes").alias("place", "node")).select("start", "node", "place")
