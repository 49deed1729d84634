"""Breadth-first crawls in the order of a queue, with a budget of pages a site."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.html import HREF
from ..sources.tables import dealt, written
from .ordered import ranked

#: Pages of a crawl, and visits beyond them that broken links may take.
MOST_PAGES, BROKEN_VISITS = 15, 100
#: Sites with at most so many pages and links are crawled by a task each.
WHOLE_SITE = 200_000
RESULT = "origin string, position long, node string, depth int, referrer string, state string"


def linked_pages(pages: DataFrame) -> DataFrame:
    """origin, node, page_id, links: the page of each canonical URL (of equal ones that of least page_id) and, in order, the first places of the links a crawl of its origin follows."""
    own = urls.origin(F.col("url"))
    hrefs = F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1), lambda h: (h != "") & ~F.startswith(h, F.lit("#")))
    whole = F.transform(hrefs, lambda h: urls.resolved(h, F.col("url")))
    followed = F.array_distinct(F.transform(F.filter(whole, lambda u: urls.crawlable(u, own)), urls.normalised))
    found = pages.where(own != "").select(own.alias("origin"), urls.normalised(F.col("url")).alias("node"), "page_id", followed.alias("links"))
    return found.groupBy("origin", "node").agg(F.min("page_id").alias("page_id"), F.min_by("links", F.struct("page_id", F.hash("links"))).alias("links"))


def listed_starts(linked: DataFrame) -> DataFrame:
    """origin, node, place: each origin's root, then its own pages by page_id, as a site map lists them."""
    listed = linked.select("origin", "node", (F.coalesce("page_id", F.lit(2**62)) + 1).alias("place"))
    return linked.select("origin").distinct().select("origin", F.concat("origin", F.lit("/")).alias("node"), F.lit(-(2**62)).alias("place")).unionByName(listed)


def page_crawl(pages: DataFrame) -> DataFrame:
    linked = written(linked_pages(pages), "linked")
    return crawl(linked, listed_starts(linked))


def crawl(linked: DataFrame, starts: DataFrame, most_pages: int = MOST_PAGES, broken_visits: int = BROKEN_VISITS, whole_site: int = WHOLE_SITE) -> DataFrame:
    """origin, position, node, depth, referrer, state of every address that each origin's queue takes in, in its order.

    A queue begins with the origin's `starts` (origin, node, place; of equal nodes that of least place, of equal places the lesser node) and takes in,
    page by page, the links of `linked` (origin, node, links; a node once) that it hasn't met. An address is `visited` if `linked` has it, else `broken`; it is
    `skipped` once `most_pages` pages, or `broken_visits` more addresses, came before. Starts have depth 0 and no referrer. Null origins and nodes are no sites.

    Small sites are a row each and crawled in a task, in one pass. The crawls of larger ones go level by level: their pages are dealt by node once, a
    frontier joins them where they lie, and only what a site's budget can visit is joined.
    """
    linked = linked.where("origin is not null and node is not null").select("origin", "node", "links")
    starts = starts.where("origin is not null and node is not null").groupBy("origin", "node").agg(F.min("place").alias("place"))
    size = lambda df, n: df.groupBy("origin").agg(F.sum(n).alias("size"))
    sizes = size(linked, F.size("links") + 1).unionByName(size(starts, F.lit(1))).groupBy("origin").agg(F.sum("size").alias("size"))
    large = written(sizes.where(F.col("size") > whole_site).select("origin"), "large")
    if large.isEmpty():
        return _by_site(linked, starts, most_pages, broken_visits)
    small = _by_site(linked.join(large, "origin", "left_anti"), starts.join(large, "origin", "left_anti"), most_pages, broken_visits)
    return small.unionByName(_by_level(linked.join(large, "origin", "left_semi"), starts.join(large, "origin", "left_semi"), most_pages, broken_visits))


def _by_site(linked: DataFrame, starts: DataFrame, most_pages: int, broken_visits: int) -> DataFrame:
    held = linked.select("origin", "node", F.lit(None).cast("long").alias("place"), "links")
    listed = starts.select("origin", "node", "place", F.lit(None).cast("array<string>").alias("links"))
    sites = held.unionByName(listed).groupBy("origin").agg(F.collect_list(F.struct("place", "node", "links")).alias("rows"))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                origin = batch.column(0)[k].as_py()
                rows = batch.column(1)[k].as_py()
                out = _walked({r["node"]: r["links"] for r in rows if r["links"] is not None}, sorted((r["place"], r["node"]) for r in rows if r["links"] is None), most_pages, broken_visits)
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([origin] * len(out), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return sites.mapInArrow(walk, RESULT)


def _walked(links: dict, starts: list, most_pages: int, broken_visits: int) -> list[tuple]:
    """position, node, depth, referrer, state of one site's queue."""
    queue, seen, pages, out = deque((node, 0, None) for _, node in starts), {node for _, node in starts}, 0, []
    while queue:
        node, depth, referrer = queue.popleft()
        if pages >= most_pages or len(out) >= most_pages + broken_visits:
            out.append((len(out), node, depth, referrer, "skipped"))
            continue
        out.append((len(out), node, depth, referrer, "visited" if node in links else "broken"))
        pages += node in links
        for target in links.get(node, ()):
            if target not in seen:
                seen.add(target)
                queue.append((target, depth + 1, node))
    return out


def _by_level(linked: DataFrame, starts: DataFrame, most_pages: int, broken_visits: int) -> DataFrame:
    # one key, as a join on several would deal the pages anew
    key = F.struct("origin", "node")
    there = dealt(linked.select(key.alias("page"), "links"), "page")
    first = ranked(starts, ["origin"], ["place", "node"], "position")
    level = written(first.select("origin", "position", "node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("referrer")), "level")
    seen, done, depth = level.select("origin", "node"), None, 0
    so_far = level.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("pages"))
    while not level.isEmpty():
        near = level.where(F.col("position") < most_pages + broken_visits).join(so_far.select("origin", "pages"), "origin").withColumn("key", key).join(there, F.col("page") == F.col("key"), "left")
        # at most most_pages + broken_visits rows an origin
        before = Window.partitionBy("origin").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("earlier", F.col("pages") + F.coalesce(F.count("page").over(before), F.lit(0)))
        state = F.when(F.col("earlier") >= most_pages, "skipped").when(F.col("page").isNotNull(), "visited").otherwise("broken")
        near = written(near.select("origin", "position", "node", "depth", "referrer", state.alias("state"), F.when(state == "visited", F.col("links")).alias("links")), "judged")
        far = level.where(F.col("position") >= most_pages + broken_visits).withColumn("state", F.lit("skipped"))
        judged = near.drop("links").unionByName(far)
        done = judged if done is None else done.unionByName(judged)
        asked = near.select("origin", "position", F.col("node").alias("referrer"), F.posexplode("links").alias("at", "node"))
        found = asked.groupBy("origin", "node").agg(F.min(F.struct("position", "at", "referrer")).alias("by")).join(seen, ["origin", "node"], "left_anti")
        totals = so_far.join(near.where("state = 'visited'").groupBy("origin").agg(F.count(F.lit(1)).alias("more")), "origin", "left")
        totals = written(totals.select("origin", "n", (F.col("pages") + F.coalesce("more", F.lit(0))).alias("pages")), "totals")
        # links of at most most_pages pages an origin
        place = F.row_number().over(Window.partitionBy("origin").orderBy("by.position", "by.at")) - 1
        depth += 1
        level = found.join(totals, "origin").select("origin", (F.col("n") + place).cast("long").alias("position"), "node", F.lit(depth).alias("depth"), F.col("by.referrer").alias("referrer"))
        level = written(level, "level")
        grown = totals.join(level.groupBy("origin").agg(F.count(F.lit(1)).alias("more")), "origin", "left")
        so_far = written(grown.select("origin", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "pages"), "so-far")
        seen = seen.unionByName(level.select("origin", "node"))
    return done
