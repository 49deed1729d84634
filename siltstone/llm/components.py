"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for the nodes of `edges` (a, b long).

    Alternates large and small stars: every round links each node's neighbours to the smallest of them,
    first the larger neighbours, then the smaller ones, until the edges are the stars of the components.
    A round is two aggregations and two joins over edges; nothing is gathered by node, so a node of any
    degree is summed where its edges lie. Each round is written to the shared folder. The aggregates are broadcast while the counted
    edges, and so their rows, are few; else they are written first, so that none of them stands between shuffle and join and
    adaptive execution can split a centre's edges.

    Loops and repeated edges do no harm; edges with a null end are dropped. No edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, "edges"), None
    measure = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    for _ in range(most_rounds):
        now = edges.agg(*measure).first()
        if now == before or not now[0]:
            break
        before = now
        # at most two rows of 16 bytes an edge
        aside = F.broadcast if now[0] <= BROADCAST_ROWS // 2 else lambda df: written(df, "least")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = aside(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")))
        # a node that is the smallest among its neighbours keeps them
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = aside(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError("the components are not stable yet")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
