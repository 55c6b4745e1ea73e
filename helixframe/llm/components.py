"""Connected components by alternating large-star and small-star steps, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the smallest node reachable.

    Self-links, repeated links and links with a null end count for nothing; an empty
    table gives no rows. Each round writes its links to the shared folder, so a lost
    executor costs at most a round. A hub's links are never gathered: minima are
    partial aggregates, and the join back can be split.
    """
    links = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = shared.written(links, "links")
    mark = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    before = mark(links)
    for _ in range(most_rounds):
        if not before.n:
            break
        both = links.union(links.select("v", "u"))
        # what is joined is written first: then a hub's rows can be split among tasks
        least = shared.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = shared.written(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", least)
        smallest = shared.written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(smallest, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v"))).distinct()
        links = shared.written(small, "links", links, large, smallest)
        now = mark(links)
        if (now.n, now.h) == (before.n, before.h):
            break
        before = now
    else:
        raise RuntimeError("links did not become stars")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
