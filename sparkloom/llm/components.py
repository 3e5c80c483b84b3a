"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import Stage


def connected_components(links: DataFrame, stage: Stage) -> DataFrame:
    """From links (a, b) to (node, component): the smallest node reachable, for every node that has a link.

    Each round joins every link with the smallest neighbour of its end, so hubs are spread over the round's
    minimum table (written, so that AQE may split a hub's rows); the number of rounds grows as the
    logarithm of the longest path. Links from a node to itself, and links with a null end, are ignored.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, state = stage.keep(e), None
    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("n")).union(e.select(F.col("v"), F.col("u")))
        low = stage.keep(both.groupBy("x").agg(F.least(F.min("n"), F.first("x")).alias("m")))
        large = both.filter("n > x").join(low, "x").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.keep(large)
        least = stage.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        near = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stage.keep(near.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop(e, low, large, least)
        e = nxt
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
