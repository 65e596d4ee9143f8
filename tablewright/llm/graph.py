"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import written


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest id that can be reached, for the ids of ``links`` (a, b).

    Alternates two steps until nothing changes: every node ties its greater neighbours to the
    smallest one it sees, then its smaller neighbours and itself. Neighbour minima are
    aggregates that combine before the shuffle; no node's neighbours are gathered. The number
    of rounds grows with the logarithm of the longest chain. Links may repeat or be reversed.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = written(links, "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
