"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm._io import drop_table, table


def components(links: DataFrame) -> DataFrame:
    """Each node with a link, and the smallest node it reaches: columns ``node`` and ``root``.

    ``links`` has columns ``a`` and ``b``. Rounds run until nothing changes; each reads the
    table that the round before wrote, and only two numbers a round come to the driver.
    """
    edges = table(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.select(F.col("lo").alias("node"), F.col("hi").alias("far")).filter("far > node").join(least, "node").select(F.col("far").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()
        small = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        linked = large.select(F.col("hi").alias("node"), "lo").join(small, "node")
        joined = linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(linked.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).filter("hi > lo").distinct()
        new = table(joined, "edges")
        now = tuple(new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        drop_table(edges)
        edges = new
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
