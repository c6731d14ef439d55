"""Connected components of a link table by alternating large-star and small-star steps.

Each step only groups and joins on node ids; nothing is gathered in one task or on the driver, and the number of
steps grows with the logarithm of the longest chain. What a step joins is written to the shared scratch folder first, so that
Spark knows its size: a small side is broadcast, and where it isn't, the rows of a node with very many links are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that links lead to) of every node of links(a, b); a link to itself is a node alone."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.materialize(e, "links")
    alone = e.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    e = e.filter("u > v")
    before = _digest(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.materialize(large, "large-star")
        least = common.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _digest(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root")).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
