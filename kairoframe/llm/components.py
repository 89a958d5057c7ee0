"""Connected components of a link table, by alternating star steps.

Each round links every node to the least node around it: first its larger neighbours (large star), then its smaller ones
(small star). The number of links never grows, a component of any shape ends as one star on its least node, and a chain
of n nodes needs about log n rounds. Links stay in tables: nothing but a count and a checksum reaches the driver, and
each round is a table in the shared folder, dropped after the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Tables


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (least node of its component) for each node of a link to another node.

    Nodes are longs; links to itself and repeated links are fine; an empty table gives no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    seen, tables = None, Tables(links.sparkSession)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, edges = edges, tables.save(small.where("u <> v").distinct())
        tables.drop(last)
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
