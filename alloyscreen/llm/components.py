"""Connected components, shared by the near-duplicate operators. All of it stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloyscreen.llm.folders import written


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id of its component) of every id in ``edges`` (a, b); links with itself are ignored.

    Alternating large and small stars: in each round every id hands the smallest of its neighbours to the others, until
    all edges point at their root. The number of rounds grows with the logarithm of the longest chain. A hub's edges are
    joined to one row, which adaptive execution splits."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        edges = written(edges, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        edges = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
