"""Connected components by alternating large and small stars, each round a few joins and a stored table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the smallest node of its component.

    The large star hangs each node's larger neighbours on its smallest one, the small star its smaller neighbours; both
    keep components and end in stars after about log^2 rounds.  Only a count and a checksum come to the driver.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    held, before = materialise(ordered, "edges"), None
    while True:
        after = held.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if after == before or not after[0]:
            return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that a hub's rows are not all in the task that finds its smallest neighbour.
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "smallest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        held = materialise(small.distinct(), "small-star")
