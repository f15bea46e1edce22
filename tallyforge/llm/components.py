"""Connected components by alternating large-star and small-star contraction, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): the smallest id that can be reached.

    Each step groups by an id with a partial minimum and joins the minimum back, so a node with very many links is summed before
    the shuffle, and the join splits its rows. Rounds grow with the logarithm of a component's size.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has two plain sides and the engine can split the rows of an id with very many links
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "edges")
        # done when all that is left are stars: no id has two smaller neighbours, or one above and one below it
        roles = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        knots = roles.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
        if knots.isEmpty():
            break
    centres = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)
