"""Connected components of a table of links, by minimum labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.stages import cut


def connected_components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of a link; the component is its least node.

    Alternates large-star and small-star steps over the link table until it no longer changes, so
    that the number of rounds grows with the logarithm of the longest chain, and neither nodes nor
    links reach the driver.  Each round is cut by a checkpoint.  Links with a null end are ignored,
    repeated and reversed links count once, and a link of a node to itself makes a component of one.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    alone = ends.where("x = y").select(F.col("x").alias("node"))
    edges = cut(ends.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        lower = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lower, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        edges = cut(small.where("x <> y").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("y").alias("node"), F.col("y").alias("component"))
    leaves = edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    lone = alone.select("node", F.col("node").alias("component"))
    return leaves.union(roots).union(lone).groupBy("node").agg(F.min("component").alias("component"))
