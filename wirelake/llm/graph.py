"""Connected components of a large edge table by joins and aggregates."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges(a, b).

    Large-star and small-star steps: every edge is redirected to the smallest known neighbour of its end until all point to
    their roots; the number of rounds grows with the logarithm of the longest path. Each round is a written table. A node with very many
    neighbours is one key of a partial aggregate and of a join that adaptive execution splits.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: neighbours above a node go to the smallest of the node and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        new = written(small, "edges")
        # done when every node has one edge and no root has one
        loose = new.groupBy("u").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        e = new
        if not loose:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return written(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
