"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.common import drop, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of the links (a, b): component is the smallest id that links reach.

    Links to oneself are kept as such, null ends are dropped, repeats count once, an empty table gives
    an empty one. Each step takes the minimum of every neighbourhood by an aggregate and joins it back,
    so a hot node is a skewed join, never a collected group; its result is a table in the shared folder.
    Steps are logarithmic in the number of nodes; they end when every node has one link, to a node that has none.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null")
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # each link once, its larger end first
    e = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: a node and its neighbours below go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a != b").distinct()
        before, e = e, written(small, "links")
        drop(before)
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("x")).select("x.*")
        # the lower end counts 0, so a root has a sum of 0 and any other node, where all is done, 1 and no 0
        if not ends.groupBy("id").agg(F.sum("up").alias("n"), F.min("up").alias("least")).filter("n > 1 or (n = 1 and least = 0)").limit(1).count():
            break
    roots = e.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots, nodes.id == roots.a, "left").select("id", F.coalesce("component", "id").alias("component"))
