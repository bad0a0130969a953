"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import written


#: Edges that one task may hold; where there are more, a hub's are split.
ONE_TASK = 1 << 24


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, root: the least node of each component, for every node of the edges (a, b).

    A round gives each node's greater neighbours its least one, then each node's
    lesser neighbours theirs; edges only ever shrink towards stars, in a number of
    rounds that grows with the logarithm of the nodes. Each round is written, and
    nothing comes to the driver but whether all is settled. Rounds that don't end are
    an error, never a result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    for _ in range(rounds):
        if settled(pairs):
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if pairs.count() <= one_task:
            near = both.withColumn("m", F.min("b").over(Window.partitionBy("a"))).select("a", "b", F.least("a", "m").alias("m"))
        else:  # the least is written, as Spark splits a hub's edges only in a join of plain tables
            near = both.join(written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least"), "a")
        large = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node has few lesser neighbours by now
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a"))).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = written(small.distinct(), "edges")
    else:
        raise RuntimeError(f"the components are not settled after {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def settled(pairs: DataFrame) -> bool:
    """Whether the pairs (a, b), a the greater, are stars: each a has one b, and no b is an a."""
    ends = pairs.select(F.col("a").alias("node"), "b", F.lit(True).alias("greater")).union(pairs.select("b", F.lit(None), F.lit(False)))
    of_node = ends.groupBy("node").agg(F.min("b").alias("first"), F.max("b").alias("last"), F.min("greater").alias("always"), F.max("greater").alias("ever"))
    return of_node.where("first <> last or always <> ever").isEmpty()
