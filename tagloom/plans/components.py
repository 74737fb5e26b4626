"""Connected components of a distributed edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import discarded, saved


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of all nodes of edges (a, b).

    In each round every node moves to that of itself and its neighbours whose hash, new in
    each round, is smallest; edges are relabelled by that, and edges within a node go. The
    number of nodes falls by a quarter or more a round in expectation, whatever the shape
    of the graph, so rounds grow with the logarithm of the input. Minima are taken before
    each shuffle as well as after, and joins may be split by adaptive execution, so a node
    with very many edges needs no task of its own. Null ends, loops and repeated edges are
    left out.
    """
    spark, paths = edges.sparkSession, []
    keep = lambda df: saved(df, paths)
    edges = keep(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        of = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select("b", "a"))
        step = keep(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least(of("a"), of("b"))).alias("least")).select("node", F.col("least.to").alias("to")))
        if found is None:
            found = step
        else:
            found = keep(found.withColumnRenamed("to", "mid").join(step.withColumnRenamed("node", "mid"), "mid", "left").select("node", F.coalesce("to", "mid").alias("to")))
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end).drop(end).withColumnRenamed(f"{end}_to", end)
        edges = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    low = found.groupBy("to").agg(F.min("node").alias("root"))
    out = saved(found.join(low, "to").select("node", "root"))
    discarded(spark, paths)
    return out
