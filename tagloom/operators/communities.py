"""Weighted communities: modularity optimised by contraction, then by moves of single nodes.

With tot(c) the weighted degree of a community and all the sum of all weighted degrees, joining
communities that share weight w is worth w * all - tot(a) * tot(b), and moving a node of degree
k from a to b is worth (w(b) - w(a)) * all - k * (tot(b) - tot(a) + k), in whole numbers for
whole weights. In each round every community picks the neighbour worth most; pairs that pick
each other join and become one node with summed weights. When no pair is worth joining, nodes
move: a move takes place if no other of its two communities is worth more. Joins and moves of a
round touch different communities, so what they are worth adds up and every round gains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discarded, saved


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, w of undirected edges in both directions, equal ends left out, weights of repeated edges summed up."""
    own = edges.filter("src is not null and dst is not null and src <> dst and weight > 0")
    return own.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")).union(own.select("dst", "src", "weight")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def joined(pairs: DataFrame, most: int) -> DataFrame:
    """id, c: communities (by their smallest member) that pairs (a, b, w, both ways) make by joins alone."""
    spark, paths = pairs.sparkSession, []
    keep = lambda df: saved(df, paths)
    total = pairs.agg(F.sum("w").alias("all"))
    all_ = total.first()["all"]
    label = keep(pairs.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
    tot = keep(label.select("c", F.col("k").alias("tot")))
    links = pairs
    for _ in range(most):
        worth = F.col("w") * F.lit(all_) - F.col("tot_a") * F.col("tot_b")
        ends = links.join(tot.select(F.col("c").alias("a"), F.col("tot").alias("tot_a")), "a").join(tot.select(F.col("c").alias("b"), F.col("tot").alias("tot_b")), "b")
        best = keep(ends.withColumn("worth", worth).filter("worth > 0").groupBy("a").agg(F.min(F.struct((-F.col("worth")).alias("worth"), F.col("b").alias("b")))["b"].alias("b")))
        mutual = keep(best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).filter("a > b").select(F.col("a").alias("c"), F.col("b").alias("to")))
        if mutual.isEmpty():
            break
        moved = lambda df, c: df.join(mutual.withColumnRenamed("c", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        label, tot = keep(moved(label, "c")), keep(moved(tot, "c").groupBy("c").agg(F.sum("tot").alias("tot")))
        links = keep(moved(moved(links, "a"), "b").filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w")))
    out = saved(label.select("id", "k", "c"))
    discarded(spark, paths)
    return out


def moves(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """id, c (now), to, worth: each node's best move to a neighbouring community that gains, of equals to the smallest; label has id, k, c."""
    all_ = label.agg(F.sum("k")).first()[0]
    tot = label.groupBy("c").agg(F.sum("k").alias("tot"))
    near = pairs.join(label.select(F.col("id").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("w"))
    placed = near.join(label, "id")
    here = placed.filter("c = to").select("id", F.col("w").alias("w_here"))
    options = placed.filter("c <> to").join(here, "id", "left").join(tot.select(F.col("c").alias("to"), F.col("tot").alias("tot_to")), "to").join(tot.select("c", F.col("tot").alias("tot_c")), "c")
    worth = (F.col("w") - F.coalesce("w_here", F.lit(0))) * F.lit(all_) - F.col("k") * (F.col("tot_to") - F.col("tot_c") + F.col("k"))
    best = options.withColumn("worth", worth).filter("worth > 0").groupBy("id", "c").agg(F.min(F.struct((-F.col("worth")).alias("loss"), F.col("to").alias("to"))).alias("m"))
    return best.select("id", "c", F.col("m.to").alias("to"), (-F.col("m.loss")).alias("worth"))


def polished(pairs: DataFrame, label: DataFrame, most: int) -> DataFrame:
    """label (id, k, c) after moves of single nodes until none gains, or ``most`` rounds."""
    spark, paths = pairs.sparkSession, []
    for _ in range(most):
        wanted = saved(moves(pairs, label), paths)
        if wanted.isEmpty():
            break
        rank = F.struct((-F.col("worth")).alias("loss"), F.col("id").alias("id"))
        first = wanted.select("id", "worth", F.explode(F.array("c", "to")).alias("of")).groupBy("of").agg(F.min(rank)["id"].alias("id"))
        chosen = wanted.join(first.groupBy("id").agg(F.count("*").alias("n")).filter("n = 2"), "id").select("id", F.col("to").alias("_to"))
        label = saved(label.join(chosen, "id", "left").select("id", "k", F.coalesce("_to", "c").alias("c")), paths)
    out = saved(label)
    discarded(spark, paths)
    return out


def communities(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """id, community (its smallest member) of all nodes, by the edges' weights (src, dst, weight).

    Ties go to the smaller name, so the result is one of the input alone. A node without edges,
    or with edges to itself alone, is its own community; edges that are repeated, either way
    round, add up; null ends and weights of 0 or less are left out. Without edges every node
    is its own; an empty table gives no rows. ``most`` bounds the rounds of each part.
    """
    paths: list[str] = []
    pairs = saved(both_ways(edges), paths)
    ids = nodes.select("id").distinct()
    if pairs.isEmpty():
        return ids.withColumn("community", F.col("id"))
    label = polished(pairs, joined(pairs, most), most)
    names = label.groupBy("c").agg(F.min("id").alias("community"))
    out = saved(ids.join(label.join(names, "c").select("id", "community"), "id", "left").select("id", F.coalesce("community", "id").alias("community")))
    discarded(nodes.sparkSession, paths)
    return out


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """The modularity of communities (id, community); 0 without edges."""
    pairs = both_ways(edges)
    of = lambda c: members.select(F.col("id").alias(c), F.col("community").alias(f"of_{c}"))
    by = pairs.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("of_a").alias("c")).agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("of_a") == F.col("of_b"), F.col("w")).otherwise(0)).alias("inside"))
    r = by.agg(F.sum("inside").alias("i"), F.sum(F.col("tot").cast("double") * F.col("tot")).alias("s"), F.sum("tot").alias("all")).first()
    return r["i"] / r["all"] - r["s"] / (float(r["all"]) * r["all"]) if r["all"] else 0.0


def summary(members: DataFrame, first: int = 8) -> DataFrame:
    """community, size, labels: the first few members by name; only those reach a list."""
    from .stats import first_of

    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.join(first_of(members, "community", "id", "id", first, "labels"), "community").select("community", "size", F.array_join(F.col("labels").cast("array<string>"), "、").alias("labels")).orderBy(F.desc("size"), "community")
