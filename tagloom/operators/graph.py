"""Graphs of tags, jobs, companies and roles as two DataFrames: nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.lineage import cut, saved
from .stats import pairs_of


def tag_sets(jobs: DataFrame, tags: str, job_id: str) -> tuple[DataFrame, DataFrame]:
    """tags (the distinct non-blank ones in order), n, ids (rows, and those with a job_id), and job_id, tags of the ids that rows share."""
    own = F.array_sort(F.array_distinct(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: (x != "") & x.isNotNull())))
    rows = saved(jobs.select(F.col(job_id).alias("job_id"), own.alias("tags")))
    sets = saved(rows.groupBy("tags").agg(F.count("*").alias("n"), F.count("job_id").alias("ids")))
    again = rows.filter("job_id is not null").groupBy("job_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    return sets, saved(rows.join(again.select("job_id"), "job_id"))


def tag_nodes(sets: DataFrame, shared: DataFrame, top: int) -> DataFrame:
    """id, count, coverage_jobs, coverage (of all rows) of the most frequent tags; distinct ids are counted by their rows, less those that rows of one id have more."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    counts = sets.select(F.explode("tags").alias("id"), "n", "ids").groupBy("id").agg(F.sum("n").alias("count"), F.sum("ids").alias("ids"))
    more = shared.select(F.explode("tags").alias("id"), "job_id").groupBy("id").agg((F.count("*") - F.countDistinct("job_id")).alias("more"))
    nodes = counts.orderBy(F.desc("count"), "id").limit(top).join(more, "id", "left")
    return nodes.select("id", "count", (F.col("ids") - F.coalesce("more", F.lit(0))).alias("coverage_jobs")).withColumn("coverage", F.col("coverage_jobs") / max(total, 1)).orderBy(F.desc("count"), "id")


def cooccurrence(jobs: DataFrame, tags: str, job_id: str = "job_id", top: int = 50, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Tags that share jobs: nodes as in ``tag_nodes``, edges src, dst, weight. Tags without edges stay nodes.

    Jobs are worked out once and summed up by their tags; sets are cut down to the kept tags
    before pairs are made, and the edges, at most ``top`` squared, are worked out once too.
    """
    sets, shared = tag_sets(jobs, tags, job_id)
    nodes = cut(tag_nodes(sets, shared, top))
    kept = F.array(*[F.lit(r["id"]) for r in nodes.select("id").collect()])  # at most top
    if not nodes.take(1):
        return nodes, jobs.sparkSession.createDataFrame([], "src string, dst string, weight long")
    pairs = sets.select("n", F.inline(pairs_of(F.array_intersect("tags", kept)))).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("n").alias("weight"))
    return nodes, cut(pairs.filter(F.col("weight") >= least))


def job_similarity(jobs: DataFrame, tags: str, job_id: str, order: list, top: int = 80, threshold: float = 0.25) -> DataFrame:
    """src, dst, weight (Jaccard, 3 digits), shared of the first ``top`` jobs in order; jobs meet over shared tags only."""
    first = cut(jobs.orderBy(*order).limit(top).select(F.col(job_id).alias("id"), F.array_distinct(tags).alias("t")))
    rows = first.select("id", F.size("t").alias("n"), F.explode("t").alias("tag"))
    a, b = rows.select(F.col("id").alias("src"), F.col("n").alias("na"), "tag"), rows.select(F.col("id").alias("dst"), F.col("n").alias("nb"), "tag")
    met = a.join(b, "tag").filter("src < dst").groupBy("src", "dst", "na", "nb").agg(F.count("*").alias("both"), F.array_join(F.array_sort(F.collect_list("tag")), "、").alias("shared"))
    weight = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return met.filter(weight >= threshold).select("src", "dst", F.bround(weight, 3).alias("weight"), "shared")


def bipartite(jobs: DataFrame, left: str, tags: str, prefix: str, top_left: int = 20, top_tags: int = 40, least: int = 2, unknown: str = "unknown", tagged_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The largest values of a column and the tags most frequent within their rows: nodes id, label, node_type, count; edges src, dst, weight."""
    rows = jobs.select(F.coalesce(F.nullif(F.trim(F.col(left).cast("string")), F.lit("")), F.lit(unknown)).alias("left"), F.array_distinct(tags).alias("tags"))
    if tagged_only:
        rows = rows.filter(F.size("tags") > 0)
    lefts = cut(rows.groupBy("left").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "left").limit(top_left))
    inside = rows.join(F.broadcast(lefts), "left", "left_semi").select("left", F.explode("tags").alias("tag"))  # at most top_left rows
    best = cut(inside.groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag").limit(top_tags))
    edges = inside.join(F.broadcast(best), "tag", "left_semi").groupBy("left", "tag").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)
    name = lambda p, c: F.concat(F.lit(p + "::"), c)
    nodes = lefts.select(name(prefix, F.col("left")).alias("id"), F.col("left").alias("label"), F.lit(prefix).alias("node_type"), "count").unionByName(best.select(name("tag", F.col("tag")).alias("id"), F.col("tag").alias("label"), F.lit("tag").alias("node_type"), "count"))
    return nodes, edges.select(name(prefix, F.col("left")).alias("src"), name("tag", F.col("tag")).alias("dst"), "weight")


def importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with degree, weighted_degree, centrality and size_score."""
    ends = edges.select(F.col("src").alias("id"), "weight").union(edges.select(F.col("dst").alias("id"), "weight"))
    sums = ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").cast("double").alias("weighted_degree"))
    n = nodes.count()
    out = nodes.join(sums, "id", "left").na.fill({"degree": 0, "weighted_degree": 0.0})
    out = out.withColumn("centrality", F.lit(1.0) if n == 1 else F.col("degree") / max(n - 1, 1))
    return out.withColumn("size_score", F.bround(F.log1p("count") * 0.48 + F.log1p("weighted_degree") * 0.37 + F.col("centrality") * 4.5 * 0.15, 4))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, community (its smallest member): connected components; a node without edges is its own."""
    ids = cut(nodes.select("id").distinct().withColumn("_k", F.xxhash64("id")))
    num = edges.join(ids.select(F.col("id").alias("src"), F.col("_k").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("_k").alias("b")), "dst")
    found = components(num.select("a", "b"))
    rooted = ids.join(found.select(F.col("node").alias("_k"), "root"), "_k", "left").select("id", F.coalesce("root", "_k").alias("root"))
    names = rooted.groupBy("root").agg(F.min("id").alias("community"))
    return rooted.join(names, "root").select("id", "community")


def propagated(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community by label propagation: each node takes the label with most weight around it, of equals the smallest."""
    labels = cut(nodes.select("id", F.col("id").alias("community")))
    both = cut(edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("src"), "community"), "src").groupBy("dst", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("m")).select("id", F.col("m.community").alias("new"))
        new = cut(labels.join(best, "id", "left").select("id", "community", F.coalesce("new", "community").alias("new")))
        changed = not new.filter("new <> community").isEmpty()
        labels = new.select("id", F.col("new").alias("community"))
        if not changed:
            break
    return labels


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, avg_degree, components, density."""
    n, e = nodes.count(), edges.count()
    c = connected(nodes, edges).select("community").distinct().count()
    return nodes.sparkSession.createDataFrame([(n, e, round(2 * e / n, 2) if n else 0.0, c, round(2 * e / (n * (n - 1)), 4) if n > 1 else 0.0)], "nodes long, edges long, avg_degree double, components long, density double")


def effort_priority(nodes: DataFrame) -> DataFrame:
    """nodes (with importance and coverage) with priority_score and priority."""
    score = F.bround(F.col("weighted_degree") * 0.55 + F.col("degree") * 0.25 + F.col("coverage") * 100 * 0.20, 3)
    out = nodes.withColumn("priority_score", score)
    return out.withColumn("priority", F.when(score >= 18, "必修核心").when(score >= 10, "方向强化").when(score >= 6, "加分项").otherwise("观察项"))


def top_nodes(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy(F.desc("weighted_degree"), "id").limit(n)


def top_edges(edges: DataFrame, n: int | None = None) -> DataFrame:
    out = edges.orderBy(F.desc("weight"), "src", "dst")
    return out.limit(n) if n else out


def filtered(nodes: DataFrame, edges: DataFrame, least: float = 1, drop_isolated: bool = True, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of enough weight, then no isolated nodes, then the nodes of greatest weighted degree and the edges among them."""
    edges = edges.filter(F.col("weight") >= least)
    ends = edges.select(F.col("src").alias("id"), "weight").union(edges.select(F.col("dst").alias("id"), "weight")).groupBy("id").agg(F.sum("weight").alias("_w"))
    kept = nodes.join(ends, "id", "inner" if drop_isolated else "left").na.fill({"_w": 0})
    if most:
        kept = kept.orderBy(F.desc("_w"), "id").limit(most)
    kept = cut(kept.drop("_w"))
    return kept, induced(kept, edges)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def ego(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """A node, its neighbours and all edges among them; the whole graph if there is no such node."""
    if nodes.filter(F.col("id") == node).isEmpty():
        return nodes, edges
    near = edges.filter((F.col("src") == node) | (F.col("dst") == node)).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id"))
    ids = near.union(nodes.filter(F.col("id") == node).select("id")).distinct()
    own = nodes.join(ids, "id", "left_semi")
    return own, induced(own, edges)


def edge_neighbourhood(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The ends of an edge and the neighbours they share, with all edges among them."""
    near = lambda x: neighbours(edges, x).select("id")
    ids = near(a).intersect(near(b)).union(nodes.filter(F.col("id").isin(a, b)).select("id")).distinct()
    own = nodes.join(ids, "id", "left_semi")
    return own, induced(own, edges)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """id, weight of a node's neighbours, heaviest first."""
    near = edges.filter((F.col("src") == node) | (F.col("dst") == node))
    return near.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id"), "weight").orderBy(F.desc("weight"), "id")


def highlighted(nodes: DataFrame, edges: DataFrame, focus: list[str]) -> DataFrame:
    """nodes with role (focus, neighbour or dim) and scale for drawing."""
    near = edges.filter(F.col("src").isin(focus) | F.col("dst").isin(focus))
    ids = near.select(F.col("src").alias("id")).union(near.select("dst")).distinct().withColumn("_near", F.lit(True))
    role = F.when(F.col("id").isin(focus), "focus").when(F.col("_near"), "neighbour").otherwise("dim")
    out = nodes.join(ids, "id", "left").withColumn("role", role).drop("_near")
    return out.withColumn("scale", F.when(F.col("role") == "focus", 1.8).when(F.col("role") == "neighbour", 1.25).otherwise(0.9))


#: What an edge's width becomes in a highlighted graph, by what is in focus: (least, factor) for edges in focus, near it and others.
WIDTHS = {"node": ((4.0, 1.8), (2.0, 1.1), (1.0, 0.75)), "edge": ((5.0, 2.0), (2.5, 1.15), (1.0, 0.75))}
#: A drawn node's size by its type: base, weight of ln(1 + signal), of ln(1 + weighted degree), of the size score; the greatest size; the upper level's types.
SIZES = {"tag": (10.0, 9.5, 1.6, 0.0), "skill": (10.0, 9.5, 1.6, 0.0), "responsibility": (10.0, 9.5, 1.6, 0.0), "role": (14.0, 7.2, 1.8, 0.0), "job_type": (14.0, 7.2, 1.8, 0.0), "company": (14.0, 7.2, 1.8, 0.0), "job": (12.0, 4.0, 2.0, 0.0)}
OTHER_SIZE, MOST_SIZE = (10.0, 6.2, 2.2, 2.0), 56.0
TOP_LEVEL = ["role", "job_type", "company", "job"]


def highlighted_edges(edges: DataFrame, focus: list[str]) -> DataFrame:
    """edges with role (focus, neighbour or dim) and width.

    Around one node its edges are in focus and those among its neighbours are near; for two
    nodes the edge between them is in focus and their others are near. All widths are first
    drawn in as the rest is, then raised.
    """
    a, b = F.col("src").isin(focus), F.col("dst").isin(focus)
    if len(focus) > 1:
        out = edges.withColumn("role", F.when(a & b, "focus").when(a | b, "neighbour").otherwise("dim"))
    else:
        ids = edges.filter(a | b).select(F.when(a, F.col("dst")).otherwise(F.col("src")).alias("_id")).distinct()
        near = lambda c: ids.select(F.col("_id").alias(c), F.lit(True).alias(f"_near_{c}"))
        both = edges.join(near("src"), "src", "left").join(near("dst"), "dst", "left")
        out = both.withColumn("role", F.when(a | b, "focus").when(F.col("_near_src") & F.col("_near_dst"), "neighbour").otherwise("dim")).select(*edges.columns, "role")
    own = F.coalesce(F.col("width"), F.lit(1.0)) if "width" in edges.columns else F.greatest(F.lit(1.0), F.least(F.col("weight").cast("double"), F.lit(8.0)))
    first, near, rest = WIDTHS["edge" if len(focus) > 1 else "node"]
    base = F.greatest(F.lit(rest[0]), own * rest[1])
    return out.withColumn("width", F.when(F.col("role") == "focus", F.greatest(F.lit(first[0]), base * first[1])).when(F.col("role") == "neighbour", F.greatest(F.lit(near[0]), base * near[1])).otherwise(base))


def neighbour_table(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """label, weight, relation of a node's neighbours, heaviest first, then by name."""
    relation = F.col("relation") if "relation" in edges.columns else F.lit("")
    near = edges.filter((F.col("src") == node) | (F.col("dst") == node)).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id"), "weight", F.coalesce(relation, F.lit("")).alias("relation"))
    label = nodes.select("id", (F.col("label") if "label" in nodes.columns else F.lit(None).cast("string")).alias("label"))
    return near.join(label, "id", "left").select(F.coalesce("label", "id").alias("label"), "weight", "relation", "id").orderBy(F.desc("weight"), "id").drop("id")


def drawn(nodes: DataFrame) -> DataFrame:
    """nodes with visual_size and level: what a drawing of them needs."""
    have = lambda c, other: F.coalesce(*[F.col(x).cast("double") for x in (c, other) if x in nodes.columns], F.lit(0.0))
    count, jobs, degree, score = have("count", "coverage_jobs"), have("coverage_jobs", "count"), have("weighted_degree", "weighted_degree"), have("size_score", "size_score")
    kind = F.col("node_type") if "node_type" in nodes.columns else F.lit("")
    of = lambda p, signal: p[0] + F.log1p(F.greatest(signal, F.lit(0.0))) * p[1] + F.log1p(F.greatest(degree, F.lit(0.0))) * p[2] + score * p[3]
    size = of(OTHER_SIZE, F.greatest(count, jobs))
    for name, p in SIZES.items():
        size = F.when(kind == name, of(p, count if name == "job" else F.greatest(count, jobs))).otherwise(size)
    return nodes.withColumns({"visual_size": F.least(F.lit(MOST_SIZE), size), "level": F.when(kind.isin(TOP_LEVEL), 0).otherwise(1)})
