"""Network queries as a whole: which column, which graph, what it shows, and advice by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tagcells
from ..functions.constants import COLUMN_ADVICE, TAG_COLUMN_WORDS, TAG_TEXT_COLUMNS
from ..functions.text import safe, strip
from . import communities, graph, stats

DIMENSIONS = {"tech": "hard", "soft": "soft", "duty": "duty", "scene": "scene", "all": "all"}
TYPES = ("cooccurrence", "job_similarity", "company_tag", "role_tag")


def tag_column(jobs: DataFrame, dimension: str) -> str | None:
    """The dimension's best filled column among network, final, dictionary and model tags."""
    kind = DIMENSIONS[dimension]
    return stats.best_tag_column(jobs, [f"net_{kind}_tags", f"final_{kind}_tags", f"{kind}_tags", f"llm_{kind}_tags"])


def stop_words(text: str) -> list[str]:
    """A user's stop tags: parted by line ends, commas, semicolons and blanks."""
    for mark in "\n,，;；、":
        text = text.replace(mark, " ")
    return list(dict.fromkeys(text.split()))


def without(jobs: DataFrame, columns: list[str], stop: list[str]) -> DataFrame:
    """Tag columns cleaned and without stop tags."""
    clean = lambda c: F.filter(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")), lambda x: ~x.isin(stop) if stop else F.lit(True))
    return jobs.withColumns({c: clean(c) for c in columns if c in jobs.columns})


def build(jobs: DataFrame, dimension: str = "all", kind: str = "cooccurrence", top: int = 50, least: int = 2, threshold: float = 0.25, company: str = "company_norm", role: str = "direction", job_id: str = "job_id", strict: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of one of the four graphs; None, or an error if strict, where no column has tags."""
    if kind not in TYPES:
        raise ValueError(f"unknown graph {kind}")
    tags = tag_column(jobs, dimension)
    if tags is None:
        if strict:
            raise ValueError(f"no tags for {dimension}")
        return None
    if kind == "cooccurrence":
        return graph.cooccurrence(jobs, tags, job_id, top, least)
    if kind == "company_tag":
        return graph.bipartite(jobs, company, tags, "company", min(20, top), top, least)
    if kind == "role_tag":
        return graph.bipartite(jobs, role, tags, "role", min(15, max(6, top // 4)), top, least, tagged_only=True)
    first = jobs.orderBy(job_id).limit(top)
    nodes = first.select(F.col(job_id).cast("string").alias("id"), job_label(company, "title_norm", "city").alias("label"), F.size(tags).cast("long").alias("count"))
    edges = graph.job_similarity(jobs, tags, job_id, [F.asc(job_id)], top, threshold)
    return nodes, edges.withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")})


def job_label(company: str, title: str, city: str, most: int = 42) -> Column:
    """City, company and title in one short label."""
    return F.substring(F.array_join(F.filter(F.array(safe(city), safe(company), safe(title)), lambda x: x != ""), "-"), 1, most)


def insight(jobs: DataFrame, nodes: DataFrame, edges: DataFrame, role: str, tags: str, job_id: str = "job_id") -> dict[str, DataFrame]:
    """overview, roles, tags, combinations, priority and communities of a co-occurrence graph, as DataFrames."""
    total = jobs.count()
    roles = jobs.groupBy(F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role")).agg(F.count("*").alias("jobs"))
    roles = roles.withColumn("share", F.col("jobs") / max(total, 1)).orderBy(F.desc("jobs"), "role").limit(12)
    ranked = graph.effort_priority(graph.importance(nodes, edges)).orderBy(F.desc("priority_score"), "id")
    members = communities.communities(nodes, edges)
    overview = jobs.agg(F.countDistinct(job_id).alias("jobs")).withColumns({"nodes": F.lit(nodes.count()), "edges": F.lit(edges.count())})
    return {
        "overview": overview,
        "roles": roles,
        "tags": stats.tag_stats(jobs, tags, job_id).orderBy(F.desc("freq"), "tag").limit(20),
        "combinations": stats.pair_support(jobs, tags, 3, 20, total),
        "priority": ranked,
        "communities": communities.summary(members),
    }


def advice(found: dict[str, DataFrame]) -> dict[str, object]:
    """What the statistics recommend, without a model: the same each time."""
    roles, ranked = found["roles"].limit(3).collect(), found["priority"].limit(8).collect()
    pairs = found["combinations"].limit(5).collect()
    first = [r["id"] for r in ranked[:5]]
    core = [r["id"] for r in ranked if r["priority"] in ("必修核心", "方向强化")]
    return {
        "main_direction": roles[0]["role"] if roles else "",
        "main_share": roles[0]["share"] if roles else 0.0,
        "directions": [{"direction": r["role"], "jobs": r["jobs"], "priority": "高" if r["share"] >= 0.2 else "中"} for r in roles],
        "focus_first": first,
        "core": core or first,
        "bonus": [f"{r['a']} + {r['b']}" for r in pairs],
        "model": "fallback",
    }


def inspect_columns(jobs: DataFrame, text_sources: bool = True) -> DataFrame:
    """column_name, filled_rows, rows_with_tags, coverage, distinct_tags, tags, sample, advice of the columns whose name tells of tags, and of known text columns.

    A cell of any type is parsed as tags (see tagcells); a filled one is not blank and not nan,
    none, [] or {}. All columns are measured in one pass, distinct tags in another; nothing but
    a row a column comes together. Columns of equal measure go by name.
    """
    named = [c for c in jobs.columns if any(w in c.lower() for w in TAG_COLUMN_WORDS) or text_sources and c in TAG_TEXT_COLUMNS]
    if not named:
        return jobs.sparkSession.createDataFrame([], "column_name string, filled_rows long, rows_with_tags long, coverage double, distinct_tags long, tags long, sample string, advice string")
    kinds = dict(jobs.dtypes)
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v"))) if kinds[c].startswith(("array", "map", "struct", "variant")) else safe(c)
    blank = ["", "nan", "none", "[]", "{}", "{\"v\":[]}", "{\"v\":{}}"]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), (~F.lower(F.coalesce(text(c), F.lit(""))).isin(blank) & F.col(c).isNotNull()).alias("filled"), tagcells.tags_of(jobs, c).alias("t"), F.substring(F.coalesce(text(c), F.lit("")), 1, 120).alias("raw")) for c in named])
    rows = jobs.select(F.inline(cells))
    sample = F.min(F.when(F.size("t") > 0, F.array_join(F.slice("t", 1, 8), "、")).when(F.col("filled"), F.col("raw")))
    size = rows.groupBy("column_name").agg(F.count_if("filled").alias("filled_rows"), F.count_if(F.size("t") > 0).alias("rows_with_tags"), F.count("*").alias("_n"), F.sum(F.size("t")).alias("tags"), sample.alias("sample"))
    distinct = rows.select("column_name", F.explode("t").alias("tag")).distinct().groupBy("column_name").agg(F.count("*").alias("distinct_tags"))
    out = size.join(distinct, "column_name", "left").na.fill({"distinct_tags": 0, "sample": ""})
    advice = F.when(F.col("rows_with_tags") > 0, COLUMN_ADVICE[0]).when((F.col("filled_rows") > 0) & F.col("column_name").isin(TAG_TEXT_COLUMNS), COLUMN_ADVICE[1]).when(F.col("filled_rows") > 0, COLUMN_ADVICE[2]).otherwise(COLUMN_ADVICE[3])
    made = out.select("column_name", "filled_rows", "rows_with_tags", (F.col("filled_rows") / F.greatest("_n", F.lit(1))).alias("coverage"), "distinct_tags", "tags", "sample", advice.alias("advice"))
    return made.orderBy(F.desc("rows_with_tags"), F.desc("distinct_tags"), F.desc("filled_rows"), "column_name")
