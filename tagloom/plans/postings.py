"""The three ways through the library as single lazy plans: process postings, query a network, match a résumé."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, graph, match, model_calls, network, normalize, project, resume, stats, tags

#: Columns that feed each kind of final tags, in order.
FINAL_SOURCES = {
    "hard": ["hard_tags", "rule_must", "rule_nice", "rule_tools", "deep_hard", "deep_tools", "llm_must", "llm_nice", "llm_tools"],
    "soft": ["soft_tags", "deep_soft"],
    "duty": ["duty_tags", "rule_duties", "deep_duty", "llm_content", "llm_goal"],
    "scene": ["scene_tags", "rule_industry", "deep_scene", "deep_type", "llm_industry", "llm_job_type"],
}


def process(jobs: DataFrame, dictionary: dict, aliases: dict[str, list[str]], rules: dict[str, dict], order: str = "ordinal", skill_aliases: dict | None = None, threshold: float = 0.90, near: bool = True, client=None, cache: DataFrame | None = None) -> DataFrame:
    """Postings with ids, standard names, dictionary and rule tags, model skills if there is a client, final tags and duplicate flags."""
    out = project.ensure_columns(jobs, {c: "string" for c in project.REQUIRED_COLUMNS})
    out = normalize.apply(project.assign_job_id(out, order), aliases, rules)
    out = tags.apply_dictionary(out, dictionary, tags.text_of("title_norm", "title_raw", "detail"))
    for c in tags.TYPES.values():
        if c not in out.columns:
            out = out.withColumn(c, F.array().cast("array<string>"))
    out = tags.apply_rules(out, "detail")
    if client:
        cache = cache if cache is not None else jobs.sparkSession.createDataFrame([], "key string, payload string")
        prompt = model_calls.posting_text(["title_norm", "company_norm", "city", "experience", "degree"], "detail")
        out, _ = model_calls.enriched(out, cache, prompt, model_calls.SKILLS, client, "skills")
        add = lambda c, f: F.array_distinct(F.concat(c, F.coalesce(f"answer.{f}", F.array().cast("array<string>"))))
        out = out.withColumns({"hard_tags": add("hard_tags", "hard_skills"), "soft_tags": add("soft_tags", "soft_skills")}).drop("answer")
    out = tags.fuse(out, FINAL_SOURCES, skill_aliases)
    return dedup.similar(out, "detail", ["company_norm", "title_norm"], threshold, order=order) if near else dedup.with_defaults(out)


def relations(jobs: DataFrame, dimension: str = "all", kind: str = "cooccurrence", stop: list[str] = (), common: float = 0.99, **options) -> tuple[DataFrame, DataFrame] | None:
    """The graph of deduplicated postings without stop tags and tags that nearly all postings have."""
    left = dedup.deduped(jobs)
    columns = [c for c, t in left.dtypes if t == "array<string>" and c.endswith("_tags")]
    left = network.without(left, columns, list(stop))
    everywhere = [r["tag"] for r in stats.high_coverage_tags(left, columns, "job_id", common).collect()] if columns else []  # at most 1 / common tags a row's length
    return network.build(network.without(left, columns, everywhere), dimension, kind, **options)


def recommend(jobs: DataFrame, text: str, top: int = 20) -> DataFrame:
    """The best postings for a résumé's text."""
    row = resume.fields(jobs.sparkSession.createDataFrame([(text,)], "text string"), "text").select(resume.profile().alias("p")).first()["p"]
    profile = {"hard_skills": row["hard_skills"] or [], "soft_skills": row["soft_skills"] or [], "roles": row["target_roles"] or [], "degree": row["degree"], "level": row["seniority_level"], "cities": row["target_cities"] or []}
    return match.match(jobs, profile, ["final_hard_tags"], ["final_soft_tags"]).limit(top)


def visible(nodes: DataFrame, edges: DataFrame, most: int = 80) -> tuple[DataFrame, DataFrame]:
    """A graph small enough to draw."""
    return graph.filtered(nodes, edges, most=most)
