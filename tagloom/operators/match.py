"""Scoring postings against one candidate: narrow projections with the candidate as literals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DEGREES, LOWEST_MATCH, MATCH_LEVELS, SKILL_ALIASES
from ..functions.text import contains_any, distinct_folded, lookup, safe


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def skills(*arrays: Column) -> Column:
    """Arrays as one list: stripped, aliases resolved, distinct with case ignored."""
    items = F.filter(F.transform(F.concat(F.array().cast("array<string>"), *arrays), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return distinct_folded(F.transform(items, lambda x: F.coalesce(lookup(F.lower(x), SKILL_ALIASES), x)))


def own_skills(values: list[str]) -> list[str]:
    """The same for the candidate's list."""
    out: dict[str, str] = {}
    for v in values:
        v = SKILL_ALIASES.get((v or "").strip().lower(), (v or "").strip())
        if v:
            out.setdefault(v.lower(), v)
    return list(out.values())


def matched(wanted: Column, have: list[str]) -> Column:
    """The wanted skills that equal, hold or are held by one of the candidate's, case ignored."""
    low = strings([h.lower() for h in have])
    return F.filter(wanted, lambda w: F.exists(low, lambda c: F.contains(F.lower(w), c) | F.contains(c, F.lower(w))))


def overlap_score(wanted: Column, hits: Column, full: int) -> Column:
    """The share met, of ``full``, cut to a whole number; all of it if nothing is wanted."""
    n = F.size(wanted)
    return F.when(n == 0, full).otherwise(F.floor(F.lit(full) * F.size(hits) / F.greatest(n, F.lit(1)))).cast("int")


def degree_score(wanted: Column, degree: str) -> Column:
    rank = lambda text: F.greatest(*[F.when(F.contains(text, F.lit(k)), v).otherwise(0) for k, v in DEGREES.items()])
    own = max((v for k, v in DEGREES.items() if k in degree), default=0)
    return F.when(wanted == "", 8).when(F.lit(not degree), 4).when(F.lit(own) >= rank(wanted), 10).otherwise(4)


def experience_score(wanted: Column, level: str) -> Column:
    has = lambda *ws: contains_any(wanted, list(ws), fold=False)
    middle = 8 if "应届" in level else 12
    return F.when(wanted == "", 10).when(has("不限", "应届", "校招", "0-1", "1年以下"), 15).when(has("1-3年", "1年以上", "2年", "3年"), middle).when(has("3年以上", "5年", "资深", "高级"), 2).otherwise(8)


def direction_score(text: Column, roles: list[str]) -> Column:
    if not roles:
        return F.lit(10)
    hits = sum((F.contains(F.lower(text), F.lit(r.lower())).cast("int") for r in roles), F.lit(0))
    return F.when(hits > 0, F.least(F.lit(20), hits * 6 + 8)).otherwise(6)


def city_score(city: Column, cities: list[str]) -> Column:
    if not cities:
        return F.lit(3)
    hit = reduce(lambda a, b: a | b, [F.contains(city, F.lit(c)) | F.contains(F.lit(c), city) for c in cities])
    return F.when((city != "") & hit, 5).otherwise(1)


def fresh_fit(experience: Column, seniority: Column, others: Column) -> Column:
    has = lambda c, *ws: contains_any(c, list(ws), fold=False)
    return F.when(has(F.concat(others, seniority, experience), "应届", "校招", "2025届", "2026届", "接受应届", "不限经验"), 10).when(has(experience, "1-3年", "1年以上", "2年", "3年"), 5).when(has(F.concat(experience, seniority), "3年以上", "资深", "高级", "专家"), 1).otherwise(6)


def level(total: Column) -> Column:
    out = F.lit(LOWEST_MATCH)
    for least, name in reversed(MATCH_LEVELS):
        out = F.when(total >= least, name).otherwise(out)
    return out


def match(jobs: DataFrame, profile: dict, hard: list[str], soft: list[str], title: str = "title_norm", category: str = "category", direction: str = "direction", degree: str = "degree", experience: str = "experience", city: str = "city", detail: str = "detail", seniority: str | None = None, order: str = "ordinal") -> DataFrame:
    """jobs with match_total, its seven parts, matched and missing skills (10 at most), level and reason; best first.

    profile: hard_skills, soft_skills, roles, degree, level, cities. A posting that wants
    nothing gives full marks for skills.
    """
    have, soft_have = own_skills(profile.get("hard_skills", [])), own_skills(profile.get("soft_skills", []))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c and c in jobs.columns else F.lit("")
    out = jobs.withColumns({"_w": skills(*[F.coalesce(c, F.array()) for c in hard if c in jobs.columns]), "_s": skills(*[F.coalesce(c, F.array()) for c in soft if c in jobs.columns])})
    out = out.withColumns({"_h": matched(F.col("_w"), have), "_sh": matched(F.col("_s"), soft_have)})
    parts = {
        "match_hard": overlap_score(F.col("_w"), F.col("_h"), 30),
        "match_soft": overlap_score(F.col("_s"), F.col("_sh"), 10),
        "match_direction": direction_score(F.concat_ws(" ", text(category), text(direction), text(title)), own_skills(profile.get("roles", []))),
        "match_degree": degree_score(text(degree), profile.get("degree") or ""),
        "match_experience": experience_score(text(experience), profile.get("level") or "应届"),
        "match_city": city_score(text(city), own_skills(profile.get("cities", []))),
        "match_fresh": fresh_fit(text(experience), text(seniority), text(detail)),
    }
    out = out.withColumns({k: v.cast("int") for k, v in parts.items()})
    out = out.withColumn("match_total", sum(F.col(k) for k in parts))
    out = out.withColumns({"matched_skills": F.slice("_h", 1, 10), "missing_skills": F.slice(F.filter("_w", lambda w: ~F.array_contains(F.col("_h"), w)), 1, 10), "match_level": level(F.col("match_total"))})
    said = lambda words, c: F.when(F.size(c) > 0, F.concat(words, F.array_join(F.slice(c, 1, 5), "、")))
    reason = F.concat_ws(
        "；",
        said(F.concat(F.lit("已匹配"), text(title), F.lit("：")), F.col("matched_skills")),
        said(F.lit("主要缺口："), F.col("missing_skills")),
        F.when(F.col("match_fresh") >= 8, "对应届生较友好").when(F.col("match_fresh") <= 3, "经验门槛偏高"),
        F.when(F.col("match_direction") >= 14, "方向与目标较一致"),
    )
    return out.withColumn("match_reason", reason).drop("_w", "_s", "_h", "_sh").orderBy(F.desc("match_total"), F.desc("match_fresh"), order)


def missing_counts(ranked: DataFrame, order: list, first: int = 20, top: int = 10) -> DataFrame:
    """skill, n: what the best jobs want and the candidate lacks."""
    return ranked.orderBy(*order).limit(first).select(F.explode("missing_skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(top)


def career_summary(ranked: DataFrame, order: list, role: str = "direction", company: str = "company_norm", first: int = 20, top: int = 10) -> dict[str, DataFrame]:
    """roles, missing skills, and the first 15 recommended jobs' companies, of the best jobs."""
    best = ranked.orderBy(*order).limit(first)
    roles = best.groupBy(F.col(role).alias("role")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").limit(top)
    return {"roles": roles, "missing": missing_counts(ranked, order, first, top), "companies": best.filter(F.col("match_total") >= 55).orderBy(*order).limit(15).select(company).distinct()}


def keyword_score(chunk: Column, tokens: list[str]) -> Column:
    """How many distinct query tokens of two or more characters a chunk holds."""
    return F.size(F.filter(strings(sorted({t.lower() for t in tokens if len(t) >= 2})), lambda t: F.contains(F.lower(chunk), t)))


def retrieve(chunks: DataFrame, text: str, query: str, order: str, top: int = 8) -> DataFrame:
    """The chunks that hold most of the query's tokens."""
    return chunks.withColumn("score", keyword_score(safe(text), query.split())).orderBy(F.desc("score"), order).limit(top)
