"""How well the postings' texts bear out tags, and how open postings are to graduates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BONUS_SIGNALS, DUTY_SIGNALS, FRESH_NEGATIVE, FRESH_POSITIVE, REQUIREMENT_SIGNALS
from ..functions.text import contains_any, safe, strip
from .stats import exploded


def fresh_score(text: Column) -> Column:
    """0 to 100: how friendly a posting is to fresh graduates."""
    hits = lambda words: sum((F.contains(F.lower(text), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    score = F.lit(50) + F.least(hits(FRESH_POSITIVE) * 12, F.lit(42)) - F.least(hits(FRESH_NEGATIVE) * 14, F.lit(50))
    score = score - F.when(text.rlike("[1一]-?[2二]年"), 8).otherwise(0) - F.when(text.rlike("[3三]-?[5五]年|[3三]年以上|[5五]年以上"), 28).otherwise(0)
    score = score + F.when(F.contains(text, F.lit("应届")) | F.contains(text, F.lit("经验不限")), 18).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def fresh_level(score: Column) -> Column:
    return F.when(score >= 75, "高").when(score >= 55, "中").otherwise("低")


def confidence(score: Column) -> Column:
    return F.when(score >= 72, "高").when(score >= 45, "中").otherwise("低")


def tag_in(text: Column, tag: Column) -> Column:
    """Whether a tag of the row occurs in a text of the row: with boundaries if it is ASCII."""
    low, t = F.lower(text), F.lower(tag)
    quoted = F.regexp_replace(t, "([+#.\\-])", "\\\\$1")
    bounded = F.regexp_like(low, F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])")))
    return F.when(~F.contains(low, t), F.lit(False)).when(tag.rlike(r"^[A-Za-z0-9_+#.\-]+$"), bounded).otherwise(F.lit(True))


def tag_context(text: Column, tag: Column, window: int) -> Column:
    """The first place of a row's tag with what stands around it; "" without one."""
    low, t = F.lower(text), F.lower(tag)
    quoted = F.regexp_replace(t, "([+#.\\-])", "\\\\$1")
    at = F.when(tag.rlike(r"^[A-Za-z0-9_+#.\-]+$"), F.regexp_instr(low, F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])")))).otherwise(F.instr(low, t))
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, strip(F.translate(F.substring(text, start, at + F.length(tag) + window - start), "\n", " "))).otherwise(F.lit(""))


def tag_evidence(jobs: DataFrame, tags: str, detail: str, title: str, company: str, role: str, job_id: str = "job_id", fresh: str | None = None) -> DataFrame:
    """The measures of each tag: counts, coverages, signal rates, importance, confidence, priority.

    One row a tag and job carries booleans through a single aggregation; totals are of all jobs.
    """
    blank = lambda c: F.when(safe(c) != "", safe(c))
    total = jobs.agg(F.countDistinct(job_id).alias("j"), F.countDistinct(company).alias("c"), F.countDistinct(F.coalesce(F.col(role).cast("string"), F.lit("nan"))).alias("r")).first()
    text = jobs.withColumns({"_d": safe(detail), "_t": safe(title), "_c": blank(company), "_r": blank(role)})
    text = text.withColumn("_f", F.col(fresh) if fresh else fresh_score(F.col("_d")))
    rows = exploded(text, tags, job_id, "_d", "_t", "_c", "_r", "_f").withColumn("_s", tag_context(F.col("_d"), F.col("tag"), 120))
    n = lambda c: F.count_if(c).cast("double")
    found = rows.groupBy("tag").agg(
        F.count("*").alias("freq"), F.countDistinct(job_id).alias("jobs"), F.countDistinct("_c").alias("companies"), F.countDistinct("_r").alias("roles"),
        n(contains_any(F.col("_s"), REQUIREMENT_SIGNALS)).alias("_req"), n(contains_any(F.col("_s"), BONUS_SIGNALS)).alias("_bonus"), n(contains_any(F.col("_s"), DUTY_SIGNALS)).alias("_duty"),
        n(tag_in(F.col("_t"), F.col("tag"))).alias("_title"), n(tag_in(F.col("_d"), F.col("tag"))).alias("_evidence"), F.avg("_f").alias("_fresh"),
    )
    out = found.withColumns({"coverage": F.col("jobs") / max(total["j"], 1), "company_coverage": F.col("companies") / max(total["c"], 1), "role_coverage": F.col("roles") / max(total["r"], 1)})
    out = out.withColumns({f"{k}_rate": F.col(f"_{k}") / F.greatest("jobs", F.lit(1)) for k in ("req", "duty", "bonus", "title", "evidence")})
    weight = {"coverage": 32, "company_coverage": 18, "role_coverage": 12, "req_rate": 20, "duty_rate": 10, "title_rate": 5, "evidence_rate": 3}
    out = out.withColumn("_importance", sum(F.col(k) * w for k, w in weight.items()))
    out = out.withColumns({"importance": F.bround("_importance", 1), "confidence": confidence(F.col("_importance")), "fresh_avg": F.bround("_fresh", 1)})
    priority = F.when((F.col("req_rate") >= 0.45) & (F.col("coverage") >= 0.20), "核心门槛").when(F.col("importance") >= 55, "重点强化").when((F.col("bonus_rate") >= 0.35) & (F.col("req_rate") < 0.35), "加分项").otherwise("观察项")
    return out.withColumn("priority", priority).drop("_req", "_duty", "_bonus", "_title", "_evidence", "_fresh", "_importance").orderBy(F.desc("importance"), F.desc("jobs"), F.desc("req_rate"), "tag")


def overview(evidence: DataFrame) -> DataFrame:
    """tags, core, strengthen, bonus, high: how many tags there are of each kind."""
    of = lambda p: F.count_if(F.col("priority") == p)
    return evidence.agg(F.count("*").alias("tags"), of("核心门槛").alias("core"), of("重点强化").alias("strengthen"), of("加分项").alias("bonus"), F.count_if(F.col("confidence") == "高").alias("high"))


def opportunity(jobs: DataFrame, role: str, company: str, fresh: Column, job_id: str = "job_id", top: int = 20) -> DataFrame:
    """role, jobs, companies, fresh_avg, score, priority; a null role is left out."""
    rows = jobs.filter(F.col(role).isNotNull()).groupBy(F.col(role).alias("role")).agg(F.countDistinct(job_id).alias("jobs"), F.countDistinct(company).alias("companies"), F.avg(fresh).alias("fresh_avg"))
    score = F.least("jobs", F.lit(30)) * 1.2 + F.least("companies", F.lit(20)) * 1.3 + F.col("fresh_avg") * 0.55
    rows = rows.withColumn("score", score)
    return rows.withColumn("priority", F.when(score >= 65, "高").when(score >= 45, "中").otherwise("低")).orderBy(F.desc("score"), "role").limit(top)


def fresh_jobs(jobs: DataFrame, text: Column, order: str, top: int = 30) -> DataFrame:
    """The jobs friendliest to graduates, with fresh_score and fresh_level."""
    scored = jobs.withColumn("fresh_score", fresh_score(text))
    return scored.withColumn("fresh_level", fresh_level(F.col("fresh_score"))).orderBy(F.desc("fresh_score"), order).limit(top)


def examples(jobs: DataFrame, tags: str, tag: str, detail: str, order: str, limit: int = 5, window: int = 90) -> DataFrame:
    """The first jobs, in order, that have the tag, with its place in the text."""
    rows = jobs.filter(F.array_contains(tags, tag)).withColumn("context", tag_context(safe(detail), F.lit(tag), window))
    return rows.orderBy(order).limit(limit)
