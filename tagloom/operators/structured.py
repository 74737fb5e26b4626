"""Structured answers of models: a schema of fields with caps, coerced from whatever shape an answer has.

An answer is text; what stands between its outermost braces is parsed once as a variant, and each
field is taken from it by the field's rule: a list from a list or a separated text, a text cut to
its length, else the field's default. All of this is column expressions. Rows that have a result
already are left alone; of the others, those whose key the cache knows are joined with it, and
only the rest goes to the client, each distinct prompt once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_folded, mended_json, safe, strip, without_fence
from ..plans.lineage import ship
from .model_calls import cache_key

Client = Callable[[list[str]], list[str]]
PAYLOAD = "answer string, error string"


@dataclass(frozen=True)
class Field:
    """A column and the answer's field behind it: a list of at most ``items`` texts of ``length``, or, without items, a text cut to ``length``."""

    column: str
    name: str
    length: int
    items: int | None = None
    default: str = ""


#: Fields of a structured posting and of refined tags, with their caps and defaults.
POSTING = [
    Field("llm_content", "job_content", 40, 8),
    Field("llm_requirements", "job_requirements", 40, 10),
    Field("llm_bonus", "bonus_points", 40, 8),
    Field("llm_industry", "industry", 20, 3, "未知"),
    Field("llm_job_type", "job_type", 20, 3),
    Field("llm_goal", "core_goal", 25),
    Field("llm_degree", "degree_requirement", 20),
    Field("llm_experience", "experience_requirement", 20),
    Field("llm_fresh", "fresh_grad_friendly", 10, None, "不明确"),
    Field("llm_seniority", "seniority_level", 10),
    Field("llm_must", "must_have_skills", 30, 8),
    Field("llm_nice", "nice_to_have_skills", 30, 6),
    Field("llm_tools", "tool_stack", 30, 8),
]
REFINED = [
    Field("deep_hard", "hard_skills", 32, 18),
    Field("deep_soft", "soft_skills", 32, 12),
    Field("deep_duty", "responsibilities", 32, 18),
    Field("deep_scene", "industry_scenes", 32, 12),
    Field("deep_requirements", "job_requirements", 32, 18),
    Field("deep_bonus", "bonus_points", 32, 12),
    Field("deep_tools", "tool_stack", 32, 12),
    Field("deep_type", "job_type", 32, 6),
]
#: Which refined lists are added to which tags, and the most tags a row keeps.
REFINED_INTO = {"hard_tags": ["deep_hard", "deep_tools"], "soft_tags": ["deep_soft"], "duty_tags": ["deep_duty"], "scene_tags": ["deep_scene", "deep_type"]}
TAGS, TAG_LENGTH = 40, 40
#: An answer that says nothing lacks all of these.
TELLING = ("llm_content", "llm_requirements", "llm_must", "llm_tools")
ITEM_EDGES = r"(?U)^[\s\-•\[\]【】()（）\"']+|[\s\-•\[\]【】()（）\"']+$"
SPLIT = "[，,；;、\n]+"


def parsed(answer: Column, mend: bool = False) -> Column:
    """An answer as a variant: code fences off, else what stands between the outermost braces, with ``mend`` also mended; null if none parses."""
    bare = without_fence(answer)
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    tries = [bare, body, *([mended_json(body)] if mend else [])]
    return F.coalesce(*[F.try_parse_json(F.nullif(t, F.lit(""))) for t in tries])


def listed(items: Column, field: Field) -> Column:
    """Texts stripped, blank and too long ones out, distinct with case ignored, at most ``field.items``."""
    clean = F.transform(items, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), ITEM_EDGES, ""))
    return distinct_folded(F.filter(clean, lambda x: (x != "") & (F.length(x) <= field.length)), field.items)


def coerced(v: Column, field: Field) -> Column:
    """A field of an answer in its column's type, whatever the answer holds."""
    path = f"$.{field.name}"
    own = F.try_variant_get(v, path, "variant")
    kind, text = F.coalesce(F.schema_of_variant(own), F.lit("")), F.try_variant_get(v, path, "string")
    if field.items is None:
        flat = F.substring(strip(F.when(kind.isin("", "VOID"), "").otherwise(F.coalesce(text, F.lit("")))), 1, field.length)
        return F.coalesce(F.nullif(flat, F.lit("")), F.lit(field.default))
    texts = F.when(kind == "STRING", F.split(text, SPLIT)).when(kind.startswith("ARRAY"), F.try_variant_get(v, path, "array<string>")).otherwise(F.array().cast("array<string>"))
    out = listed(F.coalesce(texts, F.array().cast("array<string>")), field)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(field.default))) if field.default else out


def asked(client: Client, fallback: Client | None, fields: list[Field]) -> Callable[[list[str]], list[tuple[str, str]]]:
    """Answers and errors of prompts: a client that fails, or tells nothing, is followed by the fallback if there is one."""
    names = [f.name for f in fields if f.column in TELLING] or [f.name for f in fields]

    def tells(answer: str) -> bool:
        try:
            found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
        except ValueError:
            return False
        return isinstance(found, dict) and any(found.get(n) for n in names or found)

    def one(text: str) -> tuple[str, str]:
        if not text.strip():
            return "", ""
        try:
            answer, error = client([text])[0], ""
        except Exception as e:  # noqa: BLE001  a client may fail in any way
            answer, error = "", str(e) or type(e).__name__
        if not error and tells(answer):
            return answer, ""
        if fallback is None:
            return answer, error or "empty_result"
        try:
            return fallback([text])[0], "fallback_used"
        except Exception as e:  # noqa: BLE001
            return answer, f"first_failed: {error or 'empty_result'}; fallback_failed: {e}"

    return lambda texts: [one(t) for t in texts]


def payloads(prompts: DataFrame, ask: Callable[[list[str]], list[tuple[str, str]]]) -> DataFrame:
    """key, answer, error of distinct prompts (key, prompt)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = ask(frame["prompt"].tolist())
            yield pd.DataFrame({"key": frame["key"], "answer": [a for a, _ in found], "error": [e for _, e in found]})

    ship(prompts.sparkSession)
    return prompts.groupBy("key").agg(F.min("prompt").alias("prompt")).mapInPandas(run, f"key string, {PAYLOAD}")


def structured(jobs: DataFrame, prompt: Column, fields: list[Field], client: Client, error: str, task: str, cache: DataFrame | None = None, fallback: Client | None = None, done: str | None = None, overwrite: bool = False, chosen: Column | None = None, model: str = "offline", version: str = "1") -> tuple[DataFrame, DataFrame]:
    """jobs with the fields' columns and ``error``, and the cache (key, answer, error) with what was asked now.

    Rows whose list ``done`` has items keep what they have unless ``overwrite``; ``chosen`` tells
    which rows are asked at all. A blank prompt, like an answer that does not parse, gives the
    defaults. Columns that jobs has are filled where rows were asked; others are new.
    """
    spark = jobs.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], f"key string, {PAYLOAD}")
    has = F.size(F.coalesce(F.col(done), F.array().cast("array<string>"))) > 0 if done in jobs.columns and not overwrite else F.lit(False)
    ask = ~has & (F.coalesce(chosen, F.lit(False)) if chosen is not None else F.lit(True))
    rows = jobs.withColumns({"_structured_ask": ask, "_structured_prompt": F.coalesce(prompt, F.lit(""))}).withColumn("_structured_key", F.when(F.col("_structured_ask"), cache_key(task, model, version, F.col("_structured_prompt"))))
    wanted = rows.filter("_structured_ask").select(F.col("_structured_key").alias("key"), F.col("_structured_prompt").alias("prompt"))
    new = payloads(wanted if overwrite else wanted.join(cache, "key", "left_anti"), asked(client, fallback, fields))
    whole = (cache.join(wanted.select("key").distinct(), "key", "left_anti") if overwrite else cache).unionByName(new)
    met = rows.join(whole.select(F.col("key").alias("_structured_key"), F.col("answer").alias("_structured_answer"), F.col("error").alias("_structured_error")), "_structured_key", "left").withColumn("_structured_v", parsed(F.col("_structured_answer")))
    empty = lambda f: F.array().cast("array<string>") if f.items else F.lit(f.default)
    own = lambda c, otherwise: F.col(c) if c in jobs.columns else otherwise
    made = {f.column: F.when(F.col("_structured_ask"), coerced(F.col("_structured_v"), f)).otherwise(own(f.column, empty(f))) for f in fields}
    made[error] = F.when(F.col("_structured_ask"), F.coalesce("_structured_error", F.lit(""))).otherwise(own(error, F.lit("")))
    return met.withColumns(made).select(*[c for c in jobs.columns if c not in made], *made), whole


def structure_postings(jobs: DataFrame, prompt: Column, client: Client, **options) -> tuple[DataFrame, DataFrame]:
    """Postings with the thirteen fields and llm_error."""
    return structured(jobs, prompt, POSTING, client, "llm_error", "jd_structuring", done="llm_content", **options)


def refine_tags(jobs: DataFrame, prompt: Column, client: Client, **options) -> tuple[DataFrame, DataFrame]:
    """Postings with the eight refined lists and deep_error; the lists are added to the tag columns, which are made where they lack."""
    out, cache = structured(jobs, prompt, REFINED, client, "deep_error", "tag_refinement", done="deep_hard", **options)
    cap = Field("", "", TAG_LENGTH, 100)
    have = lambda c: listed(F.coalesce(F.col(c), F.array().cast("array<string>")), cap) if c in jobs.columns else F.array().cast("array<string>")
    return out.withColumns({t: distinct_folded(F.concat(have(t), listed(F.concat(*deep), cap)), TAGS) for t, deep in REFINED_INTO.items()}), cache


def outline(texts: list[str]) -> list[str]:
    """An answer by rule, for work without a network: the text's words in each field's place, some lists as texts."""
    out = []
    for t in texts:
        w = t.split()
        out.append("```json\n" + json.dumps({"job_content": w[:12], "job_requirements": "，".join(w[4:20]), "industry": None, "job_type": w[-2:], "core_goal": " ".join(w[:9]), "degree_requirement": w[0] if w else "", "fresh_grad_friendly": "", "seniority_level": len(w), "must_have_skills": [[x] for x in w[:1]] + w[1:4], "tool_stack": {"a": 1}, "hard_skills": w[:30], "soft_skills": "；".join(w[:3]), "responsibilities": w[2:5]}, ensure_ascii=False) + "\n```")
    return out


def posting_prompt(jobs: DataFrame, columns: list[str], detail: str, most: int) -> Column:
    """Labelled lines of the columns that jobs has (lists joined), then the detail, cut to ``most`` characters."""
    kinds = dict(jobs.dtypes)
    text = lambda c: F.array_join(c, "，") if kinds[c].startswith("array") else safe(c)
    lines = [F.when(text(c) != "", F.concat(F.lit(f"[{c}]"), text(c))) for c in columns if c in kinds]
    return F.substring(F.concat_ws("\n", *lines, F.when(safe(detail) != "", F.concat(F.lit("[detail]"), safe(detail)))), 1, most)
