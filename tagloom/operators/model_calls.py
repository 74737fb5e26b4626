"""Model calls over rows: a cache is joined first, and only what it lacks goes to the client.

A client is any picklable function from a list of texts to a list of JSON answers. Without
a network, ``offline`` answers by rule, the same each time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HARD_SPECS, SOFT_SPECS
from ..functions.text import loose_json, safe

Client = Callable[[list[str]], list[str]]
SKILLS = "hard_skills array<string>, soft_skills array<string>"


def cache_key(task: str, model: str, version: str, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(task), F.lit(model), F.lit(version), text))


def posting_text(columns: list[str], detail: str, most: int = 3000) -> Column:
    """A posting as labelled lines, then its text, cut to ``most`` characters: the client's input and the cache's key."""
    lines = [F.when(safe(c) != "", F.concat(F.lit(f"[{c}]"), safe(c))) for c in columns]
    return F.substring(F.concat_ws("\n", *lines, safe(detail)), 1, most)


def offline(texts: list[str]) -> list[str]:
    """Skills named in the text."""
    find = lambda t, specs: [k for k, ps in specs.items() if any(p.lower() in t.lower() for p in ps)]
    return [json.dumps({"hard_skills": find(t, HARD_SPECS), "soft_skills": find(t, SOFT_SPECS)}, ensure_ascii=False) for t in texts]


def answered(rows: DataFrame, key: str, prompt: str, client: Client, batch: int = 16) -> DataFrame:
    """key, payload for each distinct key; an answer that fails is an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "payload": client(part[prompt].tolist())})

    return rows.groupBy(key).agg(F.min(prompt).alias(prompt)).mapInPandas(run, f"{key} string, payload string")


def enriched(jobs: DataFrame, cache: DataFrame, prompt: Column, schema: str, client: Client, task: str, model: str = "offline", version: str = "1") -> tuple[DataFrame, DataFrame]:
    """jobs with a struct column answer, and the cache with what was asked now."""
    keyed = jobs.withColumns({"_prompt": prompt}).withColumn("_key", cache_key(task, model, version, F.col("_prompt")))
    have = cache.select(F.col("key").alias("_key"), "payload")
    lack = keyed.select("_key", "_prompt").join(have, "_key", "left_anti")
    new = answered(lack, "_key", "_prompt", client)
    whole = have.unionByName(new)
    out = keyed.join(whole, "_key", "left").withColumn("answer", loose_json("payload", schema)).drop("_key", "_prompt", "payload")
    return out, whole.withColumnRenamed("_key", "key")
