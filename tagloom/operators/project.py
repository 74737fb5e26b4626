"""Schemas, filters and look-ups over postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COLUMNS, REQUIRED_COLUMNS
from ..functions.text import safe, snippet
from .upsert import first_of

TAG_COLUMNS = {"all": "all_tags", "hard": "hard_tags", "soft": "soft_tags", "duty": "duty_tags", "scene": "scene_tags"}
FINAL_COLUMNS = {k: f"final_{v}" for k, v in TAG_COLUMNS.items()}
MODEL_COLUMNS = {"hard": "llm_must", "duty": "llm_content"}
SOURCES = {"dictionary": TAG_COLUMNS, "final": FINAL_COLUMNS, "model": MODEL_COLUMNS}


def english(df: DataFrame) -> DataFrame:
    """Captured columns under their English names."""
    return df.withColumnsRenamed({k: v for k, v in COLUMNS.items() if k in df.columns})


def original(df: DataFrame) -> DataFrame:
    """English columns under their captured names."""
    return df.withColumnsRenamed({v: k for k, v in COLUMNS.items() if v in df.columns})


def missing_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def validate(df: DataFrame, required: list[str] = REQUIRED_COLUMNS, strict: bool = False) -> tuple[bool, list[str]]:
    lack = missing_columns(df, required)
    if lack and strict:
        raise ValueError(f"columns lack: {', '.join(lack)}")
    return not lack, lack


def ensure_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with typed defaults for columns that lack: "" for strings, [] for arrays, else null."""
    default = lambda t: F.lit("") if t == "string" else F.array().cast(t) if t.startswith("array") else F.lit(None).cast(t)
    return df.withColumns({c: default(t) for c, t in types.items() if c not in df.columns})


def basic_clean(df: DataFrame, order: str, deduplicate: bool = True) -> DataFrame:
    """Missing columns and nulls as "", one row an address (the first), captured_at as a time, job_id from the order.

    The address is detail_url if any row has one, else page_url; blank addresses are one.
    """
    out = ensure_columns(df, {c: "string" for c in REQUIRED_COLUMNS})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in out.dtypes if t == "string" or c in REQUIRED_COLUMNS})
    if deduplicate:
        some = out.agg(F.max(safe("detail_url") != "").alias("d"), F.max(safe("page_url") != "").alias("p")).first()
        key = "detail_url" if some["d"] else "page_url" if some["p"] else None
        out = first_of(out, [key], order) if key else out
    out = assign_job_id(out, order) if "job_id" in out.columns else out.withColumn("job_id", F.col(order).cast("string"))
    return out.withColumn("captured_at", F.try_to_timestamp("captured_at"))


def assign_job_id(df: DataFrame, order: str) -> DataFrame:
    """job_id where blank: job_ and the row's order."""
    have = safe("job_id") if "job_id" in df.columns else F.lit("")
    return df.withColumn("job_id", F.when(have == "", F.concat(F.lit("job_"), F.col(order).cast("string"))).otherwise(have))


def in_lists(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Rows within all chosen lists; an empty list chooses all."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]).isin(kv[1])) if kv[1] else d, chosen.items(), df)


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def search(df: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Rows any of whose columns matches a regular expression, case ignored; a blank one matches all."""
    if not pattern.strip():
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).rlike(f"(?i){pattern}") for c in columns]))


def with_tag(df: DataFrame, tags: str, tag: str) -> DataFrame:
    return df.filter(F.array_contains(tags, tag))


def tag_lookup(df: DataFrame, tags: str, tag: str, detail: str, window: int = 50) -> DataFrame:
    """Rows with a tag, and the tag's first place in the text."""
    return with_tag(df, tags, tag).withColumn("context", snippet(F.coalesce(detail, F.lit("")), tag, window))


def tag_column(kind: str, source: str = "dictionary", strict: bool = False) -> str | None:
    """The column of a tag kind from a source; unknown kinds have the dictionary's whole list, or an error if strict."""
    if source == "model":
        return MODEL_COLUMNS.get(kind)
    known = SOURCES[source]
    if kind not in known and strict:
        raise ValueError(f"unknown kind {kind}")
    return known.get(kind, known["all"])


def available_tag_column(df: DataFrame, kind: str, source: str) -> str | None:
    """The column if any row has tags in it; for final tags else the dictionary's."""
    c = tag_column(kind, source)
    if c in df.columns and not df.filter(F.size(c) > 0).isEmpty():
        return c
    other = tag_column(kind)
    return other if source == "final" and other in df.columns else None


def first_known(columns: list[str], unknown: tuple[str, ...] = ("nan", "none", "未知", "未知公司", "未知职位", "未知类别")) -> Column:
    """The first column that is not blank or unknown."""
    return F.coalesce(*[F.when((safe(c) != "") & ~F.lower(safe(c)).isin(*unknown), safe(c)) for c in columns])


def jobs_of_label(df: DataFrame, label: str, role: str, title: str, parts: list[str], tags: str) -> DataFrame:
    """Rows of a node label: of that role, else that title (or its first 18 characters), else of all its known parts, else with that tag.

    One aggregation tells which of the branches has rows.
    """
    titled = (F.col(title) == label) | (F.substring(title, 1, 18) == label)
    pieces = [p.strip() for p in label.split("-") if p.strip()]
    each = [reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) == p for c in parts]) for p in pieces] if len(pieces) > 1 and parts else []
    hits = df.agg(F.count_if(F.col(role) == label).alias("role"), F.count_if(titled).alias("title"), *[F.count_if(c).alias(f"p{i}") for i, c in enumerate(each)]).first()
    if hits["role"]:
        return df.filter(F.col(role) == label)
    if hits["title"]:
        return df.filter(titled)
    known = [c for i, c in enumerate(each) if hits[f"p{i}"]]
    if known:
        return df.filter(reduce(lambda a, b: a & b, known))
    return with_tag(df, tags, label)


def jobs_of_edge(df: DataFrame, a: str, b: str, role: str, tags: str) -> DataFrame:
    """Rows of an edge: with either end as role if there are any, else with both tags."""
    by_role = df.filter(F.col(role).isin(a, b))
    return by_role if not by_role.isEmpty() else df.filter(F.array_contains(tags, a) & F.array_contains(tags, b))


def jobs_of_company(df: DataFrame, company: str, name: str, tags: str | None = None, tag: str | None = None, unknown: str = "未知公司") -> DataFrame:
    own = df.filter(F.when(safe(company) == "", unknown).otherwise(safe(company)) == name)
    return with_tag(own, tags, tag) if tag else own


def percent(c: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f%%", c * 100)


def preview(df: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """The columns that exist, and the first rows."""
    out = df.select([c for c in columns if c in df.columns])
    return out.limit(n) if n else out


def fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value: named columns of each row as rows, lists joined, blanks left out."""
    types = dict(df.dtypes)
    text = lambda c: F.array_join(c, "，") if types[c].startswith("array") else safe(c)
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in columns if c in types]))).filter("value <> ''")


def merged_tags(df: DataFrame, sources: list[str], target: str, stop: list[str] = (), too_common: list[str] = ()) -> DataFrame:
    """The union of tag columns in order, without stop and too common tags."""
    drop = [*stop, *too_common]
    union = F.array_distinct(F.concat(F.array().cast("array<string>"), *[F.coalesce(c, F.array().cast("array<string>")) for c in sources if c in df.columns]))
    return df.withColumn(target, F.filter(union, lambda x: ~x.isin(drop)) if drop else union)


#: Columns that may hold a posting's address, in order.
LINKS = ["详情链接", "岗位链接", "职位链接", "url", "URL", "link", "Link"]


def external_link(df: DataFrame) -> Column:
    """The first filled address column's value, else ""."""
    have = [c for c in ("detail_url", *LINKS) if c in df.columns]
    return F.coalesce(*[F.when(safe(c) != "", safe(c)) for c in have], F.lit(""))


def importable(df: DataFrame, identity: list[str] = ("title", "company", "city", "detail", "detail_url", "page_url")) -> tuple[bool, list[str]]:
    """Whether any identity column is there, and which required ones lack."""
    return any(c in df.columns for c in identity), missing_columns(df)
