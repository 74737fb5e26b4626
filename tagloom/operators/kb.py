"""The knowledge base: documents, chunks, vectors and evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_any, cosine, safe
from .stats import first_of
from .upsert import replaced


def document_id(kind: str, name: str, text: str) -> Column:
    """The kind and 12 hex digits of kind, name and the first 1,000 characters."""
    return F.concat(F.col(kind), F.lit("_"), F.substring(F.md5(F.concat_ws("|", kind, name, F.substring(text, 1, 1000))), 1, 12))


def windows(c: Column | str, size: int = 900, overlap: int = 120, least: int = 80) -> Column:
    """Fixed windows of a text, those under ``least`` characters left out."""
    text = safe(c)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(max(size - overlap, 1)))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i, F.lit(size)))), lambda w: F.length(w) >= least)


def packed_paragraphs(text: str, size: int = 500, overlap: int = 80) -> list[str]:
    """Paragraphs packed greedily up to ``size``; a longer one is cut into sliding windows on its own."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        nonlocal held, length
        if held:
            out.append("\n\n".join(held))
        held, length = [], 0

    for part in (p.strip() for p in text.split("\n\n")):
        if not part:
            continue
        if len(part) > size:
            flush()
            step = max(1, size - overlap)
            out.extend(w for i in range(0, len(part), step) if (w := part[i : i + size].strip()))
        elif held and length + 2 + len(part) > size:
            flush()
            held, length = [part], len(part)
        else:
            length += len(part) + (2 if held else 0)
            held.append(part)
    flush()
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def paragraphs(texts: pd.Series) -> pd.Series:
    return texts.map(packed_paragraphs)


#: Document kinds that are chunk kinds too, and keywords of the others in order.
KINDS = ("project", "internship", "competition", "research", "resume")
KIND_WORDS = {"project": ["项目", "平台", "系统", "算法"], "internship": ["实习", "公司", "部门"], "competition": ["竞赛", "比赛", "获奖"], "research": ["论文", "研究", "课题"]}


def chunk_kind(kind: Column, text: Column) -> Column:
    out = F.lit("other")
    for name, words in reversed(list(KIND_WORDS.items())):
        out = F.when(contains_any(text, words, fold=False), name).otherwise(out)
    return F.when(kind.isin(*KINDS), kind).otherwise(out)


def chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kind: str | None = None) -> DataFrame:
    """doc_id, chunk_id, chunk_index (from 1), chunk_type, chunk_text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.col(kind) if kind else F.lit("")).alias("_kind"), F.posexplode(paragraphs(F.coalesce(text, F.lit("")))).alias("i", "chunk_text"))
    return rows.select("doc_id", F.format_string("%s_chunk_%03d", F.col("doc_id").cast("string"), F.col("i") + 1).alias("chunk_id"), (F.col("i") + 1).alias("chunk_index"), chunk_kind(F.col("_kind"), F.col("chunk_text")).alias("chunk_type"), "chunk_text")


def search(store: DataFrame, query: list[float], order: str, vector: str = "embedding", top: int = 5) -> DataFrame:
    """The rows with the greatest cosine to a query vector, rounded to 4 digits."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return store.withColumn("score", F.bround(cosine(F.col(vector).cast("array<double>"), q), 4)).orderBy(F.desc("score"), order).limit(top)


def by_kind(found: DataFrame, kind: str, item: str, rank: str, most: int = 1000) -> DataFrame:
    """The first ``most`` items of each kind, in rank order."""
    return first_of(found, kind, item, rank, most, "items")


def evidence(store: DataFrame, query: list[float], order: str, kind: str = "chunk_type", item: str = "chunk_text", vector: str = "embedding", top: int = 6) -> tuple[DataFrame, DataFrame]:
    """The chunks nearest to a query vector, best first, and their items by kind."""
    best = search(store, query, order, vector, top)
    ranked = best.withColumn("_place", F.row_number().over(Window.orderBy(F.desc("score"), order)))  # top rows
    return best, first_of(ranked, kind, item, "_place", top, "items")


def evidence_for_job(job: DataFrame, store: DataFrame, embed, columns: dict[str, str], **options) -> tuple[str, DataFrame, DataFrame]:
    """The retrieval query of a posting (the one row of job), the chunks nearest to it and their items by kind.

    ``columns`` names the posting's title, company, city, experience, degree, skills and wants;
    ``embed`` turns texts into vectors. A blank query finds nothing.
    """
    row = job.select(job_query(**columns).alias("q")).first()
    text = row["q"] if row else ""
    best, grouped = evidence(store, list(map(float, embed([text])[0])) if text else [0.0], **options)
    return text, (best if text else best.limit(0)), (grouped if text else grouped.limit(0))


def upsert_vectors(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new chunks in place of old ones; new rows without a vector are left out."""
    return replaced(store, new.filter(F.size(F.coalesce("embedding", F.array())) > 0), ["chunk_id"])


def job_query(title: str, company: str, city: str, experience: str, degree: str, skills: str, wants: str) -> Column:
    """A posting as one retrieval query: fields, at most 10 skills and 8 requirements."""
    part = lambda c, n, m: F.array_join(F.slice(F.slice(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), 1, m), 1, n), "、")
    items = F.array(*[safe(c) for c in (title, company, city, experience, degree)], part(skills, 10, 15), part(wants, 8, 12))
    return F.array_join(F.filter(items, lambda x: x != ""), "；")


def embedded(rows: DataFrame, text: str, embed, dim_check: bool = True) -> DataFrame:
    """rows with embedding, from a client function called in batches of texts on the workers."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([list(map(float, v)) for v in embed(part.tolist())], index=part.index, dtype=object)

    return rows.withColumn("embedding", run(F.coalesce(text, F.lit(""))))
