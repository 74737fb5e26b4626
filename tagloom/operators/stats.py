"""Counts and coverage of tags, traits, columns and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import COVERAGE_ADVICE, COVERAGE_BANDS, DIAGNOSED
from ..functions.text import safe


def exploded(jobs: DataFrame, tags: str, *keep: str) -> DataFrame:
    """A row for each distinct non-blank tag of a row."""
    return jobs.select(*keep, F.explode(F.array_distinct(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: (x != "") & x.isNotNull()))).alias("tag"))


def tag_stats(jobs: DataFrame, tags: str, job_id: str = "job_id", group: str | None = None) -> DataFrame:
    """tag, freq, covered_jobs, total_jobs, coverage; with ``group``, by group (a null one is left out).

    Jobs without tags count in the total.
    """
    keys = [group] if group else []
    rows = exploded(jobs, tags, job_id, *keys)
    stats = rows.groupBy(*keys, "tag").agg(F.count("*").alias("freq"), F.countDistinct(job_id).alias("covered_jobs"))
    if group:
        total = jobs.filter(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(job_id).alias("total_jobs"))
        out = stats.join(total, group)
    else:
        out = stats.withColumn("total_jobs", F.lit(jobs.agg(F.countDistinct(job_id)).first()[0]).cast("long"))
    return out.withColumn("coverage", F.col("covered_jobs") / F.greatest("total_jobs", F.lit(1)))


def keyword_overview(jobs: DataFrame, columns: dict[str, str], job_id: str = "job_id") -> DataFrame:
    """tag_type, tag, freq, covered_jobs over several tag columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("tag_type"), F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))).alias("tags")) for k, c in columns.items()])
    rows = jobs.select(job_id, F.inline(pairs)).select(job_id, "tag_type", F.explode("tags").alias("tag")).filter("tag <> ''")
    return rows.groupBy("tag_type", "tag").agg(F.count("*").alias("freq"), F.countDistinct(job_id).alias("covered_jobs"))


def raw_keyword_stats(jobs: DataFrame, tags: str, job_id: str = "job_id") -> DataFrame:
    """tag, freq, covered_jobs; a tag that a row repeats counts each time."""
    rows = jobs.select(job_id, F.explode(tags).alias("tag")).filter("tag <> ''")
    return rows.groupBy("tag").agg(F.count("*").alias("freq"), F.countDistinct(job_id).alias("covered_jobs"))


def value_counts(df: DataFrame, column: str, top: int | None = None, unknown: str = "unknown") -> DataFrame:
    """value, n, most frequent first, ties by name."""
    out = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(top) if top else out


def shares(df: DataFrame, column: str) -> DataFrame:
    """value, n, share of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a value


def first_of(rows: DataFrame, group: str, value: str, order: str, n: int, name: str) -> DataFrame:
    """group and an array of its first ``n`` values in order (then by value): cut down before the shuffle, so no longer list is ever held."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, value))
    kept = rows.select(group, F.col(order).alias("_at"), F.col(value).alias("_value"), rank.alias("_rank")).filter(F.col("_rank") <= n)
    return kept.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_value"))), lambda x: x["_value"]).alias(name))


def mapping_table(df: DataFrame, norm: str, raw: str, job_id: str, order: str, link: str | None = None, first: int = 5) -> DataFrame:
    """norm, raw_names, jobs, samples (first distinct raw names joined), first link; by jobs."""
    seen = df.groupBy(norm, raw).agg(F.min(order).alias("_at"))
    names = seen.groupBy(norm).agg(F.count("*").alias("raw_names")).join(first_of(seen, norm, raw, "_at", first, "_first"), norm).select(norm, "raw_names", F.array_join("_first", "、").alias("samples"))
    extra = [F.min_by(link, F.when(safe(link) != "", F.col(order))).alias("link")] if link else []
    return df.groupBy(norm).agg(F.countDistinct(job_id).alias("jobs"), *extra).join(names, norm).orderBy(F.desc("jobs"), norm)


def trait_summary(rows: DataFrame, job_id: str = "job_id") -> DataFrame:
    """l1, jobs, hits."""
    return rows.groupBy("l1").agg(F.countDistinct(job_id).alias("jobs"), F.sum("hits").cast("long").alias("hits")).orderBy(F.desc("jobs"), F.desc("hits"), "l1")


def trait_pivot(rows: DataFrame, by: str, levels: list[str], job_id: str = "job_id", top: int | None = None) -> DataFrame:
    """``by`` against the named traits: distinct jobs, 0 where none; only the ``top`` by trait rows if given."""
    if top:
        best = rows.groupBy(by).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), by).limit(top)
        rows = rows.join(F.broadcast(best), by, "left_semi")  # top rows
    return rows.groupBy(by).pivot("l1", levels).agg(F.countDistinct(job_id)).na.fill(0, levels)


def signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, sum_hash, sum_square of all rows, whatever their order: whole 64-bit hashes added up, and their lower halves squared, so rows that repeat or change together show."""
    h = F.xxhash64(*columns)
    low = F.pmod(h, F.lit(1 << 31)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"), F.sum((low * low).cast("decimal(38,0)")).alias("sum_square"))


def column_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, rows_with_tags, total_rows, coverage, tags, in one pass; a column that lacks has zeros."""
    have = [c for c in columns if c in df.columns]
    one = [F.struct(F.lit(c).alias("column_name"), *( [F.count_if(F.size(F.coalesce(c, F.array())) > 0).alias("rows_with_tags"), F.sum(F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))).alias("tags")] if c in have else [F.lit(0).cast("long").alias("rows_with_tags"), F.lit(0).cast("long").alias("tags")])) for c in columns]
    out = df.agg(F.count("*").alias("total_rows"), F.array(*one).alias("_one")).select("total_rows", F.inline("_one"))
    return out.select("column_name", "rows_with_tags", "total_rows", (F.col("rows_with_tags") / F.greatest("total_rows", F.lit(1))).alias("coverage"), F.coalesce("tags", F.lit(0)).alias("tags"))


def diagnosis(df: DataFrame, fields: list[tuple[str, str, str]] = DIAGNOSED) -> DataFrame:
    """source, dimension, column_name, rows_with_tags, total_rows, coverage, advice of the fields that df has, in one pass; average is the mean coverage of the source's fields.

    A row has tags if its array is not empty; null arrays, and columns that hold no arrays, have none.
    """
    kinds = dict(df.dtypes)
    have = [(i, *f) for i, f in enumerate(fields) if f[2] in kinds]
    if not have:
        return df.sparkSession.createDataFrame([], "source string, dimension string, column_name string, rows_with_tags long, total_rows long, coverage double, average double, advice string")
    filled = lambda c: F.count_if(F.size(c) > 0) if kinds[c].startswith("array") else F.lit(0).cast("long")
    own = F.array(*[F.struct(F.lit(i).alias("_turn"), F.lit(s).alias("source"), F.lit(d).alias("dimension"), F.lit(c).alias("column_name"), F.col(f"_{i}").alias("rows_with_tags")) for i, s, d, c in have])
    rows = df.agg(F.count("*").alias("total_rows"), *[filled(c).alias(f"_{i}") for i, _, _, c in have]).select("total_rows", F.inline(own))
    c = F.col("coverage")
    advice = F.when(c < COVERAGE_BANDS[0], COVERAGE_ADVICE[0]).when(c < COVERAGE_BANDS[1], COVERAGE_ADVICE[1]).otherwise(COVERAGE_ADVICE[2])
    out = rows.withColumn("coverage", F.col("rows_with_tags") / F.greatest("total_rows", F.lit(1))).withColumn("average", F.avg("coverage").over(Window.partitionBy("source")))  # a row a field
    return out.orderBy("_turn").select("source", "dimension", "column_name", "rows_with_tags", "total_rows", "coverage", "average", advice.alias("advice"))


def best_tag_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The candidate with most rows that have tags, then most distinct tags; the first of equals."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        return None
    found = df.agg(*[F.count_if(F.size(F.coalesce(c, F.array())) > 0).alias(f"r{i}") for i, c in enumerate(have)]).first()
    distinct = {r["k"]: r["n"] for r in df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("tags")) for i, c in enumerate(have)]))).select("k", F.explode("tags").alias("tag")).groupBy("k").agg(F.countDistinct("tag").alias("n")).collect()}
    best = max(range(len(have)), key=lambda i: (found[f"r{i}"], distinct.get(i, 0), -i))
    return have[best] if found[f"r{best}"] else None


def high_coverage_tags(df: DataFrame, columns: list[str], row_id: str, threshold: float = 0.99) -> DataFrame:
    """tag, rows, coverage, columns of tags that at least ``threshold`` of all rows have in any of the columns."""
    total = df.count()
    pairs = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("tags")) for c in columns])
    rows = df.select(row_id, F.inline(pairs)).select(row_id, "source", F.explode("tags").alias("tag")).filter("tag <> ''")
    out = rows.groupBy("tag").agg(F.countDistinct(row_id).alias("rows"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("columns"))
    return out.withColumn("coverage", F.col("rows") / max(total, 1)).filter(F.col("coverage") >= threshold)


def dimension_overlap(df: DataFrame, dimensions: dict[str, str], row_id: str) -> DataFrame:
    """tag, dimensions (how many have it), names, rows: which tags are shared among dimensions."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(c).alias("tags")) for k, c in dimensions.items()])
    rows = df.select(row_id, F.inline(pairs)).select(row_id, "dim", F.explode("tags").alias("tag")).filter("tag <> ''")
    return rows.groupBy("tag").agg(F.countDistinct("dim").alias("dimensions"), F.array_join(F.array_sort(F.collect_set("dim")), ",").alias("names"), F.countDistinct(row_id).alias("rows"))


def top_by_dimension(df: DataFrame, dimensions: dict[str, str], row_id: str, top: int) -> DataFrame:
    """dim, rank, tag, n, rate: the most frequent tags of each dimension; the rate is of all rows."""
    total = df.count()
    pairs = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(c).alias("tags")) for k, c in dimensions.items()])
    rows = df.select(F.inline(pairs)).select("dim", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag <> ''")
    counts = rows.groupBy("dim", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "tag")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).withColumn("rate", F.col("n") / max(total, 1))


def pairs_of(tags: Column) -> Column:
    """All pairs (a < b) of a row's distinct tags, as structs."""
    t = F.array_sort(F.array_distinct(tags))
    return F.flatten(F.transform(t, lambda a, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pair_support(jobs: DataFrame, tags: str, least: int = 2, top: int | None = None, total: int | None = None) -> DataFrame:
    """a, b, support and rate (of all rows) of tag pairs, by support."""
    total = jobs.count() if total is None else total
    out = jobs.select(F.inline(pairs_of(F.col(tags)))).groupBy("a", "b").agg(F.count("*").alias("support")).filter(F.col("support") >= least)
    out = out.withColumn("rate", F.col("support") / max(total, 1)).orderBy(F.desc("support"), "a", "b")
    return out.limit(top) if top else out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
