"""A corpus pipeline: quality classifier, near-duplicates, mixing, packing.

Each stage takes documents and returns a DataFrame, which is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import mixing, packing, quality, similar
from tagloom.llm.common import cut, free, saved, shared_dir, ship, table
from tagloom.llm.queries import domains_of
from tagloom.plans.sieve import sieved


def clean_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    judged, verdict = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter(F.col(verdict)["keep"]).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8), that with the smallest doc_id.

    Rows are decided on by their texts, so different texts that share a doc_id, or lack one,
    are groups of their own. A row without doc_id stays only where its group has no other;
    equal rows count once.
    """
    grouped = cut(similar.groups(ship(spark) and docs))
    rows = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"), F.count("*").alias("rows")
    light = saved(docs.groupBy(similar.text_key().alias("key")).agg(*rows).join(grouped.hint("shuffle_hash"), "key"))
    least = light.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id", "key")).alias("least"), F.sum("rows").alias("rows"))
    least = saved(least)
    # a row that is all of its group stays, and is not shuffled
    several = saved(light.join(least.filter("rows > 1"), "root", "left_semi").select("key"))
    open_, alone = sieved(docs, similar.text_key(), several)
    own_id, own_key, row = (free(docs, c) for c in ("_kept", "_key", "_row"))
    kept = least.select(F.col("least.doc_id").alias(own_id), F.col("least.key").alias(own_key))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (similar.text_key() == F.col(own_key))
    own = open_.join(kept.hint("shuffle_hash"), same, "left_semi")
    # summed up before the shuffle, however many rows are the same
    one = own.groupBy("doc_id", similar.text_key().alias(own_key)).agg(F.min(F.struct(*docs.columns)).alias(row))
    return one.select(*[F.col(row)[c].alias(c) for c in docs.columns]).union(alone)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as a mixture of clean text alone has them.

    Targets are all expected clean tokens, and none of toxic and junk text. A document that is
    more likely clean than not has a rate of one or more: the fit may only raise it, by what
    it takes to make good for clean tokens expected in documents left out. A labelled document
    has its label as its chance. Without labels all documents stay.
    """
    light, domains = mixing.prepared(docs, domains_of(table(spark, sf_dir, "labels")), also=similar.text_key())
    if light is None or "clean" not in domains:
        return docs
    clean = F.col(f"_p{domains.index('clean')}")
    held = light.agg(F.sum(F.col("tokens") * clean)).first()[0] or 0.0
    rated = mixing.rates(light, len(domains), [held if d == "clean" else 0.0 for d in domains], least=F.when(clean >= 0.5, 1.0).otherwise(0.0))
    own_id, own_key, number, copy = (free(docs, c) for c in ("_id", "_key", "_copies", "_copy"))
    copies = mixing.finished(rated, domains).filter("copies > 0").groupBy(F.col("doc_id").alias(own_id), F.col("_also").alias(own_key)).agg(F.max("copies").alias(number))
    own = docs.join(copies.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own_id)) & (similar.text_key() == F.col(own_key)))
    return own.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(number)))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", clean_only),
    ("near-duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Perplexities, components and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
