"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model (see ngrams) is fitted on all trusted documents, equal texts once, and no n-gram is
left out; counts, continuation counts and the joins of the smoothing are sharded by n-gram.
Documents are stored in blocks, in a table bucketed by block, so their texts are not shuffled.
A block sends its distinct n-grams to the shards and gets their log-probabilities back; no
worker and no driver holds the model. Every language has two quantiles of log-perplexity over all
of its documents. A document is rejected beyond the upper quantile plus ``fence`` times the
spread between the two, and never below the ``trusted_quantile`` of its language's trusted
documents. A short text's perplexity scatters more, so the threshold is raised by a factor
exp(``allowance`` / sqrt(symbols)).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import bucketed, cut, dropped, free, saved, ship
from .lm import grown
from .ngrams import Asked, by_shard, learned, packed, resolved, totals

#: Thresholds of more languages than this are joined without broadcast.
LANGUAGES = 10_000
#: Bytes of text of a block, at least and at most, and for which there is a shard.
LEAST, MOST, SHARD = 1 << 20, 10 << 20, 1 << 24


PACKED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of all that are labelled good and never bad."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")


def blocked(docs: DataFrame, size: int) -> DataFrame:
    """block, ids, keys (digests of the texts), rows (all columns, packed): docs in the order they are read, in blocks of about ``size`` bytes of text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, held, keys, n = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
                for b in held:
                    stream.write_batch(b)
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            ends = pa.array([0, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (ids, pa.array(keys, pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | turn], pa.int64()), *lists, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "ids", "keys", "rows"])

        for batch in batches:
            at = 0
            for i, t in enumerate(batch.column("text")):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                keys.append(hashlib.md5(data).digest())
                n += len(data) + 1
                if n >= size:
                    held.append(batch.slice(at, i + 1 - at))
                    yield out()
                    turn, held, keys, n, at = turn + 1, [], [], 0, i + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield out()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, keys array<binary>, rows binary")


def unpacked(rows: pa.Table) -> pa.Table:
    """The documents of a block."""
    return pa.ipc.open_stream(rows["rows"][0].as_buffer()).read_all()


def texts_of(docs: pa.Table) -> Iterator[str]:
    return (t.as_py() or "" for t in docs["text"])


def with_perplexity(docs: DataFrame, labels: DataFrame, name: str, order: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, stored, with a struct column: symbols and perplexity of each text; a null text is empty."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
    size = min(max(LEAST, total // (4 * docs.sparkSession.sparkContext.defaultParallelism)), MOST)
    shards = max(16, total // SHARD)
    blocks, stored = bucketed(blocked(docs, size), "block", max(1, total // size))
    try:
        light = blocks.select("block", F.posexplode(F.arrays_zip("ids", "keys")).alias("place", "own")).select("block", "place", F.col("own.ids").alias("doc_id"), F.col("own.keys").alias("key"))
        first = light.join(trusted(labels), "doc_id").groupBy("key").agg(F.min(F.struct("block", "place")).alias("first")).select("first.*")
        chosen = first.groupBy("block").agg(F.collect_list("place").alias("places"))
        rows = blocks.select("block", "rows")

        def learning(one: pa.Table, places: pa.Table) -> pa.Table:
            some = unpacked(one).take(places["places"][0].values) if one.num_rows and places.num_rows else pa.table({"text": []})
            each, n = learned(texts_of(some), order, False)
            return pa.Table.from_pandas(packed(one["block"][0].as_py() if one.num_rows else 0, each, shards, n), schema=PACKED, preserve_index=False)

        def asking(one: pa.Table) -> pa.Table:
            return pa.Table.from_pandas(packed(one["block"][0].as_py(), Asked.of(texts_of(unpacked(one)), order, False).each, shards), preserve_index=False)

        def measured(one: pa.Table, answers: pa.Table) -> pa.Table:
            own = unpacked(one)
            asked = Asked.of(texts_of(own), order, False)
            by, _ = by_shard(asked.each, shards)
            answers = answers.sort_by("shard")
            values = np.empty(len(by), np.float32)
            values[by] = np.concatenate([grown(v.as_py()).astype(np.uint32).view(np.float32) for v in answers["values"]])
            symbols = asked.ends - asked.starts
            new = pa.StructArray.from_arrays([pa.array(symbols, pa.int64()), pa.array(10 ** (-asked.totals(values.astype(float)) / symbols), pa.float64())], ["symbols", "perplexity"])
            return own.select(keep).append_column(name, new)

        taught = rows.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(learning, "shard long, block long, keys binary, n binary")
        counts = saved(totals(taught))
        answers = resolved(rows.groupBy("block").applyInArrow(asking, "shard long, block long, keys binary"), counts, order, shards)
        schema = StructType([*docs.select(keep).schema.fields, StructField(name, StructType([StructField("symbols", LongType()), StructField("perplexity", DoubleType())]))])
        return saved(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(measured, schema))
    finally:
        dropped(stored, docs.sparkSession)


def thresholds(scored: DataFrame, good: DataFrame, low: float, high: float, fence: float, trusted_quantile: float) -> DataFrame:
    """lang, threshold: from columns lang and perplexity of all documents, and of the trusted ones."""
    log = F.ln("perplexity")
    spread = scored.groupBy("lang").agg(F.percentile_approx(log, [low, high], 10_000).alias("q"))
    clean = good.groupBy("lang").agg(F.percentile_approx(log, trusted_quantile, 10_000).alias("t"))
    both = spread.join(clean, spread["lang"].eqNullSafe(clean["lang"]), "left").select(spread["lang"], "q", "t")
    return both.select("lang", F.exp(F.greatest(F.col("q")[1] + fence * (F.col("q")[1] - F.col("q")[0]), F.col("t"))).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, order: int = 6, low: float = 0.25, high: float = 0.75, fence: float = 1.5, trusted_quantile: float = 0.97, allowance: float = 1.0, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs (or its columns ``keep``) with a struct column: symbols, perplexity, threshold, keep; and that column's name.

    docs needs doc_id, text and lang; its other columns stay as they are, whatever their
    names; the new one is _quality, or with more underlines if docs has that. A null text is
    empty: its perplexity is that of an end symbol alone. A null language is a language of
    its own. Null and repeated rows are rows like others; labels that are null, or disagree,
    trust nothing. Without labels all symbols are equally likely and all documents are kept.
    An empty table gives no rows. The result is stored once, so no text is scored twice.
    """
    columns, name = docs.columns if keep is None else keep, free(docs, "_quality")
    needed = list(dict.fromkeys([*columns, "doc_id", "lang"]))  # texts are stored again only for a caller that wants them back
    scored = with_perplexity(docs.select(*dict.fromkeys([*needed, "text"])), labels, name, order, needed)
    light = scored.select("doc_id", "lang", F.col(name)["perplexity"].alias("perplexity"))
    limits = cut(thresholds(light, light.join(trusted(labels), "doc_id"), low, high, fence, trusted_quantile))
    lang, limit = free(scored, "_lang"), free(scored, "_limit")
    limits = limits.toDF(lang, limit)
    if limits.count() <= LANGUAGES:
        limits = F.broadcast(limits)
    of = scored.join(limits, F.col("lang").eqNullSafe(F.col(lang)), "left")
    own = F.col(name)
    most = F.col(limit) * F.exp(allowance / F.sqrt(own["symbols"]))
    inner = F.struct(own["symbols"].alias("symbols"), own["perplexity"].alias("perplexity"), most.alias("threshold"), (own["perplexity"] <= most).alias("keep"))
    return of.select(*[F.col(c) for c in columns], inner.alias(name)), name
