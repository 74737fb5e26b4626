"""The registered queries of this package and their oracle SQL, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, counts, langid, licenses, lm, mixing, packing, phrases, quality, rolling, sharding, simhash, topk
from .common import table
from .license_texts import TEMPLATES


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, with a checksum of their ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 greatest integer inner products of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24; slot is its position there, virtual_slot its slot of the map."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and verdict."""
    judged, _ = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return judged.select("doc_id", "lang", "_quality.symbols", "_quality.perplexity", "_quality.threshold", "_quality.keep")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under a model of nine tenths of the documents."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return lm.score(table(spark, sf_dir, "documents"), held_out)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license template found in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), TEMPLATES)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found to every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic, junk or clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean").alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate in a mixture of all tokens with little junk and toxic text."""
    labelled = domains_of(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labelled, {"clean": 0.97, "toxic": 0.02, "junk": 0.01})


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and tokens."""
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of two thirds of the documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = langid.identify(docs, "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: 60 * floor((doc_id + h mod 1000) / 6), in whole numbers; null beyond 64 bits.
EVENT_S = "try_multiply(10L, try_subtract(try_add(doc_id, crc32(cast(cast(doc_id as string) as binary)) % 1000), pmod(try_add(doc_id, crc32(cast(cast(doc_id as string) as binary)) % 1000), 6L)))"


def op12_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's source had in the half hour and the day before it."""
    found = rolling.features(table(spark, sf_dir, "documents"), "source", EVENT_S, "char_length(text)", "lang", [1800, 86400], [(1, 2), (99, 100)], ["doc_id"])
    return found.select("doc_id", F.col("window").alias("window_s"), F.col("_time").alias("event_s"), F.col("n").alias("n_events"), F.col("sum").alias("sum_chars"), F.col("labels").alias("n_langs"), F.col("q0").alias("median_chars"), F.col("q1").alias("high_chars"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's 2000 most cohesive phrases of two and three words."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_top_k": op2_top_k,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_licenses": op7_licenses,
    "op8_nearest": op8_nearest,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_language_id": op11_language_id,
    "op12_rolling": op12_rolling,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op2_top_k": """WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score, row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.v, e.v) DESC, e.vec_id) AS rank
FROM e q JOIN e ON q.r <> e.r AND len(q.v) = len(e.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM s WHERE rank <= 5""",
    "op12_rolling": """WITH crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, lang, source, length(text) AS chars, doc_id + xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
 lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) % 1000 AS x FROM documents, crcs),
e AS (SELECT *, 10 * (x - ((x % 6) + 6) % 6) AS event_s FROM d),
w AS (SELECT doc_id, 1800 AS window_s, event_s, count(*) OVER v AS n_events, sum(chars) OVER v AS s, list(lang) OVER v AS ls, list_sort(list_filter(list(chars) OVER v, lambda y: y IS NOT NULL)) AS m FROM e
 WINDOW v AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 1800 PRECEDING AND 1 PRECEDING)
 UNION ALL SELECT doc_id, 86400, event_s, count(*) OVER v, sum(chars) OVER v, list(lang) OVER v, list_sort(list_filter(list(chars) OVER v, lambda y: y IS NOT NULL)) FROM e
 WINDOW v AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING))
SELECT doc_id, window_s::BIGINT AS window_s, event_s, CASE WHEN event_s IS NULL THEN 0 ELSE n_events END AS n_events, CASE WHEN event_s IS NULL THEN 0 ELSE coalesce(s, 0)::BIGINT END AS sum_chars,
 CASE WHEN event_s IS NULL THEN 0 ELSE coalesce(len(list_distinct(ls)), 0) END AS n_langs, CASE WHEN event_s IS NOT NULL AND len(m) > 0 THEN m[(len(m) + 1) // 2] END AS median_chars,
 CASE WHEN event_s IS NOT NULL AND len(m) > 0 THEN m[(99 * len(m) + 99) // 100] END AS high_chars FROM w""",
    "op13_collocations": r"""WITH w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 4) t(k)) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM g WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, cut, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
 JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:cut], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(p[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
}
