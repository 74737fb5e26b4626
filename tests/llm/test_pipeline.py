"""Each stage of the pipeline on a small corpus, its decisions followed through."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import quality, similar
from tagloom.llm.common import table


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, sf, "labels").collect()}
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(s.columns == columns for s in steps[:3])
    first, second, third = ([r["doc_id"] for r in s.collect()] for s in steps[:3])

    judged = {r["doc_id"]: r["_quality"]["keep"] for r in quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))[0].collect()}
    assert sorted(first) == sorted(d for d, keep in judged.items() if keep)
    good = [d for d, (q, _) in labels.items() if q]
    assert sum(d in set(first) for d in good) >= 0.95 * len(good)

    sets = {d: similar.shingles(texts[d]) for d in first}
    near = lambda a, b: similar.jaccard(sets[a], sets[b]) >= 0.8
    label = {d: d for d in first}
    for _ in first:
        new = {d: min(label[e] for e in first if near(d, e)) for d in first}
        if new == label:
            break
        label = new
    assert sorted(second) == sorted(set(label.values()))

    clean = [d for d in second if labels.get(d) == (1, 0)]
    toxic = [d for d in second if labels.get(d, (0, 0))[1]]
    assert sum(d in set(third) for d in clean) >= 0.95 * len(clean)
    assert len(toxic) < 3 or sum(d in set(third) for d in toxic) < len(toxic)

    tokens = {}
    for r in steps[3].collect():
        tokens.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for parts in tokens.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
    covered = {}
    for r in steps[3].collect():
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    total = {r["doc_id"]: r["doc_tokens"] for r in steps[3].collect()}
    assert covered == {d: n * third.count(d) for d, n in total.items()}


def test_empty(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_clashing_names_and_missing_ids(spark, tmp_path):
    """Null and repeated ids and columns named like the stages' own: no stage fails, no unlinked row goes."""
    sf = "/root/testdata/sf0.001"
    extra = ["_lang", "_limit", "_quality", "_turn", "_kept", "_key", "_row", "_id", "_copy", "_copies", "_also", "rate", "tokens", "_p0"]
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 7).otherwise(F.col("doc_id")))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = docs.count()
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[5:] == extra and docs.count() >= 0.8 * before, name
        assert {tuple(r) for r in docs.select(*extra).distinct().collect()} == {tuple(range(len(extra)))}
    assert corpus_pipeline.STAGES[3][1](spark, docs, sf).select(F.sum("length")).first()[0] > 0


def test_without_labels_all_documents_stay_in_the_mixture(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    labels = table(spark, sf, "labels").limit(0)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, sf, "documents")
    assert corpus_pipeline.mixed(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.clean_only(spark, docs, str(tmp_path)).count() == docs.count()
