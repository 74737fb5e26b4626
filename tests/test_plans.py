"""Whole plans on a few postings."""

from pyspark.sql import functions as F

from tagloom.operators import model_calls, network, project
from tagloom.plans import postings
from tagloom.sources import store

JOB = "ordinal long, company string, title string, city string, detail string, degree string, experience string, detail_url string"
RULES = {"normalization": {}, "category_rules": {"产品类": ["产品经理"]}, "direction_rules": {"数据": ["SQL"]}}
DICTIONARY = {"hard": {"x": ["SQL", "Python", "Excel"]}, "soft": ["沟通"]}


def rows(spark):
    long = "岗位职责：数据分析 任职要求：熟练SQL，Python 沟通 " + "内容" * 40
    data = [(0, "星辰科技有限公司", "ai产品经理", "北京", long, "本科", "应届", "http://a"), (1, "星辰", "AI产品经理", "北京", long + "。", "本科", "应届", "http://b"), (2, "云图", "BI分析师", "上海", "SQL Excel", "", "3年以上", ""), (3, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, JOB)


def test_process_network_and_match(spark, tmp_path):
    out = postings.process(rows(spark), DICTIONARY, {}, RULES, client=model_calls.offline).cache()
    got = {r["ordinal"]: r for r in out.collect()}
    assert got[0]["company_norm"] == got[1]["company_norm"] == "星辰" and got[0]["title_norm"] == "AI产品经理"
    assert got[0]["duplicate_group_id"] == got[1]["duplicate_group_id"] == "SIM_0001" and got[0]["duplicate_keep"] != got[1]["duplicate_keep"]
    assert set(got[2]["final_hard_tags"]) == {"SQL", "Excel", "数据分析"} and got[3]["final_all_tags"] == [] and got[3]["company_norm"] == "未知公司"
    nodes, edges = postings.relations(out, "tech", least=1)
    assert ("SQL" in {r["id"] for r in nodes.collect()}) and edges.count() >= 1
    found = network.insight(out, nodes, edges, "direction", "final_hard_tags")
    assert found["overview"].first()["jobs"] == 4 and network.advice(found)["model"] == "fallback"
    for kind in network.TYPES:
        assert network.build(out, "tech", kind, least=1, threshold=0.1) is not None
    ranked = postings.recommend(out, "本科\nPython SQL 产品经理 应届 2025").collect()
    assert len(ranked) == 4 and {"SQL", "Python"} <= set(next(r for r in ranked if r["company_norm"] == "星辰")["matched_skills"])
    assert network.inspect_columns(out).filter("column_name = 'hard_tags'").first()["rows_with_tags"] == 3
    assert network.stop_words("a，b c;a") == ["a", "b", "c"]
    assert [r[0] for r in out.orderBy("ordinal").select(project.external_link(out)).collect()] == ["http://a", "http://b", "", ""]

    key = store.processing_key("1", rows(spark), {"near": True})
    assert key == store.processing_key("1", rows(spark).orderBy(F.desc("ordinal")), {"near": True}) != store.processing_key("2", rows(spark), {})
    assert store.processed(spark, str(tmp_path), key, lambda: rows(spark)).count() == 4
    assert store.processed(spark, str(tmp_path), key, lambda: 1 / 0).count() == 4 and store.forget(spark, str(tmp_path), key)
    docs = spark.createDataFrame([("resume", "r", "text", 2), ("project", "p", "text", 1)], "doc_type string, title string, text string, created_at int")
    once = store.ingest(spark.createDataFrame([], "doc_id string, doc_type string, title string, text string, created_at int"), docs)
    assert store.ingest(once, docs).count() == 2
