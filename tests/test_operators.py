"""Operators on inline rows."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions.text import repaired as tx_repaired
from tagloom.functions.text import section as tx_section
from tagloom.operators import communities, dedup, evidence, graph, kb, match, model_calls, network, normalize, project, resume, stats, structured, tags, textgroups, textjoin, upsert
from tagloom.plans.lineage import saved

JOB = "ordinal long, job_id string, company string, title string, city string, detail string, captured_at string"


def test_names(spark):
    df = spark.createDataFrame([(c,) for c in ["北京 星辰科技有限公司（上海）", "有限公司", "上海电气", "云图智能", None, "深圳蓝海｜招聘"]], "c string")
    got = [r[0] for r in df.select(normalize.company("c", normalize.alias_map({"云图": ["云图智能"]}))).collect()]
    assert got == ["北京星辰", "有限", "上海电气", "云图", "未知公司", "深圳蓝海"]
    df = spark.createDataFrame([(c,) for c in ["急聘 ai 产品经理（双休）", "LLM产品经理", "BI分析师", "数据分析工程师", "", "NLP算法工程师"]], "t string")
    assert [r[0] for r in df.select(normalize.title("t")).collect()] == ["AI产品经理", "大模型产品经理", "数据分析师", "数据分析工程师", "未知职位", "大模型算法工程师"]
    rules = {"normalization": {}, "category_rules": {"产品类": ["产品经理"]}, "direction_rules": {"AI": ["ai"]}}
    out = normalize.apply(spark.createDataFrame([("x公司", "产品经理")], "company string, title string"), {}, rules).first()
    assert (out["company_norm"], out["category"], out["direction"]) == ("x", "产品类", "通用方向")


def test_names_are_worked_out_once_a_row(spark):
    df = spark.range(1).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("c"))
    for name, mark in ((normalize.title, "诚聘"), (normalize.company, "【.*?】")):
        assert 1 <= df.select(name("c"))._jdf.queryExecution().optimizedPlan().toString().count(mark) <= 2  # a lambda is printed twice


def test_dictionary_and_rules(spark):
    df = spark.createDataFrame([("use SQL and C++ 数据分析",), ("mysql",), (None,)], "d string")
    words = tags.leaf_words({"a": ["SQL", "C++"], "b": {"c": ["数据分析", "SQL"]}})
    assert words == ["SQL", "C++", "数据分析"]
    got = [r[0] for r in df.select(tags.found(F.coalesce("d", F.lit("")), words, {"C++": "Cpp"})).collect()]
    assert got == [["数据分析", "Cpp", "SQL"], [], []]
    out = tags.apply_rules(spark.createDataFrame([("岗位职责：智能体搭建 任职要求：Python 加分项：飞书", ["python"])], "detail string, hard_tags array<string>"), "detail").first()
    assert out["rule_must"] == ["Python"] and out["rule_duties"] == ["智能体搭建与优化"] and out["rule_nice"] == ["飞书"] and out["rule_goal"] == "智能体搭建与优化"
    assert [t.lower() for t in out["hard_tags"]].count("python") == 1


def test_stats_denominators(spark):
    df = spark.createDataFrame([("1", ["a", "b", "a"], "x"), ("1", ["a"], "x"), ("2", [], "x"), ("3", None, None)], "job_id string, tags array<string>, g string")
    got = {r["tag"]: (r["freq"], r["covered_jobs"], r["total_jobs"]) for r in stats.tag_stats(df, "tags").collect()}
    assert got == {"a": (2, 1, 3), "b": (1, 1, 3)}
    assert {r["tag"]: r["freq"] for r in stats.raw_keyword_stats(df, "tags").collect()} == {"a": 3, "b": 1}
    assert {(r["g"], r["total_jobs"]) for r in stats.tag_stats(df, "tags", group="g").collect()} == {("x", 2)}
    assert stats.best_tag_column(df, ["none", "tags"]) == "tags" and stats.best_tag_column(df, ["none"]) is None


def test_evidence(spark):
    rows = [(1, "1", "c1", "SQL岗", "x", "任职要求：熟练SQL", ""), (2, "2", "c2", "b", "x", "了解 mysql 优先", ""), (3, "3", "", "b", "x", "", "")]
    jobs = spark.createDataFrame(rows, JOB).withColumn("tags", F.array(F.lit("SQL")))
    out = evidence.tag_evidence(jobs, "tags", "detail", "title", "company", "city").first()
    assert (out["freq"], out["jobs"], out["companies"], out["roles"]) == (3, 3, 2, 1)
    assert out["req_rate"] == pytest.approx(1 / 3) and out["title_rate"] == pytest.approx(1 / 3) and out["evidence_rate"] == pytest.approx(1 / 3)
    assert out["importance"] == round(32 + 18 * 2 / 3 + 12 + 20 / 3 + 5 / 3 + 1, 1)
    df = spark.createDataFrame([("应届可投，培养",), ("3年以上",), ("1-2年",), ("",)], "t string")
    assert [r[0] for r in df.select(evidence.fresh_score(F.col("t"))).collect()] == [92, 8, 42, 50]


def test_keep_and_exact(spark):
    rows = [(1, "a", "c", "t", "x", "long text", "2024-01-01"), (2, "b", "c", "t", "x", "s", "2024-02-01"), (3, "c", "c", "u", "x", "s", "bad"), (4, "d", "c", "u", "x", "longer", None), (5, "e", None, "", "x", "", None)]
    jobs = spark.createDataFrame(rows, JOB)
    kept = lambda s: {r["ordinal"] for r in dedup.exact(jobs, ["company", "title"], s).filter("duplicate_keep").collect()}
    assert kept("latest_then_longest") == {2, 4, 5} and kept("longest_detail") == {1, 4, 5} and kept("latest_scrape_time") == {2, 4, 5}
    out = dedup.exact(jobs, ["company", "title"])
    assert {r["duplicate_group_id"] for r in out.collect()} == {"", "EXACT_0001", "EXACT_0002"}
    s = dedup.summary(out).first()
    assert (s["total"], s["groups"], s["duplicates"], s["kept"]) == (5, 2, 2, 3)
    assert dedup.summary(dedup.exact(jobs.limit(0), ["company"])).first()["total"] == 0


def plain_similarity(texts):
    grams = [[t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)] for t in (" ".join(t.lower().split()) for t in texts)]
    df = {g: sum(g in set(x) for x in grams) for x in grams for g in x}
    vecs = []
    for x in grams:
        v = {g: x.count(g) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g in x}
        n = math.sqrt(sum(a * a for a in v.values())) or 1
        vecs.append({g: a / n for g, a in v.items()})
    return lambda i, j: sum(a * vecs[j].get(g, 0) for g, a in vecs[i].items())


def test_similar_components(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefgh "), 80)) for _ in range(4)]
    texts = [b for b in base] + [b[:70] + "x" * k for b in base for k in (6, 9)] + ["", "", "q"]
    rows = [(i, str(i), "c", "t", "x", t, None) for i, t in enumerate(texts)]
    out = {r["ordinal"]: r for r in dedup.similar(spark.createDataFrame(rows, JOB), "detail", ["company", "title"], 0.8).collect()}
    own = [i for i, t in enumerate(texts) if t]
    sim = plain_similarity(texts)
    label = {i: i for i in own}
    for _ in own:
        for i, j in itertools.combinations(own, 2):
            if sim(i, j) >= 0.8:
                label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i in own:
        groups.setdefault(label[i], []).append(i)
    want = {tuple(g) for g in groups.values() if len(g) > 1}
    got = {}
    for i, r in out.items():
        if r["duplicate_group_id"]:
            got.setdefault(r["duplicate_group_id"], []).append(i)
    assert {tuple(sorted(g)) for g in got.values()} == want and want
    for g in want:
        assert [out[i]["is_duplicate"] for i in g] == [not out[i]["duplicate_keep"] for i in g] and sum(out[i]["duplicate_keep"] for i in g) == 1
        assert all(abs(out[i]["max_similarity_in_group"] - max(sim(a, b) for a, b in itertools.combinations(g, 2))) < 1e-9 for i in g)
    assert all(r["duplicate_keep"] and not r["is_duplicate"] for r in out.values() if not r["duplicate_group_id"])


def test_similar_pairs_over_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(12)) for _ in range(6)]
    texts = ["".join(c if rng.random() > 0.04 else "z" for c in b) for b in base for _ in range(12)]
    monkeypatch.setattr(textjoin, "TILE", 3)
    rows = spark.createDataFrame([(7, len(texts), i, 1, t) for i, t in enumerate(texts)], "block long, n long, rep long, m long, text string")
    sim = plain_similarity(texts)
    for threshold in (0.6,):
        want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sim(i, j) >= threshold}
        got = {(r["a"], r["b"]): r["similarity"] for r in textjoin.similar_pairs(rows, threshold, entries=500).collect()}
        assert set(got) == want and all(abs(s - sim(*p)) < 1e-9 for p, s in got.items())
    assert not textjoin.similar_pairs(rows.limit(0), 0.8).collect()


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_similar_groups_over_tiles(spark, monkeypatch, threshold):
    """One block in many tiles beside a small one: groups and their greatest similarity as of all pairs, and no row for each pair."""
    rng = np.random.default_rng(5)
    base = [" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(12)) for _ in range(6)] + ["\U0001f600\U0001f601 und \U0001f602" * 4]
    texts = ["".join(c if rng.random() > rate else "z" for c in b) for b in base for rate in [0.01, 0.04] * 6] + ["x", "yz"]
    rows = spark.createDataFrame([(k, len(texts), 1000 * k + i, 1, t) for k, n in ((0, len(texts)), (8, 9)) for i, t in enumerate(texts[:n])], "block long, n long, rep long, m long, text string")
    monkeypatch.setattr(textgroups, "TEXTS", 10)
    got = textgroups.similar_groups(rows, threshold).collect()
    sim, label = plain_similarity(texts), list(range(len(texts)))
    links = {p: sim(*p) for p in itertools.combinations(range(len(texts)), 2) if sim(*p) >= threshold}
    for low, other in [(label, links), (mine := list(range(len(texts))), [(r["a"], r["b"]) for r in got if r["a"] < 1000])]:
        for a, b in other:
            low[:] = [min(low[a], low[b]) if x in (low[a], low[b]) else x for x in low]
    assert mine == label and len(set(label)) < len(texts) - 3
    for root in {label[a] for a, _ in links}:
        assert max(r["similarity"] for r in got if r["a"] < 1000 and label[r["a"]] == root) == pytest.approx(max(s for (a, _), s in links.items() if label[a] == root), abs=1e-9)
    assert any(r["a"] >= 8000 for r in got) and not any((r["a"] >= 8000) != (r["b"] >= 8000) for r in got)
    assert not textgroups.similar_groups(rows.limit(0), 0.8).collect()


def test_alike_texts_make_no_row_for_each_pair(spark):
    """What a block of texts that are all alike sends on grows with the texts, not with their pairs."""
    texts = ["the same advertisement again and again, " * 20 + f"number {i:03}" for i in range(300)]
    jobs = spark.createDataFrame([(0, 300, i, 1, t) for i, t in enumerate(texts)], "block long, n long, rep long, m long, text string")
    assert 299 <= dedup.similar_groups(jobs, 0.8).count() <= 600


def sent(spark, run):
    """Bytes of all shuffles of what run does."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    last = max(stages(), default=-1)
    run()
    return sum(n for at, n in stages().items() if at > last)


def test_tiles_are_not_shuffled_for_their_pairs(spark, monkeypatch):
    """What a block of many tiles shuffles is its texts, not its pairs of tiles."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdef"), 2000)) for _ in range(300)]
    rows = saved(spark.createDataFrame([(0, 300, i, 1, t) for i, t in enumerate(texts)], "block long, n long, rep long, m long, text string"))
    monkeypatch.setattr(textgroups, "TEXTS", 10)
    assert 0 < sent(spark, lambda: textgroups.similar_groups(rows, 0.9).collect()) < 2 * sum(map(len, texts))


def test_texts_are_not_shuffled_to_find_copies(spark):
    """Near-duplicates shuffle each text at most once: into its tile."""
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefghijklmnop"), 2000)) for _ in range(200)]
    texts += texts[:10]
    rows = [(i, str(i), "c", "t", "x", t, None) for i, t in enumerate(texts)]
    jobs = saved(spark.createDataFrame(rows, JOB).repartition(8))
    found = {}
    size = sent(spark, lambda: found.update({r["ordinal"]: r["duplicate_group_id"] for r in dedup.similar(jobs, "detail", ["company", "title"]).select("ordinal", "duplicate_group_id").collect()}))
    assert 0 < size < 1.2 * sum(map(len, texts))
    assert all(bool(found[i]) == (i < 10 or i >= 200) for i in range(210))


def test_groups_with_copies_are_linked_and_have_similarity_one(spark, monkeypatch):
    """Large groups of several tiles are joined by one link; texts that only one text of the other tile is like still join."""
    rng = np.random.default_rng(8)
    base = [" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(12)) for _ in range(3)]
    texts = ["".join(c if rng.random() > rate else "z" for c in b) for b in base for rate in [0.01, 0.03, 0.06] * 9]
    texts += [texts[0]] * 3 + [texts[40]] * 2
    rows = [(i, str(i), "c", "t", "x", t, None) for i, t in enumerate(texts)]
    monkeypatch.setattr(textgroups, "TEXTS", 9)
    out = {r["ordinal"]: r for r in dedup.similar(spark.createDataFrame(rows, JOB), "detail", ["company", "title"], 0.8).collect()}
    sim, label = plain_similarity(texts), list(range(len(texts)))
    links = [p for p in itertools.combinations(range(len(texts)), 2) if sim(*p) >= 0.8]
    for a, b in links:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    groups = {root: out[root]["duplicate_group_id"] for root in set(label)}
    assert len({g for g in groups.values() if g}) == len([g for g in groups.values() if g]) > 1
    for i, root in enumerate(label):
        assert out[i]["duplicate_group_id"] == groups[root] and bool(groups[root]) == (label.count(root) > 1)
        if label.count(root) > 1:
            assert out[i]["max_similarity_in_group"] == pytest.approx(max(sim(*p) for p in links if label[p[0]] == root), abs=1e-9)


def test_similar_takes_nulls_ties_and_copies(spark):
    rows = [(i, str(i), "c" if i % 2 else None, "", "x", t, None) for i, t in enumerate(["same text here", "same text here", "Same  text here", "same text here", None, "", "a", "a"])]
    jobs = spark.createDataFrame(rows, JOB).withColumns({"n": F.lit(1), "block": F.lit(2), "rep": F.lit(3), "root": F.lit(4), "digest": F.lit(5)})
    out = dedup.similar(jobs, "detail", ["company", "title"])
    assert out.columns[: len(jobs.columns)] == jobs.columns
    got = {r["ordinal"]: (r["duplicate_group_id"], r["duplicate_keep"], r["max_similarity_in_group"]) for r in out.collect()}
    assert got == {0: ("SIM_0001", False, 1.0), 2: ("SIM_0001", True, 1.0), 1: ("SIM_0002", True, 1.0), 3: ("SIM_0002", False, 1.0), **{i: ("", True, 0.0) for i in range(4, 8)}}
    assert dedup.similar(jobs.limit(0), "detail", ["company", "title"]).count() == 0


def test_graph(spark):
    nodes = spark.createDataFrame([(x, 1, 1, 0.5) for x in "abcdef"], "id string, count long, coverage_jobs long, coverage double")
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 1), ("a", "c", 2), ("d", "e", 1)], "src string, dst string, weight long")
    got = {r["id"]: r["community"] for r in graph.connected(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert {r["id"]: r["community"] for r in graph.propagated(nodes, edges).collect()}["f"] == "f"
    s = graph.summary(nodes, edges).first()
    assert tuple(s) == (6, 4, 1.33, 3, 0.2667)
    imp = {r["id"]: (r["degree"], r["weighted_degree"], r["centrality"]) for r in graph.importance(nodes, edges).collect()}
    assert imp["a"] == (2, 7.0, 0.4) and imp["f"] == (0, 0.0, 0.0)
    assert [r["id"] for r in graph.neighbours(edges, "a").collect()] == ["b", "c"]
    own, among = graph.ego(nodes, edges, "a")
    assert {r["id"] for r in own.collect()} == {"a", "b", "c"} and among.count() == 3
    own, _ = graph.edge_neighbourhood(nodes, edges, "a", "b")
    assert {r["id"] for r in own.collect()} == {"a", "b", "c"}
    kept, among = graph.filtered(nodes, edges, least=2)
    assert {r["id"] for r in kept.collect()} == {"a", "b", "c"} and among.count() == 2
    assert {r["id"]: r["role"] for r in graph.highlighted(nodes, edges, ["d"]).collect()} == {"a": "dim", "b": "dim", "c": "dim", "d": "focus", "e": "neighbour", "f": "dim"}
    one = nodes.filter("id = 'a'")
    assert graph.importance(one, edges.limit(0)).first()["centrality"] == 1.0


def test_cooccurrence_works_out_jobs_once(spark):
    """With ids that are shared or lack, and blank and repeated tags."""
    rows = [(1, ["a", "b", "a", ""]), (1, ["b", "c"]), (2, ["a", "b"]), (None, ["a", "c", None]), (None, ["a", "c"]), (3, None), (4, [])]
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    jobs = spark.createDataFrame(rows, "job_id long, tags array<string>").coalesce(1).mapInArrow(passed, "job_id long, tags array<string>")
    nodes, edges = graph.cooccurrence(jobs, "tags", top=3)
    got = {r["id"]: (r["count"], r["coverage_jobs"], round(r["coverage"], 9)) for r in nodes.collect()}
    assert got == {"a": (4, 2, round(2 / 7, 9)), "b": (3, 2, round(2 / 7, 9)), "c": (3, 1, round(1 / 7, 9))}
    assert {tuple(r) for r in edges.collect()} == {("a", "b", 2), ("a", "c", 2)}
    assert seen.value == len(rows)


def test_match(spark):
    jobs = spark.createDataFrame([(1, ["SQL", "Java"], "AI产品", "", "本科", "3年以上", "北京"), (2, [], "x", "", "", "", ""), (3, ["R"], "x", "", "博士", "应届", "上海")], "ordinal long, skills array<string>, title_norm string, category string, degree string, experience string, city string")
    out = {r["ordinal"]: r for r in match.match(jobs, {"hard_skills": ["sql", "PowerBI"], "roles": ["产品"], "degree": "硕士", "cities": ["北京"]}, ["skills"], []).collect()}
    parts = lambda r: tuple(r[k] for k in ("match_hard", "match_soft", "match_direction", "match_degree", "match_experience", "match_city", "match_fresh"))
    assert parts(out[1]) == (15, 10, 14, 10, 8, 5, 5)
    assert parts(out[2]) == (30, 10, 6, 8, 10, 1, 6) and parts(out[3])[3:6] == (4, 15, 1)
    assert out[1]["matched_skills"] == ["SQL"] and out[1]["missing_skills"] == ["Java"] and out[1]["match_total"] == sum(parts(out[1]))


def test_upserts(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, n long, v string")
    new = spark.createDataFrame([("b", 4, 1.0), ("c", 5, 2.0), ("c", 6, 3.0)], "k string, n long, w double")
    got = lambda m: {(r["k"], r["n"]) for r in upsert.merge(base, new, m, "k", "n").collect()}
    assert got("merge_update") == {("a", 2), ("b", 4), ("c", 6)} and got("append_new") == {("a", 2), ("b", 3), ("c", 6)} and got("overwrite") == {("b", 4), ("c", 6)}
    assert {r["k"] for r in upsert.deleted(base, "k", "a").collect()} == {"b"}
    pages = spark.createDataFrame([("http://d", "p", "t", "c", "x", "d"), (" ", "p", "t", "c", "x", "d"), (None, None, "t", "c", "x", "d"), ("", "", "t ", "c", "x", "d")], "detail_url string, page_url string, title string, company string, city string, detail string")
    keys = [r[0] for r in pages.select(upsert.row_key(pages)).collect()]
    assert keys[:2] == ["url:http://d", "url:p"] and keys[2] == keys[3] and keys[2].startswith("hash:")


def test_projections(spark):
    df = spark.createDataFrame([(0, "u", "t1", "2024-01-01"), (1, "u", "t2", "x"), (2, None, "t3", None), (3, "", "t4", None)], "ordinal long, detail_url string, title string, captured_at string")
    out = project.basic_clean(df, "ordinal").orderBy("ordinal").collect()
    assert [r["title"] for r in out] == ["t1", "t3"] and out[0]["captured_at"] is not None and out[1]["job_id"] == "2"
    assert project.validate(df) == (False, [c for c in project.REQUIRED_COLUMNS if c not in df.columns])
    jobs = spark.createDataFrame([("r", "some title", ["x"]), ("s", "other", ["r", "y"])], "role string, title string, tags array<string>")
    hits = lambda label: [r["title"] for r in project.jobs_of_label(jobs, label, "role", "title", ["role", "title"], "tags").collect()]
    assert hits("r") == ["some title"] and hits("other") == ["other"] and hits("y") == ["other"] and hits("s-other-zz") == ["other"]
    assert project.search(jobs, "SOME.*", ["title"]).count() == 1 and project.search(jobs, " ", ["title"]).count() == 2


def test_chunks_and_vectors(spark):
    text = "a" * 300 + "\n\n" + "b" * 198 + "\n\n" + "c" * 1200 + "\n\nd"
    parts = kb.packed_paragraphs(text)
    assert parts[0] == "a" * 300 + "\n\n" + "b" * 198 and [len(p) for p in parts[1:4]] == [500, 500, 360] and parts[-1] == "d"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [r["chunk_id"] for r in kb.chunks(df).orderBy("chunk_index").collect()][:2] == ["1_chunk_001", "1_chunk_002"]
    assert [len(w) for w in df.filter("doc_id = 1").select(kb.windows("text")).first()[0]] == [900, 900, len(text.strip()) - 1560]


def test_resume(spark):
    text = "张三\n教育经历\n某某大学 本科 2021-2025\n项目经历\n用Python做推荐系统\n专业：计算机科学"
    r = resume.fields(spark.createDataFrame([(text,), (None,)], "t string"), "t").select("resume.*", resume.profile().alias("p")).collect()
    assert r[0]["candidate_name"] == "张三" and r[0]["degree"] == "本科" and r[0]["graduation_year"] == "2025" and r[0]["education"][0]["school"] == "某某大学"
    assert r[0]["projects"] == ["用Python做推荐系统；专业：计算机科学"] and r[0]["p"]["hard_skills"] == ["Python"] and r[1]["candidate_name"] == ""
    assert r[0]["major"] == "计算机科学" and r[1]["education"] == [] and r[1]["seniority_level"] == "应届" and r[1]["p"]["projects"] == []


def test_resume_sections_and_fallbacks(spark):
    texts = [
        "李四\n工作经历：字节科技有限公司 2021-2023\n负责数据分析\n- 推进落地\n2020 某银行\n教育背景\n北大学院 硕士 2019\n软件工程 2016 2019\n项目经验\nSQL 报表平台\n课题一\n技能\nPython, Excel\n3年 上海",
        "某某公司 运营助理\n做了一个推荐系统\n院系：信息学院",
        "\n".join(["项目经历"] + [f"2020 项{i}" for i in range(12)] + ["x" * 300]),
        "行" * 50_000,
    ]
    got = [r["resume"] for r in resume.fields(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "i int, t string, _lines int"), "t").orderBy("i").collect()]
    a, b, c, d = got
    assert a["internships"] == ["字节科技有限公司 2021-2023；负责数据分析；推进落地", "2020 某银行"] and a["projects"] == ["SQL 报表平台", "课题一"] and a["candidate_name"] == "李四"
    assert [tuple(e) for e in a["education"]] == [("北大学院", "硕士", "", "2019", ""), ("", "硕士", "软件工程", "2016", "2019")] and (a["degree"], a["graduation_year"], a["seniority_level"]) == ("硕士", "2023", "初级")
    assert a["hard_skills"] == ["Python", "SQL", "Excel", "数据分析"] and a["target_cities"] == ["上海"] and a["soft_skills"] == ["逻辑思维", "执行力", "责任心"] and a["target_roles"] == ["数据分析", "数据分析师", "商业分析"]
    assert b["projects"] == ["做了一个推荐系统"] and b["internships"] == ["某某公司 运营助理"] and b["major"] == "信息学院" and b["target_roles"] == ["运营", "增长运营", "内容运营"]
    assert c["projects"] == [f"2020 项{i}" for i in range(8)] and d["candidate_name"] == "" and d["projects"] == []


def test_resume_by_model(spark):
    df = spark.createDataFrame([(1, "王五\n本科 2025 SQL"), (2, "王五\n本科 2025 SQL"), (3, None), (4, "bad")], "i int, t string")
    def client(texts):
        if texts == ["bad"]:
            raise RuntimeError("no")
        return [json.dumps({"candidate_name": " 王五五 ", "basic_info": {"degree": 5, "target_roles": "产品，产品,运营"}, "skills": {"hard_skills": ["Go", "sql", {"a": 1}]}, "education": ["x", {"school": "S", "end_year": 2024}], "strengths": None, "projects": ["p" * 60]})] * len(texts)

    out, cache = resume.by_model(df, "t", client)
    rows = {r["i"]: r["resume"] for r in out.collect()}
    assert rows[1] == rows[2] and rows[1]["candidate_name"] == "王五五" and rows[1]["degree"] == "5" and rows[1]["target_roles"] == ["产品", "运营", "数据分析师", "数据分析", "商业分析"]
    assert rows[1]["hard_skills"][:2] == ["Go", "sql"] and [tuple(e) for e in rows[1]["education"]] == [("S", "", "", "", "2024")] and rows[1]["graduation_year"] == "2025" and rows[1]["projects"] == []
    assert rows[3]["candidate_name"] == "" and rows[4]["hard_skills"] == [] and {r["error"] for r in cache.collect()} == {"", "no"} and cache.count() == 3
    again, more = resume.by_model(df, "t", lambda t: 1 / 0, spark.createDataFrame(cache.collect(), cache.schema))
    assert {r["i"]: r["resume"] for r in again.collect()} == rows and more.count() == 3


def test_structured_postings(spark):
    answers = {
        "a": '```json\n{"job_content": ["- x ", "X", "", null, "' + "y" * 41 + '", 5], "industry": "甲，乙；甲,丙,丁", "core_goal": "' + "g" * 30 + '", "fresh_grad_friendly": " ", "tool_stack": {"k": 1}}\n```',
        "b": "no json", "c": '{"job_content": []}', "d": 'text {"must_have_skills": "Go"} more',
    }

    def client(texts):
        if texts[0] == "e":
            raise RuntimeError("down")
        return [answers[t] for t in texts]

    jobs = spark.createDataFrame([(i, t, ["old"] if i == 6 else None, 1) for i, t in enumerate(["a", "b", "c", "d", "e", None, "a"])], "i int, t string, llm_content array<string>, _key int")
    out, cache = structured.structure_postings(jobs, F.col("t"), client)
    got = {r["i"]: r.asDict() for r in out.collect()}
    assert got[0]["llm_content"] == ["x", "5"] and got[0]["llm_industry"] == ["甲", "乙", "丙"] and got[0]["llm_goal"] == "g" * 25 and got[0]["llm_fresh"] == "不明确" and got[0]["llm_tools"] == [] and got[0]["llm_error"] == ""
    assert [got[i]["llm_error"] for i in range(1, 7)] == ["empty_result", "empty_result", "", "down", "", ""] and got[3]["llm_must"] == ["Go"] and got[4]["llm_industry"] == ["未知"]
    assert got[6]["llm_content"] == ["old"] and got[6]["llm_industry"] == [] and {r["key"] for r in cache.collect()} and cache.count() == 6 and got[0]["_key"] == 1
    kept = spark.createDataFrame(cache.collect(), cache.schema)
    again, _ = structured.structure_postings(jobs, F.col("t"), lambda t: 1 / 0, cache=kept)
    assert {r["i"]: r.asDict() for r in again.collect()} == got
    late, _ = structured.structure_postings(jobs, F.col("t"), client, fallback=lambda t: ['{"tool_stack": ["T"]}'], chosen=F.col("i") > 0, overwrite=True)
    rows = {r["i"]: r.asDict() for r in late.collect()}
    assert rows[0]["llm_content"] is None and rows[1]["llm_tools"] == ["T"] and rows[4]["llm_error"] == "fallback_used" and rows[6]["llm_content"] == ["x", "5"]
    assert structured.structure_postings(jobs.limit(0), F.col("t"), client)[0].count() == 0


def test_refined_tags(spark):
    jobs = spark.createDataFrame([("x", ["Go", "go", "a" * 50]), ("", None)], "t string, hard_tags array<string>")
    out, _ = structured.refine_tags(jobs, F.col("t"), lambda ts: ['{"hard_skills": ["GO", "Rust"], "tool_stack": "Git；Go", "job_type": ["T"], "industry_scenes": ["S"]}' for _ in ts])
    a, b = sorted(out.collect(), key=lambda r: r["t"], reverse=True)
    assert a["hard_tags"] == ["Go", "Rust", "Git"] and a["scene_tags"] == ["S", "T"] and a["deep_hard"] == ["GO", "Rust"] and a["soft_tags"] == [] and b["hard_tags"] == [] and b["deep_error"] == ""
    fused = tags.fuse(out, {"hard": ["hard_tags", "deep_tools", "absent"], "duty": ["deep_duty", "llm_goal"]}, {"hard": {"git": "Git tool"}})
    assert sorted(r["final_hard_tags"] for r in fused.collect()) == [[], ["Go", "Rust", "Git tool"]]


def test_communities(spark):
    rng = random.Random(4)
    groups = {g: [f"{g}{i}" for i in range(6)] for g in "abc"}
    edges = [(x, y, rng.randint(3, 9)) for g in groups.values() for x, y in itertools.combinations(g, 2) if rng.random() < 0.8]
    edges += [(rng.choice(groups[p]), rng.choice(groups[q]), 1) for p, q in itertools.combinations("abc", 2) for _ in range(4)]
    rows = edges + [(y, x, 1) for x, y, _ in edges[:3]] + [("a0", "a0", 50), (None, "a1", 3), ("a1", "b1", 0)]
    frame = spark.createDataFrame(rows, "src string, dst string, weight long")
    nodes = spark.createDataFrame([(n,) for g in groups.values() for n in g] + [("z",), ("z",)], "id string")
    members = communities.communities(nodes, frame)
    got = {r["id"]: r["community"] for r in members.collect()}
    assert len(got) == 19 and got["z"] == "z" and all(got[n] == g + "0" for g, ns in groups.items() for n in ns)
    w = {}
    for x, y, n in edges + [(y, x, 1) for x, y, _ in edges[:3]]:
        w[x, y] = w.get((x, y), 0) + n
        w[y, x] = w.get((y, x), 0) + n
    m2, k = sum(w.values()), {}
    for (x, _), n in w.items():
        k[x] = k.get(x, 0) + n

    def value(of):
        tot = {}
        for x, n in k.items():
            tot[of[x]] = tot.get(of[x], 0) + n
        return sum(n for (x, y), n in w.items() if of[x] == of[y]) / m2 - sum(t * t for t in tot.values()) / m2**2

    assert abs(communities.modularity(frame, members) - value(got)) < 1e-12
    assert all(value(got | {x: c}) <= value(got) + 1e-12 for x in k for c in set(got.values()))
    lone = {r["id"]: r["community"] for r in graph.propagated(nodes, frame.filter("weight > 0 and src is not null and src <> dst")).collect()}
    assert value(got) >= value(lone) - 1e-12
    assert {r["id"]: r["community"] for r in communities.communities(nodes, frame.limit(0)).collect()} == {n: n for n in got}
    assert communities.communities(nodes.limit(0), frame.limit(0)).count() == 0 and communities.modularity(frame.limit(0), members) == 0
    assert [(r["community"], r["size"], r["labels"]) for r in communities.summary(members, 2).collect()][0] == ("a0", 6, "a0、a1")


def test_model_cache(spark):
    jobs = spark.createDataFrame([("Python 数据分析",), ("飞书",), ("Python 数据分析",)], "detail string")
    none = spark.createDataFrame([], "key string, payload string")
    prompt = model_calls.posting_text([], "detail")
    out, cache = model_calls.enriched(jobs, none, prompt, model_calls.SKILLS, model_calls.offline, "skills")
    assert sorted(tuple(r["answer"]["hard_skills"]) for r in out.collect()) == [("Python", "数据分析"), ("Python", "数据分析"), ("飞书",)]
    assert cache.count() == 2

    def fail(texts):
        raise AssertionError("asked again")

    again, _ = model_calls.enriched(jobs, spark.createDataFrame(cache.collect(), cache.schema), prompt, model_calls.SKILLS, fail, "skills")
    assert again.count() == 3


def test_drawn_graphs(spark):
    nodes = spark.createDataFrame([("a", "A", "role", 3, 9.0), ("b", None, "tag", None, 1.0), ("c", "C", "x", 0, None)], "id string, label string, node_type string, count long, weighted_degree double")
    edges = spark.createDataFrame([("a", "b", 2, "r"), ("a", "c", 2, None), ("b", "c", 9, "s"), ("d", "e", 1, "t")], "src string, dst string, weight long, relation string")
    assert [tuple(r) for r in graph.neighbour_table(nodes, edges, "a").collect()] == [("b", 2, "r"), ("C", 2, "")] and graph.neighbour_table(nodes, edges, "zz").count() == 0
    got = {r["src"] + r["dst"]: (r["role"], round(r["width"], 6)) for r in graph.highlighted_edges(edges, ["a"]).collect()}
    assert got == {"ab": ("focus", 4.0), "ac": ("focus", 4.0), "bc": ("neighbour", 6.6), "de": ("dim", 1.0)}
    got = {r["src"] + r["dst"]: (r["role"], round(r["width"], 6)) for r in graph.highlighted_edges(edges, ["a", "b"]).collect()}
    assert got == {"ab": ("focus", 5.0), "ac": ("neighbour", 2.5), "bc": ("neighbour", 6.9), "de": ("dim", 1.0)}
    size = {r["id"]: (round(r["visual_size"], 4), r["level"]) for r in graph.drawn(nodes).collect()}
    assert size == {"a": (round(14 + math.log1p(3) * 7.2 + math.log1p(9) * 1.8, 4), 0), "b": (round(10 + math.log1p(1) * 1.6, 4), 1), "c": (10.0, 1)}


def test_diagnosis_and_columns(spark):
    rows = spark.createDataFrame([(["x"], [], "a、b", None, "t"), (None, ["y"], "nan", None, "t"), (["z"], None, "b", None, "")], "hard_tags array<string>, final_hard_tags array<string>, skill string, must string, detail string")
    got = {r["column_name"]: (r["rows_with_tags"], r["total_rows"], round(r["coverage"], 3), round(r["average"], 3)) for r in stats.diagnosis(rows).collect()}
    assert got == {"hard_tags": (2, 3, 0.667, 0.667), "final_hard_tags": (1, 3, 0.333, 0.333)}
    assert stats.diagnosis(rows.select("skill")).count() == 0 and stats.diagnosis(rows.limit(0)).agg(F.sum("rows_with_tags")).first()[0] == 0
    got = [(r["column_name"], r["filled_rows"], r["rows_with_tags"], r["distinct_tags"], r["tags"], r["sample"]) for r in network.inspect_columns(rows).collect()]
    assert got == [("hard_tags", 2, 2, 2, 2, "x"), ("skill", 2, 2, 2, 3, "a、b"), ("detail", 2, 2, 1, 2, "t"), ("final_hard_tags", 1, 1, 1, 1, "y"), ("must", 0, 0, 0, 0, "")]
    assert network.inspect_columns(rows, text_sources=False).count() == 4 and network.inspect_columns(rows.limit(0)).agg(F.sum("filled_rows")).first()[0] in (0, None)


def test_evidence_for_a_job(spark):
    store = spark.createDataFrame([(1, "p", "one", [1.0, 0.0]), (2, "q", "two", [0.9, 0.1]), (3, "p", "three", [0.0, 1.0]), (4, None, "four", None)], "id int, chunk_type string, chunk_text string, embedding array<double>")
    job = spark.createDataFrame([("Dev", "ACME", None, ["go", "go", "sql"])], "title string, company string, city string, skills array<string>")
    columns = {"title": "title", "company": "company", "city": "city", "experience": "city", "degree": "city", "skills": "skills", "wants": "skills"}
    text, best, grouped = kb.evidence_for_job(job, store, lambda texts: [[1.0, 0.0]], columns, order="id", top=3)
    assert text == "Dev；ACME；go、sql；go、sql" and [r["id"] for r in best.collect()] == [1, 2, 3] and {r["chunk_type"]: r["items"] for r in grouped.collect()} == {"p": ["one", "three"], "q": ["two"]}
    blank = job.select(*[F.lit(None).cast(t).alias(c) for c, t in job.dtypes])
    assert kb.evidence_for_job(blank, store, lambda texts: 1 / 0, columns, order="id")[1].count() == 0
    half = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    assert stats.first_of(half, "k", "id", "id", 3, "v").filter("k = 'hot'").first()["v"] == [0, 2, 4] and "collect_list" in stats.first_of(half, "k", "id", "id", 3, "v")._jdf.queryExecution().toString()


def test_orders(spark):
    rng = random.Random(9)
    rows = [(i, rng.sample(["go", "sql", "c", "r"], rng.randint(0, 4)), rng.choice(["应届", "3-5年", ""]), rng.choice(["上海", "北京"])) for i in range(60)]
    jobs = spark.createDataFrame(rows, "ordinal long, tags array<string>, experience string, city string").repartition(4)
    got = match.match(jobs, {"hard_skills": ["go", "sql"], "cities": ["上海"]}, ["tags"], []).collect()
    assert [r["ordinal"] for r in got] == [r["ordinal"] for r in sorted(got, key=lambda r: (-r["match_total"], -r["match_fresh"], r["ordinal"]))] and len({r["match_total"] for r in got}) > 3
    assert all(r["match_total"] == sum(r[c] for c in r.asDict() if c.startswith("match_") and c not in ("match_total", "match_level", "match_reason")) for r in got)
    counts = stats.value_counts(jobs, "city").collect()
    assert [tuple(r) for r in counts] == sorted(((c, sum(r[3] == c for r in rows)) for c in ("上海", "北京")), key=lambda x: (-x[1], x[0]))
    pairs = stats.pair_support(jobs, "tags", 1, 20).collect()
    want = sorted((-sum({a, b} <= set(r[1]) for r in rows), a, b) for a, b in itertools.combinations(sorted(["go", "sql", "c", "r"]), 2))
    assert [(-r["support"], r["a"], r["b"]) for r in pairs] == [w for w in want if w[0]]


def test_rule_patterns_are_searched_once_a_text(spark):
    """Sections are searched only for what the whole text holds, with the labels that each would have of its own."""
    texts = ["智能客服 fastGPT 岗位职责：节点管理，PYTHON 任职要求：学习 python 加分项：飞书 智能客服 我们提供：门店", "agent 企业微信", "", None, "任职要求：实战 岗位职责：客户引流 对接企业微信"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    out = tags.rule_profile(rows, "t", ("requirements",))
    assert {c for c in out.columns if not c.startswith("_rule_")} == {"i", "t", "_at_requirements"}
    assert out._jdf.queryExecution().analyzed().toString().count("contains(") <= 4
    sections = tags.SECTIONS
    parts = rows.select("i", tx_repaired("t").alias("s")).select("i", "s", *[tx_section(F.col("s"), *m).alias(k) for k, m in sections.items()])
    parts = {r["i"]: r for r in parts.collect()}
    held = lambda t, specs: [k for k, ps in specs.items() if any(p.lower() in t.lower() for p in ps)]
    for r in out.collect():
        p = parts[r["i"]]
        want, duty, more = p["requirements"] or p["s"], p["responsibilities"] or p["s"], " ".join(x for x in (p["bonus"], p["offer"], p["highlights"]) if x)
        assert r["_rule_hard"] == held(p["s"], tags.HARD_SPECS) and r["_rule_tools"] == held(p["s"], tags.TOOL_SPECS)
        assert r["_rule_must"] == held(want, tags.HARD_SPECS) and r["_rule_soft"] == held(want, tags.SOFT_SPECS)
        assert r["_rule_duties"] == held(duty, tags.DUTY_SPECS) and r["_rule_nice"] == held(more, tags.HARD_SPECS)
