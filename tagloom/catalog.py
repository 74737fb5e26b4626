"""The library's registered queries over the driver's tables, and their DuckDB twins.

The tables hold no postings, so these stand for them: an order with the distinct words of its
parts' names as tags (company: market segment, role: priority, city: nation), a document as a
posting's text (company: source, city: lang), an event as a capture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.constants import COVERAGE_ADVICE, DIAGNOSED, DUTY_SPECS, FRESH_NEGATIVE, FRESH_POSITIVE, HARD_SPECS, JOB_TYPE_SPECS, SCENE_SPECS, SECTIONS, SOFT_SPECS, TOOL_SPECS
from .operators import dedup, evidence, graph, kb, match, normalize, project, stats, tags, upsert
from .operators import communities as community
from .operators.network import inspect_columns
from .plans.lineage import saved, ship, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """job_id, tags, company, role, city: orders, those without lines too."""
    words = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.explode(F.split("p_name", " ")).alias("w"))
    tagged = words.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("w")).alias("tags"))
    customers = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: 25 rows
    own = table(spark, sf, "orders").join(tagged, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return own.select(F.col("o_orderkey").alias("job_id"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("c_mktsegment").alias("company"), F.col("o_orderpriority").alias("role"), F.col("n_name").alias("city"))


JOBS = """WITH words AS (SELECT l_orderkey, unnest(string_split(p_name, ' ')) AS w FROM lineitem JOIN part ON l_partkey = p_partkey),
tagged AS (SELECT l_orderkey, list_sort(list_distinct(list(w))) AS tags FROM words GROUP BY 1),
jobs AS (SELECT o_orderkey AS job_id, coalesce(tags, []) AS tags, c_mktsegment AS company, o_orderpriority AS role, n_name AS city
FROM orders LEFT JOIN tagged ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT job_id, company, role, city, unnest(tags) AS tag FROM jobs)"""


@query("tag_stats", JOBS + """ SELECT tag, count(*) AS freq, count(DISTINCT job_id) AS covered_jobs, (SELECT count(DISTINCT job_id) FROM jobs) AS total_jobs,
count(DISTINCT job_id) / (SELECT count(DISTINCT job_id) FROM jobs) AS coverage FROM t GROUP BY tag""")
def tag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tag_stats(jobs(spark, sf), "tags").orderBy(F.desc("covered_jobs"), F.desc("freq"), "tag")


@query("tag_stats_by_group", JOBS + """, n AS (SELECT company, count(DISTINCT job_id) AS total_jobs FROM jobs WHERE company IS NOT NULL GROUP BY 1)
SELECT company, tag, count(*) AS freq, count(DISTINCT job_id) AS covered_jobs, any_value(total_jobs) AS total_jobs, count(DISTINCT job_id) / any_value(total_jobs) AS coverage
FROM t JOIN n USING (company) GROUP BY company, tag""")
def tag_stats_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tag_stats(jobs(spark, sf), "tags", group="company").orderBy("company", F.desc("coverage"), F.desc("covered_jobs"), F.desc("freq"), "tag")


@query("keyword_overview", """WITH p AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS adjective, string_split(p_name, ' ')[2] AS noun, p_brand AS brand, p_type AS kind FROM part),
u AS (SELECT p_partkey, 'adjective' AS tag_type, adjective AS tag FROM p UNION ALL SELECT p_partkey, 'noun', noun FROM p UNION ALL SELECT p_partkey, 'brand', brand FROM p UNION ALL SELECT p_partkey, 'kind', kind FROM p)
SELECT tag_type, tag, count(*) AS freq, count(DISTINCT p_partkey) AS covered_jobs FROM u GROUP BY 1, 2""")
def keyword_overview(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("p_name", " ")
    parts = table(spark, sf, "part").select("p_partkey", F.array(w[0]).alias("a"), F.array(w[1]).alias("b"), F.array("p_brand").alias("c"), F.array("p_type").alias("d"))
    return stats.keyword_overview(parts, {"adjective": "a", "noun": "b", "brand": "c", "kind": "d"}, "p_partkey")


@query("raw_keyword_stats", """WITH w AS (SELECT l_orderkey, unnest(string_split(p_name, ' ')) AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT tag, count(*) AS freq, count(DISTINCT l_orderkey) AS covered_jobs FROM w GROUP BY 1""")
def raw_keyword_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.raw_keyword_stats(rows.select("l_orderkey", F.split("p_name", " ").alias("w")), "w", "l_orderkey")


@query("value_distribution_topk", "SELECT n_name AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def value_distribution_topk(spark: SparkSession, sf: str) -> DataFrame:
    return stats.value_counts(table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")), "n_name", 15)


@query("category_share", "SELECT c_mktsegment AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY 1")
def category_share(spark: SparkSession, sf: str) -> DataFrame:
    return stats.shares(table(spark, sf, "customer"), "c_mktsegment")


@query("company_mapping", """WITH s AS (SELECT n_name, s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT n_name, s_name, min(s_suppkey) AS pos FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY pos) AS k FROM d)
SELECT s.n_name, count(DISTINCT s.s_suppkey) AS jobs, (SELECT count(*) FROM d WHERE d.n_name = s.n_name) AS raw_names,
(SELECT string_agg(s_name, '、' ORDER BY k) FROM r WHERE r.n_name = s.n_name AND k <= 5) AS samples FROM s GROUP BY s.n_name""")
def company_mapping(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return stats.mapping_table(rows, "n_name", "s_name", "s_suppkey", "s_suppkey")


@query("global_filters", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')")
def global_filters(spark: SparkSession, sf: str) -> DataFrame:
    return project.in_lists(table(spark, sf, "documents"), {"lang": ["en", "de"], "source": ["src1", "src2", "src3"], "text": []}).select("doc_id", "lang", "source")


@query("detail_search", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed? under|released') OR regexp_matches(source, '(?i)licensed? under|released')")
def detail_search(spark: SparkSession, sf: str) -> DataFrame:
    return project.search(table(spark, sf, "documents"), "licensed? under|released", ["text", "source"]).select("doc_id")


@query("tag_lookup_context", """WITH p AS (SELECT doc_id, text, instr(lower(text), 'that') AS p FROM documents)
SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(p - 50, 1), p + 4 + 50 - greatest(p - 50, 1)) ELSE '' END AS context FROM p WHERE list_contains(string_split(lower(text), ' '), 'that')""")
def tag_lookup_context(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("words", F.split(F.lower("text"), " "))
    return project.tag_lookup(docs, "words", "that", "text", 50).select("doc_id", "context")


@query("text_normalize", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]+>', ' ', 'g'), 'https?://[^\s\x{00a0}\x{0085}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g'),
'[^\x{4e00}-\x{9fa5}a-zA-Z0-9+#.]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS norm FROM documents""")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.normalized("text").alias("norm"))


@query("region_normalize", """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '北京' WHEN 1 THEN '上海' WHEN 2 THEN '深圳' WHEN 3 THEN '苏州' ELSE replace(n_name, '_', '-') END AS city FROM nation""")
def region_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("北京市"), F.lit("上海·浦东"), F.lit("深圳-南山/广州"), F.lit("江苏苏州工业园"), F.col("n_name")), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", tx.region(raw).alias("city"))


@query("tokenize_filter", r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '<[^>]+>', ' ', 'g'), 'https?://[^\s\x{00a0}\x{0085}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g') AS text FROM documents),
n AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[^\x{4e00}-\x{9fa5}a-z0-9+#.]+', ' ', 'g'), ' '), ' ') AS w FROM c)
SELECT doc_id, len(list_filter(w, lambda x: len(x) >= 2 AND x NOT IN ('the', 'of', 'and'))) AS n FROM n""")
def tokenize_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.tokens("text", {"the", "of", "and"})).cast("long").alias("n"))


WORDS = ["the", "of", "and", "with", "that", "this", "not", "was", "une", "der"]
BOUND = "regexp_matches(lower(text), '(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])')"


@query("dictionary_tagging", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {BOUND.format(w=w)} THEN '{w}' END" for w in sorted([*WORDS, 'node.js'], key=lambda w: (-len(w), w))) + "], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def dictionary_tagging(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(tags.found(F.col("text"), [*WORDS, "node.js"]), ",").alias("tags"))


TRAITS = {"article": {"definite": ["the"], "indefinite": ["a"]}, "link": {"and": ["and"], "of": ["of", "with"]}}
COUNT = "len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x = '{w}'))"
TRAIT_SQL = "WITH r AS (" + " UNION ALL ".join(f"SELECT doc_id, source, lang, '{a}' AS l1, '{b}' AS l2, " + " + ".join(COUNT.format(w=w) for w in ws) + " AS hits FROM documents" for a, g in TRAITS.items() for b, ws in g.items()) + "), h AS (SELECT * FROM r WHERE hits > 0)"


def trait_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tags.traits(table(spark, sf, "documents"), TRAITS, "text", ["doc_id", "source", "lang"])


@query("trait_table", TRAIT_SQL + " SELECT doc_id, source, lang, l1, l2, hits::INTEGER AS hits FROM h")
def trait_table(spark: SparkSession, sf: str) -> DataFrame:
    return trait_rows(spark, sf)


@query("trait_summary", TRAIT_SQL + " SELECT l1, count(DISTINCT doc_id) AS jobs, sum(hits)::BIGINT AS hits FROM h GROUP BY 1")
def trait_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.trait_summary(trait_rows(spark, sf), "doc_id")


@query("trait_pivot_region", TRAIT_SQL + " SELECT lang, count(DISTINCT CASE WHEN l1 = 'article' THEN doc_id END) AS article, count(DISTINCT CASE WHEN l1 = 'link' THEN doc_id END) AS link FROM h GROUP BY 1")
def trait_pivot_region(spark: SparkSession, sf: str) -> DataFrame:
    return stats.trait_pivot(trait_rows(spark, sf), "lang", ["article", "link"], "doc_id")


@query("trait_pivot_company", TRAIT_SQL + """, b AS (SELECT source FROM h GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 15)
SELECT source, count(DISTINCT CASE WHEN l1 = 'article' THEN doc_id END) AS article, count(DISTINCT CASE WHEN l1 = 'link' THEN doc_id END) AS link FROM h SEMI JOIN b USING (source) GROUP BY 1""")
def trait_pivot_company(spark: SparkSession, sf: str) -> DataFrame:
    return stats.trait_pivot(trait_rows(spark, sf), "source", ["article", "link"], "doc_id", top=15)


RULES = {"metal": ["bolt", "nut"], "round": ["ring", "widget"], "plain": ["red", "blue"]}


@query("title_category", """SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%nut%' THEN 'metal' WHEN p_name LIKE '%ring%' OR p_name LIKE '%widget%' THEN 'round'
WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'plain' ELSE '其他' END AS category FROM part""")
def title_category(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", normalize.category("p_name", RULES).alias("category"))


@query("company_name_norm", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN 1 THEN '星辰' || s_suppkey WHEN 2 THEN '云图' ELSE '未知公司' END AS company FROM supplier""")
def company_name_norm(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, F.concat("s_name", F.lit("（北京分公司）"))).when(k % 4 == 1, F.concat(F.lit("北京 星辰"), k.cast("string"), F.lit("科技有限公司｜招聘"))).when(k % 4 == 2, "云图智能 集团").otherwise(" ")
    return spread(table(spark, sf, "supplier").select("s_suppkey", "s_name")).select("s_suppkey", normalize.company(raw, normalize.alias_map({"云图": ["云图智能集团"]})).alias("company"))


@query("title_norm", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'AI产品经理' WHEN 1 THEN '大模型产品经理' WHEN 2 THEN '数据分析师' WHEN 3 THEN '未知职位' ELSE replace(p_name, ' ', '') END AS title FROM part""")
def title_norm(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, "急聘ai/产品经理（双休）").when(k % 5 == 1, "LLM 产品经理-校招").when(k % 5 == 2, "高薪 BI 分析师").when(k % 5 == 3, "　").otherwise(F.col("p_name"))
    return spread(table(spark, sf, "part").select("p_partkey", "p_name")).select("p_partkey", normalize.title(raw).alias("title"))


#: Words of the documents and the markers and skills that stand in their place.
MARKERS = {"with": "岗位职责：", "that": "任职要求：", "from": "加分项：", "this": "Python", "und": "智能客服", "pour": "节点管理", "para": "沟通", "der": "我们提供", "des": "飞书", "have": "数据分析"}


def section_sql(name: str) -> str:
    starts, stops = SECTIONS[name]
    first = "list_min(list_filter([" + ", ".join(f"{{'place': instr(t, '{m}'), 'turn': {i}, 'size': {len(m)}}}" for i, m in enumerate(starts)) + "], lambda x: x.place > 0))"
    end = "list_min(list_filter([" + ", ".join(f"instr(substr(t, f.place + f.size), '{m}')" for m in stops) + "], lambda x: x > 0))"
    return f"(SELECT CASE WHEN f IS NULL THEN '' ELSE regexp_replace(substr(t, f.place + f.size, coalesce({end} - 1, length(t))), '^[ ：:;；]+|[ ：:;；]+$', '', 'g') END FROM (SELECT {first} AS f))"


def labels_sql(text: str, specs: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({text}), '{p.lower()}')" for p in ps) + f" THEN '{k}' END" for k, ps in specs.items()) + "], lambda x: x IS NOT NULL)"


RULE_SQL = "WITH d AS (SELECT doc_id, trim(regexp_replace(" + "replace(" * len(MARKERS) + "coalesce(text, '')" + "".join(f", '{k}', '{v}')" for k, v in MARKERS.items()) + ", '\\s+', ' ', 'g')) AS t FROM documents), " + f"""
s AS (SELECT doc_id, t, {section_sql('responsibilities')} AS duties, {section_sql('requirements')} AS wants, {section_sql('bonus')} AS bonus, {section_sql('offer')} AS offer, {section_sql('highlights')} AS highlights FROM d),
x AS (SELECT *, CASE WHEN duties <> '' THEN duties ELSE t END AS du, CASE WHEN wants <> '' THEN wants ELSE t END AS wa, array_to_string(list_filter([bonus, offer, highlights], lambda x: x <> ''), ' ') AS mo FROM s),
l AS (SELECT doc_id, duties, wants, {labels_sql('t', HARD_SPECS)} AS hard, {labels_sql('wa', SOFT_SPECS)} AS soft, {labels_sql('du', DUTY_SPECS)} AS rule_duties, {labels_sql('wa', HARD_SPECS | SOFT_SPECS)} AS req, list_concat({labels_sql('mo', HARD_SPECS)}, {labels_sql('mo', DUTY_SPECS)}, {labels_sql('mo', SCENE_SPECS)}) AS b,
{labels_sql('t', SCENE_SPECS)} AS ind, {labels_sql('t', JOB_TYPE_SPECS)} AS kind, {labels_sql('wa', HARD_SPECS)} AS must, {labels_sql('mo', HARD_SPECS)} AS nice, {labels_sql('t', TOOL_SPECS)} AS tools FROM x)
SELECT doc_id, duties, wants, """ + ", ".join(f"array_to_string({c}, ',') AS {n}" for c, n in (("hard", "rule_hard"), ("soft", "rule_soft"), ("rule_duties", "rule_duties"), ("req", "rule_requirements"), ("list_filter(b, lambda x, i: list_position(b, x) = i)", "rule_bonus"), ("ind", "rule_industry"), ("kind", "rule_job_type"), ("must", "rule_must"), ("nice", "rule_nice"), ("tools", "rule_tools"))) + ", substr(array_to_string((CASE WHEN len(rule_duties) > 0 THEN rule_duties ELSE ind END)[1:3], '、'), 1, 25) AS rule_goal FROM l"


@query("rule_sections", RULE_SQL)
def rule_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections and all rule fields of the documents, some of whose words stand for markers and skills."""
    text = F.coalesce("text", F.lit(""))
    for word, mark in MARKERS.items():
        text = F.replace(text, F.lit(word), F.lit(mark))
    rows = tags.rule_profile(table(spark, sf, "documents").select("doc_id", text.alias("detail")), "detail", ("responsibilities", "requirements"))
    fields = ("hard", "soft", "duties", "requirements", "bonus", "industry", "job_type", "must", "nice", "tools")
    return rows.select("doc_id", F.col("_at_responsibilities").alias("duties"), F.col("_at_requirements").alias("wants"), *[F.array_join(f"_rule_{c}", ",").alias(f"rule_{c}") for c in fields], F.col("_rule_goal").alias("rule_goal"))


@query("tag_fusion", JOBS + """, f AS (SELECT job_id, list_transform(tags || [company], lambda x: CASE WHEN x = 'red' THEN 'crimson' ELSE x END) AS a FROM jobs)
SELECT job_id, array_to_string(list_sort(list_distinct(a)), ',') AS fused FROM f""")
def tag_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs(spark, sf).withColumn("more", F.array("company"))
    out = tags.fuse(rows, {"hard": ["tags", "more"]}, {"hard": {"red": "crimson"}})
    return out.select("job_id", F.array_join(F.array_sort("final_hard_tags"), ",").alias("fused"))


NODES = ", c AS (SELECT tag AS id, count(*) AS n, count(DISTINCT job_id) AS jobs FROM t GROUP BY 1 ORDER BY n DESC, id LIMIT 12)"
EDGES = NODES + """, e AS (SELECT a.tag AS src, b.tag AS dst, count(*) AS weight FROM t a JOIN t b ON a.job_id = b.job_id AND a.tag < b.tag
WHERE a.tag IN (SELECT id FROM c) AND b.tag IN (SELECT id FROM c) GROUP BY 1, 2 HAVING count(*) >= 2)"""
ENDS = EDGES + """, s AS (SELECT id, count(*) AS degree, sum(weight)::DOUBLE AS weighted_degree FROM (SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1)"""


def network(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.cooccurrence(jobs(spark, sf), "tags", top=12)


@query("cooccurrence_nodes", JOBS + NODES + " SELECT id, n AS count, jobs AS coverage_jobs, jobs / (SELECT count(*) FROM jobs) AS coverage FROM c")
def cooccurrence_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return network(spark, sf)[0]


@query("cooccurrence_edges", JOBS + EDGES + " SELECT * FROM e")
def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_edges(network(spark, sf)[1])


@query("skill_combinations", JOBS + """ SELECT a.tag AS a, b.tag AS b, count(*) AS support, count(*) / (SELECT count(*) FROM jobs) AS rate FROM t a JOIN t b ON a.job_id = b.job_id AND a.tag < b.tag
GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY support DESC, a, b LIMIT 20""")
def skill_combinations(spark: SparkSession, sf: str) -> DataFrame:
    return stats.pair_support(jobs(spark, sf), "tags", 2, 20)


@query("job_similarity_edges", JOBS + """, f AS (SELECT * FROM jobs ORDER BY job_id LIMIT 80),
p AS (SELECT a.job_id AS src, b.job_id AS dst, list_sort(list_intersect(a.tags, b.tags)) AS common, len(a.tags) AS na, len(b.tags) AS nb FROM f a JOIN f b ON a.job_id < b.job_id)
SELECT src, dst, (len(common) * 1000 // (na + nb - len(common)))::BIGINT AS permille, array_to_string(common, '、') AS shared FROM p WHERE len(common) > 0 AND len(common) / (na + nb - len(common)) >= 0.25""")
def job_similarity_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.job_similarity(jobs(spark, sf), "tags", "job_id", [F.asc("job_id")])
    exact = F.size(F.split("shared", "、"))
    both = jobs(spark, sf).select("job_id", F.size("tags").alias("n"))
    out = edges.join(both.select(F.col("job_id").alias("src"), F.col("n").alias("na")), "src").join(both.select(F.col("job_id").alias("dst"), F.col("n").alias("nb")), "dst")
    return out.select("src", "dst", F.floor(exact * 1000 / (F.col("na") + F.col("nb") - exact)).cast("long").alias("permille"), "shared")


BI = """, l AS (SELECT {left} AS l, count(*) AS n FROM jobs {where} GROUP BY 1 ORDER BY n DESC, l LIMIT {a}), b AS (SELECT tag, count(*) AS n FROM t WHERE {left} IN (SELECT l FROM l) GROUP BY 1 ORDER BY n DESC, tag LIMIT {b})
SELECT '{p}::' || {left} AS src, 'tag::' || tag AS dst, count(*) AS weight FROM t WHERE {left} IN (SELECT l FROM l) AND tag IN (SELECT tag FROM b) GROUP BY 1, 2 HAVING count(*) >= 2"""


@query("bipartite_edges", JOBS + BI.format(left="company", where="", a=20, b=10, p="company"))
def bipartite_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bipartite(jobs(spark, sf), "company", "tags", "company", 20, 10)[1]


@query("role_tag_edges", JOBS + BI.format(left="role", where="WHERE len(tags) > 0", a=3, b=10, p="role"))
def role_tag_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bipartite(jobs(spark, sf), "role", "tags", "role", 3, 10, tagged_only=True)[1]


@query("node_importance", JOBS + ENDS + " SELECT c.id, degree, weighted_degree, degree / (SELECT count(*) - 1 FROM c) AS centrality, round(ln(1 + n) * 0.48 + ln(1 + weighted_degree) * 0.37 + degree / (SELECT count(*) - 1 FROM c) * 4.5 * 0.15, 4) AS size_score FROM c JOIN s USING (id)")
def node_importance(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = network(spark, sf)
    return graph.importance(nodes, edges).select("id", "degree", "weighted_degree", "centrality", "size_score")


@query("top_nodes", JOBS + ENDS + " SELECT id, weighted_degree FROM s ORDER BY weighted_degree DESC, id LIMIT 5")
def top_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_nodes(graph.importance(*network(spark, sf)), 5).select("id", "weighted_degree")


@query("graph_summary", JOBS + EDGES + """ SELECT (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM e) AS edges, round(2 * (SELECT count(*) FROM e) / (SELECT count(*) FROM c), 2) AS avg_degree, 1::BIGINT AS components,
round(2 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM c) * ((SELECT count(*) FROM c) - 1)), 4) AS density""")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.summary(*network(spark, sf))


COMMUNITIES = JOBS.replace("WITH words", "WITH RECURSIVE words") + """, c AS (SELECT job_id AS id, tags FROM jobs ORDER BY job_id LIMIT 80),
e AS (SELECT x.id AS src, y.id AS dst, len(list_intersect(x.tags, y.tags)) AS weight FROM c x JOIN c y ON x.id < y.id WHERE len(list_intersect(x.tags, y.tags)) > 0 AND len(list_intersect(x.tags, y.tags)) / (len(x.tags) + len(y.tags) - len(list_intersect(x.tags, y.tags))) >= 0.4),
b AS (SELECT src AS a, dst AS b, weight AS w FROM e UNION ALL SELECT dst, src, weight FROM e),
k AS (SELECT a AS id, sum(w)::HUGEINT AS k FROM b GROUP BY 1), m AS (SELECT sum(k)::HUGEINT AS s FROM k),
r AS (SELECT 0 AS it, id, k, id AS c FROM k UNION ALL (
 WITH o AS (SELECT c, sum(k) AS tot FROM r GROUP BY 1), l AS (SELECT x.c AS a, y.c AS b, sum(w) AS w FROM b JOIN r x ON x.id = b.a JOIN r y ON y.id = b.b WHERE x.c <> y.c GROUP BY 1, 2),
 g AS (SELECT l.a, l.b, w * s - oa.tot * ob.tot AS worth FROM l JOIN o oa ON oa.c = l.a JOIN o ob ON ob.c = l.b CROSS JOIN m),
 h AS (SELECT a, b FROM g WHERE worth > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY worth DESC, b) = 1), u AS (SELECT x.a AS c, x.b AS dest FROM h x JOIN h y ON x.a = y.b AND x.b = y.a WHERE x.a > x.b)
 SELECT it + 1, id, k, coalesce(dest, r.c) FROM r LEFT JOIN u ON u.c = r.c WHERE EXISTS (SELECT 1 FROM u))),
q AS (SELECT 0 AS it, id, k, c FROM r WHERE it = (SELECT max(it) FROM r) UNION ALL (
 WITH o AS (SELECT c, sum(k) AS tot FROM q GROUP BY 1), l AS (SELECT b.a AS id, y.c AS dest, sum(w) AS w FROM b JOIN q y ON y.id = b.b GROUP BY 1, 2),
 g AS (SELECT q.id, q.c, l.dest, (l.w - coalesce(i.w, 0)) * s - q.k * (od.tot - oc.tot + q.k) AS worth FROM q JOIN l ON l.id = q.id AND l.dest <> q.c LEFT JOIN l i ON i.id = q.id AND i.dest = q.c JOIN o od ON od.c = l.dest JOIN o oc ON oc.c = q.c CROSS JOIN m),
 h AS (SELECT * FROM g WHERE worth > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY worth DESC, dest) = 1),
 f AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY z ORDER BY worth DESC, id) AS turn FROM (SELECT id, worth, unnest([c, dest]) AS z FROM h)) WHERE turn = 1 GROUP BY 1 HAVING count(*) = 2)
 SELECT it + 1, q.id, k, coalesce(h.dest, q.c) FROM q LEFT JOIN (SELECT h.id, dest FROM h JOIN f ON f.id = h.id) h ON h.id = q.id WHERE EXISTS (SELECT 1 FROM h))),
p AS (SELECT id, min(id) OVER (PARTITION BY c) AS community FROM q WHERE it = (SELECT max(it) FROM q))"""


def job_communities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and communities of the first 80 jobs, by the tags that similar ones share."""
    rows = saved(jobs(spark, sf))
    edges = saved(graph.job_similarity(rows, "tags", "job_id", [F.asc("job_id")], threshold=0.4).select("src", "dst", F.size(F.split("shared", "、")).alias("weight")))
    nodes = rows.select(F.col("job_id").alias("id")).orderBy("id").limit(80)
    return nodes, edges, community.communities(nodes, edges)


@query("communities", COMMUNITIES + " SELECT c.id, coalesce(community, c.id) AS community FROM c LEFT JOIN p ON p.id = c.id")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return job_communities(spark, sf)[2]


@query("community_summary", COMMUNITIES + """, z AS (SELECT c.id, coalesce(community, c.id) AS community, row_number() OVER (PARTITION BY coalesce(community, c.id) ORDER BY c.id) AS turn FROM c LEFT JOIN p ON p.id = c.id),
mo AS (SELECT sum(inside) / any_value(s) - sum(tot * tot) / (any_value(s)::DOUBLE * any_value(s)) AS modularity FROM (SELECT x.community, sum(w)::DOUBLE AS tot, sum(w) FILTER (x.community = y.community)::DOUBLE AS inside FROM b JOIN z x ON x.id = b.a JOIN z y ON y.id = b.b GROUP BY 1) CROSS JOIN m)
SELECT community, count(*) AS size, string_agg(id::VARCHAR, '、' ORDER BY id) FILTER (turn <= 8) AS labels, round((SELECT modularity FROM mo), 9) AS modularity FROM z GROUP BY 1""")
def community_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Each community's size and first names, and the modularity of all."""
    _, edges, members = job_communities(spark, sf)
    return community.summary(members).withColumn("modularity", F.round(F.lit(community.modularity(edges, members)), 9))


@query("effort_priority", JOBS + ENDS + """, k AS (SELECT c.id, degree, weighted_degree, jobs / (SELECT count(*) FROM jobs) AS coverage FROM c JOIN s USING (id))
SELECT id, round(v, 3) AS priority_score, CASE WHEN v >= 18 THEN '必修核心' WHEN v >= 10 THEN '方向强化' WHEN v >= 6 THEN '加分项' ELSE '观察项' END AS priority FROM (SELECT id, 0.55 * weighted_degree + 0.25 * degree + 20 * coverage AS v FROM k)""")
def effort_priority(spark: SparkSession, sf: str) -> DataFrame:
    return graph.effort_priority(graph.importance(*network(spark, sf))).select("id", "priority_score", "priority")


@query("ego_subgraph", JOBS + EDGES + """, f AS (SELECT min(id) AS x FROM c), i AS (SELECT x AS id FROM f UNION SELECT dst FROM e, f WHERE src = x UNION SELECT src FROM e, f WHERE dst = x)
SELECT src, dst, weight FROM e WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i)""")
def ego_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = network(spark, sf)
    first = nodes.agg(F.min("id")).first()[0]
    return graph.ego(nodes, edges, first)[1] if first else edges


@query("filtered_graph", JOBS + ENDS + """, k AS (SELECT id FROM s ORDER BY weighted_degree DESC, id LIMIT 6) SELECT src, dst, weight FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def filtered_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.filtered(*network(spark, sf), least=1, most=6)[1]


@query("high_coverage_tags", JOBS + " SELECT tag, count(DISTINCT job_id) AS rows, 'tags' AS columns, count(DISTINCT job_id) / (SELECT count(*) FROM jobs) AS coverage FROM t GROUP BY 1 HAVING count(DISTINCT job_id) / (SELECT count(*) FROM jobs) >= 0.3")
def high_coverage_tags(spark: SparkSession, sf: str) -> DataFrame:
    return stats.high_coverage_tags(jobs(spark, sf), ["tags"], "job_id", 0.3)


@query("column_coverage", JOBS + """ SELECT 'tags' AS column_name, count(*) FILTER (len(tags) > 0) AS rows_with_tags, count(*) AS total_rows, count(*) FILTER (len(tags) > 0) / count(*) AS coverage, sum(len(tags))::BIGINT AS tags FROM jobs
UNION ALL SELECT 'absent', 0, count(*), 0.0, 0 FROM jobs""")
def column_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return stats.column_coverage(jobs(spark, sf), ["tags", "absent"])


DIAGNOSIS = JOBS + ", f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{d}', '{c}')" for i, (s, d, c) in enumerate(DIAGNOSED)) + """) v(i, source, dimension, column_name)),
k AS (SELECT source, dimension, column_name, count(*) FILTER (len(tags) > 0 AND job_id % (i + 1) = 0) AS rows_with_tags, count(*) AS total_rows FROM f CROSS JOIN jobs GROUP BY ALL)
SELECT *, rows_with_tags / total_rows AS coverage, round(avg(rows_with_tags / total_rows) OVER (PARTITION BY source), 9) AS average, """ + f"CASE WHEN rows_with_tags / total_rows < 0.3 THEN '{COVERAGE_ADVICE[0]}' WHEN rows_with_tags / total_rows < 0.7 THEN '{COVERAGE_ADVICE[1]}' ELSE '{COVERAGE_ADVICE[2]}' END AS advice FROM k"


@query("tag_diagnosis", DIAGNOSIS)
def tag_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    """All fields of the diagnosis, each filled in fewer of the jobs than the one before."""
    rows = jobs(spark, sf).withColumns({c: F.when(F.col("job_id") % (i + 1) == 0, F.col("tags")) for i, (_, _, c) in enumerate(DIAGNOSED)})
    return stats.diagnosis(rows).withColumn("average", F.round("average", 9))


@query("tag_columns", """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_name, p_type FROM part), c AS (SELECT 'skill_text' AS column_name, CASE WHEN p_partkey % 3 > 0 THEN w END AS t, p_partkey % 3 > 0 AS filled FROM p
UNION ALL SELECT 'must_list', CASE WHEN p_partkey % 2 = 0 THEN w END, p_partkey % 2 = 0 FROM p UNION ALL SELECT 'detail', list_distinct([p_type]), true FROM p UNION ALL SELECT 'nice', NULL, false FROM p),
u AS (SELECT column_name, count(DISTINCT tag) AS distinct_tags, count(*) AS tags FROM (SELECT DISTINCT column_name, r, tag FROM (SELECT column_name, row_number() OVER () AS r, t FROM c), unnest(t) x(tag)) GROUP BY 1)
SELECT c.column_name, count(*) FILTER (filled) AS filled_rows, count(*) FILTER (len(t) > 0) AS rows_with_tags, count(*) FILTER (filled) / count(*) AS coverage, coalesce(any_value(distinct_tags), 0) AS distinct_tags, coalesce(any_value(tags), 0) AS tags,
CASE WHEN count(*) FILTER (len(t) > 0) > 0 THEN 'a candidate for the network''s tags' ELSE 'empty in this selection' END AS advice FROM c LEFT JOIN u ON u.column_name = c.column_name GROUP BY 1""")
def tag_columns(spark: SparkSession, sf: str) -> DataFrame:
    """What the columns of parts with a tag's name hold: texts, arrays, a text source, nothing."""
    words = F.split("p_name", " ")
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.array_join(words, "；")).alias("skill_text"), F.when(F.col("p_partkey") % 2 == 0, words).alias("must_list"), F.col("p_type").alias("detail"), F.lit(None).cast("string").alias("nice"), F.lit("x").alias("other"))
    return inspect_columns(rows).drop("sample")


DIM = """WITH p AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part), u AS (SELECT k, 'name' AS dim, a AS tag FROM p UNION ALL SELECT k, 'name', b FROM p UNION ALL SELECT k, 'second', b FROM p)"""


def dims(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", w.alias("name"), F.array(w[1]).alias("second"))


@query("dimension_overlap", DIM + " SELECT tag, count(DISTINCT dim) AS dimensions, string_agg(DISTINCT dim, ',' ORDER BY dim) AS names, count(DISTINCT k) AS rows FROM u GROUP BY 1")
def dimension_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dimension_overlap(dims(spark, sf), {"name": "name", "second": "second"}, "p_partkey")


@query("dimension_top", DIM + """, c AS (SELECT dim, tag, count(DISTINCT k) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, tag)::INTEGER AS rank FROM c)
SELECT dim, rank, tag, n, n / (SELECT count(*) FROM part) AS rate FROM r WHERE rank <= 5""")
def dimension_top(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_by_dimension(dims(spark, sf), {"name": "name", "second": "second"}, "p_partkey", 5)


EV = "WITH w AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w in WORDS[:6]) + """) v(tag)),
d AS (SELECT doc_id, text, source, lang, tag FROM documents, w WHERE regexp_matches(lower(text), '(^|[^A-Za-z0-9_])' || tag || '($|[^A-Za-z0-9_])'))"""


@query("evidence_table", EV + """, m AS (SELECT tag, count(*) AS freq, count(DISTINCT doc_id) AS jobs, count(DISTINCT source) AS companies, count(DISTINCT lang) AS roles, count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM documents) AS coverage,
count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents) AS company_coverage, count(DISTINCT lang) / (SELECT count(DISTINCT lang) FROM documents) AS role_coverage,
count(*) FILTER (regexp_matches(lower(split_part(text, chr(10), 1)), '(^|[^A-Za-z0-9_])' || tag || '($|[^A-Za-z0-9_])')) / count(DISTINCT doc_id) AS title_rate, count(DISTINCT doc_id) / count(DISTINCT doc_id) AS evidence_rate FROM d GROUP BY 1),
v AS (SELECT *, 32 * coverage + 18 * company_coverage + 12 * role_coverage + 5 * title_rate + 3 * evidence_rate AS w FROM m)
SELECT * EXCLUDE w, 0.0::DOUBLE AS req_rate, round(w, 1) AS importance, CASE WHEN w >= 72 THEN '高' WHEN w >= 45 THEN '中' ELSE '低' END AS confidence, CASE WHEN round(w, 1) >= 55 THEN '重点强化' ELSE '观察项' END AS priority FROM v""")
def evidence_table(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of six words, with each document's first line as its title."""
    docs = table(spark, sf, "documents").withColumn("tags", tags.found(F.col("text"), WORDS[:6])).withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    out = evidence.tag_evidence(docs, "tags", "text", "title", "source", "lang", "doc_id")
    return out.select("tag", "freq", "jobs", "companies", "roles", "coverage", "company_coverage", "role_coverage", "title_rate", "evidence_rate", "req_rate", "importance", "confidence", "priority")


#: Words of the documents and the signals that stand in their place.
SIGNALS = {"with": "应届", "that": "实习", "from": "3年以上", "this": "资深", "und": "校招", "pour": "1-2年", "para": "培养"}


def in_sql(words: list[str]) -> str:
    return f"len(list_filter([{', '.join(repr(w.lower()) for w in words)}], lambda w: contains(lower(t), w)))"


FRESH = "documents".join(["WITH d AS (SELECT doc_id, " + "replace(" * len(SIGNALS) + "coalesce(text, '')" + "".join(f", '{k}', '{v}')" for k, v in SIGNALS.items()) + " AS t FROM ", "),"]) + f"""
s AS (SELECT doc_id, greatest(0, least(100, 50 + least(12 * {in_sql(FRESH_POSITIVE)}, 42) - least(14 * {in_sql(FRESH_NEGATIVE)}, 50) - CASE WHEN regexp_matches(t, '[1一]-?[2二]年') THEN 8 ELSE 0 END
 - CASE WHEN regexp_matches(t, '[3三]-?[5五]年|[3三]年以上|[5五]年以上') THEN 28 ELSE 0 END + CASE WHEN contains(t, '应届') OR contains(t, '经验不限') THEN 18 ELSE 0 END)) AS v FROM d)
SELECT doc_id, v::INTEGER AS fresh_score, CASE WHEN v >= 75 THEN '高' WHEN v >= 55 THEN '中' ELSE '低' END AS fresh_level FROM s"""


def signalled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with some words as signals of a posting."""
    text = F.coalesce("text", F.lit(""))
    for word, signal in SIGNALS.items():
        text = F.replace(text, F.lit(word), F.lit(signal))
    return table(spark, sf, "documents").select("doc_id", text.alias("t"))


@query("fresh_scores", FRESH)
def fresh_scores(spark: SparkSession, sf: str) -> DataFrame:
    score = evidence.fresh_score(F.col("t"))
    return signalled(spark, sf).select("doc_id", score.alias("fresh_score"), evidence.fresh_level(score).alias("fresh_level"))


@query("opportunity", FRESH.replace("SELECT doc_id, v::INTEGER AS fresh_score", ", g AS (SELECT lang AS role, count(*) AS jobs, count(DISTINCT source) AS companies, avg(v) AS f FROM s JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1), o AS (SELECT *, least(jobs, 30) * 1.2 + least(companies, 20) * 1.3 + f * 0.55 AS score FROM g) SELECT role, jobs, companies, round(f, 6) AS fresh_avg, round(score, 6) AS score, CASE WHEN score >= 65 THEN '高' WHEN score >= 45 THEN '中' ELSE '低' END AS priority FROM o -- "))
def opportunity(spark: SparkSession, sf: str) -> DataFrame:
    rows = signalled(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    out = evidence.opportunity(rows, "lang", "source", evidence.fresh_score(F.col("t")), "doc_id")
    return out.select("role", "jobs", "companies", F.round("fresh_avg", 6).alias("fresh_avg"), F.round("score", 6).alias("score"), "priority")


@query("fresh_jobs", FRESH + " ORDER BY 2 DESC, 1 LIMIT 30")
def fresh_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.fresh_jobs(signalled(spark, sf), F.col("t"), "doc_id").select("doc_id", "fresh_score", "fresh_level")


@query("evidence_examples", """WITH d AS (SELECT doc_id, text, regexp_extract(lower(text), '^(.*?)(^|[^A-Za-z0-9_])that($|[^A-Za-z0-9_])', 0, 's') AS m FROM documents WHERE regexp_matches(lower(text), '(^|[^A-Za-z0-9_])that($|[^A-Za-z0-9_])'))
SELECT doc_id FROM d ORDER BY doc_id LIMIT 5""")
def evidence_examples(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("tags", tags.found(F.col("text"), WORDS))
    return evidence.examples(docs, "tags", "that", "text", "doc_id").select("doc_id")


@query("job_match", JOBS + """, h AS (SELECT job_id, company, role, city, tags, len(list_filter(tags, lambda x: x IN ('red', 'bolt', 'ring'))) AS m FROM jobs)
SELECT job_id, CASE WHEN len(tags) = 0 THEN 30 ELSE (30 * m) // len(tags) END::INTEGER AS match_hard, 10::INTEGER AS match_soft, CASE WHEN role LIKE '1-%' THEN 14 ELSE 6 END::INTEGER AS match_direction, 8::INTEGER AS match_degree, 10::INTEGER AS match_experience,
CASE WHEN city = 'NATION_3' OR contains(city, 'NATION_3') OR contains('NATION_3', city) THEN 5 ELSE 1 END::INTEGER AS match_city, 6::INTEGER AS match_fresh,
array_to_string(list_sort(list_filter(tags, lambda x: x IN ('red', 'bolt', 'ring'))), '|') AS matched, array_to_string(list_sort(list_filter(tags, lambda x: x NOT IN ('red', 'bolt', 'ring')))[1:10], '|') AS missing,
(match_hard + match_soft + match_direction + match_degree + match_experience + match_city + match_fresh)::INTEGER AS match_total FROM h""")
def job_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs(spark, sf).withColumns({"title_norm": F.lit(""), "category": F.lit(""), "direction": F.col("role"), "ordinal": F.col("job_id")})
    out = match.match(rows, {"hard_skills": ["red", "bolt", "ring"], "roles": ["1-URGENT"], "cities": ["NATION_3"]}, ["tags"], [])
    return out.select("job_id", "match_hard", "match_soft", "match_direction", "match_degree", "match_experience", "match_city", "match_fresh", F.array_join(F.array_sort("matched_skills"), "|").alias("matched"), F.array_join(F.array_sort("missing_skills"), "|").alias("missing"), "match_total")


@query("missing_skills", JOBS + """, h AS (SELECT job_id, role, city, list_filter(tags, lambda x: x NOT IN ('red', 'bolt', 'ring')) AS missing, tags FROM jobs),
s AS (SELECT *, CASE WHEN len(tags) = 0 THEN 30 ELSE (30 * (len(tags) - len(missing))) // len(tags) END + CASE WHEN role LIKE '1-%' THEN 14 ELSE 6 END AS score FROM h ORDER BY score DESC, job_id LIMIT 20), m AS (SELECT unnest(list_slice(missing, 1, 10)) AS skill FROM s)
SELECT skill, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, skill LIMIT 10""")
def missing_skills(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs(spark, sf).withColumns({"title_norm": F.lit(""), "category": F.lit(""), "direction": F.col("role"), "ordinal": F.col("job_id")}).drop("city")
    ranked = match.match(rows, {"hard_skills": ["red", "bolt", "ring"], "roles": ["1-URGENT"]}, ["tags"], [])
    return match.missing_counts(ranked, [F.desc("match_total"), F.asc("job_id")])


EX = """WITH d AS (SELECT *, md5(text) AS h, count(*) OVER (PARTITION BY md5(text), lang) AS n FROM documents), g AS (SELECT *, dense_rank() OVER (ORDER BY h, lang) AS id FROM d WHERE n > 1)"""


def exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumns({"h": F.md5("text"), "captured_at": F.lit(None).cast("string"), "ordinal": F.col("doc_id")})
    return dedup.exact(docs, ["h", "lang"], detail="text")


@query("exact_dedup", EX + " SELECT d.doc_id, coalesce('EXACT_' || lpad(id::VARCHAR, greatest(4, length(id::VARCHAR))::INTEGER, '0'), '') AS duplicate_group_id, row_number() OVER (PARTITION BY d.h, d.lang ORDER BY d.doc_id) > 1 AS is_duplicate, row_number() OVER (PARTITION BY d.h, d.lang ORDER BY d.doc_id) = 1 AS duplicate_keep FROM d LEFT JOIN g ON d.doc_id = g.doc_id")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(spark, sf).select("doc_id", "duplicate_group_id", "is_duplicate", "duplicate_keep")


@query("dedup_summary", EX + " SELECT count(*) AS total, (SELECT count(DISTINCT id) FROM g) AS groups, count(*) - (SELECT count(DISTINCT (h, lang)) FROM d) AS duplicates, (SELECT count(DISTINCT (h, lang)) FROM d) AS kept FROM d")
def dedup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.summary(exact_groups(spark, sf))


@query("duplicate_groups", EX + " SELECT 'EXACT_' || lpad(id::VARCHAR, greatest(4, length(id::VARCHAR))::INTEGER, '0') AS duplicate_group_id, count(DISTINCT doc_id) AS jobs, arg_min(source, doc_id) AS company, arg_min(lang, doc_id) AS title, 1.0::DOUBLE AS max_similarity FROM g GROUP BY id")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.group_stats(exact_groups(spark, sf), "doc_id", "source", "lang")


@query("keep_record", """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, length(o_orderpriority) DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k = 1""")
def keep_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("string"))
    return dedup.keep_one(rows, ["o_custkey"], captured="at", detail="o_orderpriority", order="o_orderkey").filter("duplicate_keep").select("o_custkey", "o_orderkey")


NEAR = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, trim(text) AS raw, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS t FROM documents),
n AS (SELECT source, lang, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) > 1),
g AS (SELECT doc_id, source, lang, substr(t, i, k) AS gram, count(*) AS tf FROM (SELECT doc_id, source, lang, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM d SEMI JOIN n USING (source, lang), range(2, 5) r(k)) GROUP BY ALL),
f AS (SELECT source, lang, gram, count(*) AS df FROM g GROUP BY ALL),
w AS (SELECT doc_id, source, lang, gram, df, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM g JOIN f USING (source, lang, gram) JOIN n USING (source, lang)),
u AS (SELECT w.doc_id, source, lang, gram, w / norm AS w FROM w JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) x ON x.doc_id = w.doc_id WHERE df > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.source = b.source AND a.lang = b.lang AND a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.9),
r AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p UNION SELECT r.x, q.y FROM r JOIN (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p) q ON r.y = q.x),
c AS (SELECT x AS doc_id, least(x, min(y)) AS root FROM r GROUP BY x),
top AS (SELECT root, max(s) AS top FROM p JOIN c ON c.doc_id = p.a GROUP BY 1),
i AS (SELECT root, row_number() OVER (ORDER BY source, lang, root) AS id FROM (SELECT DISTINCT root FROM c) JOIN d ON d.doc_id = root),
k AS (SELECT c.doc_id, id, top, row_number() OVER (PARTITION BY root ORDER BY length(raw) DESC, c.doc_id) = 1 AS keep FROM c JOIN i USING (root) JOIN top USING (root) JOIN d ON d.doc_id = c.doc_id),
z AS (SELECT d.doc_id, CASE WHEN id IS NULL THEN '' ELSE 'SIM_' || lpad(id::VARCHAR, greatest(4, length(id::VARCHAR))::INTEGER, '0') END AS duplicate_group_id, coalesce(NOT keep, false) AS is_duplicate, coalesce(keep, true) AS duplicate_keep, round(coalesce(top, 0), 5) AS similarity FROM d LEFT JOIN k ON k.doc_id = d.doc_id)"""


def near_duplicates(select: str) -> str:
    """SQL over z, the documents with their duplicate columns."""
    return f"{NEAR} {select}"


@query("near_dedup", near_duplicates("SELECT * FROM z"))
def near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicates among the documents of one source and language."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", "text", F.lit(None).cast("string").alias("captured_at"))
    found = dedup.similar(rows, "text", ["source", "lang"], order="doc_id")
    return found.select("doc_id", "duplicate_group_id", "is_duplicate", "duplicate_keep", F.round("max_similarity_in_group", 5).alias("similarity"))


CAP = "WITH ev AS (SELECT *, user_id || ':' || event_type AS k FROM events), base AS (SELECT * FROM ev WHERE event_id % 2 = 0), new AS (SELECT * FROM ev WHERE event_id % 2 = 1), "


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two captures of the feed: the tables that are merged, together all of it."""
    ev = table(spark, sf, "events").select("event_id", "value", F.concat_ws(":", "user_id", "event_type").alias("k"))
    return ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1")


LAST = "(SELECT k, max(event_id) AS event_id FROM {t} GROUP BY 1)"


@query("capture_merge_update", CAP + f"b AS {LAST.format(t='base')}, n AS {LAST.format(t='new')} SELECT k, event_id FROM n UNION ALL SELECT k, event_id FROM b WHERE k NOT IN (SELECT k FROM n)")
def capture_merge_update(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.merge(*halves(spark, sf), "merge_update", "k", "event_id").select("k", "event_id")


@query("capture_append_new", CAP + f"b AS {LAST.format(t='base')}, n AS {LAST.format(t='new')} SELECT k, event_id FROM b UNION ALL SELECT k, event_id FROM n WHERE k NOT IN (SELECT k FROM b)")
def capture_append_new(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.merge(*halves(spark, sf), "append_new", "k", "event_id").select("k", "event_id")


@query("capture_overwrite", CAP + f"n AS {LAST.format(t='new')} SELECT k, event_id FROM n")
def capture_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.merge(*halves(spark, sf), "overwrite", "k", "event_id").select("k", "event_id")


@query("import_summary", CAP + """b AS (SELECT DISTINCT k FROM base), n AS (SELECT k, count(*) AS c FROM new GROUP BY 1)
SELECT (SELECT count(*) FROM b) AS existing, (SELECT count(*) FROM new) AS imported, (SELECT count(*) FROM (SELECT k FROM b UNION SELECT k FROM n)) AS final, (SELECT count(*) FROM n WHERE k IN (SELECT k FROM b)) AS updated, (SELECT sum(c - 1)::BIGINT FROM n) AS duplicates""")
def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    base, new = halves(spark, sf)
    return upsert.import_summary(base, new, "k")


@query("capture_status", CAP + "b AS (SELECT DISTINCT k FROM base) SELECT event_id, CASE WHEN k IN (SELECT k FROM b) THEN 'updated' ELSE 'created' END AS status FROM new")
def capture_status(spark: SparkSession, sf: str) -> DataFrame:
    base, new = halves(spark, sf)
    return upsert.status(base, new, "k").select("event_id", "status")


@query("row_key", "SELECT page_id, CASE WHEN url <> '' THEN 'url:' || url ELSE 'hash:' || md5('|||') END AS key FROM pages")
def row_key(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumnRenamed("url", "page_url")
    return pages.select("page_id", upsert.row_key(pages).alias("key"))


@query("vector_topk", """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM embeddings, q)
SELECT vec_id, round(c, 4) AS score FROM s ORDER BY round(c, 4) DESC, vec_id LIMIT 5""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    store = table(spark, sf, "embeddings")
    q = store.filter("vec_id = 0").select("embedding").first()
    return kb.search(store, list(q[0]) if q else [0.0], "vec_id").select("vec_id", "score")


@query("job_evidence", """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 4) AS c FROM embeddings, q),
b AS (SELECT *, row_number() OVER (ORDER BY c DESC, vec_id) AS k FROM s QUALIFY k <= 6) SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY k) AS items FROM b GROUP BY 1""")
def job_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors nearest to a posting's query, by label; the client answers with the second vector."""
    store = table(spark, sf, "embeddings").withColumn("item", F.col("vec_id").cast("string"))
    asked = store.filter("vec_id = 1").select("embedding").first()
    job = table(spark, sf, "documents").orderBy("doc_id").limit(1).withColumn("skills", F.array("lang"))
    columns = {"title": "source", "company": "source", "city": "lang", "experience": "lang", "degree": "lang", "skills": "skills", "wants": "skills"}
    _, _, grouped = kb.evidence_for_job(job, store, lambda texts: [list(asked[0]) if asked else [0.0] for _ in texts], columns, order="vec_id", kind="label", item="item")
    return grouped.select("label", F.array_join("items", ",").alias("items"))


@query("drawn_graph", JOBS + ENDS + """, z AS (SELECT min(id) AS x FROM c), r AS (SELECT CASE WHEN src = x THEN dst ELSE src END AS y FROM e, z WHERE src = x OR dst = x) SELECT 'node' AS kind, c.id AS name, round(least(56, 10 + ln(1 + n) * 9.5 + ln(1 + weighted_degree) * 1.6), 6) AS measure, 'level 1' AS note FROM c JOIN s USING (id)
UNION ALL SELECT 'edge', src || ' ' || dst, CASE WHEN src = x OR dst = x THEN greatest(4, w * 1.8) WHEN src IN (SELECT y FROM r) AND dst IN (SELECT y FROM r) THEN greatest(2, w * 1.1) ELSE w END,
CASE WHEN src = x OR dst = x THEN 'focus' WHEN src IN (SELECT y FROM r) AND dst IN (SELECT y FROM r) THEN 'neighbour' ELSE 'dim' END FROM (SELECT *, greatest(1, least(greatest(weight, 1), 8) * 0.75) AS w FROM e), z
UNION ALL SELECT 'neighbour', CASE WHEN src = x THEN dst ELSE src END, weight, 'together' FROM e, z WHERE src = x OR dst = x""")
def drawn_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and levels of nodes, widths of edges around the first node, and its neighbours' table."""
    nodes, edges = network(spark, sf)
    first = nodes.agg(F.min("id")).first()[0]
    sized = graph.drawn(graph.importance(nodes.withColumn("node_type", F.lit("tag")), edges))
    out = sized.select(F.lit("node").alias("kind"), F.col("id").alias("name"), F.round("visual_size", 6).alias("measure"), F.concat(F.lit("level "), F.col("level").cast("string")).alias("note"))
    wide = graph.highlighted_edges(edges, [first]).select(F.lit("edge"), F.concat_ws(" ", "src", "dst"), "width", "role")
    near = graph.neighbour_table(nodes.withColumn("label", F.col("id")), edges.withColumn("relation", F.lit("together")), first).select(F.lit("neighbour"), "label", F.col("weight").cast("double"), "relation")
    return out.union(wide).union(near)


@query("evidence_by_type", "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS items FROM r WHERE k <= 1000 GROUP BY 1")
def evidence_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.col("vec_id").cast("string").alias("item"))
    return kb.by_kind(rows, "label", "item", "vec_id").select("label", F.array_join("items", ",").alias("items"))


@query("chunks_fixed", """WITH s AS (SELECT doc_id, regexp_replace(text, '^[\\s\\x{00a0}\\x{3000}]+|[\\s\\x{00a0}\\x{3000}]+$', '', 'g') AS t FROM documents), c AS (SELECT doc_id, unnest(generate_series(1, greatest(len(t), 1), 780)) AS i, t FROM s)
SELECT doc_id, count(*) AS chunks, sum(len(trim(substr(t, i, 900), ' ')))::BIGINT AS chars FROM c WHERE len(trim(substr(t, i, 900), ' ')) >= 80 GROUP BY 1""")
def chunks_fixed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(kb.windows("text")).alias("c"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("c")).cast("long").alias("chars"))


@query("chunks_paragraph")
def chunks_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    return kb.chunks(table(spark, sf, "documents"))


@query("keyword_retrieval", """SELECT doc_id, (contains(lower(text), 'license')::INT + contains(lower(text), 'that')::INT + contains(lower(text), 'under')::INT)::INTEGER AS score FROM documents ORDER BY 2 DESC, 1 LIMIT 8""")
def keyword_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return match.retrieve(table(spark, sf, "documents"), "text", "license that under x", "doc_id").select("doc_id", "score")


@query("html_title", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.html_title("html").alias("title"))


@query("stream_upsert", "SELECT user_id || ':' || event_type AS k, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The feed replayed as a stream and merged by key; the snapshot equals the batch result."""
    import uuid

    from .plans.lineage import shared_dir
    from .streaming.capture import snapshot, upsert_batches

    schema = table(spark, sf, "events").schema
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    feed = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("k", F.concat_ws(":", "user_id", "event_type"))
    upsert_batches(feed.select("k", "event_id"), f"{root}/table", "k", "event_id", f"{root}/log").awaitTermination()
    return snapshot(spark, f"{root}/table").select("k", "event_id")


@query("table_signature", "SELECT count(*) AS n, true AS same_in_other_order, false AS same_with_a_row_twice, false AS same_with_values_swapped FROM orders")
def table_signature(spark: SparkSession, sf: str) -> DataFrame:
    """The signature of orders against those of the same rows in another order, with a row twice for another, and with two columns swapped."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    keys = ["o_orderkey", "o_custkey"]
    last = rows.agg(F.max(F.struct(*keys)).alias("s")).select("s.*")
    first = rows.agg(F.min(F.struct(*keys)).alias("s")).select("s.*")
    others = {"same_in_other_order": rows.orderBy(F.desc("o_orderkey")), "same_with_a_row_twice": rows.join(last, keys, "left_anti").union(first), "same_with_values_swapped": rows.select(F.col("o_custkey").alias("o_orderkey"), F.col("o_orderkey").alias("o_custkey"))}
    out = stats.signature(rows, keys).select("n", F.struct("sum_hash", "sum_square").alias("own"))
    for name, df in others.items():
        out = out.join(stats.signature(df, keys).select(F.col("n"), F.struct("sum_hash", "sum_square").alias(name)), "n", "left")
    return out.select("n", *[F.col("own").eqNullSafe(F.col(name)).alias(name) for name in others])


@query("latest_capture", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_capture(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.last_of(table(spark, sf, "events"), ["user_id"], "event_id").select("user_id", "event_id")


@query("share_window", "SELECT n_name, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def share_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


from . import catalog_records  # noqa: E402, F401  registers its queries
