"""Text functions on inline rows, each quirk included."""

import math
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from tagloom.functions import segment, tagcells
from tagloom.functions import text as tx


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r["x"] for r in df.select(make(F.col("t")).alias("x")).collect()]


def test_cleaning(spark):
    assert one(spark, tx.safe, None, "　a  b  ", "") == ["", "a  b", ""]
    assert one(spark, tx.collapse, "a 　\n b") == ["a b"]
    assert one(spark, tx.normalized, "<b>Hello</b>\tC++ .NET#1 http://x.y/z?q=1 世界！", None) == ["hello c++ .net#1 世界", ""]
    assert one(spark, tx.digits, "-K") == ["12-9K"]
    assert one(spark, lambda c: tx.absolute_url(c, "https://h"), "//a/b", "/c", "http://d", "e") == ["https://a/b", "https://h/c", "http://d", "e"]
    assert one(spark, tx.distinct_lines, "a\r\n b  c\na\n\nd") == ["a\nb c\nd"]
    assert one(spark, tx.html_title, "<html><TITLE> A\n b</title>", None) == ["A b", ""]
    assert one(spark, tx.urls, "see http://a.b https://c.d http://a.b x") == [["http://a.b", "https://c.d"]]


def test_region(spark):
    assert one(spark, tx.region, "北京市", "上海·浦东", "X/深圳", "江苏苏州园区", "Paris", None) == ["北京", "上海", "深圳", "苏州", "Paris", ""]


def test_dictionary_words(spark):
    assert one(spark, lambda c: tx.has_word(c, "AI"), "paid", "用AI做", "ai.", "AI2") == [False, True, True, False]
    assert one(spark, lambda c: tx.has_word(c, "C++"), "use C++ now", "C+++") == [True, True]
    assert one(spark, lambda c: tx.has_word(c, "Power BI"), "XPower BIX") == [True]
    assert one(spark, lambda c: tx.count_word(c, "sql"), "sql,sql mysql SQL") == [3]
    assert one(spark, lambda c: tx.count_word(c, "数据"), "数据数据x") == [2]


def test_snippets(spark):
    assert one(spark, lambda c: tx.snippet(c, "SQL", 2), "ab sql cd", "none", "sql") == ["b sql c", "", "sql"]
    assert one(spark, lambda c: tx.bounded_snippet(c, "ai", 3), "paid x\nAI y") == ["x AI y"]


def test_sections(spark):
    make = lambda c: tx.section(c, ["岗位职责", "工作内容"], ["任职要求"])
    assert one(spark, make, "x 岗位职责：做A；任职要求：B", "任职要求 y 工作内容 z", "无") == ["做A", "z", ""]
    assert one(spark, tx.repaired, "A智能体　和 唾眠 BA服务") == ["AI智能体 和 睡眠 BA服务"]


def test_tag_cells(spark):
    cells = {
        "['a b', 'c']": ["a b", "c"], '["x","y"]': ["x", "y"], "Power BI": ["Power", "BI"], "a、b；c|d": ["a", "b", "c", "d"], "nan": [], "[]": [], None: [], "": [], "a/b": ["a", "b"], "a/b" * 60: ["a/b" * 60],
        "[1, 2, true, null, 1.5]": ["1", "2", "True", "1.5"], '{"k": ["x", "y z"], "j": {"m": "p, q"}, "n": 5}': ["p", "q", "x", "y z"], "{'a': 'b', 'c': ['d', 'e']}": ["b", "d", "e"], "['Docker' 'Python']": ["Docker", "Python"],
        "single": ["single"], "(x, y)": ["x", "y"], " • a - ": ["a"], "x,x, X": ["x", "X"], "[[1,[2,3]],[4]]": ["1", "2", "3", "4"], "{broken": ["broken"], "数据 分析": ["数据", "分析"],
    }
    assert one(spark, tagcells.tag_list, *cells) == list(cells.values())
    schema = "m map<string,array<string>>, a array<array<string>>, s struct<i:int,s:string>, b array<boolean>, t string, n int"
    df = spark.createDataFrame([({"b": ["x"]}, [["p"], ["q", "p"], None], (1, "u, v"), [True, None], "['z']", 3), (None,) * 6], schema)
    assert [list(r) for r in df.select(*[tagcells.tags_of(df, c).alias(c) for c in df.columns]).collect()] == [[["x"], ["p", "q"], ["u", "v"], ["True"], ["z"], []], [[]] * 6]
    both = df.select(F.try_parse_json(F.lit('{"b": ["x", {"c": "y, z"}], "a": [1.50]}')).alias("v"))
    assert both.select(tagcells.tags_of(both, "v")).first()[0] == ["1.5", "x", "y", "z"]
    assert df.limit(0).select(tagcells.tags_of(df, "a")).collect() == []


def test_segments(spark, tmp_path):
    (tmp_path / "u.txt").write_text("机器学习 10\npower bi 10 n\n深度学习模型\n\n", encoding="utf-8")
    assert segment.load_user_words(str(tmp_path / "u.txt")) == {"机器学习": 10, "power bi": 10, "深度学习模型": None} and segment.load_user_words(str(tmp_path / "none")) == {}
    rng = random.Random(2)
    words = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(30)}
    known = segment.Dictionary(words)
    total = sum(words.values())

    def ways(run):
        yield from ([run[:n], *rest] for n in range(1, len(run) + 1) if run[:n] in words or n == 1 for rest in (ways(run[n:]) if run[n:] else [[]]))

    value = lambda cut: sum(math.log(words.get(w, 1) / total) for w in cut)
    for _ in range(60):
        run = "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(1, 9)))
        assert abs(value(list(known.cut_run(run))) - max(map(value, ways(run)))) < 1e-9
    own = {"机器学习": 10, "机器": 50, "学习": 50, "power bi": 10, "c++": 3, "深度学习模型": None, "模型": 40}
    got = one(spark, lambda c: segment.segmented(spark, c, own, {"and"}, {"很"}, 1), "精通深度学习模型 and Power BI, C++", "x1学习", None, "  ", "机" * 3)
    assert got == [["精", "通", "深度学习模型", "power bi", "c++"], ["x1", "学习"], [], [], ["机", "机", "机"]]
    assert segment.Dictionary({}).cut("无词 ok") == ["无", "词", "ok"] and len(known.cut("甲" * 20_000)) > 0


def test_arrays_of_tags(spark):
    df = spark.createDataFrame([(["Power BI", None, " ", "x", "x"],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(tx.array_tags("a")).collect()] == [["Power BI", "x"], []]
    assert [r[0] for r in df.select(tx.norm_list("a", split=None, max_items=1)).collect()] == [["Power BI"], []]
    assert one(spark, lambda c: tx.norm_list(c, fold=True), "a，A；b\na") == [["a", "b"]]
    df = spark.createDataFrame([(["bb", "a", "B", "ccc"],)], "a array<string>")
    assert df.select(tx.by_length(F.col("a"))).first()[0] == ["ccc", "bb", "a", "B"]


def test_tokens(spark):
    assert one(spark, lambda c: tx.tokens(c, {"the"}, {"数据"}), "The SQL 数据分析师 x") == [["sql", "据分", "分析", "析师"]]


def test_json_and_latex(spark):
    got = one(spark, lambda c: tx.loose_json(c, "a array<string>, b int"), 'so ```{"a": ["x",], "b": 2,}``` end', "no", None)
    assert got[0]["a"] == ["x"] and got[0]["b"] == 2 and got[1:] == [None, None]
    got = one(spark, lambda c: tx.loose_json(c, "summary string, b int", "summary"), '{"summary": "say “x,]” twice", "b": 1}', "{“b”: 3,}", "```json\nplain words\n```", "  ", None, '{"b": 4} and {')
    assert [tuple(r) if r else None for r in got] == [("say “x,]” twice", 1), (None, 3), ("plain words", None), None, None, (None, 4)]
    assert one(spark, tx.latex, "50% & a_b \\") == [r"50\% \& a\_b \textbackslash\{\}"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(tx.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [0.0, 0.0]


def test_boundary_pattern():
    assert re.search(tx.boundary("a.b"), "x a.b y") and not re.search(tx.boundary("a.b"), "x aab y")


def test_segmented_texts_go_on_in_pieces(spark):
    texts = pd.Series(["x" * n for n in (4, 7, 1, 2, 30, 1)])
    assert [list(p.index) for p in segment.pieces(texts, 10)] == [[0], [1, 2, 3], [4], [5]]
    rows = [(i, "ab cd " * (200_000 if i == 3 else i)) for i in range(6)]
    got = spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", F.size(segment.segmented(spark, "t", {})).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: 400_000 if i == 3 else 2 * i for i, _ in rows}
