"""Readers, pages, streaming, and the registered queries against their SQL."""

import os
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.sources import artifacts, captured, documents, files, pages, settings
from tagloom.streaming import capture

SF = "/root/testdata/sf0.001"


def test_csv_encodings(spark, tmp_path):
    text = '职位名称,岗位详情\n"数据,分析","多\n行"\n产品,""\n'
    for name, encoding in (("a", "utf-8-sig"), ("b", "gb18030"), ("c", "utf-8")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
        rows = files.as_text(files.read(spark, str(tmp_path / f"{name}.csv"))).collect()
        assert [tuple(r) for r in rows] == [("数据,分析", "多\n行"), ("产品", "")] and rows[0].__fields__[0] == "职位名称"
    with pytest.raises(ValueError):
        files.read(spark, "x.txt")
    (tmp_path / "j.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read(spark, str(tmp_path / "j.json")).count() == 2


def pdf_of(streams, extra=()):
    """A PDF whose pages hold these content streams, in reverse order in the file."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (10 + i) for i in range(len(streams))) + b"]/Count %d>>" % len(streams)}
    for i, (data, packed) in enumerate(streams):
        body = zlib.compress(data) if packed else data
        objects[10 + i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R/Resources<</Font<</F1 5 0 R>>>>>>" % (20 + i)
        objects[20 + i] = b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(body), b"/Filter/FlateDecode" if packed else b"", body)
    objects |= dict(extra)
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, objects[n]) for n in sorted(objects, reverse=True))


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.MD").write_bytes("\ufeffone\r\n\r\none\rtwo  three".encode())
    p = lambda *texts: "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"
    doc = lambda tag, inner: f'<w:{tag} xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{inner}</w:{tag}>'
    table = "<w:tbl><w:tr><w:tc>" + p("x") + p("y") + "</w:tc><w:tc>" + p("z &amp; w") + "</w:tc></w:tr></w:tbl>"
    for name, body in (("long", table + p("one", " two") + p("a paragraph with more than forty characters in it")), ("short", p("one") + table)):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            z.writestr("word/document.xml", doc("document", f"<w:body>{body}</w:body>"))
            z.writestr("word/header1.xml", doc("hdr", p("head")))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    cmap = zlib.compress(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange")
    fonts = [(5, b"<</Type/Font/ToUnicode 6 0 R>>"), (6, b"<</Filter/FlateDecode>>stream\n" + cmap + b"\nendstream")]
    first = b"BT /F1 12 Tf 10 700 Td <000100020003> Tj 0 -14 Td [<0004> -500 <0002>] TJ ET"
    second = rb"BT 1 0 0 1 5 5 Tm (Plain \(text\) \101\\) Tj 1 0 0 1 5 3 Tm (next) Tj T* (la\
st) ' ET"
    (tmp_path / "d.pdf").write_bytes(pdf_of([(first, True), (second, False)], fonts))
    held = b"30 0 31 30 " + b"<</Type/Catalog/Pages 31 0 R>> " + b"<</Type/Pages/Kids[32 0 R]>>"
    held = b"30 0 31 31 " + held[11:]
    packed = zlib.compress(held)
    stream = b"<</Type/ObjStm/N 2/First 11/Filter/FlateDecode>>stream\n" + packed + b"\nendstream"
    page = b"7 0 obj\n" + stream + b"\nendobj\n32 0 obj\n<</Type/Page/Contents 33 0 R>>\nendobj\n33 0 obj\n<<>>stream\n(in a stream) Tj\nendstream\nendobj"
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.5\n" + page)
    (tmp_path / "f.pdf").write_bytes(b"junk")
    (tmp_path / "empty").write_bytes(b" \n")
    rows = documents.read_documents(spark, str(tmp_path)).collect()
    got = {r["file_name"]: r["text"] for r in rows}
    assert got == {"a.txt": "中文", "b.MD": "one\ntwo three", "long.docx": "one two\na paragraph with more than forty characters in it\nx y | z & w", "short.docx": "one\nx\ny\nz & w\nhead", "bad.docx": "", "d.pdf": "中ab\nc a\nPlain (text) A\\\nnext\nlast", "e.pdf": "in a stream", "f.pdf": "", "empty": ""}
    assert {r["file_name"]: (r["suffix"], r["extractor"], r["error"] != "") for r in rows if r["text"] == ""} == {"bad.docx": ("docx", "docx", True), "f.pdf": ("pdf", "pdf", True), "empty": ("", "bytes", True)}
    assert all(r["char_count"] == len(r["text"]) and r["raw_size"] == os.path.getsize(tmp_path / r["file_name"]) for r in rows)
    assert documents.resume_input(spark, " a\r\na ").first()[:3] == ("text_input", "a", 1) and documents.resume_input(spark).first()["error"] and documents.resume_input(spark, "", str(tmp_path / "a.txt")).first()[:2] == ("upload", "中文")
    assert files.load_words(str(tmp_path / "none")) == set() and files.load_dictionary(str(tmp_path / "none")) == {}


def test_readable_text(spark):
    pages_ = {
        "<nav>skip this long navigation text</nav><p>A paragraph that is long enough.</p><p>short</p><script>var x = 'a long script text here'</script>": "A paragraph that is long enough.",
        None: "", "": "", "no tags but long enough to stay": "no tags but long enough to stay",
        "<!-- a comment that is long <p> enough -->one &amp; two &#233;&#x20AC; &lt;b&gt; end<br>x": "one & two é€ <b> end",
        "<P>joined <b>texts</b>   of\n a block</P><h2>second block, long enough</h2>": "joined texts of a block\nsecond block, long enough",
        "text before the end of it<script>never ends, long enough to stay": "text before the end of it",
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages_)], "i int, h string")
    assert [r["t"] for r in df.orderBy("i").select(pages.readable_text("h").alias("t")).collect()] == list(pages_.values())
    assert df.limit(0).select(pages.readable_text("h")).collect() == []


def test_posting(spark):
    page = """<div class="job-banner"><span class="name">Dev <b>Lead</b></span><span class="salary">\ue032\ue033K</span></div>
    <div class="job-detail"><p class="name"></p><ul class="tag-list"><li>X<li>3 years<li>BA</ul><div class="location-address">Road 1</div>
    <div class="job-sec-text">Do <b>it</b><i style="visibility: HIDDEN">no</i><script>var</script><span>kanzhun</span><br>boss well</div></div><div class="company-info"><a class="name">ACME</a></div>
    <div class="job-card-wrapper active"><a href="//x.org/1">l</a></div>"""
    df = spark.createDataFrame([(0, page, "u"), (1, None, None), (2, "<p>text</p>", "https://www.zhipin.com/a"), (3, '<div class="job-banner"><b class="boss-info-attr">Co · HR</b></div>', "https://www.zhipin.com/a")], "i int, h string, u string")
    got = {r["i"]: r["p"].asDict() for r in df.select("i", pages.posting("h", "u").alias("p")).collect()}
    blank = dict.fromkeys(got[1], "")
    assert got[0] == blank | {"city": "X", "experience": "3 years", "degree": "BA", "address": "Road 1", "company": "ACME", "detail": "Do\nit\nwell", "detail_url": "https://x.org/1"}
    assert got[1] == got[2] == blank | {"error": "no posting on the page"} and got[3] == blank | {"company": "Co", "detail_url": "https://www.zhipin.com/a"}
    found = df.filter("i = 0").select(pages.posting(F.regexp_replace("h", '"job-detail"', '"other"')).alias("p")).first()["p"]
    assert (found["title"], found["salary_raw"], found["salary"]) == ("Dev Lead", "\ue032\ue033K", "12K")


def test_posting_reads_only_closed_references(spark):
    page = '<div class="job-detail"><b class="name">a&amp b&amp;</b><p class="desc">&lt;x&gt &#65; &#66 &amp;lt; &nosuch; &&&amp</p><a class="more-job-btn" href="/j?a=1&copy=2&amp;b=3">m</a></div>'
    got = spark.createDataFrame([(page,)], "h string").select(pages.posting("h").alias("p")).first()["p"]
    assert (got["title"], got["detail"], got["detail_url"]) == ("a&amp b&", "<x&gt A &#66 &lt; &nosuch; &&&amp", "https://www.zhipin.com/j?a=1&copy=2&b=3")


def test_artifacts(spark, tmp_path):
    store = artifacts.Artifacts(spark, str(tmp_path / "s"))
    assert store.load("t") is None and store.records("t") == [] and store.list("t").count() == 0 and store.keep("t", 1) == 0
    one = spark.createDataFrame([(1, [1.5, None]), (None, None)], "i int, v array<double>")
    assert store.save("t", one, "s1", "first")["version"] == 1 and store.save("t", one.limit(0), "s2")["version"] == 2 and store.save("u", one)["version"] == 1
    assert artifacts.same_rows(store.load("t", 1), one) and store.load("t").count() == 0 and store.load("t", signature="s1") is None and store.load("t", 9) is None
    assert [(r["version"], r["rows"], r["note"]) for r in store.list("t").collect()] == [(2, 0, ""), (1, 2, "first")]
    late = artifacts.Artifacts(spark, str(tmp_path / "s"))
    late.records = lambda kind: []  # a writer that has not seen the others' versions
    assert late.save("t", one)["version"] == 3
    assert store.remembered("t", "s3", lambda: one).count() == 2 and store.remembered("t", "s3", lambda: 1 / 0).count() == 2 and store.records("t")[0]["version"] == 4
    assert store.keep("t", 1) == 3 and [r["version"] for r in store.records("t")] == [4] and len(os.listdir(tmp_path / "s" / "t")) == 1
    twice = one.union(one)
    assert not artifacts.same_rows(one, twice) and artifacts.same_rows(twice, one.select("v", "i").union(one.select("v", "i"))) and not artifacts.same_rows(one, one.select("i"))
    assert artifacts.reused(one, one, twice, lambda: 1 / 0) is twice and artifacts.reused(one, twice, twice, lambda: one) is one and artifacts.reused(one, None, None, lambda: one) is one
    assert artifacts.table_signature(one) == artifacts.table_signature(one.orderBy("i")) != artifacts.table_signature(twice)
    (tmp_path / "f.txt").write_text("a")
    before = artifacts.file_signature(spark, str(tmp_path / "f.txt"))
    (tmp_path / "f.txt").write_text("ab")
    assert before and before != artifacts.file_signature(spark, str(tmp_path / "f.txt")) and artifacts.file_signature(spark, str(tmp_path / "none")) == ""


def test_settings(spark, tmp_path, monkeypatch):
    store = artifacts.Artifacts(spark, str(tmp_path / "s"))
    assert settings.load(store) == settings.defaults() and len(settings.defaults()) == 36
    kept = settings.save(store, {"jd_struct_provider": "remote", "jd_struct_remote_base_url": "http://x", "jd_struct_remote_api_key": "k", "limit": 5})
    assert settings.load(store) == kept and "jd_struct_remote_api_key" not in kept and kept["limit"] == 5 and kept["jd_skill_provider"] == "local"
    monkeypatch.setenv("JD_STRUCT_API_KEY", "secret")
    c = settings.of_task(kept, "jd_structuring")
    assert (c.task, c.provider, c.model, c.url, c.secret) == ("jd_struct", "remote", "gpt-5.4", "http://x", "secret")
    c = settings.of_task(kept, "candidate_embedding")
    assert (c.model, c.url, c.secret, c.remote_enabled) == ("qwen3-embedding:8b", "http://localhost:11434/api/embeddings", "", False) and settings.of_task(kept, "odd").model == ""
    store.save("settings", spark.createDataFrame([("jd_skill_provider", "{bad"), ("jd_skill_local_model", None)], "key string, value string"))
    assert settings.load(store) == settings.defaults()


def test_captured(spark, tmp_path):
    empty = captured.load(spark, str(tmp_path / "none"))
    assert empty.columns == captured.COLUMNS and empty.count() == 0
    rows = spark.createDataFrame([("u1", "a", "x"), ("u1", "b", "y,\nz"), (None, "c", None)], "detail_url string, title string, detail string")
    for _ in range(2):
        captured.write(rows.coalesce(1), str(tmp_path / "c.csv"))
    back = captured.load(spark, str(tmp_path / "c.csv"))
    assert set(back.columns) == set(captured.COLUMNS) and {(r["detail_url"], r["title"], r["detail"]) for r in back.collect()} == {("u1", "b", "y,\nz"), ("", "c", "")}
    assert os.path.exists(tmp_path / "c.csv") and not os.path.exists(tmp_path / "c.csv.old") and not os.path.exists(tmp_path / "c.csv.new")

    store, asked = artifacts.Artifacts(spark, str(tmp_path / "s")), []

    def enrich(df):
        asked.append(df.count())
        return df.withColumn("size", F.length("v"))

    feed = lambda *rows: spark.createDataFrame(rows, "k string, n int, v string")
    first = captured.refresh(store, "c", feed(("a", 1, "x"), ("a", 2, "xx"), ("b", 1, None), (None, 9, "q")), "k", "n", enrich)
    assert first.counts == {"created": 2, "updated": 0, "unchanged": 0, "kept": 0} and {(r["k"], r["v"], r["size"]) for r in first.table.collect()} == {("a", "xx", 2), ("b", None, None)}
    again = captured.refresh(store, "c", feed(("a", 5, "xx"), ("b", 1, None)), "k", "n", enrich)
    assert again.counts["unchanged"] == 2 and again.version == 1 and asked == [2]
    third = captured.refresh(store, "c", feed(("b", 1, ""), ("c", 1, "new")), "k", "n", enrich)
    assert third.counts == {"created": 1, "updated": 1, "unchanged": 0, "kept": 1} and third.version == 2 and asked == [2, 2] and third.table.count() == 3
    assert captured.refresh(artifacts.Artifacts(spark, str(tmp_path / "e")), "c", first.table.select("k", "n", "v").limit(0), "k", "n", lambda d: d).counts["created"] == 0


def test_stream_in_batches(spark, tmp_path):
    schema = "k string, n long, at timestamp"
    for i, rows in enumerate([[("a", 1), ("b", 2)], [("a", 3), ("c", 4)]]):
        spark.createDataFrame(rows, "k string, n long").selectExpr("k", "n", "timestamp'2024-01-01' as at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        capture.upsert_batches(feed.select("k", "n"), str(tmp_path / "out"), "k", "n", str(tmp_path / "log")).awaitTermination()
    assert {tuple(r) for r in capture.snapshot(spark, str(tmp_path / "out")).select("k", "n").collect()} == {("a", 3), ("b", 2), ("c", 4)}
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = capture.without_repeats(feed, "at", "k").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "l2")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3


@pytest.mark.parametrize("name", ["tag_stats", "cooccurrence_edges", "trait_table", "exact_dedup", "job_match", "stream_upsert", "rule_sections"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalog.ORACLES[name]).df()
    plain = lambda d: sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in d[sorted(got.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


def test_whole_pages_are_read(spark):
    html = "".join(f"<p>paragraph {i} that is long enough to stay</p>" for i in range(2000))
    text = spark.createDataFrame([(html,)], "html string").select(pages.readable_text("html")).first()[0]
    assert len(text) > 60_000 and text.endswith("paragraph 1999 that is long enough to stay")


def test_tokenize_filter_keeps_every_document(spark, tmp_path):
    rows = [(1, "plain words here"), (2, "<b>bold</b> words"), (3, "see https://x.org/a now"), (4, None), (5, "a < b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n"] for r in catalog.QUERIES["tokenize_filter"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 2, 3: 2, 4: 0, 5: 0}


def test_missing_skills_counts_jobs_of_few_tags(spark, tmp_path):
    """Compared with the query's SQL, too."""
    tables = {
        "part": ([(1, "bolt blue"), (2, "red")], "p_partkey long, p_name string"),
        "lineitem": ([(10, 1), (11, 1), (11, 2)], "l_orderkey long, l_partkey long"),
        "orders": ([(10, 5, "1-URGENT"), (11, 5, "5-LOW"), (12, 6, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "customer": ([(5, 0, "A")], "c_custkey long, c_nationkey long, c_mktsegment string"),
        "nation": ([(0, "N")], "n_nationkey long, n_name string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["missing_skills"](spark, str(tmp_path)).collect()]
    assert got == con.execute(catalog.ORACLES["missing_skills"]).fetchall() == [("blue", 2)]


def test_all_sql_can_be_planned():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    for name, sql in catalog.ORACLES.items():
        assert con.execute(f"EXPLAIN {sql}").fetchall(), name
