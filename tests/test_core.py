"""Operators on small tables, and every query with SQL against DuckDB."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import conversion, evidence, graph, retrieval, sections, verify
from lexmill.operators.components import components
from lexmill.plans import catalogue


def test_no_core_module_needs_the_llm_package():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "lexmill")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            assert not any("lexmill.llm" in open(os.path.join(folder, f), encoding="utf-8").read() for f in files if f.endswith(".py"))


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("a, b, same", [("借款 500，000 元", "借款500,000元", True), ("**甲方**（签字）", "甲方(签字)", True), ("500,001", "500,000", False), ("a<b>c", "ac", True), ("3 < 5", "3<5", True)])
def test_norm_quote(spark, a, b, same):
    assert (one(spark, X.norm_quote, a) == one(spark, X.norm_quote, b)) == same


def test_text_functions(spark):
    assert one(spark, X.norm_reading, "１,234,567 元，500,000元") == "1234567元,500,000元"
    assert one(spark, X.clean_passage, "# T\n![i](u)[l](u) <b>x</b> <50,000元>\n|---|\n\n\n\nhttps://a.b/c。**y**") == "T\nl x <50,000元>\n\n。y"
    assert one(spark, X.fragments, "甲方…乙方...签字…") == ["甲方", "乙方", "签字"]
    assert one(spark, X.snippet, " a\n\n b　c ") == "a b c"
    assert one(spark, X.tokens, "Hello 合同款 x1 甲") == ["hello", "x1", "合同", "同款", "甲"]
    assert one(spark, X.yaml_value, 'a: "b"') == '"a: \\"b\\""'
    assert one(spark, X.tokens, None) is None


def test_sections_and_outline(spark):
    docs = spark.createDataFrame([(1, "pre\n# A\n## B\ntext\n### C\n## D #\nx\n"), (2, None), (3, ""), (4, "```\n# no\n```\n# yes\n#tag\n### deep\n## mid"), (5, "### low first\n# top")], "id int, text string")
    got = sorted((r.id, r.sec, r.heading_path, r.body) for r in sections.sections(docs, "id").collect())
    assert got[:5] == [(1, 0, "", "pre"), (1, 1, "A", ""), (1, 2, "A > B", "text"), (1, 3, "A > B > C", ""), (1, 4, "A > D", "x")]
    assert [r[2] for r in got if r[0] == 5] == ["low first", "top"]
    tree = sorted((r.id, r.idx, r.level, r.title, r.line_start, r.line_end, r.parent_idx) for r in sections.outline(docs, "id").collect())
    assert [t for t in tree if t[0] == 4] == [(4, 0, 1, "yes", 3, 6, None), (4, 1, 3, "deep", 5, 5, 0), (4, 2, 2, "mid", 6, 6, 0)]


def test_tables_and_packing(spark):
    docs = spark.createDataFrame([(1, "a\n| x | y |\n|---|---|\n| 1 | 2 |\nb\n| z |\n")], "id int, text string")
    assert sorted((r.first_line, r.n_rows, r.n_columns) for r in sections.tables(docs, "id").collect()) == [(1, 3, 2), (5, 1, 1)]
    rng = random.Random(1)
    rows = [(k, i, "字" * rng.randint(1, 30)) for k in range(5) for i in range(rng.randint(1, 40))]
    units = spark.createDataFrame(rows, "k int, i int, u string")
    for overlap in (0, 20):
        out = sections.packed(units, ["k"], "i", "u", 50, overlap).collect()
        for k in range(5):
            own, want, now = [r.text.split("\n\n") for r in sorted((r for r in out if r.k == k), key=lambda r: r.chunk)], [], []
            for _, _, u in [r for r in rows if r[0] == k]:
                if now and sum(map(len, now)) + len(u) > 50:
                    want.append(now)
                    kept = []
                    for x in reversed(now):
                        if sum(map(len, kept)) + len(x) > overlap:
                            break
                        kept.insert(0, x)
                    now = kept if sum(map(len, kept)) + len(u) <= 50 else []
                now = [*now, u]
            assert own == [*want, now]


def test_anchors(spark):
    body = "借款人向出借人借款 500,000 元，甲方于六月签字，乙方于七月盖章。"
    quotes = [("500，000元", "ok"), ("500,001", "mismatch"), ("甲方…乙方", "ok"), ("乙方…甲方", "mismatch"), ("**借款人**", "ok")]
    text = "\n".join(f"事实〔来源: _md/a.md：「{q}」〕" for q, _ in quotes) + "〔来源: _md/none.md：「x」〕〔来源: _md/s.md：「x」〕〔来源: _md/s.md：「x」〕（未核验）"
    pages = spark.createDataFrame([(1, text), (2, None), (3, "no")], "id int, text string")
    sources = spark.createDataFrame([("_md/a.md", body, False), ("_md/s.md", "x", True)], "source string, body string, suspect boolean")
    got = [r.verdict for r in verify.verify_anchors(verify.anchors(pages, "id"), sources).orderBy("anchor_no").collect()]
    assert got == [v for _, v in quotes] + ["missing", "unmarked", "ok"]
    claims = verify.claims(spark.createDataFrame([(1, "# h〔来源: a：「q」〕\n一〔来源: a：「q」〕二〔来源: b：「r」〕（未核验）")], "id int, text string"), "id").orderBy("claim_no").collect()
    assert [(c.claim, c.source, c.quote) for c in claims] == [("一", "a", "q"), ("二", "b", "r")]


@pytest.mark.parametrize("path, inside", [("_md/a.md", True), ("_md/../wiki/a.md", False), ("outside.md", False), ("_md\\b\\..\\c.md", True), ("/_md/a.md", False), ("_md/../_md/x", True), ("../_md/x", False)])
def test_closed_world(spark, path, inside):
    assert one(spark, verify.closed_world, path) == inside


def test_closures_dates_skips_links(spark):
    lines = ["> [!check] 128,205 + 128,205 + 25,641 == 282,051", "> [!check] 1,000 ＋ 1 ＝＝ 1,002", "> [!check] 1 + x == 2", "plain"]
    got = verify.closures(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), "line").orderBy("i").collect()
    assert [r.verdict for r in got] == ["ok", "wrong", "unreadable", "unreadable"]
    entries = spark.createDataFrame([("p", i, x) for i, x in enumerate(["- 2020年5月1日 a", "- 2020年 b", "- 2019年12月 c", "- none", "- 2020年1月2日 d", "- 2020年1月1日 e"])], "page string, i int, line string")
    assert [r.i for r in verify.out_of_order(entries, "page", "i", "line").orderBy("i").collect()] == [2, 5]
    log = "## [2026-01-01] skip | a\\b.pdf\n- 原因：broken\n## [2026-01-02] skip | c.pdf\n- 原因： \n# other\n- 原因：not for c\n## [2026-01-03] skip | c.pdf\n"
    skips = {r.path: r.has_reason for r in verify.skip_ledger(spark.createDataFrame([(1, log), (2, None)], "id int, text string"), "id").collect()}
    assert skips == {"a/b.pdf": True, "c.pdf": False}
    pages = spark.createDataFrame([(1, "[[甲|x]] [[乙#s]] [[#here]] [[丙]]"), (2, None)], "id int, text string")
    names = spark.createDataFrame([("甲",), ("乙",), ("甲",)], "name string")
    assert [(r.id, r.target) for r in verify.dead_links(verify.links(pages, "id"), names).collect()] == [(1, "丙")]


def test_unanchored(spark):
    text = "\n".join(
        ["# 标题", "事实一", "事实二〔来源: a：「b」〕", "事实三〔来源: a：「b」〕，另有其他", "## 付款情况", "## 甲方欠款", "# 标题", "> [!note] 分析", "> 意见", "", "> 仍是意见", "事实四", "> [!check] 1 + 1 == 2", "> 引文", "| a | b |", "|---|---|", "| 1 | 2 |",
         "```", "code", "```", "- [[甲]]", "未在本案材料中找到。", "未在本案材料中找到，但是", "> [!warning] ⚠ 冲突", "***", "[[甲|乙]]", "结论〔来源: a：「b」〕（未核验）。"]
    )
    pages = spark.createDataFrame([(1, "标题", "---\nsource: x\n---\n\n" + text), (2, "t", None)], "id int, title string, text string")
    bare = ["事实一", "事实三〔来源: a：「b」〕，另有其他", "## 甲方欠款", "# 标题", "事实四", "引文", "| 1 | 2 |", "code", "未在本案材料中找到，但是", "[[甲|乙]]"]
    assert [r.line for r in verify.unanchored(pages, "id", title="title", navigation=True).orderBy("line_no").collect()] == bare
    assert [r.line for r in verify.unanchored(pages, "id").orderBy("line_no").collect()] == ["# 标题", *bare[:7], bare[7], "- [[甲]]", *bare[8:]]


def test_gate_and_provenance(spark):
    drafts = spark.createDataFrame([(1, "事实〔来源: _md/a.md：「甲方付款」〕"), (2, "裸事实\n> [!check] 1+1==3"), (3, "x〔来源: b.md：「甲方」〕"), (4, "")], "id int, text string")
    sources = spark.createDataFrame([("_md/a.md", "甲方 付款。", False), ("b.md", "甲方", False)], "source string, body string, suspect boolean")
    got = {r.id: tuple(r)[1:] for r in verify.gate(drafts, "id", sources).collect()}
    assert got == {1: (0, 0, 0, 0, 0), 2: (0, 0, 1, 1, 1), 3: (0, 1, 0, 0, 1), 4: (0, 0, 0, 0, 0)}
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    page = lambda version, source, s, c, text: "---\n" + "".join(f"{k}: {v}\n" for k, v in (("provenance_version", version), ("source", source), ("source_sha256", s), ("content_sha256", c)) if v) + "---\n\n" + text
    pages = [(1, page("1", "a.pdf", sha("A"), sha("t\r\n"), "t\r\n")), (2, page(None, "a.pdf", sha("A"), sha("t"), "t")), (3, page("2", "a.pdf", sha("B"), sha("t"), "u")), (4, page("1", None, sha("A"), sha("t"), "t")), (5, page("1", "z.pdf", sha("A"), None, "t")), (6, "plain"), (7, None)]
    found = verify.provenance(spark.createDataFrame(pages, "id int, text string"), spark.createDataFrame([("a.pdf", sha("A"))], "source string, sha string"))
    assert {r.id: r.findings for r in found.collect()} == {2: "legacy", 3: "unsupported, original changed, body changed", 4: "incomplete, no original", 5: "incomplete, no original", 6: "legacy", 7: "legacy"}


def test_routes_names_quality(spark):
    paths = {"a/b.pdf": "ocr", "x.DOCX": "native", "y.doc": "legacy", "z.xls": "anydoc", "p.png": "ocr", "noext": "unsupported", "q.zip": "unsupported"}
    got = spark.createDataFrame([(p,) for p in paths], "x string").select("x", conversion.route(F.col("x")).alias("r")).collect()
    assert {r.x: r.r for r in got} == paths
    files = spark.createDataFrame([("d/report.pdf",), ("d/report.docx",), ("d/other.txt",)], "path string")
    assert {r.path: r.out_path for r in conversion.output_names(files, "path").collect()} == {"d/report.pdf": "d/report.pdf.md", "d/report.docx": "d/report.docx.md", "d/other.txt": "d/other.md"}
    rows = [(1, "x" * 100, None, None), (2, "short", None, None), (3, "y" * 60, 2, None), (4, ("a line that repeats\n") * 31, None, None), (5, "z" * 100, None, [0.9, 0.5]), (6, None, None, None), (7, "ok" * 20 + "́□" * 5, None, None)]
    q = {r.id: r for r in conversion.quality(spark.createDataFrame(rows, "id int, text string, pages int, confidences array<double>")).collect()}
    assert {i for i, r in q.items() if r.suspect} == {2, 3, 4, 5, 6, 7} and q[4].most_repeated == 31 and q[5].low == 1
    pairs = spark.createDataFrame([("共500000元，2020年", "共800000元，2020年"), ("1 2 3", "1 3"), ("a", "b"), ("1,234", "1234")], "a string, b string")
    assert [r.n for r in pairs.select(conversion.digit_mismatches(F.col("a"), F.col("b")).alias("n")).collect()] == [1, 1, 0, 0]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple apple cherry"), (3, "durian"), (4, None), (5, "")], "id int, text string")
    index = retrieval.postings(docs, "id", F.col("text"))
    queries = spark.createDataFrame([(9, "apple"), (9, "cherry"), (8, "none")], "query int, term string")
    got = retrieval.bm25(index, "id", queries, 5).orderBy("rank").collect()
    assert [(r.query, r.id) for r in got] == [(9, 2), (9, 1)] and got[0].score > got[1].score
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "id bigint, v array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query bigint, vector array<double>")
    assert [(r.rank, r.id, r.score) for r in retrieval.cosine(vectors, "id", "v", asked, 3).orderBy("rank").collect()] == [(0, 1, 1.0), (1, 5, 1.0), (2, 2, 0.7071)]
    assert retrieval.cosine(vectors, "id", "v", asked, 3, floor=0.9).count() == 2 and retrieval.cosine(vectors, "id", "v", asked.limit(0), 3).count() == 0
    a = spark.createDataFrame([(1, 10, 0), (1, 20, 1)], "query int, id int, rank int")
    b = spark.createDataFrame([(1, 20, 0), (1, 30, 1)], "query int, id int, rank int")
    assert [(r.id, r.score) for r in retrieval.fuse(a, b, "id", 5).orderBy("rank").collect()] == [(20, round(1 / 61 + 1 / 60, 6)), (10, round(1 / 60, 6)), (30, round(1 / 61, 6))]


def test_terms(spark):
    rows = spark.createDataFrame([(1, i, "甲乙丙" if i % 2 else "乙") for i in range(50)] + [(2, 0, "none")], "doc_id bigint, line_no int, norm string")
    terms = spark.createDataFrame([("a", "甲乙"), ("b", "乙"), ("c", "丁"), ("d", ""), ("e", "乙"), ("b", "乙")], "term string, wanted string")
    want = sorted([("a", 1, i) for i in range(1, 50, 2)] + [(t, 1, i) for t in "be" for i in range(50)])
    assert sorted(tuple(r) for r in evidence.find_terms(rows, terms).collect()) == want
    assert evidence.find_terms(rows, terms.filter("term = 'd'")).count() == 0
    first = evidence.capped(evidence.find_terms(rows, terms)).collect()
    assert all(r.truncated for r in first) and sorted((r.term, r.line_no) for r in first) == sorted([("a", i) for i in range(1, 40, 2)] + [(t, i) for t in "be" for i in range(20)])


def test_small_text_rules(spark):
    assert one(spark, X.mark_images, "a ![x](d/p.png) ![alt]() ![]() <img src=\"d/q.jpg\" w=1><div> </div>") == "a 〔图像：p.png —— 已省略未保留，请查原件〕 〔图像：alt —— 已省略未保留，请查原件〕 〔图像：未命名 —— 已省略未保留，请查原件〕 〔图像：q.jpg —— 已省略未保留，请查原件〕"
    assert one(spark, X.json_slice, 'x {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and one(spark, X.json_slice, "none") is None
    assert [one(spark, X.safe_asset, p) for p in ("a/b.png", "../a", "/a", "a/../b", "C:\\a", "a..b")] == [True, False, False, False, False, True]


def test_graphs(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for pair in pairs for x in pair}
    links = spark.createDataFrame([("甲", "乙方"), ("乙", "丙"), ("丁", "丁"), ("甲", "nobody")], "node string, target string")
    names = spark.createDataFrame([("甲", "甲"), ("乙方", "乙"), ("乙", "乙"), ("丙", "丙"), ("丁", "丁")], "name string, node string")
    g = graph.edges(links, names)
    assert sorted(tuple(r) for r in g.collect()) == sorted([("甲", "乙"), ("乙", "甲"), ("乙", "丙"), ("丙", "乙")])
    steps = graph.distances(g, spark.createDataFrame([("甲",)], "node string"))
    assert {(r.node, r.distance, r.parent) for r in steps.collect()} == {("甲", 0, None), ("乙", 1, "甲"), ("丙", 2, "乙")}


def plain(df):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return f"{float(v):.6f}"
        return str(v)

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(value).astype(object)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(small):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    ours, theirs = plain(catalogue.queries()[name](spark, small).toPandas()), plain(db.sql(catalogue.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns) and ours.equals(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_chunks_keep_the_budget(spark, small):
    rows = catalogue.queries()["chunk_document"](spark, small).filter("chunk > 0 or n_tokens <= 384")
    assert rows.filter("n_tokens > 384 and text like '%\n\n%'").count() == 0


def test_units_keep_the_limit(spark):
    assert sections.split_prose("a\n \nb", 10) == ["a", "b"]
    sentence = "字" * 149 + "。"
    assert sections.split_prose(sentence * 2, 384) == [sentence * 2] and sections.split_prose(sentence * 3, 384) == [sentence] * 3
    assert sections.split_prose("字" * 10, 4) == ["字" * 4, "字" * 4, "字" * 2]
    assert sections.split_structured("前\n一、甲（一）乙\n（二）丙，本院认为丁依第八条戊", 384) == ["前", "一、甲（一）乙", "（二）丙，", "本院认为丁依", "第八条戊"]
    head, rows = "| 甲 | 乙 |\n|---|---|", [f"| {i} | 内容内容 |" for i in range(30)]
    block = "\n".join([head, *rows])
    assert sections.split_structured(f"前\n{block}\n后", 384) == ["前", block, "后"]
    pieces = sections.split_structured(block, 40)
    assert len(pieces) > 1 and all(p.startswith(head + "\n") for p in pieces) and [r for p in pieces for r in p.split("\n")[2:]] == rows
    rng = random.Random(5)
    for limit in (7, 40, 192):
        for _ in range(60):
            text = "".join(rng.choice(["字" * rng.randint(1, 300), "x" * rng.randint(1, 1500), "。", "\n", "\n\n", "\n| " + "格" * rng.randint(1, 200) + " | 1 |\n", "\n|--|--|\n", "第三条"]) for _ in range(rng.randint(1, 25)))
            out = sections.split_structured(text, limit)
            assert all(0 < sections.count_tokens(u) <= limit for u in out)
            left = "".join("".join(out).split())
            assert "|" in text or left == "".join(text.split())
            assert {c: left.count(c) >= text.count(c) for c in "字x格。第"} == dict.fromkeys("字x格。第", True)
    texts = ["", "字", "abc", "abcd字e", "𠀀一龥\n"]
    counted = spark.createDataFrame([(t,) for t in texts], "x string").select("x", sections.approximate_tokens(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in counted} == {t: sections.count_tokens(t) for t in texts}


@pytest.mark.parametrize("name, limit", [("chunk_document", 384), ("chunk_hierarchical", 192), ("table_split", 96)])
def test_no_chunk_is_above_its_limit(spark, small, name, limit):
    rows = catalogue.queries()[name](spark, small)
    assert rows.count() > 0 and rows.filter(F.col("n_tokens") > limit).count() == 0


def test_evidence_is_whole(spark):
    long = "前言\n" + "字" * 500 + "\n证据在后"
    docs = spark.createDataFrame([(1, long), (2, "---\nquality: suspect\n---\n\n# 题\n甲方 a\n## 次"), (3, None)], "doc_id bigint, text string")
    hits = spark.createDataFrame([(50, 0, 1, 0.5), (50, 1, 2, 0.4), (50, 2, 3, 0.3)], "query bigint, rank int, doc_id bigint, score double")
    asked = spark.createDataFrame([(50, "甲方"), (50, "无"), (100, "甲方"), (100, "甲方")], "query bigint, term string")
    grep = spark.createDataFrame([("甲方", 2, 5, True)], "term string, doc_id bigint, line_no int, truncated boolean")
    rows = evidence.bundle(hits, asked, grep, docs, sections.outline(docs, "doc_id")).collect()
    of = lambda kind: [r for r in rows if r.kind == kind]
    assert {r.rank: r.anchor for r in of("hit")} == {0: "〔来源: _md/1.md：「" + long.replace("\n", " ") + "」〕", 1: "〔来源: _md/2.md：「# 题 甲方 a ## 次」〕（未核验）", 2: None}
    assert {r.rank: (r.n_headings, r.first_heading) for r in of("hit")} == {0: (0, None), 1: (2, "题"), 2: (0, None)}
    assert sorted((r.query, r.term, r.doc_id, r.line_no, r.truncated, r.anchor) for r in of("grep")) == [(q, "甲方", 2, 5, True, "〔来源: _md/2.md：「甲方 a」〕（未核验）") for q in (50, 100)]
    assert [(r.query, r.term) for r in of("not_found")] == [(50, "无")]
    assert sorted((r.query, r.doc_id, r.level, r.title, r.parent_idx) for r in of("outline")) == [(None, 2, 1, "题", None), (None, 2, 2, "次", 0)]


def test_evidence_bundle_has_every_channel(spark, small):
    rows = catalogue.queries()["evidence_bundle"](spark, small)
    texts = catalogue.table(spark, small, "documents").filter("text is not null")
    assert rows.filter("kind = 'hit'").join(texts, "doc_id").filter(~F.contains("anchor", X.snippet(X.body(F.col("text"))))).count() == 0
    assert rows.filter("kind = 'outline'").count() == catalogue.queries()["outline_tree"](spark, small).count() > 0
    found = {(r.term, r.doc_id, r.line_no, r.truncated) for r in catalogue.queries()["grep_terms"](spark, small).collect()}
    ours = {(r.term, r.doc_id, r.line_no, r.truncated) for r in rows.filter("kind = 'grep'").collect()}
    assert ours and ours == {f for f in found if f[0] in {t for t, *_ in ours}}


def test_paths_have_no_limit(spark):
    rng = random.Random(8)
    pairs = {(f"n{i:02}", f"n{i + 1:02}") for i in range(14)} | {(f"x{rng.randrange(12):02}", f"x{rng.randrange(12):02}") for _ in range(14)} | {("n00", "x03"), ("n00", "x07"), ("lone", "lost")}
    pairs = {(a, b) for a, b in pairs if a != b}
    g = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "a string, b string").distinct()
    start = spark.createDataFrame([("n00",)], "node string")
    sides: dict[str, set[str]] = {}
    for a, b in pairs:
        sides.setdefault(a, set()).add(b)
        sides.setdefault(b, set()).add(a)
    want, queue = {"n00": ["n00"]}, ["n00"]
    for now in queue:
        for near in sorted(sides[now]):
            if near not in want:
                want[near] = [*want[now], near]
                queue.append(near)
    assert len(want["n14"]) == 15 and "lost" not in want
    assert {r.node: r.distance for r in graph.distances(g, start).collect()} == {n: len(p) - 1 for n, p in want.items()}
    assert {r.node: (r.hops, r.path) for r in graph.paths(g, start).collect()} == {n: (len(want[n]) - 1, want[n]) if n in want else (None, None) for n in sides}


# --- rules that a query and its SQL could share a mistake in: cases by hand


def each(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_forms_by_hand(spark):
    assert each(spark, X.norm_quote, "甲→乙", "甲－乙", "<b>（a）</b>，“b” 3,000") == ["甲→乙", "甲-乙", '(a)"b"3000']
    assert each(spark, X.norm_reading, "１，２３４，５６７元 ＡＢｚ", "1,234,567,890", "a、b％～－！？", "3,0001") == ["1234,567元ABz", "1234567890", "a,b%~-！？", "3,0001"]
    assert each(spark, X.clean_passage, "参见https://example.invalid/a。第3条应付款50,000.00元", "借款<50,000.00元，第3条见后续>", "a\rb\n---\nc", "  ```py\nx\n```", "<b class='x'>y</b>") == [
        "参见。第3条应付款50,000.00元", "借款<50,000.00元，第3条见后续>", "a\nb\n\nc", "\nx\n", "y",
    ]
    assert each(spark, X.query_variants, "甲 的 违约金", "违约金 合同", "甲方 乙方 违约金", "合同 的 违约金 是 多少", "", "的 是") == [["违约金"], [], ["违约金 甲方"], ["合同 违约金 多少", "违约金 合同"], [], []]
    assert each(spark, lambda c: conversion.route(c), "a.gif", "b.XML", "c.epub", "d.eml", "e.wps", "f.xlsb", "g") == ["ocr", "native", "native", "unsupported", "legacy", "anydoc", "unsupported"]


def test_closures_of_all_kinds(spark):
    lines = ["128,205 + 128,205 + 25,641 == 282,051", "1,000 + 1 == 1,002", "2*(3-1)==4", "-(2-5)*2 == 6", "１＋２==3", "1 + 1 == 2 or so", "(1==1", "1==1==1", "5-2-1==2", "2*-3 == -6"]
    df = spark.createDataFrame([(i, "> [!check] " + x) for i, x in enumerate(lines)], "i int, line string")
    got = [r.verdict for r in verify.closures(df, "line").orderBy("i").collect()]
    assert got == ["ok", "wrong", "ok", "ok", "ok", "unreadable", "unreadable", "unreadable", "ok", "ok"]


def test_terms_of_any_number_and_length(spark):
    rows = spark.createDataFrame([(1, 0, "abcabc"), (1, 1, "x"), (2, 0, "a\nbc甲乙"), (3, 0, "")], "doc_id bigint, line_no int, norm string")
    terms = spark.createDataFrame([("t1", "abc"), ("t2", "x"), ("t3", "甲乙"), ("t4", ""), ("t5", "abc"), ("t6", "bc甲"), ("t7", "zz"), ("t1", "abc")], "term string, wanted string")
    got = sorted(tuple(r) for r in evidence.find_terms(rows, terms).collect())
    assert got == [("t1", 1, 0), ("t2", 1, 1), ("t3", 2, 0), ("t5", 1, 0), ("t6", 2, 0)]
    many = spark.range(150_000).selectExpr("cast(id as string) as term", "concat('k', id, 'e') as wanted")
    assert evidence.find_terms(spark.createDataFrame([(1, 0, "k77e-k140000e")], "doc_id bigint, line_no int, norm string"), many).count() == 2
    assert evidence.find_terms(rows, terms.limit(0)).count() == 0 == evidence.find_terms(rows.limit(0), terms).count()


def test_limits_reach_the_tasks(spark):
    scored = spark.range(1000).selectExpr("id % 7 as query", "id as doc", "cast(id % 13 as double) as score")
    ranked = retrieval.ranked(scored, "doc", 3)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    assert sorted({r.rank for r in ranked.collect()}) == [0, 1, 2]
