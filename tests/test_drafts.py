from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from corpusloom.operators import evidence as ev
from corpusloom.operators import lint
from corpusloom.plans import drafts
from corpusloom.sources import landed, word

DRAFT = """# 1 One
### 1.2 Deep

| a | b |
|---|---|
| 1 | 2 | 3 |

text
```
# no heading
| x |
```
## 1.1 A
## 1.3 B
![p](x.png)"""


def test_lint(spark):
    df = spark.createDataFrame([(1, DRAFT), (2, None), (3, ""), (4, "word " * 600), (5, "word [3] " * 600)], "doc_id long, text string")
    got = {(r.doc_id, r.line_no, r.code) for r in lint.lint(df).collect()}
    assert got == {(1, 2, "HEADING_JUMP"), (1, 4, "NO_TEXT_AROUND"), (1, 6, "TABLE_COLUMNS"), (1, 2, "HEADING_NUMBER"), (1, 14, "HEADING_NUMBER"), (1, 15, "NO_TEXT_AROUND"), (4, 1, "NO_CITATION")}
    assert spark.createDataFrame([(4, "a\nb😀\nc")], "o int, t string").select(lint.line_of(F.col("o"), F.col("t"))).first()[0] == 2


def test_heading_numbers_of_any_length(spark):
    big = "9" * 50
    texts = [
        "# 9999999999999 A\n# 10000000000000 B\n# 10000000000002 C",
        "# 2147483647 A\n# 2147483648 B",
        f"# {big} A\n# 1{'0' * 50} B\n# 1{'0' * 49}1 C\n# 1{'0' * 49}1 D",
        "# 007 A\n# 8 B\n# 0 C\n# 01 D\n# 9 E\n# 10 F",
        "# 1" + ".1" * 9999 + " A\n# 1" + ".1" * 9998 + ".3 B",
        "word " * 500 + "\n[" + ", ".join(["12"] * 9999) + "]",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line_no) for r in lint.lint(df).collect() if r.code in ("HEADING_NUMBER", "NO_CITATION")}
    assert got == {(0, 1), (0, 3), (1, 1), (2, 1), (2, 4), (3, 1), (3, 3), (3, 5), (4, 2)}


def test_findings_by_source_of_long_numbers(spark, tmp_path):
    rows = [(1, "# 9999999999999 A", "web", None), (2, "# 1 A\n# 3000000000 B", "web", None), (3, f"# {'8' * 40} A\n# {'8' * 39}9 B", None, "body"), (4, "# 1 A", "web", None), (5, None, "web", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, section string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in drafts.findings_by_source(spark, str(tmp_path)).collect()} == {("web", "error", "HEADING_NUMBER", 2), (None, "error", "HEADING_NUMBER", 1)}


def test_evidence_spans(spark):
    text = "😀 May be; it may  be so, and It Is Likely that mayor may."
    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")
    rows = ev.phrase_evidence(df, "m", ["may", "it is likely that", "may be"]).orderBy("ord").collect()
    assert [r.excerpt for r in rows] == ["May be", "may  be", "It Is Likely that", "may"]
    assert all(text[r.span_start : r.span_end] == r.excerpt for r in rows)
    assert ev.traced(ev.phrase_evidence(df, "m", ["may"]), df).first().rate == 1.0


def test_terms(spark):
    text = "目标区间与目标函数，目标区间和目标函数；长句。长句！"
    assert ev.recurring_terms(text) == [("目标函数", 2), ("目标区间", 2), ("长句", 2)]
    got = {r.doc_id: tuple(r)[1:] for r in ev.term_clusters(spark.createDataFrame([(1, text), (2, None), (3, "abc")], "doc_id long, text string")).collect()}
    assert got == {1: (3, 1, 2, 6, 0.666667), 2: (0, 0, 0, 0, None), 3: (0, 0, 0, 0, None)}


def test_references(spark):
    c = spark.createDataFrame([("a", [1, 2, 9]), ("b", [1]), ("d", None)], "doc_id string, numbers array<int>")
    n = spark.createDataFrame([("a", 3), ("c", 2), ("d", 0)], "doc_id string, n_entries long")
    got = {r.doc_id: (r.n_cited, r.n_listed, r.dangling, r.uncited, r.jaccard) for r in ev.reference_links(c, n).collect()}
    assert got == {"a": (3, 3, 1, 1, 0.5), "b": (1, 0, 1, 0, 0.0), "c": (0, 2, 0, 2, 0.0), "d": (0, 0, 0, 0, None)}
    df = spark.createDataFrame([("[1] A, B. T. 2001. [2] C, D. U. 2002.\nx",)], "t string")
    assert df.select(ev.split_references(F.col("t"))).first()[0] == ["[1] A, B. T. 2001.", "[2] C, D. U. 2002.", "x"]
    lines = spark.createDataFrame([("[3] Wu, A. Title, 2001",), ("We see that 2001 was so.",)], "t string")
    assert [r[0] for r in lines.select(ev.is_reference(F.col("t"))).collect()] == [True, False]


def test_trees_and_intervals(spark):
    heads = spark.createDataFrame([("d", p, lv) for p, lv in enumerate([1, 2, 3, 2, 4, 1, 2])], "doc_id string, pos int, level int")
    assert [r.parent_pos for r in ev.heading_tree(heads).orderBy("pos").collect()] == [None, 0, 1, 0, 3, None, 5]
    s = spark.createDataFrame([("k", 0, 0, 10), ("k", 1, 12, 20)], "key string, no int, s_start int, s_end int")
    c = spark.createDataFrame([("k", x) for x in (0, 5, 11, 12, 25)] + [("z", 1)], "key string, c_start int")
    assert {(r.key, r.c_start): r.sentence_no for r in ev.clause_sentences(c, s).collect()} == {("k", 0): 0, ("k", 5): 0, ("k", 11): None, ("k", 12): 1, ("k", 25): None, ("z", 1): None}


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("A b",), ("a-B",), ("c",)], "n string")
    got = {r.n: r.slug for r in ev.unique_slugs(df, "n").collect()}
    assert got["c"] == "c" and got["A b"].startswith("a-b-") and got["A b"] != got["a-B"]
    assert [ev.chinese_number(x) for x in ("一百二十", "十二", "二〇一九", "12", "x", "", None)] == [120, 12, 2019, 12, None, None, None]
    keys = spark.createDataFrame([("10",), ("9",), ("A2",), ("a1",)], "k string")
    assert [r.k for r in keys.orderBy(ev.natural_key(F.col("k"))).collect()] == ["9", "10", "a1", "A2"]


def test_markup(spark):
    df = spark.createDataFrame([("# T\n\n- *a* [b](c) ![i](j)\n```\nx\n```\n| d |",)], "t string")
    assert df.select(ev.markdown_to_text(F.col("t"))).first()[0] == "T a b d"
    assert spark.createDataFrame([(r"\mathrm{ a b c } x",)], "t string").select(ev.compact_latex(F.col("t"))).first()[0] == r"\mathrm{abc} x"


def test_landed_responses(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2301.00001v2</id><title>A\n b</title><summary>s</summary><published>2023-01-01</published></entry></feed>'
    rows = [
        (1, "arxiv", atom),
        (1, "openalex", json.dumps({"results": [{"title": "T", "id": "u", "doi": "https://doi.org/10.1/x", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0]}, "cited_by_count": 3}]})),
        (1, "semantic_scholar", json.dumps({"data": [{"title": "S", "externalIds": {"ArXiv": "1"}, "year": None}]})),
        (1, "dblp", json.dumps({"result": {"hits": {"hit": [{"info": {"title": "D.", "year": "2019", "url": "z"}}]}}})),
        (1, "web", json.dumps({"webPages": {"value": [{"name": "<b>W</b>", "url": "w", "snippet": "x"}]}})),
        (2, "web", "{}"),
        (2, "arxiv", "<broken"),
        (2, "dblp", None),
    ]
    got = landed.parse_responses(spark.createDataFrame(rows, "query_id long, source string, body string")).collect()
    assert {(r.source, r.title, r.year, r.doi, r.arxiv_id) for r in got if r.error is None} == {("arxiv", "A b", 2023, None, "2301.00001"), ("openalex", "T", 2020, "10.1/x", None), ("semantic_scholar", "S", None, None, "1"), ("dblp", "D", 2019, None, None), ("web", "W", None, None, None)}
    assert next(r.snippet for r in got if r.source == "openalex") == "a b"
    assert {r.source for r in got if r.error} == {"web", "arxiv", "dblp"}
    pages = spark.createDataFrame([("u", "b", "x"), ("u", "a", " "), ("v", "c", "y"), ("v", "z", "n")], "url string, source string, body string")
    assert {(r.url, r.source) for r in landed.first_page(pages, ["a", "b", "c"]).collect()} == {("u", "b"), ("v", "c")}
    polls = spark.createDataFrame([("p", 1, 120.0, 60, 0, None), ("p", 2, 33.333, 60, 1000, None), ("q", 1, None, None, None, "timeout")], "provider string, polled_at long, used_percent double, window_minutes int, resets_at_ms long, error string")
    assert {(r.provider, r.used_percent, r.failed) for r in landed.usage_windows(polls).collect()} == {("p", 33.3, False), ("q", None, True)}


def test_word_in_depth(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda inner, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}{inner}</w:p>"
    t = lambda s: f"<w:r><w:t>{s}</w:t></w:r>"
    body = p(t("Abstract"), "Heading1") + p('<w:commentRangeStart w:id="7"/>' + t("marked one")) + p(t("two") + '<w:commentRangeEnd w:id="7"/>' + t(" out")) + p(t("Body"), "Heading1") + p(t("Keywords: a, b")) + p(t("rest"))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/comments.xml", f'<w:comments {ns}><w:comment w:id="7" w:author="x"><w:p>{t("why?")}</w:p></w:comment></w:comments>')
        z.writestr("word/media/i.png", b"")
    (tmp_path / "b.docx").write_bytes(b"no")
    rows = word.read_word(spark, str(tmp_path)).collect()
    got = [(r.kind, r.text, r.detail) for r in sorted(rows, key=lambda r: (r.path, r.no)) if r.path.endswith("a.docx")]
    assert ("comment", "why?", "marked one\ntwo") in got and ("picture", "i.png", "") in got
    assert ("heading", "Body", "1") in got and ("abstract", "marked one\ntwo out", "") in got and ("keywords", "a, b\nrest", "") in got
    assert [r.kind for r in rows if r.path.endswith("b.docx")] == ["broken"]
