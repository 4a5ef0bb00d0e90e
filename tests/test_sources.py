from __future__ import annotations

import json
import struct
import zipfile

import pytest

from corpusloom.sources import blocks, images, lexicons, sinks, sql
from corpusloom.streaming import ingest


def test_block_lists(spark, tmp_path):
    for doc, content in (("a", [{"type": "text", "text": "T", "text_level": 1}, {"type": "table", "table_body": "<table/>", "table_caption": ["Table 1", None]}]), ("b", {"type": "text"}), ("c", "x")):
        (tmp_path / doc).mkdir()
        (tmp_path / doc / f"{doc}_content_list.json").write_text(json.dumps(content) if doc != "c" else "[{broken")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "other.txt").write_text("x")
    rows, broken = blocks.read_block_lists(spark, str(tmp_path))
    assert [(r.block_index, r.type, r.caption) for r in rows.orderBy("path", "block_index").collect() if r.type] == [(0, "text", ""), (1, "table", "Table 1")]
    assert {r.reason for r in broken.collect()} >= {"not a list"}
    docs, skipped = blocks.discover(spark, str(tmp_path))
    assert {r.doc for r in docs.collect()} == {"a", "b", "c"}
    assert [(r.doc, r.reason) for r in skipped.collect()] == [("d", "no block list")]


MARKDOWN = """---
title: x
---
# Head
Some text
on two lines.

- one
- two

| a | b <<2 | |
| --- | --- | --- |
| 1 \\| 2 | ^^ | 3 |

```py
code
```
$$
x = 1
$$
![cap](i.png)
"""


def test_markdown():
    got = blocks.markdown_blocks(MARKDOWN)
    assert [(k, t) for k, t, _, _ in got] == [("text", "Head"), ("text", "Some text on two lines."), ("list", "one\ntwo"), ("table", ""), ("code", "code"), ("equation", "x = 1"), ("image", "cap")]
    assert got[0][2] == 1
    assert 'colspan="2"' in got[3][3] and "1 | 2" in got[3][3]
    assert blocks.front_matter("no header") == ("no header", "")


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# H\n\ntext")
    (tmp_path / "b.txt").write_text("one\nline\n\ntwo")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>after</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "d.docx").write_bytes(b"no zip")
    rows = blocks.read_documents(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc, r.block_index)):
        by.setdefault(r.doc[-6:].split("/")[-1], []).append((r.type, r.text, r.level))
    assert by["a.md"] == [("text", "H", 1), ("text", "text", None)]
    assert by["b.txt"] == [("text", "one line", None), ("text", "two", None)]
    assert by["c.docx"] == [("text", "Title", 1), ("table", "", None), ("text", "after", None)]
    assert by["d.docx"] == [("broken", "", None)]


def test_image_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20))
    (tmp_path / "b.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 8) + b"xx")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 8)
    (tmp_path / "d.svg").write_text('<?xml version="1.0"?><svg viewBox="0 0 40 50"></svg>')
    (tmp_path / "e.png").write_bytes(b"no image")
    got = {r.path[-5:]: (r.width, r.height) for r in images.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (30, 20), "b.gif": (7, 8), "c.jpg": (6, 5), "d.svg": (40, 50), "e.png": (None, None)}


def test_bounded_sql(spark):
    spark.range(5000).createOrReplaceTempView("many")
    meta, df = sql.bounded_sql(spark, "WITH a AS (SELECT id FROM many) SELECT * FROM a", 5000)
    assert meta["limit_applied"] == 1000 and df.count() == 1000
    assert sql.bounded_sql(spark, "-- drop\nselect 1 AS x")[1].count() == 1
    assert (sql.choose_limit(None), sql.choose_limit(0), sql.choose_limit(7)) == (200, 1, 7)
    for bad in ("DROP TABLE many", "CREATE TABLE t AS SELECT 1", "INSERT INTO many SELECT 1", "WITH a AS (SELECT 1) INSERT INTO many SELECT * FROM a", "SET x=1"):
        with pytest.raises(PermissionError):
            sql.bounded_sql(spark, bad)


def test_ddl_model():
    got = sql.ddl_model("CREATE TABLE a (id INT PRIMARY KEY, n VARCHAR(10) NOT NULL DEFAULT 'x', u INT UNIQUE, CONSTRAINT c UNIQUE (n, u)); -- t\nCREATE TABLE s.b (x DECIMAL(10, 2)); ALTER TABLE b ADD CONSTRAINT k PRIMARY KEY (x);")
    assert [t["name"] for t in got] == ["a", "b"]
    assert got[0]["primary_key"] == ["id"] and got[0]["unique_sets"] == [["n", "u"]]
    assert [(c["name"], c["type"], c["nullable"], c["default"]) for c in got[0]["columns"]] == [("id", "INT", False, None), ("n", "VARCHAR(10)", False, "'x'"), ("u", "INT", True, None)]
    assert got[1]["primary_key"] == ["x"] and got[1]["columns"][0]["type"] == "DECIMAL(10,2)"


def test_lexicons(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"name": "hedges", "version": "1", "entries": ["may ", "May", "", "can"]}))
    (tmp_path / "b.json").write_text(json.dumps({"name": "boosters", "version": "2", "entries": ["can"]}))
    (tmp_path / "c.json").write_text(json.dumps({"name": "links", "version": "1", "groups": {"x": ["so"], "y": ["so", "as"]}}))
    rows = lexicons.read_lexicons(spark, str(tmp_path))
    assert rows.filter("name = 'hedges'").count() == 2
    assert {(r.problem, r.detail) for r in lexicons.lexicon_problems(rows).collect()} == {("versions differ", "1,2"), ("in hedges and boosters", "can"), ("in two groups", "so")}


def test_sinks(spark, tmp_path):
    assert sinks.canonical_json({"b": 1.23456789, "a": [float("nan"), "é"]}) == '{"a":[null,"é"],"b":1.234568}\n'
    df = spark.createDataFrame([("m", 0.5, None), ("a", 1.0, "x|y")], "metric string, low double, reason string")
    assert sinks.yaml_clauses(df).startswith('- metric: "a"\n  low: 1.0\n  reason: "x|y"\n- metric: "m"')
    assert "x\\|y" in sinks.markdown_table(df)
    with pytest.raises(ValueError):
        sinks.bounded_rows(df, 1)
    sinks.append_history(spark.sql("SELECT 1 AS id, current_timestamp() AS ts, 'q' AS query"), str(tmp_path / "h"))
    sinks.write_sheet(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 1


def test_jsonable(spark):
    df = spark.sql("SELECT CAST(1.50 AS DECIMAL(5,2)) AS d, encode('x', 'UTF-8') AS b, DATE'2025-01-02' AS t, CAST(NULL AS INT) AS n")
    assert json.loads(sql.jsonable(df).first().value) == {"d": 1.5, "b": "x", "t": "2025-01-02", "n": None}


def test_streams(spark, tmp_path):
    rows = [(1, "2025-01-01 00:00:00", 1, "click", 1.0), (1, "2025-01-01 00:00:00", 1, "click", 1.0), (2, "2025-01-01 00:10:00", 1, "view", 2.0), (3, "2025-01-03 00:00:00", 2, "click", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "value", "'{}' AS props")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.event_stream(spark, str(tmp_path / "in"))
    ingest.run_available(ingest.windowed_counts(ingest.once(stream), late=None), str(tmp_path / "c1"), str(tmp_path / "o1"))
    got = {(str(r.start), r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert got == {("2025-01-01 00:00:00", "click", 1), ("2025-01-01 00:00:00", "view", 1)}
    ingest.run_available(ingest.monthly_counters(stream), str(tmp_path / "c2"), "months", "complete")
    assert {(r.event_type, r.month, r.used) for r in spark.table("months").collect()} == {("click", "2025-01", 3), ("view", "2025-01", 1)}
    ingest.run_available(ingest.session_counts(stream), str(tmp_path / "c3"), str(tmp_path / "o3"))
    assert {(r.user_id, r.n_events) for r in spark.read.parquet(str(tmp_path / "o3")).collect()} == {(1, 3)}
