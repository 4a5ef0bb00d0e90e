"""Federated search, resumed work, adapters, sinks and the profile operators by goldens and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chinese, federation, profile
from corpusloom.sources import sinks


def test_retries_and_breaker():
    waits, calls = [], []

    def limited(query):
        calls.append(query)
        if len(calls) < 3:
            raise federation.RateLimited("429")
        return [{"title": "t"}]

    assert federation.ask(limited, "q", 3, 2.0, waits.append) == ([{"title": "t"}], None, 3)
    assert waits == [1.0, 2.0]

    def always(query):
        raise federation.RateLimited("429")

    assert federation.ask(always, "q", 2, 3.0, waits.append)[1:] == ("rate limited: 429", 2)
    assert federation.ask(lambda q: 1 / 0, "q")[1:] == ("ZeroDivisionError: division by zero", 1)
    breaker = federation.Breaker(2)
    for ok in (False, True, False, False):
        breaker.note("a", ok)
    assert breaker.open("a") and not breaker.open("b")


def test_fan_out(spark):
    def broken(query):
        raise ValueError(query)

    queries = spark.createDataFrame([("a",), ("a",), (None,), (" ",), ("b",)], "query string")
    sources = {"one": lambda q: [{"title": q, "url": "https://x.example/" + q}], "none": lambda q: [], "bad": broken}
    rows = federation.fan_out(queries, sources).collect()
    assert {(r.query, r.source, r.error) for r in rows if r.source == "one"} == {("a", "one", None), ("b", "one", None)}
    assert all(r.error for r in rows if r.source == "bad") and not [r for r in rows if r.source == "none"]
    assert federation.fan_out(queries.limit(0), sources).count() == 0
    assert list(federation.academic({"dblp": 1, "web": 2, "openalex": 3})) == ["openalex", "dblp"]
    assert (federation.mode_of("a survey of x"), federation.mode_of("weather")) == ("academic", "web")


def test_unfinished_and_adapters(spark):
    work = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, d string")
    state = spark.createDataFrame([("a", "1", "done"), ("b", "9", "done"), ("c", "3", "failed")], "k string, d string, status string")
    assert {r.k for r in federation.unfinished(work, state, "k", "d").collect()} == {"b", "c"}
    a = federation.Adapters("en")
    a.register("en", len)
    a.register("zh", sum)
    assert (a.of("zh"), a.of("xx"), a.of(None)) == (sum, len, len)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    one = sinks.write_products({"p": df, "q": df.limit(0)}, str(tmp_path / "one"))
    two = sinks.write_products({"p": df.orderBy(F.desc("a")).repartition(3), "q": df.limit(0)}, str(tmp_path / "two"))
    assert one == two and set(one) == {"p", "q"}
    v = spark.createDataFrame([("M-A", "fail", 2.0), ("M-B", "pass", 1.0)], "metric string, verdict string, value double")
    text, data = sinks.validation_report(v)
    assert text == "fail: 1, pass: 1\nfail\tM-A\t2.0\n" and '"pass":1' in data
    assert sinks.read_yaml_clauses(sinks.yaml_clauses(v)) == [{"metric": "M-A", "value": 2.0, "verdict": "fail"}, {"metric": "M-B", "value": 1.0, "verdict": "pass"}]
    with pytest.raises(ValueError):
        sinks.read_yaml_clauses("x")
    f = tmp_path / "f.txt"
    f.write_text("data")
    first, second = (sinks.backup_file(str(f), str(tmp_path / "store")) for _ in range(2))
    assert first["sha256"] == second["sha256"] and (first["kept"], second["kept"]) == (False, True)
    sinks.export_snapshot(df, str(tmp_path / "snap"))
    assert "<td>x</td>" in (tmp_path / "snap.html").read_text()
    sinks.write_sheet(df, str(tmp_path / "sheet"))
    assert sinks.read_sheet(spark, str(tmp_path / "sheet")).count() == 2
    sinks.write_paper(df.withColumn("paper_key", F.lit("k")), df, str(tmp_path / "paper"))
    assert spark.read.parquet(str(tmp_path / "paper/blocks")).count() == 2
    assert sinks.resolve_config(None, {"C": str(f)}, "C", []) == str(f)
    assert sinks.resolve_config(None, {}, "C", ["/none", str(f)]) == str(f)
    with pytest.raises(FileNotFoundError):
        sinks.resolve_config("/none", {}, "C", [])


def test_profile_operators(spark):
    rows = spark.createDataFrame([("k", i) for i in range(7)], "k string, v int")
    a = profile.fingerprints(rows, "k", [F.col("v")])
    b = profile.fingerprints(rows.repartition(3), "k", [F.col("v")])
    c = profile.fingerprints(rows.filter("v > 0"), "k", [F.col("v")])
    assert [r.status for r in profile.compared(a, b, "k").collect()] == ["same"]
    assert [r.status for r in profile.compared(a, c, "k").collect()] == ["differs"]
    assert [r.status for r in profile.compared(a, c.limit(0), "k").collect()] == ["only_a"]
    codes = spark.createDataFrame([(["N_LT_5", "NO_TABLES"],), (["N_LT_5"],), ([],)], "c array<string>").select(profile.collapsed(F.col("c"), F.col("c")).alias("c"))
    assert [r.c for r in codes.collect()] == [["NO_TABLES"], ["N_LT_5"], []]
    n = spark.createDataFrame([("p", 1, i, x) for i, x in enumerate([1, 2, 4, 5, 5, 3])], "key string, chapter int, at int, number int")
    assert [r.kind for r in profile.chapter_continuity(n).orderBy("at").collect()] == ["ok", "ok", "gap", "ok", "duplicate", "backward"]
    heads = spark.createDataFrame([("1.2 Title",), ("1.2.3.4 Title",), ("3 items were used.",), ("Title",), (None,)], "t string").select(profile.heading_level(F.col("t")).alias("h"))
    assert [r.h for r in heads.collect()] == [2, 3, None, None, None]
    html = "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td> 2 </td></tr></table>"
    t = spark.createDataFrame([(html,), ("",), (None,)], "t string").select(profile.pipe_table(F.col("t")).alias("p"))
    assert [r.p for r in t.collect()] == ["| a | b |\n|---|---|\n| 1 | 2 |", None, None]


def test_stratum_sample_by_brute_force(spark):
    for n in (3, 10, 11, 25, 30):
        placed = spark.createDataFrame([("s", i + 1, n) for i in range(n)], "s string, upto long, n long")
        got = sorted(r.upto - 1 for r in profile.stratum_sample(placed, ["s"], 10).collect())
        stride = max(1, n // 10)
        want = list(range(n)) if n <= 10 else list(range(0, n, stride))[:10]
        assert got == want


def test_merged_cells():
    from corpusloom.sources.blocks import grid_html, merge_parts, merge_problems

    assert [merge_parts(x) for x in ("a <<2", "^^", "a ^^3", "^^ text", "x<<2 y", "b ^^2 <<3")] == [("a", 2, 1), ("", 1, 0), ("a", 1, 3), ("^^ text", 1, 1), ("x<<2 y", 1, 1), ("b", 3, 2)]
    html = grid_html([["a ^^2", "b"], ["^^", "c"], ["^^ d", "e"]])
    assert html == '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>^^ d</td><td>e</td></tr></table>'
    assert merge_problems([["^^", "a <<3"], ["b ^^2", "c"]]) == [(0, 0, "nothing above"), (0, 1, "columns beyond the row"), (1, 0, "rows beyond the table")]


def test_chinese(spark):
    hits = spark.createDataFrame([("由此可见，结果。由此",)], "t string").select(*[c.alias(k) for k, c in chinese.grouped_hits(F.col("t"), {"a": ["由此"], "b": ["由此可见"]}).items()]).first()
    assert (hits.a, hits.b) == (1, 1)
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("ab -'é中.") for _ in range(30))) for i in range(20)]
    got = {(r.k, r.span_start, r.span_end): r.token for r in chinese.spans(spark.createDataFrame(texts, "k int, text string"), "k", "[A-Za-z][A-Za-z'-]*").collect()}
    import re

    assert got == {(k, *m.span()): m.group().lower() for k, t in texts for m in re.finditer("[A-Za-z][A-Za-z'-]*", t)}
