from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import align, blocks, checks, corpus, metrics, search


def test_continuity(spark):
    rows = [("a", n) for n in (1, 2, 4, 4, 5)] + [("b", 2), ("b", None), ("c", 1)]
    got = {(r.k, r.n, r.expected, r.problem) for r in checks.continuity(spark.createDataFrame(rows, "k string, n int"), ["k"], "n", ["n"]).collect()}
    assert got == {("a", 4, 3, "gap"), ("a", 4, 5, "duplicate"), ("b", 2, 1, "gap")}


def test_overlaps_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        x, y = rng.randrange(0, 900), rng.randrange(0, 900)
        rows.append((i % 2, i, float(x), float(y), float(x + rng.randrange(-5, 400)), float(y + rng.randrange(1, 300))))
    rows.append((0, 99, None, 1.0, 2.0, 3.0))
    want = {}
    for a, b in itertools.combinations([r for r in rows if r[2] is not None and r[4] > r[2]], 2):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        if a[0] == b[0] and w > 0 and h > 0:
            want[a[1], b[1]] = round(w * h / min((a[4] - a[2]) * (a[5] - a[3]), (b[4] - b[2]) * (b[5] - b[3])), 9)
    df = spark.createDataFrame(rows, "page int, id int, x1 double, y1 double, x2 double, y2 double")
    got = checks.overlaps(df, ["page"]).collect()
    assert len(got) == len(want)
    assert {(r.id_a, r.id_b): round(r.share, 9) for r in got} == want


def test_jaccard_by_brute_force(spark):
    rng = random.Random(4)
    sets = {i: sorted({rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 7))}) for i in range(40)}
    df = spark.createDataFrame([(i, w) for i, w in sets.items()], "id int, words array<string>")
    got = {(r.query_id, r.row_id): r["rank"] for r in checks.jaccard_matches(df, df, 0.4, top=3).collect()}
    want = {}
    for a, wa in sets.items():
        near = sorted((-len(set(wa) & set(wb)) / len(set(wa) | set(wb)), b) for b, wb in sets.items() if wa and wb and len(set(wa) & set(wb)) >= 0.4 * len(set(wa) | set(wb)))
        want |= {(a, b): i + 1 for i, (_, b) in enumerate(near[:3])}
    assert got == want


def test_inventory_and_audit(spark):
    e = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("n", None)], "name string, v double")
    a = spark.createDataFrame([("a", 1.0), ("c", 3.0), ("n", None)], "name string, v double")
    assert {(r.name, r.verdict) for r in checks.audit(e, a, "name", "v").collect()} == {("a", "match"), ("b", "missing"), ("c", "unexpected"), ("n", "match")}
    assert {(r.name, r.state) for r in checks.inventory(e, a, ["name"]).collect()} == {("a", "present"), ("b", "missing"), ("c", "extra"), ("n", "present")}


def test_retention_and_orphans(spark):
    df = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 1)], "c string, k int")
    assert {r.k for r in checks.retention(df.withColumn("id", F.concat("c", "k")), ["c"], [F.col("k").desc()], 3, "id").collect()} == {0, 1}
    edges = spark.createDataFrame([(1, 2), (1, 9), (None, 1)], "a int, b int")
    nodes = spark.createDataFrame([(1,), (2,)], "n int")
    assert {(r.a, r.b, r.missing_end) for r in checks.orphans(edges, nodes, ["a", "b"], "n").collect()} == {(1, 9, "b"), (None, 1, "a")}


def test_merge_keeps_the_first_and_adds(spark):
    rows = [("s1", 1, "k", 1.0, None), ("s2", 1, "k", 9.0, None), ("s3", 1, "k", 5.0, None), ("s2", 2, "l", 1.0, None), ("s1", 3, "m", 1.0, "timeout")]
    r = spark.createDataFrame(rows, "source string, place int, key string, score double, error string")
    w = spark.createDataFrame([("s1", 2.0, 1), ("s2", 1.0, 2)], "source string, weight double, source_order int")
    got = {x.key: (x.source, round(x.score, 6), x.n_found, x.sources) for x in search.merged(r, w).collect()}
    assert got == {"k": ("s1", 2.0 + 0.15 * 2, 3, ["s1", "s2", "s3"]), "l": ("s2", 1.0, 1, ["s2"])}
    assert [x.key for x in search.top(search.merged(r, w), 1).collect()] == ["k"]


def test_dedup_keys(spark):
    rows = [("10.1/X", "", "http://a", "t", "s"), (None, "2301.00001v2", "http://a", "t", "s"), ("", None, "HTTP://www.A.b/c/?d", "t", "s"), (None, None, None, " The  T ", "s")]
    df = spark.createDataFrame(rows, "doi string, arxiv string, url string, title string, source string")
    got = [r[0] for r in df.select(search.dedup_key(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["doi:10.1/x", "arxiv:2301.00001", "url:http://a.b/c", "title:the t|s"]


def metric_rows(spark, rows):
    return spark.createDataFrame(rows, "metric string, value double, unit string, n_tokens long, doc_id long")


def test_summary_rules(spark):
    rows = [("a", float(v), "u", 10 * v, v) for v in (1, 2, 3, 4)] + [("a", None, None, 5, 9)]
    rows += [("one", 5.0, "u", 1, 1), ("mixed", 1.0, "u", 1, 1), ("mixed", 2.0, "w", 1, 2), ("none", None, "u", 1, 1)]
    s = {r.metric: r for r in corpus.summary(metric_rows(spark, rows), ["metric"]).collect()}
    assert (s["a"].n_valid, s["a"].n_missing, s["a"].p25, s["a"].median, s["a"].p75) == (4, 1, 2.0, 3.0, 3.0)
    assert s["a"].warnings == "SMALL_SAMPLE"
    assert (s["one"].sd, s["one"].ci95_low, s["one"].warnings) == (0.0, None, "TINY_SAMPLE")
    assert s["mixed"].mean is None and "MIXED_UNIT_AGGREGATION" in s["mixed"].warnings
    assert s["none"].mean is None and "HIGH_MISSING" in s["none"].warnings


def test_summary_is_the_same_for_any_partitioning(spark):
    rng = random.Random(8)
    df = metric_rows(spark, [(rng.choice("ab"), rng.random() * 1e6, "u", 1, i) for i in range(500)])
    got = [sorted(map(tuple, corpus.summary(df.repartition(n), ["metric"]).collect())) for n in (1, 4, 64)]
    assert got[0] == got[1] == got[2]


def test_contract_and_validation(spark):
    rows = [("x", float(v), "u", 1, v) for v in range(1, 21)] + [("same", 1.0, "u", 1, v) for v in range(9)] + [("y", float(v), "u", 1, v) for v in range(1, 21)]
    c = corpus.contract(corpus.summary(metric_rows(spark, rows + [("sum", 1.0, "u", 1, 1)]), ["metric"]), derived={"sum": ["x", "y"]})
    bands = {r.metric: (r.low, r.high, r.level, r.reason) for r in c.collect()}
    assert bands["x"] == (6.0, 15.0, "gate", "")
    assert bands["sum"] == (12.0, 30.0, "gate", "")
    assert bands["same"] == (None, None, "warn", "iqr_zero")
    d = spark.createDataFrame([(1, "x", 5.0), (1, "y", 7.0), (1, "same", 1.0), (2, "x", None)], "draft_id int, metric string, value double")
    v = {(r.draft_id, r.metric): (r.verdict, r.deviation) for r in corpus.validate(c, d).collect()}
    assert v == {(1, "x"): ("fail", 1.0), (1, "y"): ("pass", 0.0), (1, "same"): ("skipped", None), (2, "x"): ("skipped", None)}
    assert {(r.draft_id, r.outcome) for r in corpus.verdicts(corpus.validate(c, d)).collect()} == {(1, "fail"), (2, "unusable")}


def test_holdout(spark):
    m = metric_rows(spark, [("x", 1.0, "u", 1, 1), ("x", 2.0, "u", 1, 2)])
    assert corpus.holdout(m, spark.createDataFrame([(1,)], "doc_id long")).count() == 1
    with pytest.raises(ValueError):
        corpus.holdout(m, spark.createDataFrame([(7,)], "doc_id long"))


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("h", "a", None)], "g string, p string, q int")
    one = sorted(map(tuple, corpus.fingerprint(df, ["g"], ["p", "q"]).collect()))
    assert one == sorted(map(tuple, corpus.fingerprint(df.orderBy(F.col("q").desc()).repartition(3), ["g"], ["p", "q"]).collect()))
    changed = df.withColumn("q", F.coalesce("q", F.lit(0)))
    assert one != sorted(map(tuple, corpus.fingerprint(changed, ["g"], ["p", "q"]).collect()))


def test_table_shapes(spark):
    html = "<table><tr><th colspan='2'>H</th></tr><tr><td>a</td><td>1.5</td></tr><tr><td></td><td>$x$</td></tr><tr><td>12 %</td><td>3–4</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "no table")], "block_id int, table_body string")
    got = {r.block_id: tuple(r)[1:] for r in blocks.table_shapes(df).collect()}
    assert got[1] == (4, 7, 2, 1, 3, 1, 2)
    assert got[2] == got[3] == got[4] == (0, 0, 0, 0, 0, 0, 0)


def test_sections(spark):
    rows = [("p", i, i, s, t, lv) for i, (s, t, lv) in enumerate([("prose", "T", 1), ("prose", "x", None), ("prose", "1 Introduction", 2), ("tables", "", None), ("prose", "2 Our Model:", 2), ("prose", "y", None)])]
    df = spark.createDataFrame(rows, "paper_key string, block_index int, block_id int, stream string, plain string, level int")
    s = blocks.with_sections(df)
    assert [r.section for r in s.orderBy("block_index").collect()] == ["front", "front", "introduction", "introduction", "our model", "our model"]
    assert {(r.section, r.first_position, r.next_position) for r in blocks.section_extents(s).collect()} == {("front", 1, 3), ("introduction", 3, 5), ("our model", 5, None)}


def test_references_and_numbers(spark):
    rows = [("p", 1, "figures", "", "Figure 1: a"), ("p", 2, "figures", "", "Fig. 03 b"), ("p", 3, "figures", "", "Figure 3"), ("p", 4, "prose", "see Figures 1-2 and fig. 9", None)]
    df = spark.createDataFrame(rows, "paper_key string, block_id int, stream string, plain string, caption string")
    r = blocks.reference_consistency(df, "figures", "figures?|figs?").first()
    assert (r.declared, r.referenced, r.shared, r.dangling, r.uncited) == (2, 3, 1, 2, 1)
    n = blocks.numbering(df, "figures").first()
    assert (n.n_declared, n.n_distinct, n.n_duplicate, n.n_missing) == (3, 2, 1, 1)


def test_newest_block(spark):
    df = spark.createDataFrame([(1, "p", 0, "text", "old", "2025-01-01"), (1, "p", 0, "text", "new", "2025-02-01"), (None, "p", 0, "text", "x", "2025-01-01")], "block_id long, paper_key string, block_index int, type string, text_plain string, loaded_at string")
    assert [r.text_plain for r in blocks.newest(df).collect()] == ["new"]


def test_token_metrics_golden(spark):
    text = "The evaluation was carefully not shown. It might have improved the reduction, however."
    m = metrics.token_metrics(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"))
    r = {x.doc_id: x for x in m.collect()}
    assert (r[1].n_tokens, r[1].M_HED_14, r[1].M_CONN_30c, r[1].n_nominal) == (13, 1, 1, 2)
    assert r[2].M_HED_14 is None and r[3].n_tokens == 0
    s = metrics.sentence_table(spark.createDataFrame([(1, "It was also not shown. They show it. Es ist gut.")], "doc_id int, text string"))
    assert [x.passive for x in s.orderBy("sent_no").collect()] == [True, False, False]


def test_alignment(spark):
    left, right = ["the quick brown fox jumps", "only here at all", "value 1"], ["value 1", "the quick brown fox jumped 12", "zzz"]
    got = align.align_paragraphs(left, right)
    assert [(k, i, j) for k, i, j, _, _ in got] == [("SAME", 0, 1), ("ONLY_LEFT", 1, None), ("SAME", 2, 0), ("ONLY_RIGHT", None, 2)]
    assert got[0][4] == "the quick brown fox jumped 12"
    df = spark.createDataFrame([(1, left, right), (2, None, ["x"]), (3, [], [])], "doc_id long, left array<string>, right array<string>")
    assert align.aligned(df).groupBy("doc_id").count().collect().__len__() == 2
    loss = align.text_layer_loss(spark.createDataFrame([(1, "a1.2", "a1"), (2, None, "x")], "doc_id long, layer string, converted string")).collect()
    assert [(r.digit_loss, r.punct_loss) for r in loss] == [(0.5, 1.0), (None, None)]


def test_download_names_of_whole_texts(spark, tmp_path):
    from corpusloom.plans import relational

    same = "the same forty characters of two texts, and then "
    rows = [(1, None, same + "one"), (2, None, same + "two"), (3, None, "equal"), (4, None, "equal"), (5, "p", same), (6, None, None), (7, None, " ")]
    spark.createDataFrame(rows, "doc_id long, paper_key string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in relational.download_names(spark, str(tmp_path)).collect()}
    assert got == {(True, 4, 2), (False, 3, 3)}
