from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.functions import split, stats
from corpusloom.functions import text as tx


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first().x


def test_tokens_and_units(spark):
    assert one(spark, "It's a well-known 3D Test", tx.tokens(F.col("t"))) == ["it's", "a", "well-known", "d", "test"]
    assert one(spark, "模型ABC有12个", tx.cjk_units(F.col("t"))) == 5
    assert one(spark, "１2三", tx.n_digits(F.col("t"))) == 2
    assert one(spark, None, tx.n_tokens(F.col("t"))) is None


def test_language_rule(spark):
    assert [one(spark, t, tx.language(F.col("t"))) for t in ("abc", "中文 text", "12 %", "", None)] == ["en", "zh", "unknown", "unknown", None]


def test_markup(spark):
    assert one(spark, "<p>a&amp;b<!-- x --><br/>c&nbsp;&lt;d</p>", tx.html_to_text(F.col("t"))) == "a&b c <d"
    assert one(spark, r"\alpha_{1} + $x$ \frac{a}{b}", tx.latex_to_text(F.col("t"))) == "_ 1 + x a b"
    assert one(spark, "2.1 Method:", tx.normal_title(F.col("t"))) == "method"
    assert one(spark, " A b—Ç 1! ", tx.slug(F.col("t"))) == "a-b-ç-1"


def test_urls(spark):
    assert one(spark, "HTTPS://WWW.Example.org/A/b/?q=1#x", tx.normal_url(F.col("t"))) == "https://example.org/A/b"
    assert one(spark, "HTTPS://WWW.Example.org/A/b/?q=1#x", tx.normal_url(F.col("t"), keep_query=True)) == "https://example.org/A/b/?q=1"
    assert one(spark, "http://a.b:80/c", tx.host(F.col("t"))) == "a.b"


def test_numbers(spark):
    assert one(spark, "see [3], [1, 4] and [6-8] but not [0, 1] or [x]", tx.cited_numbers(F.col("t"))) == [1, 3, 4, 6, 7, 8]
    assert one(spark, "9-3", tx.expand_range(F.col("t"))) == [9, 3]
    assert one(spark, "1-900", tx.expand_range(F.col("t"))) == [1, 900]
    assert one(spark, "A. B. Title, 2007a. 1999", tx.first_year(F.col("t"))) == 2007
    assert one(spark, "v10.2", tx.semver(F.col("t"))) == (10, 2, 0)
    assert one(spark, "none", tx.semver(F.col("t"))) is None


def test_inverted_index(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert df.select(tx.inverted_to_text(F.col("m"))).first()[0] == "a b a"


def test_phrases_are_longest_first(spark):
    words = tx.tokens(F.col("t"))
    assert one(spark, "As well as this, as well so as", tx.phrase_hits(words, ["as", "as well", "as well as"])) == ["as well as", "as well", "as"]
    rng = random.Random(3)
    entries = ["a", "a b", "b c a", "c"]
    for _ in range(20):
        toks = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        hits, i = [], 0
        while i < len(toks):
            n = next((k for k in (3, 2, 1) if " ".join(toks[i : i + k]) in entries and len(toks) >= i + k), 0)
            if n:
                hits.append(" ".join(toks[i : i + n]))
            i += max(1, n)
        assert one(spark, " ".join(toks), tx.phrase_hits(words, entries)) == hits


def loop_mtld(words, threshold=0.72):
    def way(ws):
        seen, n, factors = set(), 0, 0.0
        for w in ws:
            seen.add(w)
            n += 1
            if len(seen) / n <= threshold:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(seen) / n) / (1 - threshold)
        return len(ws) / factors if factors else None

    a, b = way(words), way(words[::-1])
    return None if a is None or b is None else (a + b) / 2


def test_mtld(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcdefghij") for _ in range(n)],) for n in (0, 5, 19, 20, 60, 200)] + [(["w"] * 30,), ([str(i) for i in range(40)],)]
    got = [r[0] for r in spark.createDataFrame(rows, "w array<string>").select(tx.mtld(F.col("w"))).collect()]
    for (words,), value in zip(rows, got, strict=True):
        want = loop_mtld(words) if len(words) >= 20 else None
        assert (value is None) == (want is None)
        assert want is None or abs(value - want) < 1e-9
        got = split.mtld_of(words)
        assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-9)


def test_quantiles_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(50))) for g in range(1, 40) for _ in range(g)] + [(99, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in stats.ranked_quantiles(df, ["g"], "v", {"a": ("half_even", 0.25), "b": ("ceil", 0.9), "c": ("upper", 0.5)}).collect()}
    assert 99 not in got
    for g in range(1, 40):
        vs = sorted(v for k, v in rows if k == g)
        n = len(vs)
        assert got[g].a == vs[round(0.25 * (n - 1))]
        assert got[g].b == vs[-(-9 * n // 10) - 1]
        assert got[g].c == vs[n // 2]


def test_guards(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("c", 1.0, 4.0), ("n", 1.0, 2.0), ("n", 2.0, None), ("r", 1.0, 1.0), ("r", 2.0, 2.0), ("r", 3.0, 3.0)], "g string, x double, y double")
    r = {x.g: x.r for x in df.groupBy("g").agg(stats.guarded_corr("x", "y").alias("r")).collect()}
    assert r["c"] is None and r["n"] is None and abs(r["r"] - 1) < 1e-12
    low, high = stats.wilson(F.col("h"), F.col("n"))
    got = spark.createDataFrame([(20, 20), (0, 20), (0, 0)], "h int, n int").select(F.round(low, 3), F.round(high, 3)).collect()
    assert [tuple(g) for g in got] == [(0.839, 1.0), (0.0, 0.161), (None, None)]
    assert spark.range(1).select(stats.t_95(F.lit(1)), stats.t_95(F.lit(2)), stats.t_95(F.lit(40))).first()[:] == (None, 12.706, 1.96)


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [(None, "a")], "x string, y string")
    assert round(stats.cohen_kappa(df, "x", "y").first().kappa, 6) == 0.4


SENTENCES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("See e.g. Fig. 3 of Dr. Wu et al. for 3.14 points. Next.", ["See e.g. Fig. 3 of Dr. Wu et al. for 3.14 points.", "Next."]),
    ("A. B. Smith wrote it. Then J. left.", ["A. B. Smith wrote it.", "Then J. left."]),
    ("[12]. It holds (see above). However, no.", ["It holds (see above).", "However, no."]),
    ("1. Opening\n2. Approach\nThis is it.", ["1. Opening\n2. Approach\nThis is it."]),
    ("Really? yes it is. It was so. they left.", ["Really?", "yes it is.", "It was so. they left."]),
    ("It was done.\nwhere K counts.\n[4] says so.\n12 runs.", ["It was done.", "where K counts.", "[4] says so.", "12 runs."]),
    ("Call it X. 25 of them. Call it Y. [3] has it. Call it Z. Then no.", ["Call it X.", "25 of them.", "Call it Y.", "[3] has it.", "Call it Z. Then no."]),
    ('She said "go." Then "no!" (He left.) End', ['She said "go.', '" Then "no!', '" (He left.', ") End"]),
    ("他来了……走了！“好。”她说。", ["他来了……", "走了！", "“好。", "”她说。"]),
    ("误差为3.5，下降.结论成立。", ["误差为3.5，下降.", "结论成立。"]),
    ("Keywords: a. b. c.\nReal text here.", ["Real text here."]),
    ("$a. B$ holds. Yes.", ["holds.", "Yes."]),
    ("... ! ?", []),
    ("", []),
    (None, []),
]


def test_sentence_rules():
    for text, want in SENTENCES:
        assert [text[a:b] for a, b in split.split_sentences(text)] == want, text


def test_clauses():
    s = "首先，分析（甲，乙）数据；其次：得出1,000个结论。"
    assert [s[a:b] for a, b in split.split_clauses(s)] == ["首先，", "分析（甲，乙）数据；", "其次：", "得出1,000个结论。"]


def test_sentences_udf(spark):
    df = spark.createDataFrame([("One. Two, three.",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(split.sentences_udf()(F.col("t"))).collect()]
    assert [(s.no, s.text, s.n_clauses) for s in got[0]] == [(0, "One.", 1), (1, "Two, three.", 2)]
    assert got[1] is None and got[2] == []


def test_large_groups_are_cut_and_stay_exact(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, round(rng.gauss(0, 1), 2)) for k in ("a", "b", None) for _ in range(700)] + [("a", 0.0)] * 300
    df = spark.createDataFrame(rows, "k string, v double")
    whole = sorted(map(repr, stats.cumulative(df, ["k"], "v").collect()))
    monkeypatch.setattr(stats, "WHOLE", 50)
    monkeypatch.setattr(stats, "BUCKETS", 7)
    assert sorted(map(repr, stats.cumulative(df, ["k"], "v").collect())) == whole
    got = {r.k: r for r in stats.ranked_quantiles(df, ["k"], "v", {"m": ("half_even", 0.5), "l": ("linear", 0.9)}).collect()}
    for k in ("a", "b", None):
        vs = sorted(v for g, v in rows if g == k)
        n = len(vs)
        assert got[k].m == vs[round(0.5 * (n - 1))]
        pos = 0.9 * (n - 1)
        want = vs[int(pos)] + (vs[min(n - 1, int(pos) + 1)] - vs[int(pos)]) * (pos - int(pos))
        assert abs(got[k].l - want) < 1e-9
