"""Operators for training-data text: goldens, brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import encode, language, leakage, lookalikes, quality, registry, scans, sentences, truncation

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    assert df.count() >= 0
    assert len(df.columns) == len(set(df.columns))


# ---- encoding


@pytest.fixture(scope="module")
def encoder():
    return encode.TextEncoder.load()


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    lines = Path(encode.TOKENIZERS, "byte_bpe_50k.tiktoken").read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("own", pat_str=encode.SPLIT, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n  x", "a" * 3000, "<|endoftext|> plain", "naïve café 中文字符 テスト 🙂👩‍👩‍👧", "don't  we'll\tI'M", "​﻿\xa0", "1234567890" * 20, "퟿\U0010ffff", "==" * 400]


def test_same_as_the_public_encoder(encoder, public):
    for text in ODD:
        assert encoder.encode(text) == public.encode_ordinary(text), text[:40]
    assert encoder.encode(None) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(encoder, public, text):
    assert encoder.encode(text) == public.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(max_size=20), st.data())
def test_appends_and_edits_are_exact(encoder, piece, by, data):
    bpe = encoder.bpe
    last = bpe.prefixes(piece)
    assert bpe.append(piece, last, by) == bpe.prefixes(piece + by)
    a = data.draw(st.integers(0, len(piece)))
    b = data.draw(st.integers(a, len(piece)))
    got, _ = bpe.edit(piece, last, a, b, by)
    assert got == bpe.prefixes(piece[:a] + by + piece[b:])


def test_edit_stops_early(encoder):
    piece = b"the quick brown fox " * 200
    _, computed = encoder.bpe.edit(piece, encoder.bpe.prefixes(piece), 50, 55, b"zebra!")
    assert computed < len(piece) / 2


def test_encode_corpus(spark, encoder):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, "z", "x"), (2, None, "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode.encode_corpus(df).collect()), key=repr)
    assert got == sorted([(1, encoder.encode("a b"))] * 2 + [(None, encoder.encode("z")), (2, []), (3, [])], key=repr)
    assert encode.encode_corpus(df.limit(0)).count() == 0


# ---- look-alikes

SAME = [("that ｓａｉｄ", "that said"), ("máｓ bien", "más bien"), ("résumé", "résumé"), ("а lа іnversа", "a la inversa"), ("all t⁠he same", "all the same"), ("ﬁnal", "final"), ("for\xa0all that", "for all that"), ("up‐to‑date", "up-to-date"), ("Τhe οf", "The of"), ("反观ＡＢ", "反观AB")]
OTHER = [("mas bien", "más bien"), ("20²", "202"), ("o0", "00"), ("Said", "said"), ("a\nb", "a b"), ("½", "1/2")]


def test_canonical_forms():
    form = lookalikes.Canonical()
    for a, b in SAME:
        assert form(a) == form(b), (a, b)
        assert form(form(a)) == form(a)
    for a, b in OTHER:
        assert form(a) != form(b), (a, b)
    russian = "Модуль поиска сравнивает указанный язык в корпусе"
    assert form(russian) == russian
    assert form(russian.replace("о", "o")) == russian


def test_singletons_and_radicals():
    form = lookalikes.Canonical()
    for a, b in [("at 5 \u212a", "at 5 K"), ("\u212b", "\xc5"), ("\u2126", "\u03a9"), ("\uf900", "\u8c48"), ("\U0002f800", "\u4e3d"), ("\u2f00\u6587", "\u4e00\u6587"), ("5 \xb5m", "5 \u03bcm"), ("\u0958", "\u0915\u093c")]:
        assert form(a) == form(b) == form(form(a)), (a, b)
        assert form(a + " e\u0301") == form(b) + " \xe9"


def test_lookalike_pairs(spark):
    rows = [(1, "the same text"), (2, "the same tеxt"), (3, "the same text"), (4, "the​ same text"), (5, None), (6, "  "), (7, "​"), (None, "the same text"), (2, "the same tеxt"), (8, "alone"), (8, "аlone")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "k long, t string, key_a string")
    got = sorted(map(tuple, lookalikes.lookalike_pairs(df, "k", "t").collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert lookalikes.lookalike_pairs(df.limit(0), "k", "t").count() == 0


def test_lookalike_pairs_by_brute_force(spark):
    rng = random.Random(2)
    forms = lookalikes.Canonical()
    rows = [(rng.randrange(40), "".join(rng.choice(["a", "\u0430", "b ", "b\xa0", "\u200b"]) for _ in range(3))) for _ in range(60)]
    df = spark.createDataFrame(rows, "k long, t string")
    want = {(min(a, c), max(a, c)) for a, x in rows for c, y in rows if a != c and x != y and forms(x) and forms(x) == forms(y)}
    assert {tuple(r) for r in lookalikes.lookalike_pairs(df, "k", "t", forms).collect()} == want


# ---- leakage

ITEM = "When Harkel reread section 128 of the Rinbry draft, 52 clauses lost their Holbry label and the remaining 325 moved into the Cobsol band near 35.23."
ITEM_ZH = "若把161道题分给315个小组，Drezethar的均值便由42.78降到5.23，而Grisol每天都在场，因此评阅者认为Nokvinfen的说法仍需核对。"


def leaked(spark, docs, items=((1, ITEM), (2, ITEM_ZH))):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}


def test_leaks(spark):
    words = ITEM.split()
    marked = " ".join(f"{w} [3]" if n % 4 == 0 else f"**{w}**" if n % 5 == 0 else w for n, w in enumerate(words))
    replaced = " ".join("XX" if n in (8, 17) else w for n, w in enumerate(words))
    other = ITEM.replace("Harkel", "Pelvin").replace("128", "99").replace("Rinbry", "Masgam").replace("52", "7").replace("Holbry", "Wesdov").replace("325", "8").replace("Cobsol", "Tashqua").replace("35.23", "1.5")
    docs = ["x " + ITEM + " y", ITEM.upper(), ITEM.lower().replace(",", ""), marked, replaced, " ".join(words[:19]), other, None, "", "前文。" + ITEM_ZH, ITEM_ZH[:30], ITEM_ZH.replace("，", "")[5:], ITEM.replace(" ", "\xa0").replace("5", "５")]
    assert leaked(spark, docs) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, 2), (11, 2), (12, 1)}
    assert leaked(spark, docs, [(1, None), (2, "")]) == set()
    assert leaked(spark, []) == set()


def test_best_stretch_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        eq = [rng.random() < 0.8 for _ in range(rng.randrange(1, 40))]
        want = 0
        for i in range(len(eq)):
            for j in range(i, len(eq)):
                if eq[i] and eq[j] and sum(not x for x in eq[i : j + 1]) * 10 <= j - i + 1:
                    want = max(want, j - i + 1)
        assert leakage.best_stretch(eq)[0] == want


NAMES = {"Harkel": "Pelvin", "Rinbry": "Masgam", "Holbry": "Wesdov", "Cobsol": "Tashqua"}
NUMBERS = {"128": "99", "52": "7", "325": "8", "35.23": "1.5"}


def test_reparameterised_passages(spark):
    """All names, all numbers, or both are others: met by template, leaked by none."""

    def swapped(by):
        text = ITEM
        for a, b in by.items():
            text = text.replace(a, b)
        return text

    docs = [swapped(NAMES), swapped(NUMBERS), swapped(NAMES | NUMBERS), ITEM, swapped({"128": "99"})]
    assert leaked(spark, docs) == {(3, 1), (4, 1)}
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {(r.doc_id, r.n_items) for r in leakage.reparameterised(d, i).collect()} == {(0, 1), (1, 1), (2, 1)}
    assert leakage.reparameterised(d.limit(0), i).count() == 0
    plan = leakage.leaks(d, i)._jdf.queryExecution().toString()
    assert "hashpartitioning(text" not in plan and "Join" not in plan


def test_names_beside_ideographs(spark):
    assert leakage.names_in(ITEM_ZH) == {"drezethar", "grisol", "nokvinfen"}
    other = ITEM_ZH.replace("Grisol", "Yaruld").replace("Nokvinfen", "Rintor")
    assert leaked(spark, [other[35:]]) == set()


def test_blocks_of_items_and_slices_of_pairs(spark, monkeypatch):
    """Items in many blocks, documents in many slices and repeated passages give the same rows."""
    rng = random.Random(5)
    words = [rng.choice("kelvin masgam torlun pelvin wesdov quabry the of and a in table draft score label band".split()) for _ in range(4000)]
    items = [(k, " ".join(words[k * 40 : k * 40 + 36])) for k in range(30)] + [(7, ITEM), (None, ITEM), (8, "short one")]
    docs = [" ".join(words[a : a + 90]) for a in range(0, 1200, 37)] + [(ITEM + " ") * 40, " ".join(words)]
    want = leaked(spark, docs, items)
    low = [[leakage.lower(t) for t in leakage.tokens(x)] for x in docs]
    brute = set()
    for k, text in items:
        b = [leakage.lower(t) for t in leakage.tokens(text)]
        for d, a in enumerate(low):
            if k is not None and any(leakage.best_stretch([a[x + diag] == b[x] for x in range(max(0, -diag), min(len(b), len(a) - diag))])[0] >= 20 for diag in range(-len(b), len(a))):
                brute.add((d, k))
    assert want == brute
    monkeypatch.setattr(leakage.leaks, "__defaults__", (300,))
    assert leaked(spark, docs, items) == want
    finder = leakage.Finder(leakage.Items.build([(k, t) for k, t in items if k is not None]))
    whole = sorted(x for x in finder.find(docs) if x[1] is not None)
    monkeypatch.setattr(leakage, "CHUNK", 50)
    monkeypatch.setattr(leakage, "PAIRS", 3)
    assert sorted(x for x in finder.find(docs) if x[1] is not None) == whole


# ---- quality

CLASSES = [
    ("| a | b |\n| 1 | 2 |\n| 3 | 4 |", "table"),
    ("x\t1\t2\ny\t3\t4", "table"),
    ("A & 1 & n/a \\\\\nB & 2 & 3 \\\\", "table"),
    ("A, 1, n/a\nB, 2, 50%\nC, —, 3", "table"),
    ("- one thing\n- another thing\n- a third", "list"),
    ("1. The table cells\n2. The order\n3. The share", "list"),
    ("The hedging rate ..... 12\nThe lower bound ..... 14\nEnd ..... 20", "list"),
    ("平均句长\n目标区间\n默认设置", "list"),
    ("• Долю предложений;\n• Долю предложений;\n• Долю предложений;\n• Номера статей;", "list"),
    ("word word word word word word word word word word", "junk"),
    ("}{|^~ @#$% ^&*( )_+ <>{} |||| ~~~~ ^^^^ @@@@", "junk"),
    ("fhqrgpbbn flcjbsxfjkp bvdng wdcqrblmk twpjhgmfp", "junk"),
    ("V76lgv1RpJqgA8p8dimD91vfecOW8oJnkT3y5EZDf+UI0/0JGhpU7w2UAWXAUMEJQE==", "junk"),
    ("IT IS LIKELY THAT THE TABLE CENSUS REPORTS THE TABLE CELLS BECAUSE IT CAN.", None),
    ("It holds (p < 0.03, n = 196, x = 0.54 ± 0.08). [1, 84] [24, 94] We agree, though.", None),
    ("Once upon a time, there was\na text with hard line\nbreaks that went on and\non until its end.", None),
    ("1. Although this is a sentence, it is led by a number, as long as it takes.\n2. So is this other one, which goes on.\n3. And this one ends the list here, too.", None),
    ("短句。", None),
    ("", None),
    ("  \n ", None),
    (None, None),
]


def test_content_classes():
    for text, want in CLASSES:
        assert quality.content_class(text) == want, text


def test_statistics(spark):
    s = quality.stats("same line\nsame line\nother.\n\npara\n\npara")
    assert s["n_lines"] == 5 and round(s["dup_line_share"], 3) == 0.4 and round(s["dup_para_share"], 3) == 0.333
    assert quality.stats("ab ab ab ab")["top_ngram_coverage"] == 1.0
    assert set(quality.stats("").values()) == {0, 0.0}
    df = spark.createDataFrame([("b", 1, None), ("b", 2, ""), ("b", 3, "- a\n- b\n- c"), ("b", 3, "- a\n- b\n- c"), ("b", None, "- a\n- b\n- c")], "src string, rec_id long, text string")
    assert quality.text_statistics(df).count() == 5
    assert [tuple(r) for r in quality.not_prose(df).collect()] == [("b", 3, "list")]
    long = "word " * 200_000
    assert quality.content_class(long) == "junk"


def test_dominant_words():
    token = "0123456789abcdef" * 2 + "01234567"
    few = " ".join(f"{token} {w}" for w in ("some", "other", "four", "tall", "last"))
    assert quality.content_class(few) == "junk"
    assert quality.stats(few)["top_ngram_coverage"] > 0.9
    rng = random.Random(3)
    for _ in range(3000):
        words = [rng.choice("a bb ccc dddd eeeee ffffffff".split()) for _ in range(rng.randrange(1, 14))]
        want = 0.0
        for n in range(1, 5):
            for gram in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}:
                at, k = 0, 0
                while at <= len(words) - n:
                    hit = tuple(words[at : at + n]) == gram
                    k, at = k + hit, at + (n if hit else 1)
                if k >= 3:
                    want = max(want, k * len("".join(gram)) / len("".join(words)))
        assert abs(quality._ngram_coverage(words) - want) < 1e-9
        assert want <= 0.5 or quality._may_dominate(words)


def test_repetition_without_spaces():
    for phrase in ("今すぐ購入", "请点击这里下载最新版本软件，", "ดาวน์โหลดเวอร์ชันใหม่ที่นี่", "好"):
        assert quality.content_class(phrase * 50) == "junk", phrase
        s = quality.stats(phrase * 50)
        assert s["top_ngram_coverage"] > 0.9 and s["distinct_word_share"] < 0.1, phrase
    s = quality.stats(TEXTS["zh"])
    assert quality.content_class(TEXTS["zh"]) is None and s["top_ngram_coverage"] < 0.2 and 0.5 < s["distinct_word_share"] < 1


def test_rules_and_statistics_agree(spark):
    """p1_found names what p1_stats classes, and the rules read the statistics that p1_stats gives."""
    found = {tuple(r) for r in quality.p1_found(spark, SMALL).collect()}
    rows = quality.p1_stats(spark, SMALL).collect()
    assert found == {(r.src, r.rec_id, r.content_class) for r in rows if r.content_class}
    assert any(r.content_class is None and r.common_share > 0.2 for r in rows)
    m = quality.Measured("the cat sat on the mat and " * 9)
    assert quality.is_repetitive(m) and m.top_ngram_coverage > 0.5 and quality.stats(m.text)["top_ngram_coverage"] == m.top_ngram_coverage
    shuffled = " ".join("abc dbe fgh".split()[(i * i // 3) % 3] for i in range(60))
    assert quality.content_class(shuffled) == "junk"
    assert quality.Measured("").mean_line_words == 0.0


# ---- sentences

SPLITS = [
    ("As shown in Fig. 7, Dr. Wu rates it at 9.62 points. Next one.", ["As shown in Fig. 7, Dr. Wu rates it at 9.62 points.", "Next one."]),
    ("It closed at 5 p.m. Figure 1 shows it.", ["It closed at 5 p.m.", "Figure 1 shows it."]),
    ("at approx. 7 a.m. on the server.The next", ["at approx. 7 a.m. on the server.", "The next"]),
    ('He said, "Stop here. Then go!" and left. "Again?!" asked Bo.', ['He said, "Stop here. Then go!" and left.', '"Again?!" asked Bo.']),
    ('Jo wrote: "Never print it." Use .csv or .json, e.g. a.b.md, now.', ['Jo wrote: "Never print it."', "Use .csv or .json, e.g. a.b.md, now."]),
    ("Heading\n\n1. One thing.\n2. Two\nthings.", ["Heading", "1. One thing.", "2. Two\nthings."]),
    ("It is (see ch. 6. and notes) fine. (This holds.) End", ["It is (see ch. 6. and notes) fine.", "(This holds.)", "End"]),
    ("We waited ... and then it came. Bo moved to the U.S. office.", ["We waited ... and then it came.", "Bo moved to the U.S. office."]),
    ("Von A. B. Wu, z. B. ca. 3 (vgl. S. 2 ff.). Am 22. März kam er.", ["Von A. B. Wu, z. B. ca. 3 (vgl. S. 2 ff.).", "Am 22. März kam er."]),
    ("Elle dit : « Arrêtez. Encore ! » puis part. Selon M. Roy, oui.", ["Elle dit : « Arrêtez. Encore ! » puis part.", "Selon M. Roy, oui."]),
    ("La Dra. Paz dijo: «Basta. ¿Sí?» y fue. ¿Vale n.º 9? Sí.", ["La Dra. Paz dijo: «Basta. ¿Sí?» y fue.", "¿Vale n.º 9?", "Sí."]),
    ("他写道：“停。再来！”，随后走了。“好吗？”他答：“好。”误差为4.8。（成立。）结果（见表7。）说明高.停！", ["他写道：“停。再来！”，随后走了。", "“好吗？”", "他答：“好。”", "误差为4.8。", "（成立。）", "结果（见表7。）说明高.", "停！"]),
    ("「止めて。やる！」と述べた。（同じ。）次。", ["「止めて。やる！」と述べた。", "（同じ。）", "次。"]),
    ("هل هذا صحيح؟ نعم.هذا صحيح.", ["هل هذا صحيح؟", "نعم.", "هذا صحيح."]),
    ("यह है। वह है।", ["यह है।", "वह है।"]),
    ("ระบบค้นหาบันทึกผล ดังนั้นผู้ตรวจบันทึก", ["ระบบค้นหาบันทึกผล", "ดังนั้นผู้ตรวจบันทึก"]),
    ("It closed at 4 p.m. (This also holds.) When it did, Wu et al. (2003) left.", ["It closed at 4 p.m.", "(This also holds.)", "When it did, Wu et al. (2003) left."]),
    ("1. (This holds.)\n2. That too.", ["1. (This holds.)", "2. That too."]),
    ("at level\n424. Note it.", ["at level\n424.", "Note it."]),
    ("", []),
    (" \n\n ", []),
    (None, []),
]


def test_sentence_goldens():
    splitter = sentences.Splitter()
    for text, want in SPLITS:
        assert [text[a:b] for a, b in splitter.spans(text)] == want, text


def test_best_path_by_brute_force():
    """The path through the terminators against all choices of ends."""
    import itertools

    rng = random.Random(4)
    for _ in range(300):
        para = "".join(rng.choice("a. .") for _ in range(rng.randrange(1, 12)))
        nodes = [(i + 1, rng.choice([-9.0, -1.5, 0.5, 2.5, 9.5])) for i, ch in enumerate(para) if ch == "."]

        def value(ends, para=para, nodes=nodes):
            total, at = 0.0, 0
            for (b, score), end in zip(nodes, ends, strict=True):
                if end:
                    total += score + (0 if "a" in para[at:b] else sentences.WORDLESS)
                    at = b
            return total

        got = sentences.best_path(para, nodes)
        assert value(got) == max(value(e) for e in itertools.product([False, True], repeat=len(nodes)))


def test_letters_and_units_end_sentences():
    for text in ("It is rich in vitamin C. The next one isn't.", "The gap was 5 mm. Then it closed.", "It took 20 sec. After that it ended."):
        assert len(sentences.Splitter().spans(text)) == 2, text
    for text in ("It was told by J. Thew of A. B. Wu, and M. Roy left.", "See MM. Roy and Sec. Two of it.", "The work by T. This and others"):
        assert len(sentences.Splitter().spans(text)) == 1, text


def test_small_openers():
    splitter = sentences.Splitter(sentences.Openers(small=frozenset(["pgtool"])))
    text = "It ended in the old run. pgtool shows it. See the old run. and more"
    assert [text[a:b] for a, b in splitter.spans(text)] == ["It ended in the old run.", "pgtool shows it.", "See the old run. and more"]


def test_thai_lattice():
    assert sentences.thai_words("ระบบค้นหาบันทึกความยาวของประโยค") == ["ระบบ", "ค้นหา", "บันทึก", "ความ", "ยาว", "ของ", "ประโยค"]
    assert "".join(sentences.thai_words("ฮฮฮระบบ")) == "ฮฮฮระบบ"


def test_sentences_edge(spark):
    df = spark.createDataFrame([("a", "One. Two."), (None, "X."), ("b", None), ("c", "")], "rec_id string, text string")
    got = sorted(map(tuple, sentences.sentences(df).collect()), key=repr)
    assert got == sorted([("a", 0, 0, 4), ("a", 1, 5, 9), (None, 0, 0, 2)], key=repr)
    assert sentences.sentences(df.limit(0)).count() == 0


# ---- scans

WORDS = {w: 5000 for w in "the section skeleton merges half of oversized examples glossary explains any change schema because it is likely that a rule-based rule based splitter table template modern".split()}


def test_scan_repair():
    words = scans.Words(dict(WORDS), {}, {})
    kinds, heads, text = scans.examine("the skel-\neton merges half of the over\xad\nsized examples because the rule-\nbased splitter explains it", words)
    assert kinds == {"hyphen"} and "skeleton" in text and "rule-based" in text and "oversized" in text
    kinds, _, text = scans.examine("it is 1ikely that the glos5ary femplate explains the rnodern table", words)
    assert kinds == {"ocr_char"} and text == "it is likely that the glossary template explains the modern table"
    assert scans.Words({"vehicle": 900, "the": 9000}, {}, {}).meant("vehic1e") == "vehicle"
    for clean in ("the section merges half", "a rule-\nbased splitter", "M-SLEN-01 is v2.1 of 1st", "", "Velnok and Ti"):
        assert scans.examine(clean, words)[0] == set(), clean
    kinds, heads, text = scans.examine("any change of the section because it is\n\n- 130 -\n\nlikely that the glossary merges half.\nTHE TABLE CELLS NOKVEL\nit explains the schema", words)
    assert "page_number" in kinds and "the table cells nokvel" in dict(heads)
    assert "130" not in text


def test_page_noise(spark):
    rows = [(1, "text_plain", "p", "it is likely that the glossary merges\nThe table ce\nhalf of the section because it explains"), (2, "caption", None, None), (None, "caption", "p", "x-\ny"), (3, "text_plain", "p", ""), (4, "caption", "q", "half of the sec-\ntion"), (4, "caption", "q", "half of the sec-\ntion")]
    df = spark.createDataFrame(rows, "rec_id long, field string, paper_key string, text string")
    titles = spark.createDataFrame([("p", "The Table Cells  12"), ("q", None)], "paper_key string, title string")
    words = scans.Words(dict(WORDS), {}, {})
    got = {tuple(r) for r in scans.page_noise(df, titles, words).collect()}
    assert got == {(1, "text_plain", "running_head"), (4, "caption", "hyphen")}
    assert scans.page_noise(df.limit(0), titles.limit(0)).count() == 0
    assert {(r.rec_id, r.text) for r in scans.repaired(df, words).collect() if r.rec_id == 4} == {(4, "half of the section")}


def test_words_judged_by_all_counts(spark, monkeypatch):
    rows = ["vehicle " * 2500 + "the " * 9000, "vehic1e", "a rare vehicie " * 60, "the re-\nuse of it", "re-use once", "the un-\nknown one", "的" * 100 + "平均句长" * 400, "平坷句长", "平冫均句长"]
    df = spark.createDataFrame([(i, "text_plain", "p", t) for i, t in enumerate(rows)], "rec_id long, field string, paper_key string, text string")
    titles = spark.createDataFrame([], "paper_key string, title string")
    want = {(1, "ocr_char"), (5, "hyphen"), (7, "ocr_char"), (8, "ocr_char")}
    for most in (scans.MAX_FACTS, 0):
        monkeypatch.setattr(scans.judged, "__defaults__", (scans.DEFAULT, most))
        assert {(r.rec_id, r.noise_kind) for r in scans.page_noise(df, titles).collect() if r.noise_kind != "running_head"} == want
        fixed = {r.rec_id: r.text for r in scans.repaired(df).collect()}
        assert (fixed[1], fixed[3], fixed[5], fixed[7]) == ("vehicle", "the re-use of it", "the unknown one", "平均句长")


def test_judged_like_the_whole_dictionary(spark):
    texts = scans.scanned_texts(spark, SMALL)
    counts: dict = {"w": {}, "c": {}, "h": {}}
    for r in scans.corpus_counts(texts).collect():
        if r.kind == "h":
            counts["h"][r.key] = max(counts["h"].get(r.key, (0, "")), (r.n, r.mid))
        else:
            counts[r.kind][r.key] = r.n
    words = scans.Words(counts["w"], {k: (m, n) for k, (n, m) in counts["h"].items()}, counts["c"])
    want = {tuple(r) for r in scans.repaired(texts, words).collect()}
    assert {tuple(r) for r in scans.repaired(texts).collect()} == want


def test_texts_are_read_once_to_be_judged(spark, monkeypatch):
    """Words and broken words come of one pass over the texts."""
    rows = ["the re-\nuse of it", "re-use once", "the un-\nknown one", None, "", "a | b\nc-\nd | e\n1 | 2\n3 | 4"]
    df = spark.createDataFrame([(i, "text_plain", "p", t) for i, t in enumerate(rows)], "rec_id long, field string, paper_key string, text string")
    read, real = [], scans.map_rows
    monkeypatch.setattr(scans, "map_rows", lambda df, *a: read.append(df.columns) or real(df, *a))
    _, judge = scans.judged(df)
    assert read.count(["text"]) == 1
    assert judge.facts == {("y", "re\t\tuse"): "own"}
    assert {r.key for r in scans.corpus_counts(df, scans.DEFAULT).filter("kind = 'y'").collect()} == {"re\t\tuse", "un\t\tknown"}
    assert scans.corpus_counts(df).filter("kind = 'y'").count() == 0


def test_noise_without_the_text(monkeypatch):
    """Kinds and header lines are the same where the repaired text isn't asked for; plain wrapped lines need no class then."""
    import random

    judge = scans.Judged({("y", "rule\t\tbased"): "own", ("t", "1ikely"): "likely", ("m", "平坷句"): "均"}, {"平": 500, "均": 500, "句": 500, "长": 500, "坷": 1})
    rnd = random.Random(1)
    bits = ["rule-\n", "based", "\n", "12\n", "THE TITLE", "a b", "| x | y |\n", "- item\n", "平坷句长", "。", "カ\n", "é", "\u0301", " ", "\t", "\u3000", "1ikely", "word\xad\n", "sized", "\r\n", "<b>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(5000)]
    assert {k for t in texts for k in scans.examine(t, judge)[0]} == {"hyphen", "ocr_char", "page_number"}
    for t in texts:
        assert scans.examine(t, judge, whole=False)[:2] == scans.examine(t, judge)[:2], t
    monkeypatch.setattr(scans, "content_class", None)
    assert scans.examine("it is 1ikely that the glossary merges\nhalf of the section", judge, whole=False)[:2] == ({"ocr_char"}, [])


def test_blank_texts_with_line_breaks_stay():
    for text in ("\n", " \n\t\n", "   ", "\u3000"):
        for whole in (True, False):
            assert scans.examine(text, scans.Judged({}, {}), whole=whole) == (set(), [], text)


def test_words_by_pieces():
    """No word goes over a blank, so words may be sought in what stands between blanks."""
    import sys

    blanks = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
    assert not any(scans.WORD.fullmatch(f"a{c}b") or scans.WORD.search(c) for c in blanks)
    for text in ("it's a rule-based\tone,\nwell--known –x’y", "naïve e\u0301t. правило-основа\u00a0это 平均x句长 カa", "", " \n"):
        whole = text if text.isascii() else scans._form(text)
        assert [w for p in scans.pieces_of(text) for w in scans.WORD.findall(p)] == scans.WORD.findall(whole)


def test_best_labels_by_brute_force():
    import itertools

    one = scans.Lines("the section merges\n12\nTHE TABLE CELLS\nhalf of the sec-\ntion because it is", scans.Judged({}, {}), scans.DEFAULT)
    every, after = [scans.DEFAULT.scores(f) for f in one.features], scans.DEFAULT.steps
    best = max(itertools.product(range(4), repeat=5), key=lambda y: sum(every[i][y[i]] for i in range(5)) + sum(after[y[i - 1]][y[i]] for i in range(1, 5)))
    assert one.labels == list(best) == [scans.BODY, scans.NUMBER, scans.HEAD, scans.BROKEN, scans.BODY]


def test_line_model_by_brute_force():
    """Label shares and pair counts of the chain against a sum over all labellings; a fit without texts is the prior."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    scores, after = rng.normal(size=(3, 4, 4)), rng.normal(size=(4, 4))
    there = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    unary, pairs = scans._expected(scores, after, there)
    want_unary, want_pairs = np.zeros_like(scores), np.zeros((4, 4))
    for t in range(3):
        n = int(there[t].sum())
        weight = {y: np.exp(sum(scores[t, i, y[i]] for i in range(n)) + sum(after[y[i - 1], y[i]] for i in range(1, n))) for y in itertools.product(range(4), repeat=n)}
        for y, w in weight.items():
            for i in range(n):
                want_unary[t, i, y[i]] += w / sum(weight.values())
            for i in range(1, n):
                want_pairs[y[i - 1], y[i]] += w / sum(weight.values())
    assert np.allclose(unary, want_unary) and np.allclose(pairs, want_pairs)
    assert np.array_equal(scans.Chain.fit([]).emit, scans.DEFAULT.emit)


def test_line_model_is_fitted_and_finds_held_out_headers(spark):
    texts, titles = scans.scanned_texts(spark, "/root/testdata/sf0.1"), scans.running_titles(spark, "/root/testdata/sf0.1")
    chain = scans.fitted(texts.filter("rec_id % 2 = 0"), titles)
    assert abs(chain.emit - scans.DEFAULT.emit).max() > 0.1
    rows = texts.filter("text LIKE '%\n%' AND field = 'text_plain' AND rec_id % 2 = 1").join(scans.known_titles(titles).groupBy("paper_key").agg({"t": "collect_set"}).toDF("paper_key", "known"), "paper_key").collect()
    found = true = right = 0
    for r in rows:
        if quality.content_class(r.text) is None:
            one = scans.Lines(r.text, scans.Judged({}, {}), chain)
            for line, label in zip(one.lines, one.labels, strict=True):
                known = len(scans.norm_title(line)) >= 8 and any(t.startswith(scans.norm_title(line)) for t in r.known)
                found, true, right = found + (label == scans.HEAD), true + known, right + (known and label == scans.HEAD)
    assert true > 10 and right / true > 0.85 and right / found > 0.6


# ---- languages

TEXTS = {
    "en": "the lower bound of the table is explained by the reading order and the sentence length which nobody has shown",
    "de": "der untere Grenzwert der Tabelle wird durch die Reihenfolge der Spalten und die Länge der Sätze nicht erklärt",
    "fr": "la borne inférieure du tableau est expliquée par l'ordre des colonnes et la longueur des phrases de ce texte",
    "ru": "нижняя граница таблицы объясняется порядком столбцов и длиной предложений этого текста",
    "zh": "平均句长与目标区间同步变化，本节说明论文模板为何简化了默认设置，并且报告了连接词频次",
    "ja": "登録表は二回目の実行の前に長い文の割合を数え直したが、検索の統合は平均の文長を報告している",
    "th": "ระบบค้นหาบันทึกความยาวของประโยคก่อนการทำงานรอบที่สองและตัดทิ้งสัดส่วนประโยคยาว",
}


@pytest.fixture(scope="module")
def detector():
    rng = random.Random(3)
    rows = []
    for lang, text in TEXTS.items():
        words = text.split()
        for _ in range(40):
            rows.append((lang, " ".join(rng.sample(words, len(words))) if len(words) > 3 else text))
    rows += [("fr", TEXTS["en"])] * 3 + [("en", TEXTS["zh"])] * 3
    return language.Detector.fit(sorted(rows))


def test_languages(detector):
    for lang, text in TEXTS.items():
        found, sure = detector.language(text)
        assert found == lang and sure > 0.99
        assert detector.language(text.upper())[0] == lang
    assert detector.language(language.strip_accents(TEXTS["fr"]))[0] == "fr"
    for none in (None, "", " \n", "12.5 % ± 3", "★★", "https://a.example/b"):
        assert detector.language(none)[0] == "unknown"


def test_mixed_segments(detector):
    text = f"{TEXTS['en']}.\n{TEXTS['de']}. ({TEXTS['zh']}。)"
    segs = detector.segments(text)
    assert [s[2] for s in segs] == ["en", "de", "zh"]
    assert segs[0][0] == 0 and segs[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(segs, segs[1:], strict=False))
    assert [s[2] for s in detector.segments(f"{TEXTS['en']} (Der). See https://der.die/das")] == ["en"]


def test_code_column(spark):
    labels = ["EN", "en_US", "zh_Hans", "German", " fra\t", None, " ", "", "unknown", "xx", "Deutsch (AT)", "-", *language.SPELLED]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string").select("i", language.code_of(language.F.col("label")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: language.code(x) for i, x in enumerate(labels)}


def test_codes():
    assert [language.code(x) for x in ("EN", "en_US", "zh_Hans", "German", "fra", None, " ", "unknown", "xx")] == ["en", "en", "zh", "de", "fr", None, None, "unknown", "xx"]


def test_model_is_a_distribution(detector):
    model = detector.models[0]
    alphabet = sorted({ch for t in TEXTS.values() for ch in f"^{t}$".lower()})
    en = language.LANGUAGES.index("en")
    import numpy as np

    got = np.exp(model.score([f"^t{c}" for c in alphabet])[:, en] - model.score(["^t"])[0, en])
    assert got.sum() < 1.05


def test_segment_rows(spark, detector):
    df = spark.createDataFrame([("a", "en", TEXTS["en"]), ("b", None, None), ("c", "de", ""), (None, "x", TEXTS["de"])], "rec_key string, label string, text string")
    got = {(r.rec_key, r.language) for r in language.language_segments(df, detector).collect()}
    assert got == {("a", "en"), ("b", "unknown"), ("c", "unknown"), (None, "de")}
    g = language.group_languages(df, detector).collect()
    assert [(r.rec_key, r.language, r.share) for r in g] == [("a", "en", 1.0)]


def test_held_out_languages(spark):
    """Accuracy on labelled rows that the models weren't fitted on; the labels themselves are partly wrong."""
    cases = spark.read.parquet("/root/testdata/sf0.01/lang_spec_cases.parquet")
    rows = sorted({(r.case_id, language.code(r.expected.language), r.text) for r in cases.collect() if r.text and r.expected and r.expected.language}, key=repr)
    fit = [(lang, text) for i, (_, lang, text) in enumerate(rows) if i % 2]
    det = language.Detector.fit(sorted(fit))
    rest = [(lang, text) for i, (_, lang, text) in enumerate(rows) if not i % 2 and lang in language.LANGUAGES and len(text) > 40]
    right = sum(det.segments(text)[0][2] == lang for lang, text in rest)
    assert right / len(rest) > 0.8


# ---- truncation


def test_truncated(spark):
    whole = ["The reading pipeline explains the lower bound.", "A second engine reports the skipped papers.", "The glossary explains the reading order.", "It reports the lower bound of the papers."]
    rows = [(i, "s", " ".join(whole[(i + k) % 4] for k in range(3 + i % 3))) for i in range(60)]
    cut = [(100, "t", "The glossary explains the reading order. A second eng"), (101, "t", "It reports the lower bound of the"), (102, "t", "The glossary explains the […]"), (103, "t", "A second engine reports,"), (104, "u", "It reports the skipped pap�")]
    kept = [(200, "t", "It reports the lower bound."), (201, "t", None), (202, "t", ""), (203, "t", "It holds.\n\n## The reading order"), (204, "t", "- one\n- two\n- three"), (205, "t", "It is at level 13.5."), (None, "t", "It is cut at the")]
    df = spark.createDataFrame([(*r, "x") for r in rows + cut + kept], "doc_id long, source string, text string, final string")
    got = {r.doc_id for r in truncation.truncated(df).filter("cut").collect()}
    assert got == {100, 101, 102, 103, 104}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_cut_lines_that_are_no_prose(spark):
    whole = [(i, "s", "The second engine explains the glossary and the reading order of it.") for i in range(30)]
    cut = [(100, "t", "It holds.\n\n## The reading ord"), (101, "t", "[3] The second engine [truncated]"), (102, "t", "- one engine\n- two engines\n- three gloss"), (103, "t", "| a | b |\n| 1 | 2 |\n| 3 | 4 [truncated]")]
    kept = [(200, "t", "It holds.\n\n## The reading order"), (201, "t", "See\nhttps://a.org/eng"), (202, "t", "- one engine\n- two orders\n- three engine")]
    df = spark.createDataFrame(whole + cut + kept, "doc_id long, source string, text string")
    assert {r.doc_id for r in truncation.truncated(df).filter("cut").collect()} == {100, 101, 102, 103}


def test_field_limits(spark):
    rng = random.Random(2)
    ends = [("a", 200)] * 30 + [("a", rng.randrange(50, 400)) for _ in range(100)] + [("b", rng.randrange(50, 400)) for _ in range(100)] + [(None, 99)] * 9
    df = spark.createDataFrame(ends, "source string, length int")
    assert {tuple(r) for r in truncation.field_limits(df).collect()} == {("a", 200), (None, 99)}


def test_trie_nodes(spark):
    nodes = truncation.trie_nodes(spark.createDataFrame([("an", 3), ("ant", 2), ("b", 1)], "word string, n long"))
    assert {tuple(r) for r in nodes.collect()} == {("a", 0, 5), ("an", 3, 2), ("ant", 2, 0), ("b", 1, 0)}


    words = spark.createDataFrame([("an", 3), ("ant", 2), ("b", 1)], "word string, n long")
    asked = truncation.asked_buckets(spark.createDataFrame([("an",)], "final string"), "final")
    assert asked.sum() == 1
    assert {tuple(r) for r in truncation.trie_nodes(words, asked).collect()} == {("an", 3, 2)}


def test_only_the_trie_finds_fragments(spark):
    """Final tokens that no context knows are decided by the trie alone; complete unknown words stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, "w", "It reports the lower bound of the docum"), (-2, "w", "It reports the lower bound of the zqxv")], "doc_id long, source string, text string")
    found = truncation.evidence(docs.select("doc_id", "source", "text").unionByName(extra)).withColumn("with_trie", truncation.score() > 0).withColumn("without", truncation.score(False) > 0)
    rows = {r.doc_id: (r.with_trie, r.without) for r in found.collect()}
    assert rows[-1] == (True, False) and rows[-2] == (False, False)
    assert sum(a and not b for a, b in rows.values()) > 1


def test_no_key_gathers_the_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ends = truncation.keyed(truncation.endings(docs)).cache()
    n = ends.count()
    for key in ("tail", "prefix"):
        assert max(r["count"] for r in ends.groupBy(key).count().collect()) <= 0.02 * n


def test_counts_by_brute_force(spark):
    """Contexts of the asked buckets are counted as without them, and a context's counts are those of a plain walk."""
    texts = ["The red cat sat. The red cat ran here", "A red cat. Zoé sat at 3.5 m. 好的句子。好", None, "", "red cat\n. x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = {(r.kind, r.key, r.word): (r.n, r.ends) for r in truncation.corpus_counts(df).collect()}
    assert (whole["w", None, "cat"], whole["w", None, "#"] if ("w", None, "#") in whole else None) == ((4, 0), None)
    codes = truncation.Codes()
    keys = truncation.ending("a red cat", codes)[5]
    assert whole["c", keys[2], None] == (4, 2)
    assert whole["c", keys[4], None] == (4, 2)
    import numpy as np

    asked = np.zeros(truncation.BUCKETS, bool)
    asked[keys[2] & (truncation.BUCKETS - 1)] = True
    some = {(r.kind, r.key, r.word): (r.n, r.ends) for r in truncation.corpus_counts(df, asked).filter("kind = 'c'").collect()}
    assert some == {k: v for k, v in whole.items() if k[0] == "c" and asked[k[1] & (truncation.BUCKETS - 1)]}
