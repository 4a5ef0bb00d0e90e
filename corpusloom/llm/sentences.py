"""Sentences of texts in spaced and spaceless scripts, as half-open spans of code points.

Paragraphs (blank lines) are split first. The terminators of a paragraph form a lattice: each is an end of a sentence or
none, scored by what speaks for and against it (``WEIGHTS``): its left token (abbreviation, initial, figure, ordinal, file
name), the quotation or bracket around it, the word to its right, in Chinese and Japanese the particles that follow. The
best path through the ends, whose edges are the sentences between them, gives the boundaries. Thai has no terminators: its runs are segmented by a lattice over a dictionary, and the gaps between words are
classified by final and opening words. Which words open sentences, also small ones ("iMetric"), is counted over the
whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._arrow import map_rows
from corpusloom.session import texts as table

#: Abbreviations after which a sentence goes on.
NEVER = frozenset(
    """dr mr mrs ms prof rev gen hon mme mlle mm sr sra srta dra d dña fr frl hr st
    e.g i.e cf vs viz approx ca vgl bzw z.b u.a d.h s.o s.u sog inkl z b u a h p.ej p.ex ej ex v.g i e c.à.d
    fig figs sec secs ch chap eq eqs ref refs vol nr nº n.º núm num art abb tab kap bd hrsg s p pp pág págs pag t éd ed eds cap caps fasc tom op cit résp resp ee""".split()
)
#: Abbreviations that end a sentence if a new one follows.
MAYBE = frozenset("etc usw inc ltd co corp a.m p.m u.s u.k e.u al ff f jr uu ee.uu bros dept est min max ibid".split())
ABBREVIATED = NEVER | MAYBE
#: Those that are abbreviations only before a figure.
BEFORE_FIGURE = frozenset("no art s p t ch cap sec fig tab ed vol d m f".split())
#: Abbreviations that are units after a figure, and then end a sentence if a new one follows.
UNITS = frozenset("mm sec st".split())
#: Capital words that open sentences and are no part of a name, so that a letter before them is no initial.
NO_NAME = frozenset(
    """The This That These Those It He She We They There Then But However When After Before While Although Because If Since Its Their
    Der Die Dies Diese Dieser Es Wir Sie Aber Wenn Danach Dann Nach Cette Ces Elle Nous Ils Mais Quand Puis Este Esta Estos Pero Cuando Después""".split()
)
#: German words before an ordinal.
BEFORE_ORDINAL = frozenset("der die das den dem des am im vom zum zur beim ab bis seit und oder jeder jede jedes jeden einen ein eine vor nach".split())

#: Words of Thai in the order of length are found by the lattice; unknown stretches cost most.
THAI = frozenset(
    """การ ความ ของ และ หรือ ที่ ใน จาก ให้ ได้ เป็น มี ไม่ จะ ก็ แต่ กับ ว่า นี้ นั้น ซึ่ง โดย เพื่อ เมื่อ หลัง ก่อน ทุก บท คน ผู้ ระบบ ผล ภาษา เดือน รอบ ใหม่ ยาว หลัก
    ทะเบียน คลัง ข้อความ ค้นหา ผู้ตรวจ ที่สอง ตัววิเคราะห์ นอกจากนี้ ดังนั้น อย่างไรก็ตาม ทำงาน เปรียบเทียบ เอกสาร อ้างอิง หายไป ตัดทิ้ง สัดส่วน ประโยค ตรวจสอบ นำเข้า มกราคม
    กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม รายงาน บันทึก ลงทะเบียน ไว้ ซ้ำกัน แก้ เนื้อหา นับ เพราะ ถ้า หาก เช่น คือ อยู่ แล้ว
    ด้วย ต่อ ตาม ถึง ระหว่าง วันที่ ปี ครั้ง แรก สุดท้าย ข้อมูล ตาราง รูป หน้า ตัวอย่าง งานวิจัย บทความ การศึกษา พบ แสดง ใช้ สามารถ ต้อง ควร อาจ ยัง เรา เขา มัน ท่าน แห่ง ทั้ง ทำให้
    ส่วน จึง เนื่องจาก ทั้งนี้ อีกทั้ง อนึ่ง กล่าวคือ""".split()
)

PARAGRAPH = re.compile(r"(?:[ \t　]*\r?\n){2,}[ \t]*")
SPACELESS = "぀-ヿ㐀-䶿一-鿿豈-﫿"
HARD = "。！？।؟｡"
RUN = re.compile(rf"[.!?…{HARD}．]+")
OPEN = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "“": "”", "«": "»", "„": "“", "‹": "›", "《": "》", "【": "】", "〈": "〉", "‚": "‘"}
CLOSERS = "\"'”’»)]」』）】》›〉“‘"
QUOTES = "\"“”„«»「」『』‹›‚‘"
#: What goes on after a quotation in Japanese and Chinese.
PARTICLES = re.compile(r"(?:と|って|は|が|を|に|の|も|で|へ|や|という|的|等)")
GOES_ON = "，、；：,;:)]）」』”%％"
FIGURE = re.compile(r"[\d][\d.,]*")
#: What stands before a capital letter that belongs to a small word ("vitamin C"), and before a unit.
BEFORE_LETTER = re.compile(r"(?<![^\W_])[a-zà-ÿ]{3,}$")
WORD_RIGHT = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
THAI_RUN = re.compile(r"[฀-๿]+(?:[ 　]+[฀-๿]+)*")
LEAD = re.compile(r"[ \t]*[(\[]?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)\]]+(?=\s)")
#: A bracket that holds a sentence of its own.
OWN_BRACKET = re.compile(r"\([^\W\d_a-z][^()]*[.!?…]\)")
LEAD_ALONE = re.compile(r"[(\[]?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)\]]+\s+")
GERMAN = re.compile(r"\b(?:der|die|das|und|den|dem|nicht|ein|eine|mit|wird|ist|am|im|von|kam|auf)\b")
#: Months that an ordinal may stand before.
MONTH = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")


def thai_words(text: str) -> list[str]:
    """The words of a run without blanks: the cheapest path through the lattice of dictionary words."""
    n = len(text)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(1e9, 0)] * n
    for i in range(n):
        cost = best[i][0]
        for size in range(1, min(16, n - i) + 1):
            c = cost + (1.0 if text[i : i + size] in THAI else 6.0 if size == 1 else 1e9)
            if c < best[i + size][0]:
                best[i + size] = (c, i)
    out, at = [], n
    while at:
        before = best[at][1]
        out.append((before, at))
        at = before
    out.reverse()
    # letters off the dictionary join to one unknown word
    words: list[tuple[int, int]] = []
    for a, b in out:
        known = text[a:b] in THAI
        if words and not known and text[words[-1][0] : words[-1][1]] not in THAI:
            words[-1] = (words[-1][0], b)
        else:
            words.append((a, b))
    return [text[a:b] for a, b in words]


class Openers:
    """Words that open and end sentences, as counted over the corpus."""

    def __init__(self, small: frozenset[str] = frozenset(), first: frozenset[str] = frozenset(), final: frozenset[str] = frozenset()):
        self.small, self.first, self.final = small, first, final


def pairs(text: str) -> list[tuple[int, int]]:
    """Closed outermost quotations and brackets of a paragraph as (opening, closing) positions."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    straight = -1
    if 0 <= text.find("»") < (text.find("«") if "«" in text else len(text)):
        # pointing inwards, as in German print
        text = text.translate({ord("»"): "«", ord("«"): "»"})
    for i, ch in enumerate(text):
        if ch == '"':
            if straight >= 0:
                stack = [s for s in stack if s[1] < straight]
                out.append((straight, i))
                straight = -1
            elif text.find('"', i + 1) > 0:
                straight = i
        elif stack and ch == OPEN[stack[-1][0]]:
            out.append((stack.pop()[1], i))
        elif ch in OPEN:
            stack.append((ch, i))
    out.sort()
    top: list[tuple[int, int]] = []
    for a, b in out:
        if not top or a > top[-1][1]:
            top.append((a, b))
    return top


#: Log odds of a sentence's end by cue; those of a terminator and of what follows add up.
WEIGHTS = {
    "nothing follows": 20.0,
    "hard stop": 6.0,
    "call": -1.0,
    "point": -1.0,
    "ellipsis": -1.0,
    "opening": 3.0,
    "known opening": 10.0,
    "goes on": -20.0,
    "inside": -20.0,
    "particle": -12.0,
    "ellipsis in spaceless": -6.0,
    "glued": -8.0,
    "no token": -8.0,
    "leads a line": -12.0,
    "ordinal": -8.0,
    "initial": -8.0,
    "letter of a word": 8.0,
    "abbreviation": -8.0,
    "unit": 8.0,
}
#: A sentence without a letter or figure.
WORDLESS = -8.0
WORDS_IN = re.compile(r"[^\W_]")


def best_path(para: str, nodes: list[tuple[int, float]]) -> list[bool]:
    """Which terminators (end, score) end a sentence: the best path through the lattice of ends.

    An edge runs from one end to a later one and stands for the sentence between them; it costs ``WORDLESS`` if nothing
    is said there. One pass: only ends without a word since need be compared one by one.
    """
    best: list[tuple[float, int]] = []
    top: list[tuple[float, int]] = []
    since_word = [(0.0, -1)]
    start = 0
    for b, score in nodes:
        if WORDS_IN.search(para, start, b):
            top = [max(top + since_word)]
            since_word = []
        value, back = max(top + [(v + WORDLESS, i) for v, i in since_word])
        since_word.append((value + score, len(best)))
        best.append((value + score, back))
        start = b
    ends = [False] * len(nodes)
    _, at = max([(0.0, -1), *((v, i) for i, (v, _) in enumerate(best))])
    while at >= 0:
        ends[at] = True
        at = best[at][1]
    return ends


def word_before(para: str, end: int) -> str:
    """The word before ``end``, with one blank between them; empty if there's none."""
    stop = end
    while stop > 0 and para[stop - 1].isspace():
        stop -= 1
    at = stop
    while at > 0 and not para[at - 1].isspace():
        at -= 1
    return para[at:stop]


class Splitter:
    def __init__(self, openers: Openers | None = None):
        self.openers = openers or Openers()

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """The sentences of a text; null, empty and blank texts have none."""
        if not text:
            return []
        out: list[tuple[int, int]] = []
        at = 0
        for m in [*PARAGRAPH.finditer(text), None]:
            end = m.start() if m else len(text)
            cuts = [at, *(at + c for c in self._cuts(text[at:end])), end]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b and (text[a].isspace() or text[a] in "​﻿"):
                    a += 1
                while a < b and (text[b - 1].isspace() or text[b - 1] in "​﻿"):
                    b -= 1
                if a < b:
                    out.append((a, b))
            at = m.end() if m else end
        return out

    def _cuts(self, para: str) -> list[int]:
        """The cuts of a paragraph: the best path through the lattice of its terminators."""
        if not para.strip():
            return []
        nodes = list(self._nodes(para))
        cuts = [b for b, ends in zip((b for b, _ in nodes), best_path(para, nodes), strict=True) if ends]
        if re.search("[฀-๿]", para):
            cuts = sorted({*cuts, *self._thai_cuts(para)})
        return cuts

    def _nodes(self, para: str) -> Iterator[tuple[int, float]]:
        """(end of the terminator with its closing marks, score of a sentence's end there) of every terminator."""
        closed = pairs(para)
        german = GERMAN.search(para) is not None
        k = began = 0
        for m in RUN.finditer(para):
            a, b = m.span()
            while k < len(closed) and closed[k][1] < a:
                k += 1
            inside = closed[k] if k < len(closed) and closed[k][0] < a < closed[k][1] else None
            quoted = bracket = False
            cues: list[str] = []
            if inside:
                bracket = para[inside[0]] not in QUOTES
                if para[b : inside[1]].strip(CLOSERS + " \n"):
                    yield b, WEIGHTS["inside"]
                    continue
                opened = self._skip(para, began)
                if bracket and inside[0] > opened and not LEAD_ALONE.fullmatch(para, opened, inside[0]):
                    yield b, WEIGHTS["inside"]
                    continue
                b, quoted = inside[1] + 1, not bracket
            while b < len(para) and para[b] in CLOSERS and (para[b] not in "\"“‘'" or (b + 1 >= len(para) or para[b + 1].isspace())) and not any(o == b for o, _ in closed):
                b += 1
            cues.extend(self._cues(para, m.group(), a, b, quoted, inside is not None, german))
            score = sum(WEIGHTS[c] for c in cues)
            if score > 0:
                began = b
            yield b, score

    @staticmethod
    def _skip(para: str, at: int) -> int:
        while at < len(para) and para[at].isspace():
            at += 1
        return at

    def _starts_new(self, para: str, at: int) -> bool:
        """Whether what stands at ``at`` looks like the opening of a sentence."""
        ch = para[at]
        if ch in "¿¡" or ch in QUOTES or ch in "(（[【":
            return True
        word = WORD_RIGHT.match(para, at)
        if word and (word.group() in self.openers.small):
            return True
        return ch.isupper() or ch.isdigit() or not (ch.islower() or ch.isspace()) and ch.isalpha()

    def _cues(self, para: str, run: str, a: int, b: int, quoted: bool, enclosed: bool, german: bool) -> Iterator[str]:
        """What speaks for and against a sentence's end at a terminator, as keys of ``WEIGHTS``."""
        at = self._skip(para, b)
        if at >= len(para):
            yield "nothing follows"
            return
        after = para[at]
        blank = at > b
        wide = re.match(f"[{SPACELESS}]", after) is not None
        if after in GOES_ON and not (blank and after in "\"”"):
            yield "goes on"
        if self._starts_new(para, at):
            yield "opening"
        if any(ch in HARD or ch == "．" for ch in run):
            yield "hard stop"
            if quoted and not blank and PARTICLES.match(para, at):
                yield "particle"
        elif set(run) <= {"…"} or (set(run) == {"."} and len(run) >= 2):
            yield "ellipsis"
            if wide:
                yield "ellipsis in spaceless"
                if para[max(0, a - 2) : a] == "等等" or para[at : at + 2] in self.openers.first:
                    yield "known opening"
            elif after.isdigit() or not (blank or run[0] == "…"):
                yield "glued"
        elif "!" in run or "?" in run:
            yield "call"
            if not blank and after.isdigit():
                yield "glued"
        else:
            yield "point"
            yield from self._point_cues(para, a, b, at, blank, wide, enclosed, german)

    def _point_cues(self, para: str, a: int, b: int, at: int, blank: bool, wide: bool, enclosed: bool, german: bool) -> Iterator[str]:
        """A single point: by its left token and what follows."""
        after = para[at]
        left = a
        while left > 0 and not para[left - 1].isspace():
            left -= 1
        token = para[left:a].lstrip("([{\"'“„«‘‚（「『¿¡–—-")
        if re.search(f"[{SPACELESS}]$", token):
            yield "hard stop"
            return
        if not token:
            yield "no token"
            return
        if blank and token[-1] in CLOSERS:
            return
        low = token.lower()
        if not blank:
            yield from self._glued_cues(para, token, low, after, at, wide, enclosed)
            return
        word = WORD_RIGHT.match(para, at)
        if FIGURE.fullmatch(token):
            if self._leads_line(para, a - len(token), b):
                yield "leads a line"
            if len(token) <= 2 and MONTH.match(para, at):
                yield "ordinal"
            if german and len(token) <= 3 and token.isdigit():
                if word_before(para, left).lower() in BEFORE_ORDINAL:
                    yield "ordinal"
            return
        if len(token) == 1 and token.isalpha():
            if self._leads_line(para, a - 1, b):
                yield "leads a line"
            if token.isupper():
                yield "initial"
                if word and word.group() in NO_NAME and BEFORE_LETTER.search(word_before(para, a - 1)):
                    yield "letter of a word"
            elif low in NEVER or low in BEFORE_FIGURE:
                yield "abbreviation"
            return
        if low in BEFORE_FIGURE and after.isdigit():
            yield "abbreviation"
        if low in NEVER:
            yield "abbreviation"
            if token in UNITS and word_before(para, a - len(token))[-1:].isdigit() and after.isupper():
                yield "unit"
        elif low in MAYBE:
            if after == "(" and not OWN_BRACKET.match(para, at):
                yield "goes on"
        elif "." in token and all(len(x) <= 2 for x in token.split(".")) and not FIGURE.match(token) and not (after.isupper() and len(token) <= 3):
            yield "abbreviation"

    def _glued_cues(self, para: str, token: str, low: str, after: str, at: int, wide: bool, enclosed: bool) -> Iterator[str]:
        """A point without a blank after it: within a name, a figure, a link, or a blank was lost."""
        if enclosed:
            return
        if wide:
            yield "hard stop" if len(token) > 2 and token[-1].isalpha() else "glued"
        elif "/" in token or "@" in token:
            yield "glued"
        elif not (after.isupper() or after in "¿¡\"“«„(" or (after.isalpha() and not after.islower() and not after.isupper())):
            yield "glued"
        elif FIGURE.fullmatch(token):
            if not (after.isupper() and para[at + 1 : at + 2].islower()):
                yield "glued"
        elif not (len(token) > 2 and token[-1].isalpha() and token[-2:].islower() | (not token[-1].isupper() and not token[-1].islower()) and low not in NEVER and "." not in token and "_" not in token):
            yield "glued"

    @staticmethod
    def _leads_line(para: str, start: int, end: int) -> bool:
        """Whether a number or letter leads a line that begins something new (and isn't wrapped from the line before)."""
        line = para.rfind("\n", 0, start) + 1
        if not LEAD.match(para, line) or para[line:start].strip(" \t(["):
            return False
        before = para[:line].rstrip()
        return not before or before[-1] in ".!?…:;" + HARD + CLOSERS

    def _thai_cuts(self, para: str) -> Iterator[int]:
        """Cuts in Thai: a gap (a blank, or the end of a final word) before an opening word."""
        for run in THAI_RUN.finditer(para):
            at = run.start()
            before: str | None = None
            for chunk in re.split(r"([ 　]+)", run.group()):
                if not chunk:
                    continue
                if chunk.isspace():
                    at += len(chunk)
                    continue
                words = thai_words(chunk)
                for i, word in enumerate(words):
                    gap = i == 0
                    if before is not None and (gap and (word in self.openers.first or not self.openers.first or before in self.openers.final) or not gap and before in self.openers.final and word in self.openers.first):
                        yield at
                    at += len(word)
                    before = word


OPENINGS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
#: Openers are kept if so many of their uses open (end) a sentence; the collected set is bounded by the next constant.
OPENS, SEEN, MAX_OPENERS = 0.3, 3, 100_000
AFTER_STOP = re.compile(r"([^\W\d_]{3,})[.!?]\s+([^\W\d_][\w-]*)|(?:\A|\n\s*\n)\s*([^\W\d_][\w-]*)")
AFTER_WIDE = re.compile(rf"(?:\A|[。！？]|\n\s*\n)\s*([{SPACELESS}]{{2}})")


def opener_counts(texts: DataFrame) -> DataFrame:
    """kind, word, n: uses of words (t), openings (s), Han pairs that open (h), Thai words in all (ta), first (tf) and last (tl)."""

    def make():
        def work(values: list) -> Iterator[tuple]:
            out: Counter = Counter()
            for text in values:
                if not text:
                    continue
                for m in AFTER_STOP.finditer(text):
                    word = m.group(2) or m.group(3)
                    if word[0].islower() and not (m.group(1) and m.group(1).lower() in ABBREVIATED):
                        out["s", word] += 1
                out.update(("t", w) for w in WORD_RIGHT.findall(text) if w[0].islower() and w.isascii())
                out.update(("h", w) for w in AFTER_WIDE.findall(text))
                for run in THAI_RUN.findall(text):
                    for chunk in run.split():
                        words = thai_words(chunk)
                        out.update(("ta", w) for w in words)
                        out["tf", words[0]] += 1
                        out["tl", words[-1]] += 1
            for (kind, word), n in out.items():
                yield kind, word, n

        return work

    return map_rows(texts.select("text"), make, OPENINGS).groupBy("kind", "word").agg(F.sum("n").alias("n"))


def corpus_openers(texts: DataFrame) -> Openers:
    """The opening and final words of a corpus; rates are computed before anything is collected."""
    counts = opener_counts(texts)
    wide = counts.groupBy("word").pivot("kind", ["s", "t", "h", "ta", "tf", "tl"]).agg(F.first("n")).na.fill(0)
    rate = lambda part, whole: (F.col(part) >= SEEN) & (F.col(part) >= OPENS * F.col(whole))
    kept = wide.select("word", rate("s", "t").alias("small"), (F.col("h") >= SEEN).alias("han"), rate("tf", "ta").alias("first"), rate("tl", "ta").alias("final"))
    rows = kept.filter("small OR han OR first OR final").limit(MAX_OPENERS + 1).collect()
    if len(rows) > MAX_OPENERS:
        raise ValueError("more opening words than expected")
    return Openers(
        frozenset(r["word"] for r in rows if r["small"]),
        frozenset(r["word"] for r in rows if r["han"] or r["first"]),
        frozenset(r["word"] for r in rows if r["final"]),
    )


SPANS = T.StructType([T.StructField("rec_id", T.StringType()), T.StructField("sent_no", T.IntegerType()), T.StructField("sent_start", T.LongType()), T.StructField("sent_end", T.LongType())])


def sentences(texts: DataFrame, openers: Openers | None = None) -> DataFrame:
    """rec_id, sent_no, sent_start, sent_end of every sentence of ``texts`` (rec_id, text).

    Null, empty and blank texts have no sentences; repeated rows are repeated; a null rec_id stays null; extra columns
    are ignored; an empty table gives no rows. Long texts are split whole.
    """
    openers = openers or corpus_openers(texts)
    known = (openers.small, openers.first, openers.final)

    def make():
        splitter = Splitter(Openers(*known))

        def work(ids: list, values: list) -> Iterator[tuple]:
            for i, text in zip(ids, values, strict=True):
                for n, (a, b) in enumerate(splitter.spans(text)):
                    yield i, n, a, b

        return work

    return map_rows(texts.select(F.col("rec_id").cast("string").alias("rec_id"), "text"), make, SPANS)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clause_spec_cases").select(F.col("case_id").alias("rec_id"), "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences(_cases(spark, sf_dir)).withColumnRenamed("rec_id", "case_id")
    return found.filter("case_id IS NOT NULL").select("case_id", "sent_start", "sent_end").distinct()


def p3_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recorded clause with the index of the sentence that holds most of it (the first of equals); null where none does."""
    spans = table(spark, sf_dir, "clause_spans").select("case_id", "clause_no", "span_start", "span_end", F.col("sentence_index").alias("old_index"))
    sents = sentences(_cases(spark, sf_dir).distinct()).withColumnRenamed("rec_id", "case_id")
    shared = F.least("span_end", "sent_end") - F.greatest("span_start", "sent_start")
    met = spans.join(sents, "case_id").withColumn("shared", shared).filter("shared > 0")
    best = met.groupBy("case_id", "clause_no", "span_start", "span_end").agg(F.max_by("sent_no", F.struct("shared", -F.col("sent_no"))).alias("sentence_index"))
    return spans.join(best, ["case_id", "clause_no", "span_start", "span_end"], "left")


QUERIES = {"p3_found": p3_found, "p3_clauses": p3_clauses}
