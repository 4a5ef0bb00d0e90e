"""Sentence and clause splitting by rules, as one Arrow function over whole texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations after which a point ends nothing.
ABBREVIATIONS = frozenset(
    """al etc fig figs eq eqs vs cf cmp approx no nos sec secs ref refs i.e e.g u.s u.k e.u ph.d m.s b.s dr prof mr mrs ms st jr sr
    inc ltd co corp dept univ vol vols pp p ch chap app appendix min max avg est resp ibid viz seq alii
    jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun""".split()
)
CJK_STOPS = "。！？…"
#: Closing marks between a stop and the blank after it, and those that a CJK sentence keeps.
CLOSERS, CJK_CLOSERS = "\"')]}»”’", "」』】》）］＞〉"
CLAUSE_MARKS = "，；：,;:"
BLANKED = re.compile(r"(?im)^[ \t]*(?:keywords?|key[ \t]+words|关键词|关键字)[ \t]*[:：][^\n]*|\$\$[^$\n]*\$\$|\$[^$\n]*\$|</?(?:sub|sup)\b[^>]*>")
NUMBERING = re.compile(r"\s*(?:\d{1,3}|\[\d{1,3}\]|\(\d{1,3}\))")
INITIAL_BEFORE = re.compile(r"[ \t]+[A-Z][A-Za-z.]")
CANDIDATE = re.compile(rf"[.!?]+|[{CJK_STOPS}]+")
LETTER = re.compile("[A-Za-z㐀-䶿一-鿿豈-﫿]")
BRACKETS = {"(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "「": "」", "『": "』", "“": "”"}

SENTENCES = T.ArrayType(
    T.StructType([T.StructField("no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_clauses", T.IntegerType())])
)


def masked(text: str) -> str:
    """The text with keyword lines, formulas and sub/superscript tags blanked at equal length."""
    return BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text) if "$" in text or "<" in text or "key" in text.lower() or "关键" in text else text


def _left_word(text: str, end: int) -> str:
    """The word that ends at ``end``, with points between its parts kept ("i.e")."""
    at = end
    while at > 0 and text[at - 1].isascii() and (text[at - 1].isalpha() or text[at - 1] == "." and at < end and text[at - 2 : at - 1].isascii() and text[at - 2 : at - 1].isalpha()):
        at -= 1
    return text[at:end]


def _point_holds(text: str, point: int, after: int) -> bool:
    """Whether a point before a blank ends nothing: a line's number, an abbreviation, an initial, or a small letter follows.

    What follows is looked for in the same line only: a line break lets the sentence end.
    """
    if NUMBERING.fullmatch(text, text.rfind("\n", 0, point) + 1, point):
        return True
    word = _left_word(text, point)
    if word.lower() in ABBREVIATIONS or (len(word) == 1 and word.isupper() and INITIAL_BEFORE.match(text, point + 1)):
        return True
    while after < len(text) and text[after] in " \t\f\v":
        after += 1
    return text[after : after + 1].islower()


def _is_end(text: str, start: int, end: int) -> bool:
    """Whether the stops at text[start:end] end a sentence.

    CJK stops always do; ASCII stops do before a blank or the end, closing marks apart, unless a point holds on
    (``_point_holds``). A half-width point among other signs than ASCII letters and figures is a CJK stop.
    """
    if text[start] in CJK_STOPS:
        return text[end : end + 1] != "."
    after = end
    while after < len(text) and text[after] in CLOSERS:
        after += 1
    if after >= len(text) or text[after].isspace():
        if text[end - 1] != "." or not _point_holds(text, end - 1, after):
            return True
    if text[end - 1] != ".":
        return False
    before, nxt = text[max(0, end - 2) : end - 1], text[end : end + 1]
    plain = lambda ch: ch.isdigit() or ch.isascii() and ch.isalpha()
    return not plain(before) and not plain(nxt) and not (nxt and nxt in CJK_STOPS)


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    """Half-open spans without outer blanks; pieces without an ASCII letter or ideograph are dropped. Null and blank: none."""
    if not text or not text.strip():
        return []
    probe = masked(text)
    spans, at = [], 0
    for m in [*CANDIDATE.finditer(probe), None]:
        end = m.end() if m else len(text)
        if m and not _is_end(probe, m.start(), end):
            continue
        if m and probe[m.start()] in CJK_STOPS:
            while end < len(text) and probe[end] in CJK_CLOSERS:
                end += 1
        a, b = at, end
        while a < b and probe[a].isspace():
            a += 1
        while b > a and probe[b - 1].isspace():
            b -= 1
        if LETTER.search(probe, a, b):
            spans.append((a, b))
        at = end
    return spans


def split_clauses(sentence: str) -> list[tuple[int, int]]:
    """Clauses between commas, semicolons and colons outside closed brackets; figures keep their commas."""
    inside, stack = [False] * len(sentence), []
    for i, ch in enumerate(sentence):
        if ch in BRACKETS:
            stack.append((BRACKETS[ch], i))
        elif stack and ch == stack[-1][0]:
            _, start = stack.pop()
            inside[start : i + 1] = [True] * (i + 1 - start)
    cuts = [0]
    for i, ch in enumerate(sentence):
        if ch in CLAUSE_MARKS and not inside[i] and not (ch in ",:" and sentence[i - 1 : i].isdigit() and sentence[i + 1 : i + 2].isdigit()):
            cuts.append(i + 1)
    cuts.append(len(sentence))
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = sentence[a:b]
        if any(ch.isalnum() for ch in piece):
            out.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())))
    return out


def sentences_udf():
    """text -> array<struct<no, start, end, text, n_clauses>>, Arrow-batched; null for null."""

    @F.pandas_udf(SENTENCES)
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None):
            if text is None:
                return None
            return [{"no": i, "start": a, "end": b, "text": text[a:b], "n_clauses": len(split_clauses(text[a:b]))} for i, (a, b) in enumerate(split_sentences(text))]

        return texts.map(one)

    return run


def mtld_of(words: list[str], threshold: float = 0.720, least: int = 20) -> float | None:
    """Bidirectional MTLD; None under ``least`` tokens or where no factor was begun."""
    if len(words) < least:
        return None
    total = 0.0
    for way in (words, words[::-1]):
        seen: set[str] = set()
        n, factors = 0, 0.0
        for w in way:
            seen.add(w)
            n += 1
            if len(seen) <= threshold * n:
                factors += 1
                seen.clear()
                n = 0
        if n:
            factors += (1 - len(seen) / n) / (1 - threshold)
        if not factors:
            return None
        total += len(words) / factors
    return total / 2


ASCII_WORD = re.compile(r"[A-Za-z][A-Za-z'-]*")


def mtld_udf():
    """text -> MTLD, Arrow-batched: the fold over a growing set is an order of magnitude slower as a higher-order function."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mtld_of(ASCII_WORD.findall(t.lower()))).astype(float)

    return run
