"""Repair of text from scanned pages: broken words, misread characters, running titles and page numbers.

The lines of a text are labelled body, broken (body whose last word goes on in the next line), header or page number by
a linear-chain conditional model over layout features (width, blank neighbours, how the sentence flows around the line,
letter case, figures), decoded by Viterbi. Its weights are fitted on the corpus itself, on a bounded sample of texts whose
header lines are known because they are running titles of the paper; the prior they are drawn to holds where a corpus has
no such lines. Headers the layout alone leaves in doubt are settled by the paper's running titles, joined by (paper, title
prefix), or by standing in several blocks of the paper. Whether a hyphen is the word's own, and whether a word was misread,
is decided by the counts of words over the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._arrow import map_rows, once
from corpusloom.llm.lookalikes import Canonical
from corpusloom.llm.quality import content_class, is_unreadable
from corpusloom.session import checkpoint
from corpusloom.session import texts as table

#: What scanners read for what (read, meant).
MISREAD = [
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("nn", "m"), ("in", "m"), ("ii", "u"), ("ii", "ü"), ("6", "é"), ("6", "ó"), ("a", "ä"), ("o", "ö"), ("ri", "n"),
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("I", "l"), ("l", "I"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("j", "i"), ("i", "j"), ("n", "u"), ("u", "n"), ("b", "h"), ("h", "b"), ("l", "t"), ("t", "l"),
    ("o", "a"), ("a", "o"), ("v", "y"), ("y", "v"), ("q", "g"), ("g", "q"), ("р", "п"), ("п", "н"), ("н", "п"), ("и", "н"), ("н", "и"), ("ш", "щ"), ("щ", "ш"), ("с", "е"), ("е", "с"), ("ь", "ъ"), ("з", "э"), ("3", "з"), ("б", "6"), ("0", "о"),
]
#: Parts of Han characters that stand alone only where a character was read in two.
HAN_PARTS = "冫氵讠亻扌忄纟钅饣礻衤犭疒宀冖艹辶阝刂彳"
#: A word is misread if what it is read for is so much more frequent, and has at least so many uses.
RATIO, RATIO_SHORT, LEAST = 50, 500, 20
#: Up to so many judgements other than "fine" go to the workers; beyond it they are joined to the texts that ask for them.
MAX_FACTS = 500_000
HAN = "㐀-䶿一-鿿"

HAN_CHAR = re.compile(f"[{HAN}]")
BREAKS = "-‐‑¬­"
#: Letters of the scripts that are read as words, and figures.
LETTERS = "0-9A-Za-zªµºÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
WORD = re.compile(f"[{LETTERS}]+(?:[-‐‑'’][{LETTERS}]+)*")
BROKEN_END = re.compile(rf"([^\W\d_]+(?:[-‐][^\W\d_]+)*)([{BREAKS}])[ \t]*$")
FIRST_WORD = re.compile(r"\s*([^\W\d_]+(?:[-‐][^\W\d_]+)*)")
#: A line that ends in a hyphen, and the word broken there.
BREAK = re.compile(rf"[{BREAKS}][ \t]*\n")
ACROSS = re.compile(rf"\S*[{BREAKS}][ \t]*\n\s*\S*")
PAGE = re.compile(r"(?:[-–—\[(|·•~*]+\s*)?(?:(?:p|pp|pag|pág|s|seite|page|página|стр|с)\.?\s*|第\s*)?(\d{1,5}|(?=[ivxlc]{2})[ivxlc]{2,8})(?:\s*(?:/|of|von|de|sur)\s*\d{1,5})?\s*(?:页|頁|ページ)?(?:\s*[-–—\])|·•~*]+)?", re.I)
BESIDE = re.compile(r"(?:\s{2,}|\s*[|·•]\s*)[-–—\[(]?\s*\d{1,5}\s*[-–—\])]?$|^[-–—\[(]?\s*\d{1,5}\s*[-–—\])]?(?:\s{2,}|\s*[|·•]\s*)(?=\S)")
STOPS = ".!?;:,。！？；：，、…।؟"
#: What ends a sentence, and what may close behind it.
ENDS, CLOSERS = tuple(".!?。！？…।؟"), "\"'”’»」』）)]"
INSIDE = re.compile(r"[.!?;。！？；](?:(?<=[。！？；])|(?<=[a-zà-ÿа-я0-9].)\s+[A-ZÀ-ÞА-Я])")
COMMA = re.compile(r"[，、；]|[,;:] ")
DIGITS = re.compile(r"\d")
BLANKS = re.compile(r"\s+")
SPACELESS_END = re.compile(f"[{HAN}぀-ヿ]")
UPPERS, LOWERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Pieces between blanks that are remembered to need no repair: how long and how many at most.
FINE_CHARS, FINE = 40, 500_000

_form = Canonical()

BODY, BROKEN, HEAD, NUMBER = range(4)
#: What a line is described by: what stands around it, how it begins and ends, whether it can be a title or a number at all.
FEATURES = ("any", "blank", "flow", "wrap", "capital", "upper", "stop", "inside", "full", "edge", "beside", "name", "lower", "untitled", "number", "hyphen", "comma", "short", "long")
PLACE = {name: i for i, name in enumerate(FEATURES)}
#: Prior weights of the features by label (a body line has none), and of a label after another one.
PRIOR = {
    HEAD: {"any": -5.5, "blank": 2.0, "flow": 2.5, "wrap": 1.5, "capital": 1.0, "upper": 3.0, "stop": -4.0, "inside": -6.0, "full": -2.0, "edge": -1.5, "beside": 3.5, "name": 1.0, "lower": -2.0, "untitled": -20.0, "number": -20.0},
    NUMBER: {"any": -9.0, "number": 15.0},
    BROKEN: {"any": -9.0, "hyphen": 12.0},
}
PRIOR_AFTER = {(HEAD, NUMBER): 1.0, (NUMBER, HEAD): 1.0, (HEAD, HEAD): -1.0}
#: A header that the layout alone leaves in doubt has at least these log odds against body; beside another header or number one less.
DOUBT, NEAR = -4.5, 1.0
#: Texts that the weights are fitted on, at most, and their greatest length.
SAMPLE, SAMPLE_CHARS = 2_000, 20_000
#: How strongly the weights are drawn to the prior, steps of the fit and their size.
DRAWN, STEPS, STEP = 5.0, 80, 0.15


class Chain:
    """Weights of the line labels: ``emit`` by label and feature, ``after`` by label and the one before."""

    def __init__(self, emit: np.ndarray | None = None, after: np.ndarray | None = None):
        if emit is None or after is None:
            emit, after = np.zeros((4, len(FEATURES))), np.zeros((4, 4))
            for label, weights in PRIOR.items():
                for name, w in weights.items():
                    emit[label, PLACE[name]] = w
            for (before, label), w in PRIOR_AFTER.items():
                after[before, label] = w
        self.emit, self.after = emit, after
        self.rows = emit.tolist()
        self.steps = after.tolist()
        self.lower = self.rows[HEAD][PLACE["lower"]]
        self.head = (emit[HEAD] - emit[BODY]).tolist()

    def scores(self, features: list[int]) -> list[float]:
        """The score of each label for a line with these features."""
        return [sum(row[k] for k in features) for row in self.rows]

    @classmethod
    def fit(cls, texts: list[tuple[list[list[int]], list[int]]]) -> Chain:
        """Fitted on (features of each line, labels) by the conditional likelihood of whole texts, drawn to the prior."""
        prior = cls()
        texts = [t for t in texts if t[0]]
        if not texts:
            return prior
        n, longest = len(texts), max(len(f) for f, _ in texts)
        x = np.zeros((n, longest, len(FEATURES)))
        gold = np.zeros((n, longest, 4))
        there = np.zeros((n, longest), bool)
        for t, (features, labels) in enumerate(texts):
            for i, (f, label) in enumerate(zip(features, labels, strict=True)):
                x[t, i, f] = 1
                gold[t, i, label] = 1
                there[t, i] = True
        gold_after = np.einsum("tib,tia->ba", gold[:, :-1], gold[:, 1:])
        flat = x.reshape(-1, len(FEATURES))
        gold_emit = gold.reshape(-1, 4).T @ flat
        emit, after = prior.emit.copy(), prior.after.copy()
        moments = [np.zeros_like(emit), np.zeros_like(after), np.zeros_like(emit), np.zeros_like(after)]
        for step in range(1, STEPS + 1):
            unary, pairs = _expected((flat @ emit.T).reshape(n, longest, 4), after, there)
            grads = (gold_emit - unary.reshape(-1, 4).T @ flat - DRAWN * (emit - prior.emit), gold_after - pairs - DRAWN * (after - prior.after))
            for k, (w, g) in enumerate(zip((emit, after), grads, strict=True)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
                w += STEP * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
        return cls(emit, after)


def _expected(scores: np.ndarray, after: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of each label at each line, expected uses of each pair of labels) of a chain, all texts at once."""
    n, longest, k = scores.shape
    own = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(after)
    ahead, back = np.empty((longest, n, k)), np.ones((longest, n, k))
    size = np.ones((longest, n, 1))
    for i in range(longest):
        now = own[:, i] if i == 0 else np.where(there[:, i, None], (ahead[i - 1] @ step) * own[:, i], ahead[i - 1])
        size[i] = now.sum(axis=1, keepdims=True)
        ahead[i] = now / size[i]
    pairs = np.zeros((k, k))
    for i in range(longest - 1, 0, -1):
        reached = np.where(there[:, i, None], own[:, i] * back[i] / size[i], 0.0)
        pairs += step * (ahead[i - 1].T @ reached)
        back[i - 1] = np.where(there[:, i, None], reached @ step.T, 1.0)
    return (ahead * back).transpose(1, 0, 2) * there[:, :, None], pairs


DEFAULT = Chain()


def norm_title(text: str) -> str:
    """A running title without numbers, case and outer marks."""
    return BLANKS.sub(" ", re.sub(r"^[\W\d_]+|[\W\d_]+$", "", text)).lower()


def _beside(line: str) -> bool:
    """Whether a number stands beside other words in a line of its own."""
    return (line[0] in "0123456789-–—[(" or line[-1] in "0123456789-–—])") and BESIDE.search(line) is not None


def _mostly_upper(text: str) -> bool:
    """Whether a text has more capital than small letters."""
    if text.isascii():
        data = text.encode()
        return len(data.translate(None, UPPERS)) < len(data.translate(None, LOWERS))
    return sum(map(str.isupper, text)) > sum(map(str.islower, text))


def _is_number(line: str) -> bool:
    return len(line) <= 30 and PAGE.fullmatch(line) is not None and (DIGITS.search(line) is not None or line.islower())


#: Misread pairs of single characters, and what several characters are read for.
SINGLE = frozenset((a, b) for a, b in MISREAD if len(a) == len(b) == 1)
SEVERAL = [(a, b) for a, b in MISREAD if len(a) == 2 and a in ("rn", "cl", "vv", "nn", "ii")]


def _classes() -> dict[int, str]:
    """Every character of a misread pair -> the representative of the characters it can be taken for."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in SINGLE:
        root[find(a)] = find(b)
    return {ord(x): find(x) for pair in SINGLE for x in pair}


CLASS = _classes()


def _narrow(word: str) -> str:
    for read, meant in SEVERAL:
        if read in word:
            word = word.replace(read, meant)
    return word


def _swaps(a: str, b: str) -> int:
    """Places in which the first word has another character, 99 if one isn't a misread pair or the lengths differ."""
    return sum(0 if x == y else 1 if (x, y) in SINGLE else 99 for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99


def _misreadings(read: str, meant: str) -> int:
    """Characters of ``read`` that were misread if ``meant`` stood there; 99 or more if that can't be."""
    a, b = _narrow(read), _narrow(meant)
    several = max(1, abs(len(read) - len(meant))) if a != read or b != meant else 0
    return min(_swaps(read, meant), several + _swaps(a, b))


def _alike_keys(word: str) -> set[str]:
    """What a word shares with all words that it can be taken for, letter by letter or with letters run together."""
    return {word.translate(CLASS), _narrow(word).translate(CLASS)}


class Words:
    """Words, Han contexts and characters with their counts, and the judgements that follow from them."""

    def __init__(self, counts: dict[str, int], contexts: dict[str, tuple[str, int]], chars: dict[str, int]):
        self.counts, self.contexts, self.chars = counts, contexts, chars
        self.judged: dict[str, str | None] = {}
        #: Pieces between blanks whose words are known to need no repair.
        self.fine: set[str] = set()
        most = max(chars.values(), default=0)
        self.common = frozenset(c for c, n in chars.items() if n * RATIO * 2 >= most and c not in HAN_PARTS)
        #: Frequent words by what all words that can be taken for each other share.
        self.alike: dict[str, list[tuple[int, str]]] = {}
        for word, n in counts.items():
            if n >= LEAST:
                for key in _alike_keys(word):
                    self.alike.setdefault(key, []).append((n, word))
        self.top = max(counts.values(), default=0)

    def own_hyphen(self, a: str, mark: str, b: str) -> bool:
        """Whether the hyphen between a and b belongs to the word."""
        a, b = a.lower().replace("‐", "-"), b.lower().replace("‐", "-")
        joined, apart = self.counts.get(a + b, 0), self.counts.get(f"{a}-{b}", 0)
        if joined or apart:
            return apart > joined
        if mark in "¬­":
            return False
        return self.counts.get(a, 0) >= LEAST and self.counts.get(b, 0) >= LEAST

    def meant(self, token: str) -> str | None:
        """The word that a misread token stands for; None if the token is no such."""
        got = self.judged.get(token, "")
        if got != "":
            return got
        if len(self.judged) > 500_000:
            self.judged.clear()
        self.judged[token] = found = self._meant(token)
        return found

    def _meant(self, token: str) -> str | None:
        digits = DIGITS.search(token) is not None
        if not _can_be_misread(token):
            return None
        capital = token[0].isupper()
        form = _lower_form(token)
        own = max(self.counts.get(form, 0), self.counts.get(form.lower(), 0), self.counts.get(token, 0))
        if own * RATIO > self.top:
            return None
        least = max(1, own) * (RATIO if len(form) > 3 or digits else RATIO_SHORT)
        best: tuple[int, str] | None = None
        for n, word in (x for key in _alike_keys(form) for x in self.alike.get(key, ())):
            if n >= least and word != form and (best is None or n > best[0]) and _misreadings(form, word) <= min(3, max(1, len(word) // 3)):
                best = (n, word)
        if best is None:
            return None
        return best[1][0].upper() + best[1][1:] if capital else best[1]

    def fix_words(self, text: str) -> tuple[str, bool]:
        """(the text with misread words put right, whether there were any)."""
        found = False
        counts, judged = self.counts, self.judged
        new = set(text.split()) - self.fine
        if len(self.fine) > FINE:
            self.fine.clear()
        for piece in new:
            bad = False
            for token in WORD.findall(piece):
                for part in (token,) if "-" not in token and "'" not in token and "’" not in token else re.split(r"[-'’‐‑]", token):
                    if counts.get(part, 0) * RATIO > self.top:
                        continue
                    meant = judged.get(part, "")
                    if meant == "":
                        meant = self.meant(part)
                    if meant is not None:
                        found = bad = True
                        text = re.sub(rf"(?<![^\W_]){re.escape(part)}(?![^\W_])", meant, text)
            if not bad and len(piece) <= FINE_CHARS:
                self.fine.add(piece)
        return text, found

    def fix_han(self, text: str) -> tuple[str, bool]:
        """(the text with misread Han characters put right, whether there were any)."""
        if text.isascii() or not HAN_CHAR.search(text):
            return text, False
        rare = {c for c in set(text) - self.common if "㐀" <= c <= "鿿" or c in HAN_PARTS}
        return self._fix_han(text, rare) if rare else (text, False)

    def _expected(self, before: str, after: str) -> tuple[str, int]:
        """The character that stands between two others most often; else the one that mostly goes with one of them."""
        mid, n = self.contexts.get(before + after, ("", 0))
        if n >= LEAST:
            return mid, n
        for key, side in ((before + "\0", before), ("\0" + after, after)):
            mid, n = self.contexts.get(key, ("", 0))
            if n >= LEAST and 2 * n > self.chars.get(side, 1 << 60):
                return mid, n
        return "", 0

    def _fix_han(self, text: str, rare: set[str]) -> tuple[str, bool]:
        out, found = list(text), False
        for i, ch in enumerate(text):
            if ch not in rare:
                continue
            if ch in HAN_PARTS:
                found = True
                continue
            before, after = text[i - 1 : i] or "^", text[i + 1 : i + 2] or "^"
            mid = self.mid(before, ch, after)
            if mid:
                out[i] = mid
                found = True
        return "".join(out), found

    def mid(self, before: str, ch: str, after: str) -> str:
        """The character that a rare one between two others was misread for; empty if it wasn't."""
        mid, _ = self._expected(before, after)
        return mid if mid and mid != ch and self.chars.get(ch, 0) * RATIO < self.chars.get(mid, 0) else ""


class Judged(Words):
    """Judgements made over the whole corpus beforehand: what isn't named needs no repair. ``facts``: (kind, key) -> answer."""

    def __init__(self, facts: dict[tuple[str, str], str], chars: dict[str, int]):
        super().__init__({}, {}, chars)
        self.facts = facts

    def own_hyphen(self, a: str, mark: str, b: str) -> bool:
        return ("y", _hyphen_key(a, mark, b)) in self.facts

    def meant(self, token: str) -> str | None:
        word = self.facts.get(("t", _lower_form(token)))
        return word[0].upper() + word[1:] if word and token[0].isupper() else word

    def mid(self, before: str, ch: str, after: str) -> str:
        return self.facts.get(("m", before + ch + after), "")


class Asking(Judged):
    """Notes what is asked about, in ``asked`` as (kind, key)."""

    def __init__(self, facts: dict[tuple[str, str], str], chars: dict[str, int]):
        super().__init__(facts, chars)
        self.asked: set[tuple[str, str]] = set()

    def own_hyphen(self, a: str, mark: str, b: str) -> bool:
        self.asked.add(("y", _hyphen_key(a, mark, b)))
        return super().own_hyphen(a, mark, b)

    def fix_words(self, text: str) -> tuple[str, bool]:
        for token in set(WORD.findall(text)):
            self.asked.update(("t", _lower_form(part)) for part in ((token,) if token.isalnum() else re.split(r"[-'’‐‑]", token)) if _can_be_misread(part))
        return text, False

    def mid(self, before: str, ch: str, after: str) -> str:
        self.asked.add(("m", before + ch + after))
        return ""


def _hyphen_key(a: str, mark: str, b: str) -> str:
    return "\t".join((a.lower().replace("‐", "-"), "soft" if mark in "¬\xad" else "", b.lower().replace("‐", "-")))


def pieces_of(text: str) -> list[str]:
    """What stands between the blanks of a text; letters that only look different are one. No word goes over a blank."""
    return (text if text.isascii() else _form(text)).split()


def _can_be_misread(token: str) -> bool:
    letters = sum(map(str.isalpha, token))
    digits = DIGITS.search(token) is not None
    return not (letters < 2 or (digits and (letters < len(token) / 2 or re.fullmatch(r"\d+(?:st|nd|rd|th|er|ème|º|ª|[a-z])", token, re.I))))


def _lower_form(token: str) -> str:
    """The form under which a token is counted."""
    return token.lower() if token.isupper() and len(token) > 1 and DIGITS.search(token) is None else token[0].lower() + token[1:]


class Lines:
    """The labelled lines of one text."""

    def __init__(self, text: str, words: Words, chain: Chain):
        raw = text.split("\n")
        self.lines = [x.strip() for x in raw if x.strip()]
        blank: list[bool] = []
        gap = False
        for x in raw:
            if x.strip():
                blank.append(gap)
                gap = False
            else:
                gap = bool(blank)
        self.blank_before = blank
        self.words = words
        self.chain = chain
        self.upper = _mostly_upper(text)
        self.width = max(map(len, self.lines), default=0)
        self.number = [_is_number(x) for x in self.lines]
        self.broken = [i + 1 < len(self.lines) and x[-1] in BREAKS and BROKEN_END.search(x) is not None for i, x in enumerate(self.lines)]
        self.features = [self._features(i) for i in range(len(self.lines))]
        head = chain.head
        self.odds = [sum([head[k] for k in f]) for f in self.features]
        self.labels = self._decode()

    def _neighbour(self, i: int, step: int) -> str | None:
        j = i + step
        while 0 <= j < len(self.lines) and self.number[j]:
            j += step
        return self.lines[j] if 0 <= j < len(self.lines) else None

    def _features(self, i: int) -> list[int]:
        """The features of a line that hold, as places in ``FEATURES``."""
        line = self.lines[i]
        out = ["any"]
        if self.broken[i]:
            out.append("hyphen")
        if self.number[i]:
            out.append("number")
        elif len(line) > 90 or sum(map(str.isalpha, line)) < 4:
            out.append("untitled")
        else:
            beside = _beside(line)
            before, after = self._neighbour(i, -1), self._neighbour(i, 1)
            if beside:
                out.append("beside")
            if self.blank_before[i] or (i + 1 < len(self.lines) and self.blank_before[i + 1]):
                out.append("blank")
            flows = before is not None and not before.rstrip(CLOSERS).endswith(ENDS)
            goes_on = after is not None and (after[0].islower() or after[0].isdigit() or "぀" <= after[0] <= "鿿" or after[0] in "([\"'«“„" or self.upper)
            starts = line[0].isupper() or "぀" <= line[0] <= "鿿" or line[0].isdigit()
            if flows and goes_on:
                out.append("flow")
                if starts:
                    out.append("capital")
            if after is not None:
                first = after.split(" ", 1)[0]
                if len(line) + 1 + len(first if len(first) < 30 else first[:1]) <= self.width - 1 and not self.broken[i]:
                    out.append("wrap")
            if before is None or after is None:
                out.append("edge")
            if line[0].islower() and not beside:
                out.append("lower")
            if line.isupper() and not self.upper and sum(map(str.isalpha, line)) >= 6:
                out.append("upper")
            last = line.rsplit(" ", 1)[-1]
            if " " in line and last[:1].isupper() and not line.isupper():
                out.append("name")
            if line[-1] in STOPS:
                out.append("stop")
            if INSIDE.search(line):
                out.append("inside")
            if COMMA.search(line):
                out.append("comma")
            if len(line) < 0.7 * self.width:
                out.append("short")
            elif len(line) >= 0.9 * self.width:
                out.append("long")
            if len(line) >= 0.97 * self.width and len(self.lines) > 2:
                out.append("full")
        return [PLACE[name] for name in out]

    def _decode(self) -> list[int]:
        if not self.lines or max(self.odds) < DOUBT and not any(self.number):
            return [BROKEN if x else BODY for x in self.broken]
        steps = self.chain.steps
        every = [self.chain.scores(f) for f in self.features]
        best, came = every[0], []
        for scores in every[1:]:
            ways = [[v + step[label] + scores[label] for v, step in zip(best, steps, strict=True)] for label in range(4)]
            best = [max(w) for w in ways]
            came.append([w.index(v) for w, v in zip(ways, best, strict=True)])
        path = [best.index(max(best))]
        for back in reversed(came):
            path.append(back[path[-1]])
        return path[::-1]

    def result(self) -> tuple[set[str], list[tuple[str, bool]], str]:
        """(kinds sure from the layout, header lines as (title, sure), continuous text without headers and numbers)."""
        kinds: set[str] = set()
        heads: list[tuple[str, bool]] = []
        body: list[tuple[str, int]] = []
        for i, (line, label) in enumerate(zip(self.lines, self.labels, strict=True)):
            near = any(self.labels[j] in (HEAD, NUMBER) for j in (i - 1, i + 1) if 0 <= j < len(self.lines))
            if label == NUMBER:
                kinds.add("page_number")
                continue
            small = -self.chain.lower if line[0].islower() else 0.0
            if label == HEAD or self.odds[i] + small >= DOUBT - NEAR * near:
                heads.append((norm_title(line), label == HEAD))
                if label == HEAD:
                    if _beside(line):
                        kinds.add("page_number")
                    continue
            body.append((line, label))
        parts: list[str] = []
        glue = ""
        for k, (line, label) in enumerate(body):
            parts.append(glue + line)
            glue = "" if SPACELESS_END.match(line[-1]) else " "
            if label == BROKEN and k + 1 < len(body):
                end, first = BROKEN_END.search(line), FIRST_WORD.match(body[k + 1][0])
                if end and first and (first.group(1)[0].islower() or end.group(1).isupper()):
                    glue = ""
                    if not self.words.own_hyphen(end.group(1), end.group(2), first.group(1)):
                        kinds.add("hyphen")
                        parts[-1] = parts[-1][: parts[-1].rfind(end.group(2))]
                    else:
                        parts[-1] = parts[-1].rstrip()
        return kinds, heads, "".join(parts)


def examine(text: str, words: Words, chain: Chain = DEFAULT, whole: bool = True) -> tuple[set[str], list[tuple[str, bool]], str]:
    """(kinds of noise, header lines in doubt or sure, repaired text) of one text; with ``whole`` false the text isn't to be used,
    and the class of its content is asked only where kinds or header lines can depend on it."""
    kinds: set[str] = set()
    heads: list[tuple[str, bool]] = []
    if text.isspace():
        return kinds, heads, text
    if not whole and "\n" in text and " " in text and not HAN_CHAR.search(text):
        lines = Lines(text, words, chain)
        found = lines.result()
        # else the lines have the same words joined as apart, and nothing else to tell
        if (found[0] or found[1] or any(lines.broken)) and content_class(text) is None:
            kinds, heads, text = found
    elif "\n" in text and content_class(text) is None:
        kinds, heads, text = Lines(text, words, chain).result()
    elif " " not in text and is_unreadable(text):
        return kinds, heads, text
    text, odd = words.fix_han(text)
    if not text.isascii():
        # letters that only look different are no misread ones
        text = _form(text)
    fixed, misread = words.fix_words(text)
    misread = misread or odd
    if misread:
        kinds.add("ocr_char")
    return kinds, heads, fixed


COUNTS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("mid", T.StringType()), T.StructField("n", T.LongType())])
HAN_AROUND = re.compile(f"(?=(.)([{HAN}])(.))", re.S)


def corpus_counts(texts: DataFrame, chain: Chain | None = None) -> DataFrame:
    """kind, key, mid, n over all texts: words (w), Han characters by their neighbours (h) and alone (c), and with ``chain``
    the broken words that are asked about (y); counted by batch first."""

    def make():
        asking = Asking({}, {})

        def work(values: list) -> Iterator[tuple]:
            pieces: Counter = Counter()
            words: Counter = Counter()
            around: Counter = Counter()
            for text in values:
                if not text:
                    continue
                plain = text
                if "\n" in text and BREAK.search(text):
                    plain = ACROSS.sub(" ", text)
                    if chain is not None and content_class(text) is None:
                        Lines(text, asking, chain).result()
                pieces.update(pieces_of(plain))
                if not text.isascii() and HAN_CHAR.search(text):
                    around.update(HAN_AROUND.findall("^" + plain.replace("\n", "") + "^"))
            for kind, key in asking.asked:
                yield kind, key, None, 1
            asking.asked = set()
            for piece, n in pieces.items():
                for w in (piece,) if piece.isascii() and piece.isalnum() else WORD.findall(piece):
                    words[w] += n
            out: Counter = Counter()
            for w, n in words.items():
                for part in {w, *re.split(r"[-'’‐‑]", w)} if not w.isalnum() else (w,):
                    if part:
                        low = part if not part.isupper() or len(part) == 1 else part.lower()
                        out[low[0].lower() + low[1:]] += n
            for w, n in out.items():
                yield "w", w, None, n
            chars: Counter = Counter()
            sides: Counter = Counter()
            for (a, ch, b), n in around.items():
                yield "h", a + b, ch, n
                sides["h", a + "\0", ch] += n
                sides["h", "\0" + b, ch] += n
                chars[ch] += n
            for (kind, key, ch), n in sides.items():
                yield kind, key, ch, n
            for ch, n in chars.items():
                yield "c", ch, None, n

        return work

    return map_rows(texts.select("text"), make, COUNTS).groupBy("kind", "key", "mid").agg(F.sum("n").alias("n"))


FACT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("answer", T.StringType())])
FACTS = T.ArrayType(FACT)
ASKED = T.StructType(FACT.fields[:2])
ASKED_BY = T.StructType([T.StructField("rec_id", T.LongType()), T.StructField("field", T.StringType()), *ASKED.fields])
TARGET = T.StructType([T.StructField("alike", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
USED = T.StructType([T.StructField("key", T.StringType()), T.StructField("use", T.StringType()), T.StructField("role", T.StringType())])
RATED = T.StructType([T.StructField("form", T.StringType()), T.StructField("own", T.LongType()), T.StructField("alike", T.StringType())])


def _asked(texts: DataFrame, shared: dict[tuple[str, str], str], chars: dict[str, int], chain: Chain) -> DataFrame:
    """rec_id, field, kind, key of what each text asks for; broken words are joined as the facts have it."""
    spread = texts.sparkSession.sparkContext.broadcast((shared, chars))

    def make():
        asking = Asking(*spread.value)

        def work(ids: list, fields: list, values: list, facts: list) -> Iterator[tuple]:
            for i, field, text, own in zip(ids, fields, values, facts, strict=True):
                if text:
                    asking.facts = _with_own(spread.value[0], own)
                    examine(text, asking, chain)
                    yield from ((i, field, *x) for x in asking.asked)
                    asking.asked = set()

        return work

    return map_rows(texts.select("rec_id", "field", "text", "facts"), make, ASKED_BY).distinct()


def _with_own(shared: dict[tuple[str, str], str], own: list[dict] | None) -> dict[tuple[str, str], str]:
    return {**shared, **{(f["kind"], f["key"]): f["answer"] for f in own}} if own else shared


def _uses(asked: DataFrame, words: DataFrame, uses) -> DataFrame:
    """key and a column for each role of ``uses(key)`` -> (role, word): the counts of the words a key is judged by."""

    def make():
        def work(keys: list) -> Iterator[tuple]:
            for key in keys:
                for role, word in uses(key):
                    yield key, word, role

        return work

    used = map_rows(asked.select("key"), make, USED)
    return used.join(words.select(F.col("key").alias("use"), "n"), "use", "left")


def hyphen_facts(asked: DataFrame, words: DataFrame) -> DataFrame:
    """kind, key, answer of the broken words whose hyphen is their own."""

    def uses(key: str) -> list[tuple[str, str]]:
        a, _, b = key.split("\t")
        return [("joined", a + b), ("apart", f"{a}-{b}"), ("a", a), ("b", b)]

    def n(role: str):
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(role)

    rated = _uses(asked, words, uses).groupBy("key").agg(*map(n, ("joined", "apart", "a", "b")))
    seen = (F.col("joined") > 0) | (F.col("apart") > 0)
    own = F.when(seen, F.col("apart") > F.col("joined")).otherwise(~F.col("key").contains("\tsoft\t") & (F.col("a") >= LEAST) & (F.col("b") >= LEAST))
    return rated.filter(own).select(F.lit("y").alias("kind"), "key", F.lit("own").alias("answer"))


def word_facts(words: DataFrame, joined: DataFrame) -> DataFrame:
    """kind, key, answer of the misread forms: all words, and the ``joined`` broken ones (key), meet the frequent words by
    what words taken for each other share."""
    top = words.agg(F.max("n")).first()[0] or 0
    new = joined.select("key").distinct().join(words, "key", "left_anti").select("key", F.lit(0).cast("bigint").alias("n"))
    known = words.unionByName(new).withColumn("low", F.lower("key"))
    small = known.filter("low <> key").join(words.select(F.col("key").alias("low"), F.col("n").alias("m")), "low", "left")
    own = known.filter("low = key").select("key", F.col("n").alias("own")).unionByName(small.select("key", F.greatest("n", F.coalesce("m", F.lit(0))).alias("own")))
    rare = own.filter(F.col("own") * RATIO <= top)

    def make_asked():
        def work(keys: list, owns: list) -> Iterator[tuple]:
            for form, n in zip(keys, owns, strict=True):
                if _can_be_misread(form):
                    for alike in _alike_keys(form):
                        yield form, n, alike

        return work

    def make_targets():
        def work(keys: list, ns: list) -> Iterator[tuple]:
            for word, n in zip(keys, ns, strict=True):
                for alike in _alike_keys(word):
                    yield alike, word, n

        return work

    def make_judged():
        def work(forms: list, found: list, ns: list) -> Iterator[tuple]:
            for form, word, n in zip(forms, found, ns, strict=True):
                if _misreadings(form, word) <= min(3, max(1, len(word) // 3)):
                    yield form, word, n

        return work

    targets = map_rows(words.filter(F.col("n") >= LEAST).select("key", "n"), make_targets, TARGET)
    asking = map_rows(rare, make_asked, RATED)
    long = (F.length("form") > 3) | F.col("form").rlike("[0-9]")
    least = F.greatest(F.lit(1), F.col("own")) * F.when(long, RATIO).otherwise(RATIO_SHORT)
    met = asking.join(targets, "alike").filter((F.col("n") >= least) & (F.col("word") != F.col("form"))).select("form", "word", "n")
    judged = map_rows(met, make_judged, T.StructType([FACT.fields[1], *TARGET.fields[1:]]))
    best = judged.groupBy("key").agg(F.max(F.struct("n", "word"))["word"].alias("answer"))
    return best.select(F.lit("t").alias("kind"), "key", "answer")


def han_facts(around: DataFrame, alone: DataFrame, chars: dict[str, int]) -> DataFrame:
    """kind, key, answer of the misread Han characters, keys being the character between its neighbours.

    ``around`` has all characters by their neighbours, ``alone`` their own counts.
    """
    most = max(chars.values(), default=0)
    rare = alone.filter(F.col("n") * RATIO * 2 < most).select(F.col("key").alias("mid"))
    asked = around.filter(~F.col("key").contains("\0")).join(rare, "mid", "left_semi").select(F.concat(F.substring("key", 1, 1), "mid", F.substring("key", 2, 1)).alias("key"))
    tops = around.groupBy("key").agg(F.max(F.struct("n", "mid")).alias("t")).filter(F.col("t.n") >= LEAST).select("key", F.col("t.n").alias("n"), F.col("t.mid").alias("mid"))
    uses = F.expr("array(struct(0 AS pos, concat(substring(key, 1, 1), substring(key, 3, 1)) AS use), struct(1 AS pos, concat(substring(key, 1, 1), char(0)) AS use), struct(2 AS pos, concat(char(0), substring(key, 3, 1)) AS use))")
    used = asked.select("key", F.explode(uses).alias("u")).select("key", "u.pos", F.col("u.use").alias("use"))
    met = used.join(tops.withColumnRenamed("key", "use"), "use").groupBy("key").agg(F.collect_list(F.struct("pos", "use", "n", "mid")).alias("met"))  # at most three

    def make():
        def work(keys: list, found: list) -> Iterator[tuple]:
            for key, met in zip(keys, found, strict=True):
                words = Words({}, {m["use"]: (m["mid"], m["n"]) for m in met}, {})
                words.chars = chars
                if mid := words.mid(*key):
                    yield "m", key, mid

        return work

    return map_rows(met, make, FACT)


def _given(texts: DataFrame, shared: dict[tuple[str, str], str], chars: dict[str, int], facts: DataFrame, chain: Chain, max_facts: int) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """(texts, shared facts) with ``facts``: shared by all workers if they are few, else joined to the texts that ask for them."""
    if facts.limit(max_facts + 1).count() <= max_facts:
        return texts, {**shared, **{(r["kind"], r["key"]): r["answer"] for r in facts.toLocalIterator()}}
    asked = _asked(texts, shared, chars, chain)
    own = asked.join(facts, ["kind", "key"]).groupBy("rec_id", "field").agg(F.collect_list(F.struct("kind", "key", "answer")).alias("new"))
    own = own.select(F.col("rec_id").alias("of"), F.col("field").alias("of_field"), "new")
    met = texts.join(own, F.col("rec_id").eqNullSafe(F.col("of")) & F.col("field").eqNullSafe(F.col("of_field")), "left")
    none = F.lit(None).cast(FACTS)
    return met.withColumn("facts", F.when(F.col("new").isNull(), F.col("facts")).otherwise(F.concat(F.coalesce("facts", F.array().cast(FACTS)), F.coalesce("new", none)))).drop("of", "of_field", "new"), shared


def judged(texts: DataFrame, chain: Chain = DEFAULT, max_facts: int = MAX_FACTS) -> tuple[DataFrame, Judged]:
    """(texts with their own facts, judge with the shared ones): what every word and Han character of ``texts`` stands for.

    Each is judged by the counts of all words and contexts, which it meets in equi-joins; only Han characters alone, at most
    as many as there are, are collected. Texts are read once, to be counted and, where they have broken words, to be laid out.
    """
    texts = texts.select("rec_id", "field", "paper_key", "text").withColumn("facts", F.lit(None).cast(FACTS))
    counts = checkpoint(corpus_counts(texts, chain))
    words = counts.filter("kind = 'w'").select("key", "n")
    alone = counts.filter("kind = 'c'").select("key", "n")
    chars = {r["key"]: r["n"] for r in alone.toLocalIterator()}
    shared: dict[tuple[str, str], str] = {}
    broken = counts.filter("kind = 'y'").select("kind", "key")
    texts, shared = _given(texts, shared, chars, checkpoint(hyphen_facts(broken, words)), chain, max_facts)
    joined = broken.select(F.regexp_replace("key", "\t(?:soft)?\t", "").alias("key"))
    found = word_facts(words, joined).unionByName(han_facts(counts.filter("kind = 'h'"), alone, chars))
    texts, shared = _given(texts, shared, chars, checkpoint(found), chain, max_facts)
    return texts, Judged(shared, chars)


LABELLED = T.StructType([T.StructField("rec_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("paper_key", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("title", T.StringType())])


def known_titles(titles: DataFrame) -> DataFrame:
    """paper_key, t: the papers' running titles without numbers and case."""
    bare = F.lower(F.regexp_replace(F.regexp_replace("title", r"^[^\p{L}]+|[^\p{L}]+$", ""), r"\s+", " "))
    return titles.select("paper_key", bare.alias("t")).filter("length(t) >= 8").distinct()


def fitted(texts: DataFrame, titles: DataFrame) -> Chain:
    """The line model of a corpus, fitted on at most ``SAMPLE`` texts of papers with known running titles.

    A line is a header if it begins one of the paper's titles, a page number or broken if it is built so, else body. The
    sample is taken by a hash of the keys; without such texts the prior holds.
    """
    known = known_titles(titles)
    lines = texts.filter(F.col("text").contains("\n") & (F.length("text") <= SAMPLE_CHARS) & F.col("rec_id").isNotNull())
    # the least text by hash of each bucket: one pass, and at most so many rows leave a partition
    bucket, order = F.pmod(F.xxhash64("rec_id", "field", F.lit("bucket")), F.lit(2 * SAMPLE)), F.xxhash64("rec_id", "field")
    least = F.min_by(F.struct("rec_id", "field", "paper_key", "text"), F.struct(order, "rec_id", "field"))
    picked = [r["r"] for r in lines.groupBy(bucket.alias("b")).agg(least.alias("r")).select("r").collect()]
    papers = texts.sparkSession.createDataFrame([(p,) for p in {r["paper_key"] for r in picked if r["paper_key"] is not None}], "paper_key string")
    with_titles = {r["paper_key"] for r in papers.join(known, "paper_key", "left_semi").collect()}
    sample = sorted((r for r in picked if r["paper_key"] in with_titles), key=lambda r: (r["rec_id"], r["field"]))[:: max(1, len(picked) // SAMPLE)][:SAMPLE]
    laid = {(r["rec_id"], r["field"], r["paper_key"]): Lines(r["text"], Judged({}, {}), DEFAULT) for r in sample if content_class(r["text"]) is None}
    rows = [(*key, i, norm_title(x)) for key, one in laid.items() for i, x in enumerate(one.lines)]
    asked = texts.sparkSession.createDataFrame([r for r in rows if len(r[-1]) >= 8], LABELLED)
    heads = asked.join(known, "paper_key").filter("startswith(t, title)").select("rec_id", "field", "paper_key", "line").distinct()
    found = {tuple(r) for r in heads.collect()}
    fit = []
    for key, one in laid.items():
        labels = [NUMBER if one.number[i] else HEAD if (*key[:2], key[2], i) in found else BROKEN if one.broken[i] else BODY for i in range(len(one.lines))]
        fit.append((one.features, labels))
    return Chain.fit(fit)


NOISE = T.StructType([T.StructField("rec_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("paper_key", T.StringType()), T.StructField("noise_kind", T.StringType()), T.StructField("title", T.StringType()), T.StructField("sure", T.BooleanType())])
REPAIRED = T.StructType([T.StructField("rec_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("text", T.StringType())])


def _run(texts: DataFrame, titles: DataFrame | None, words: Words | None, schema: T.StructType, rows, whole: bool = True) -> DataFrame:
    chain = DEFAULT if titles is None else fitted(texts, titles)
    if words is None:
        texts, judge = judged(texts, chain)
        given = (Judged, judge.facts, judge.chars)
    else:
        texts = texts.withColumn("facts", F.lit(None).cast(FACTS))
        given = (Words, words.counts, words.contexts, words.chars)
    spread = texts.sparkSession.sparkContext.broadcast(given)
    of_run = uuid4().hex

    def make():
        kind, *values = spread.value
        judge = once(("scans", of_run), lambda: kind(*values))

        def work(ids: list, fields: list, papers: list, values: list, facts: list) -> Iterator[tuple]:
            for i, field, paper, text, own in zip(ids, fields, papers, values, facts, strict=True):
                if text and i is not None:
                    if own or kind is Judged:
                        judge.facts = _with_own(spread.value[1], own)
                    yield from rows(i, field, paper, *examine(text, judge, chain, whole))

        return work

    return map_rows(texts.select("rec_id", "field", "paper_key", "text", "facts"), make, schema)


def page_noise(texts: DataFrame, titles: DataFrame, words: Words | None = None) -> DataFrame:
    """Distinct rec_id, field, noise_kind of the noise in ``texts`` (rec_id, field, paper_key, text).

    ``titles`` (paper_key, title) are the papers' running titles as found elsewhere. Defined results: null ids, null and
    blank texts have no noise; lists, tables and junk have no headers; repeated rows count once; a null paper has no
    known titles; extra columns are ignored; empty tables give no rows.
    """

    def rows(i, field, paper, kinds, heads, fixed):
        for kind in kinds:
            yield i, field, paper, kind, None, True
        for title, sure in heads:
            yield i, field, paper, "running_head", title, sure

    found = checkpoint(_run(texts, titles, words, NOISE, rows, whole=False))
    sure = found.filter("sure").select("rec_id", "field", "noise_kind")
    doubt = found.filter("NOT sure AND length(title) >= 4").select("rec_id", "field", "paper_key", "title", "noise_kind")
    prefixes = known_titles(titles).select("paper_key", F.explode(F.expr("transform(sequence(4, length(t)), n -> substring(t, 1, n))")).alias("title")).distinct()
    settled = doubt.join(prefixes, ["paper_key", "title"], "left_semi")
    often = doubt.filter("length(title) >= 8").groupBy("paper_key", "title").agg(F.count_distinct("rec_id").alias("k")).filter("k > 1")
    again = doubt.join(often, ["paper_key", "title"], "left_semi")
    return sure.unionByName(settled.select(*sure.columns)).unionByName(again.select(*sure.columns)).distinct()


def repaired(texts: DataFrame, words: Words | None = None, titles: DataFrame | None = None) -> DataFrame:
    """rec_id, field, text: every text in continuous form; null texts and ids are left out, blank ones stay as they are.

    ``titles`` (paper_key, title): running titles on which the line model is fitted.
    """
    return _run(texts, titles, words, REPAIRED, lambda i, field, paper, kinds, heads, fixed: [(i, field, fixed)])


def scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, field, paper_key, text of prose blocks' texts and of all captions."""
    blocks = table(spark, sf_dir, "blocks").select("block_id", "paper_key", "kind", "text_level", "text_plain", "caption")
    prose = F.when((F.col("kind") == "prose") & F.col("text_level").isNull(), F.col("text_plain"))
    fields = F.array(F.struct(F.lit("text_plain").alias("field"), prose.alias("text")), F.struct(F.lit("caption").alias("field"), F.col("caption").alias("text")))
    return blocks.select(F.col("block_id").cast("bigint").alias("rec_id"), "paper_key", F.explode(fields).alias("f")).select("rec_id", "f.field", "paper_key", "f.text").filter("text IS NOT NULL")


def running_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_key, title of the running heads that the extractor knew as such."""
    return table(spark, sf_dir, "blocks").filter("kind = 'running_heads'").select("paper_key", F.col("text_plain").alias("title"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise(scanned_texts(spark, sf_dir), running_titles(spark, sf_dir)).withColumnRenamed("rec_id", "block_id")


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(scanned_texts(spark, sf_dir), titles=running_titles(spark, sf_dir)).withColumnRenamed("rec_id", "block_id")


QUERIES = {"p4_found": p4_found, "p4_text": p4_text}
