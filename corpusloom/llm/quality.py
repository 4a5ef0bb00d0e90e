"""Statistics of a text's quality, and the texts that are lists, tables or junk instead of running prose.

One pass over a text gives word, line, paragraph and repetition statistics (``Measured``); combined rules on them name the
class. The rules look at how the text is built (rows of cells, short items, repeated or unreadable signs), never at its
topic, so readable but unusual prose (capitals throughout, figures in brackets, hard line breaks) stays prose.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._arrow import map_rows
from corpusloom.session import texts as table

#: Frequent function words of the languages with spaces.
COMMON = frozenset(
    """the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were their been has would
    der die das und ist nicht ein eine den dem des im mit von zu auf für als auch sich bei aus wird sind wenn dass nach vor aber nur
    le la les un une et est que des du dans pour sur par avec qui au aux pas sont dès mais ce cette se plus seulement malgré
    el los las una y es en del por con para se que al lo como más pero solo cuando sin su
    o os as um uma e do da dos das em no na por com para que se ao mais mas quando sem antes depois
    il lo gli i di che è per con della nel alla dei non si una del prima dopo senza
    de het een en van dat niet op te voor met zijn door bij uit naar om maar ook
    и в не на что с по как это из для при но после без""".split()
)
CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
SPACELESS = re.compile("[぀-ヿ㐀-鿿豈-﫿฀-๿]")
#: Characters of a script without spaces that stand for four words.
PHRASE = 8
#: The units of a lower-case text: characters of scripts without spaces, and words between them.
UNIT = re.compile("[぀-ヿ㐀-鿿豈-﫿฀-๿]|[^\\s぀-ヿ㐀-鿿豈-﫿฀-๿]+")
MARKS = ".,;:!?()\"'«»“”„。，、；：！？（）《》「」『』"
END = re.compile(r"[.!?…。！？；．۔؟।]['\"”’»」』）)\]]*$")
INNER_STOP = re.compile(r"[。！？].|[a-zа-я]{2}[.!?] +[A-ZÀ-ÞА-Я]")
STOP = re.compile(r"[.!?…。！？।؟]")
MARKER = re.compile(r"(?:[-*•·◦▪‣+–—]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,5})[.)]|\[[ xX✓]?\]|[①-⑳]|（?[一二三四五六七八九十]{1,3}[）、.])\s*(?=\S)")
LEADER = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$|…{2,}\s*\d+\s*$|·{4,}\s*\d+$")
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
CELL_SEP = (("|", re.compile(r"\s*\|\s*")), ("\t", re.compile(r"\t")), ("&", re.compile(r"\s*&\s*")), (";", re.compile(r";\s*")), (",", re.compile(r",\s+|,(?=\S)")), ("  ", re.compile(r" {2,}")))
CELL_NUMBER = re.compile(r"[<>≈~]?[-+−]?[\d.,]+\s?%?|n/a|[—–-]+|", re.I)
WORD = re.compile(r"[^\W\d_]+")
#: Signs that are no part of running text; those that also divide cells are counted apart.
ODD = re.compile(r"[^\w\s.,;:!?'\"()\-–—“”‘’«»„‚%/…。，、；：！？（）《》“”「」『』·　]")
DIVIDERS = "|&\\"
C1 = re.compile("[\x80-\x9f]")
BROKEN = re.compile(r"\\x[0-9a-f]{2}|�|□|¿½|ï¿½")
LONG = re.compile(r"[A-Za-z0-9+/=_-]{60,}")
CAPS = re.compile(r"(?<=[^\W\d_])[A-Z](?=[a-z]|\d)|\d[A-Za-z]|[A-Za-z]\d")
SPLIT_LINES = re.compile(r"\r\n|\r|\n")
ROW_BREAK = re.compile(r"\s*\\\\\s*|\|\s{2,}\|")

#: Greater shares of common words are running text; below the least one no words are made.
MOST_COMMON, NO_WORDS = 0.6, 0.1
#: Mean words of a line in an enumeration, at most.
LONG_ITEM = 12
#: So few different words in so many are no text.
FEW, FEW_OF = 6, 24

STATS = ("n_chars", "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "n_lines", "end_punct_share", "common_share", "stops_per_word", "dup_line_share", "dup_para_share", "top_ngram_coverage", "distinct_word_share", "mean_line_words")


def _dup_share(parts: list[str]) -> float:
    """Share of the parts that repeat an earlier one."""
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def _occurrences(words: list[str], gram: tuple[str, ...]) -> int:
    """How often an n-gram stands in the words without overlapping itself."""
    n, at, count = len(gram), 0, 0
    while at <= len(words) - n:
        if words[at] == gram[0] and tuple(words[at : at + n]) == gram:
            count, at = count + 1, at + n
        else:
            at += 1
    return count


def _repeat_units(text: str) -> tuple[list[str], int]:
    """(units of repetition without marks around them, characters of scripts without spaces among them)."""
    low = text.lower()
    if low.isascii() or not (spaceless := len(SPACELESS.findall(low))):
        return [w.strip(MARKS) for w in low.split()], 0
    return [u for w in UNIT.findall(low) if (u := w.strip(MARKS))], spaceless


def _ngram_coverage(words: list[str], longest: int = 4) -> float:
    """Largest share of the words' characters that one n-gram covers (n of 1 to 4, or as ``longest`` says); it must occur
    three times, overlaps apart."""
    total = sum(map(len, words))
    best = 0
    for n in range(1, longest + 1):
        if len(words) < 3 * n:
            break
        grams = Counter(zip(*(words[i:] for i in range(n)), strict=False))
        often = sorted(((count * sum(map(len, gram)), gram, count) for gram, count in grams.items() if count >= 3), reverse=True)
        if not often:
            break
        for covered, gram, count in often:
            if covered <= best:
                break
            if any(gram[k:] == gram[:-k] for k in range(1, n)):
                count = _occurrences(words, gram)
            if count >= 3:
                best = max(best, count * sum(map(len, gram)))
    return best / total if total else 0.0


def _phrase_coverage(chars: list[str]) -> float:
    """Share of the characters that the phrase around the most frequent run of ``PHRASE`` characters covers, however long."""
    runs = Counter(zip(*(chars[i:] for i in range(PHRASE)), strict=False))
    if not runs:
        return 0.0
    gram, count = max(runs.items(), key=lambda kv: (kv[1], kv[0]))
    if count < 3:
        return 0.0
    at: list[int] = []
    for i in range(len(chars) - PHRASE + 1):
        if chars[i] == gram[0] and (not at or i >= at[-1] + PHRASE) and tuple(chars[i : i + PHRASE]) == gram:
            at.append(i)
    if len(at) < 3:
        return 0.0
    room = min(b - a for a, b in zip(at, at[1:], strict=False))
    size, left = PHRASE, 0
    while size < room and at[-1] + size < len(chars) and len({chars[i + size] for i in at}) == 1:
        size += 1
    while size + left < room and at[0] > left and len({chars[i - left - 1] for i in at}) == 1:
        left += 1
    return len(at) * sum(map(len, chars[at[0] - left : at[0] + size])) / sum(map(len, chars))


def _may_dominate(words: list[str], longest: int | None = 4) -> bool:
    """Whether an n-gram of up to ``longest`` words (None: of any length) can cover over half of the characters: its words
    can't have more than as many words with the most characters that occur three times."""
    sizes = [count * len(word) for word, count in Counter(words).items() if count >= 3]
    return 2 * sum(sizes if longest is None else nlargest(longest, sizes)) > sum(map(len, words))


def _coverage(units: list[str], spaceless: int) -> float:
    """Coverage of the dominant n-gram; where most units are characters, of up to ``PHRASE`` ones or of a longer phrase."""
    return _ngram_coverage(units) if 2 * spaceless <= len(units) else max(_ngram_coverage(units, PHRASE), _phrase_coverage(units))


class Measured:
    """A text with its statistics, each computed when it is asked for first; rules and tables of statistics share them."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [x for x in map(str.strip, SPLIT_LINES.split(text)) if x]
        self._known: dict[str, object] = {}

    def __getattr__(self, name: str):
        known = self.__dict__["_known"]
        if name not in known:
            known[name] = getattr(Measured, f"_{name}")(self)
        return known[name]

    def _words(self) -> list[str]:
        return self.text.split()

    def _spaceless(self) -> int:
        return 0 if self.text.isascii() else len(SPACELESS.findall(self.text))

    def _units(self) -> tuple[list[str], int]:
        return _repeat_units(self.text)

    def _paragraphs(self) -> list[str]:
        return [p.strip() for p in self.text.split("\n\n") if p.strip()] if "\n\n" in self.text else [self.text]

    def _letters(self) -> int:
        return sum(map(len, WORD.findall(self.text)))

    def _n_chars(self) -> int:
        return len(self.text)

    def _n_words(self) -> int:
        return len(self.words) + self.spaceless // 2

    def _mean_word_len(self) -> float:
        return sum(map(len, self.words)) / len(self.words) if self.words else 0.0

    def _symbol_ratio(self) -> float:
        return len(ODD.findall(self.text)) / len(self.text) if self.text else 0.0

    def _digit_ratio(self) -> float:
        return sum(map(self.text.count, "0123456789")) / len(self.text) if self.text else 0.0

    def _n_lines(self) -> int:
        return len(self.lines)

    def _end_punct_share(self) -> float:
        return sum(END.search(x) is not None for x in self.lines) / len(self.lines) if self.lines else 0.0

    def _common_share(self) -> float:
        return sum(w.strip(".,;:!?()\"'«»“”„").lower() in COMMON for w in self.words) / len(self.words) if self.words else 0.0

    def _stops_per_word(self) -> float:
        return len(STOP.findall(self.text)) / max(1, self.n_words)

    def _dup_line_share(self) -> float:
        return _dup_share(self.lines)

    def _dup_para_share(self) -> float:
        return _dup_share(self.paragraphs)

    def _top_ngram_coverage(self) -> float:
        return _coverage(*self.units)

    def _distinct_word_share(self) -> float:
        units = self.units[0]
        return len(set(units)) / len(units) if units else 0.0

    def _mean_line_words(self) -> float:
        return max(1, self.n_words) / len(self.lines) if self.lines else 0.0


def stats(text: str) -> dict[str, float]:
    """All statistics of a text; an empty text has zeros."""
    m = Measured(text)
    return {name: getattr(m, name) for name in STATS}


def _units(text: str) -> int:
    """Words, counting two characters of a script without spaces as one."""
    return len(text.split()) + len(SPACELESS.findall(text)) // 2


def _rows(text: str, lines: list[str]) -> list[str]:
    """The rows a table would have: its lines, or what stands between row breaks where lines were run together."""
    if len(lines) > 1:
        return lines
    for cut in (re.compile(r"\\\\\s*"), re.compile(r"(?<=\|)\s+(?=\|)"), re.compile(r"(?<! ) {2}(?! )")):
        parts = [p for p in cut.split(text) if p.strip()]
        if len(parts) > 1:
            return parts
    return lines


def is_table(m: Measured) -> bool:
    """Rows of cells: two rows or more whose number of cells agrees and whose cells are short or figures."""
    rows = _rows(m.text, m.lines)
    if len(rows) < 2:
        return False
    for mark, cut in CELL_SEP:
        if sum(mark in r for r in rows) < 0.7 * len(rows):
            continue
        split = [[c.strip() for c in cut.split(r.strip().strip("|").rstrip(mark.strip() or None).removesuffix("\\\\").strip())] for r in rows if mark in r]
        split = [r for r in split if not all(set(c) <= set("-=:+ ") for c in r)] or split
        widths = Counter(map(len, split))
        width, count = widths.most_common(1)[0]
        if width < 2 or count < 0.6 * len(split) or len(split) < 2:
            continue
        cells = [c for r in split if len(r) == width for c in r]
        figures = sum(CELL_NUMBER.fullmatch(c) is not None for c in cells)
        short = sum(_units(c) <= 4 for c in cells)
        stops = sum(c.endswith((".", "。")) and _units(c) > 3 for c in cells)
        if short < 0.8 * len(cells) or stops > 0.1 * len(cells):
            continue
        if (mark in "|\t&" or figures >= 0.3 * len(cells) or mark == "  " and width >= 3) and m.common_share <= MOST_COMMON:
            return True
    return False


def is_list(m: Measured) -> bool:
    """An enumeration: three short items or more, marked or on lines of their own, that aren't sentences."""
    lines = m.lines
    if m.n_lines < 3:
        return False
    led = sum(LEADER.search(x) is not None for x in lines)
    if led >= 0.6 * len(lines):
        return True
    if m.mean_line_words > LONG_ITEM or m.common_share > MOST_COMMON:
        return False
    marked = sum(MARKER.match(x) is not None for x in lines)
    bare = [MARKER.sub("", x, count=1) for x in lines]
    sizes = [_units(x) for x in bare]
    short = sum(n <= 9 for n in sizes)
    if marked >= 0.6 * len(lines):
        sentences = sum(n > 5 and END.search(x) is not None and not x.endswith(("；", ";")) for n, x in zip(sizes, bare, strict=True))
        return short >= 0.7 * len(lines) and sentences <= 0.2 * len(lines)
    if any(INNER_STOP.search(x) for x in bare):
        return False
    # a semicolon closes an item as well as a stop does a sentence
    ended = m.end_punct_share * len(lines) - sum(x.endswith(("；", ";")) and END.search(x) is not None for x in lines)
    begins = sum(x[:1].isupper() or x[:1].isdigit() or CJK.match(x) is not None for x in bare)
    return short >= 0.9 * len(lines) and round(ended) <= 0.1 * len(lines) and begins >= 0.8 * len(lines)


def is_unreadable(text: str | Measured) -> bool:
    """Signs that say nothing: symbols, broken encodings, encoded bytes, empty markup, letters that make no words."""
    m = text if isinstance(text, Measured) else Measured(text)
    text, n = m.text, m.n_chars
    if n <= 20:
        return False
    if not text.isascii() and len(C1.findall(text)) > 0.03 * n:
        return True
    broken = len(BROKEN.findall(text))
    if broken >= 4 and broken * 4 > 0.3 * n:
        return True
    if "<" in text and sum(map(len, TAG.findall(text))) > 0.6 * n:
        return True
    if n - m.letters > 0.5 * n and m.symbol_ratio * n - sum(map(text.count, DIVIDERS)) > 0.2 * n:
        return True
    if (found := LONG.search(text)) and len(found.group()) > 0.7 * n and m.mean_word_len > 5 and len(CAPS.findall(text)) > n / 12:
        return True
    return text.isascii() and m.letters > 0.6 * n and m.n_words > 3 and m.common_share < NO_WORDS and m.digit_ratio < 0.2 and sum(map(text.lower().count, "aeiouy")) < 0.15 * m.letters


def is_repetitive(m: Measured) -> bool:
    """One word or phrase over and over: an n-gram over half of the characters, or hardly any different words; scripts
    without spaces by characters."""
    if m.n_words < 8:
        return False
    units, spaceless = m.units
    if 2 * spaceless > len(units):
        if not _may_dominate(units, None):
            return False
    elif not _may_dominate(units):
        return FEW_OF <= len(units) and len(units) * m.distinct_word_share <= FEW and m.stops_per_word < 0.5
    return m.top_ngram_coverage > 0.5


def is_boilerplate(m: Measured) -> bool:
    """Lines or paragraphs that mostly repeat earlier ones."""
    return m.n_lines >= 4 and (m.dup_line_share > 0.6 or len(m.paragraphs) >= 4 and m.dup_para_share > 0.6)


def classed(m: Measured) -> str | None:
    """list, table or junk by the statistics of a text; None for prose and for blank texts."""
    if not m.lines:
        return None
    if is_unreadable(m):
        return "junk"
    if is_table(m):
        return "table"
    if is_list(m):
        return "list"
    if is_repetitive(m) or is_boilerplate(m):
        return "junk"
    return None


def content_class(text: str | None) -> str | None:
    """The class of a text without the blanks around it; None for null."""
    return None if text is None else classed(Measured(text.strip()))


FOUND = T.StructType([T.StructField("src", T.StringType()), T.StructField("rec_id", T.LongType()), T.StructField("content_class", T.StringType())])
MEASURED = T.StructType([*FOUND.fields, *[T.StructField(n, T.DoubleType()) for n in STATS]])


def text_statistics(texts: DataFrame) -> DataFrame:
    """src, rec_id, content_class and all statistics of every text of ``texts`` (src, rec_id, text).

    One narrow pass. Null texts have null statistics and no class, blank ones zeros and no class; long texts are measured
    whole; repeated rows are repeated, extra columns are ignored, an empty table gives no rows.
    """
    empty = (None,) * len(STATS)

    def make():
        def work(sources: list, ids: list, values: list) -> Iterator[tuple]:
            for src, i, text in zip(sources, ids, values, strict=True):
                yield (src, i, content_class(text), *(empty if text is None else map(float, stats(text).values())))

        return work

    return map_rows(texts.select("src", "rec_id", "text"), make, MEASURED, max_rows=5_000)


def not_prose(texts: DataFrame) -> DataFrame:
    """The distinct src, rec_id, content_class of the texts that aren't running prose; null ids can't be named and are left out."""

    def make():
        def work(sources: list, ids: list, values: list) -> Iterator[tuple]:
            for src, i, text in zip(sources, ids, values, strict=True):
                if text and (kind := content_class(text)) is not None:
                    yield src, i, kind

        return work

    return map_rows(texts.filter("rec_id IS NOT NULL").select("src", "rec_id", "text"), make, FOUND).distinct()


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rec_id, text of prose blocks, draft paragraphs and documents."""
    blocks = table(spark, sf_dir, "blocks").filter("kind = 'prose' AND text_level IS NULL")
    parts = [
        (blocks, "blocks", "block_id", "text_plain"),
        (table(spark, sf_dir, "paragraphs"), "paragraphs", "para_id", "text"),
        (table(spark, sf_dir, "documents"), "documents", "doc_id", "text"),
    ]
    out = [df.select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("rec_id"), F.col(text).alias("text")) for df, src, key, text in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(all_texts(spark, sf_dir))


def p1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(all_texts(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_stats": p1_stats}
