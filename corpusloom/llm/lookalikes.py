"""One form for texts that look alike: width, composition, invisible characters, blanks, hyphens and look-alike letters.

``Canonical`` works in three steps: (1) compatibility normalisation of what only differs in width, joining or kind of
blank and hyphen, and deletion of ignorable characters; (2) canonical composition; (3) for every token that holds a
letter with look-alikes in another script, a Viterbi search over the lattice of its possible spellings, scored by
script-consistent character bigrams of the corpus and the script of the surrounding text. Visible differences (accents,
raised digits, case, digits for letters) are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._arrow import map_rows
from corpusloom.session import checkpoint
from corpusloom.session import texts as table

#: Letters of Latin, Cyrillic and Greek that have the same shape, in this order; a blank where there's none.
LOOKALIKES = [
    ("a", "а", " "), ("c", "с", " "), ("e", "е", " "), ("h", "һ", " "), ("i", "і", " "), ("j", "ј", " "), ("l", "ӏ", " "), ("o", "о", "ο"),
    ("p", "р", " "), ("s", "ѕ", " "), ("v", "ѵ", "ν"), ("x", "х", " "), ("y", "у", " "), ("d", "ԁ", " "), ("q", "ԛ", " "), ("w", "ԝ", " "),
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", " "), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", " "), ("K", "К", "Κ"),
    ("M", "М", "Μ"), ("N", " ", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", " "), ("T", "Т", "Τ"), ("X", "Х", "Χ"), ("Y", "Ү", "Υ"),
    ("Z", " ", "Ζ"), ("ï", "ї", "ϊ"), ("ë", "ё", " "), ("Ë", "Ё", " "), ("Ï", "Ї", "Ϊ"), ("ó", " ", "ό"),
]
SCRIPTS = ("latin", "cyrillic", "greek")
#: Kinds of blank that stand for a space, kinds of hyphen that stand for the ASCII one.
BLANKS = "               　\t"
HYPHENS = "‐‑﹣－⁃"
#: Decompositions whose result looks the same.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
LIGATURES = range(0xFB00, 0xFB50)
RADICALS = range(0x2E80, 0x2FE0)

SWITCH, CHANGE, OUTSIDE = 8.0, 0.5, 6.0


def _table() -> dict[int, str | None]:
    """Code point -> what stands for it; characters of the planes where such forms lie."""
    out: dict[int, str | None] = {}
    for cp in [*range(0x80, 0x3100), *range(0xA000, 0xA800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch in BLANKS:
            out[cp] = " "
        elif ch in HYPHENS:
            out[cp] = "-"
        elif kind == "Cf" or 0xFE00 <= cp < 0xFE10 or 0xE0100 <= cp < 0xE01F0 or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            out[cp] = None
        else:
            how = unicodedata.decomposition(ch).split(" ")[0]
            if how in SAME_LOOK or how == "<compat>" and (cp in LIGATURES or cp in RADICALS or cp == 0xB5 or 0x132 <= cp <= 0x133 or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3):
                out[cp] = unicodedata.normalize("NFKC", ch)
    out[ord("\t")] = " "
    return out


TABLE = _table()
SHAPES: dict[str, tuple[str, ...]] = {}
for _row in LOOKALIKES:
    for _ch in _row:
        if _ch != " ":
            SHAPES[_ch] = _row
#: Look-alike letters that aren't Latin: only tokens with one of them, or of a script other than Latin, need the lattice.
FOREIGN = "".join(ch for row in LOOKALIKES for ch in row[1:] if ch != " ")
LETTER = "A-Za-zªµºÀ-ɏͰ-Ͽἀ-῿Ѐ-ԯḀ-ỿ"
TOKEN = re.compile(f"[{LETTER}]+")
SUSPECT = re.compile(f"[{FOREIGN}]")


def _ranges(points: Iterable[int]) -> str:
    """Code points as the ranges of a character class; single ones beyond the basic plane are slow to search for."""
    out: list[list[int]] = []
    for cp in sorted(points):
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


SPECIAL = re.compile(f"[{_ranges(TABLE)}]")
CYRILLIC, GREEK = re.compile("[Ѐ-ԯ]"), re.compile("[Ͱ-Ͽἀ-῿]")
RUNS = re.compile(" {2,}")


@lru_cache(maxsize=4096)
def script_of(ch: str) -> int:
    cp = ord(ch)
    return 1 if 0x0400 <= cp < 0x0530 else 2 if 0x0370 <= cp < 0x0400 or 0x1F00 <= cp < 0x2000 else 0


class Canonical:
    """text -> its one form. ``bigrams``: (script, pair of letters) -> count over the corpus."""

    def __init__(self, bigrams: dict[tuple[int, str], int] | None = None):
        total: Counter = Counter()
        for (script, pair), n in (bigrams or {}).items():
            total[script, pair[0]] += n
        self.score = {k: log((n + 0.5) / (total[k[0], k[1][0]] + 40)) for k, n in (bigrams or {}).items()}
        self.floor = log(0.5 / 40) - 2
        self.token = lru_cache(maxsize=100_000)(self._token)

    def _token(self, token: str, around: int) -> str:
        """The best spelling of a token; ``around``: the script of the letters around it that have no look-alikes."""
        best: dict[int, tuple[float, str]] = {}
        for i, ch in enumerate(token):
            row, own = SHAPES.get(ch), script_of(ch)
            options = [(own, ch)] if row is None else [(s, row[s]) for s in range(3) if row[s] != " "]
            now: dict[int, tuple[float, str]] = {}
            for s, spelled in options:
                cost = -CHANGE * (spelled != ch) - OUTSIDE * (s != around) / len(token)
                if i == 0:
                    now[s] = (cost + self.score.get((s, "^" + spelled.lower()), self.floor), spelled)
                    continue
                now[s] = max(
                    (v + cost + (self.score.get((s, so_far[-1].lower() + spelled.lower()), self.floor) if s == before else -SWITCH), so_far + spelled)
                    for before, (v, so_far) in best.items()
                )
            best = now
        return max(best.values())[1]

    def __call__(self, text: str) -> str:
        if not text.isascii():
            if SPECIAL.search(text):
                text = text.translate(TABLE)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if SUSPECT.search(text):
                # look-alikes are left out, so that swapped letters don't move the vote
                plain = [0, 0, 0]
                for token in TOKEN.findall(text):
                    sure = [script_of(ch) for ch in token if ch not in SHAPES]
                    for s in sure:
                        plain[s] += 1
                around = plain.index(max(plain))

                def one(m: re.Match) -> str:
                    token = m.group()
                    return self.token(token, self._near(token, around))

                text = TOKEN.sub(one, text)
        elif "\t" in text:
            text = text.replace("\t", " ")
        return RUNS.sub(" ", text).strip()

    @staticmethod
    def _near(token: str, around: int) -> int:
        """The script of the token's own letters without look-alikes, else that of the text."""
        votes = [0, 0, 0]
        for ch in token:
            if ch not in SHAPES:
                votes[script_of(ch)] += 1
        return votes.index(max(votes)) if any(votes) else around


BIGRAMS = T.StructType([T.StructField("script", T.IntegerType()), T.StructField("pair", T.StringType()), T.StructField("n", T.LongType())])


def letter_bigrams(texts: DataFrame, column: str) -> DataFrame:
    """script, pair, n over the tokens of ``column`` that keep to one script; each batch is counted before the shuffle."""

    def make():
        def work(values: list) -> Iterator[tuple]:
            words: Counter = Counter()
            for text in values:
                if text:
                    words.update(TOKEN.findall(text))
            pairs: Counter = Counter()
            for word, n in words.items():
                scripts = set(map(script_of, word))
                if len(scripts) == 1:
                    s, low = scripts.pop(), word.lower()
                    pairs[s, "^" + low[0]] += n
                    for a, b in zip(low, low[1:], strict=False):
                        pairs[s, a + b] += n
            for (s, pair), n in pairs.items():
                yield s, pair, n

        return work

    return map_rows(texts.select(column), make, BIGRAMS).groupBy("script", "pair").agg(F.sum("n").alias("n"))


#: Distinct letter pairs: at most the square of the three alphabets' letters, whatever the corpus; more is an error.
MAX_PAIRS = 200_000


def corpus_canonical(texts: DataFrame, column: str) -> Canonical:
    rows = letter_bigrams(texts, column).limit(MAX_PAIRS + 1).collect()
    if len(rows) > MAX_PAIRS:
        raise ValueError("more letter pairs than the alphabets have")
    return Canonical({(r["script"], r["pair"]): r["n"] for r in rows})


def canonical_forms(texts: DataFrame, key: str, column: str, canonical: Canonical | None = None) -> DataFrame:
    """key, form: every row with its text's one form; null stays null, blank becomes empty, order and copies are kept."""
    canonical = canonical or corpus_canonical(texts, column)
    return _forms(texts, key, column, canonical, T.StringType(), lambda raw, form: (form,), ["form"])


def _forms(texts: DataFrame, key: str, column: str, canonical: Canonical, kind: T.DataType, out, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(key, T.LongType()), *[T.StructField(n, kind) for n in names]])
    pairs, floor = canonical.score, canonical.floor

    def make():
        form = Canonical()
        form.score, form.floor = pairs, floor

        def work(keys: list, values: list) -> Iterator[tuple]:
            for k, text in zip(keys, values, strict=True):
                yield (k, *(out(text, form(text)) if text is not None else [None] * len(names)))

        return work

    return map_rows(texts.select(F.col(key).cast("bigint").alias(key), column), make, schema)


def _digests(raw: str, form: str) -> tuple:
    return (xxhash.xxh3_128_digest(form.encode("utf-8", "replace")), xxhash.xxh3_128_digest(raw.encode("utf-8", "replace"))) if form else (None, None)


def lookalike_classes(texts: DataFrame, key: str, column: str, canonical: Canonical | None = None) -> DataFrame:
    """key, form, raw: the class of every row by its text's form, and the digest of its string, both of 128 bits.

    Null keys and texts, and texts without a visible character, are in no class; repeated rows count once.
    """
    canonical = canonical or corpus_canonical(texts, column)
    return _forms(texts, key, column, canonical, T.BinaryType(), _digests, ["form", "raw"]).filter(f"form IS NOT NULL AND {key} IS NOT NULL").distinct()


def lookalike_pairs(texts: DataFrame, key: str, column: str, canonical: Canonical | None = None) -> DataFrame:
    """key_a < key_b: pairs of rows that look the same while their strings differ.

    Texts meet by the 128-bit digest of their form, so a row moves as 40 bytes. First the different strings of a form are
    paired, however many rows hold them, then the rows of each string are joined to its pairs: equal rows never meet each
    other, and a string that a third of all rows hold costs a row for each pair asked for. Defined results: null keys and
    texts and texts without a visible character pair with nothing; repeated rows count once; extra columns are ignored;
    an empty table gives no rows.
    """
    rows = checkpoint(lookalike_classes(texts, key, column, canonical))
    spread = rows.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("form")
    kept = rows.join(spread, "form", "left_semi")
    strings = kept.select("form", "raw").distinct()
    pairs = strings.withColumnRenamed("raw", "raw_a").join(strings.withColumnRenamed("raw", "raw_b"), "form").filter("raw_a < raw_b")
    holders = lambda n: kept.select("form", F.col("raw").alias(f"raw_{n}"), F.col(key).alias(f"k{n}"))
    met = pairs.join(holders("a"), ["form", "raw_a"]).join(holders("b"), ["form", "raw_b"]).filter("ka <> kb")
    return met.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blocks").filter("kind = 'prose'").select("block_id", "text_plain")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "connectors").select("lexicon_id", F.posexplode(F.col("groups")["contrastive"]).alias("at", "entry"))
    return lists.select((F.col("lexicon_id") * 1000 + F.col("at")).cast("bigint").alias("key"), "entry")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose, entries = _prose(spark, sf_dir), _entries(spark, sf_dir)
    canonical = corpus_canonical(prose, "text_plain")
    blocks = lookalike_pairs(prose, "block_id", "text_plain", canonical).select(F.lit("blocks").alias("src"), "key_a", "key_b")
    lists = lookalike_pairs(entries, "key", "entry", canonical).filter("floor(key_a / 1000) = floor(key_b / 1000)")
    return blocks.unionByName(lists.select(F.lit("connectors").alias("src"), "key_a", "key_b"))


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_forms(_prose(spark, sf_dir), "block_id", "text_plain")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prose block with its class of texts that look the same and its own string, as hexadecimal digests."""
    return lookalike_classes(_prose(spark, sf_dir), "block_id", "text_plain").select("block_id", F.hex("form").alias("form"), F.hex("raw").alias("raw"))


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms, "p6_classes": p6_classes}
