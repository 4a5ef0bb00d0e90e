"""Evaluation passages inside training documents, found through template windows.

Both sides are brought to tokens (words; single characters in scripts without spaces) in one character form. A token
that is a number, a unit after a number or a name becomes a typed placeholder; the tokens it replaced are the window's
slots. The windows of ``WINDOW`` template tokens of the items form a hash table that every worker holds; the documents'
windows meet it where the texts are read, so no document is ever shuffled. Windows that meet by template are compared by
their slots: equal ones vote for the diagonal (document position minus item position) on which the item would stand,
unequal ones belong to a passage of the same manner with other names and numbers. Every diagonal with enough votes is
checked exactly: it must hold a stretch of the item of ``MIN_WORDS`` words (``MIN_CHARS`` characters in Chinese or
Japanese) in which at most one token in ten differs, and whose slots are the item's.

Votes lose no stretch: n >= 20 tokens with at most n // 10 replaced hold a run of six equal ones, and three windows where
none has a slot. Stretches of spaceless scripts need ``MIN_TOKENS`` tokens, of which at most one in ten differs, so a run
of six is among them too; there one window is enough.

Items go to the workers in blocks of ``BLOCK_CHARS`` characters, with one pass over the documents for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._arrow import map_rows, once
from corpusloom.llm.lookalikes import Canonical
from corpusloom.session import texts as table

WINDOW = 6
MIN_WORDS = 20
MIN_CHARS, MIN_TOKENS = 40, 12
ONE_IN = 10
#: A name stands in no larger share of the items.
NAME_SHARE = 0.03
#: Windows without slots that a diagonal needs if none with slots agreed: a stretch of 20 tokens with two replaced has three.
BARE_WINDOWS = 3
#: Characters of the items that go to the workers at once.
BLOCK_CHARS = 4_000_000
#: Tokens of documents that are looked up at once, and window pairs that are compared at once.
CHUNK, PAIRS = 400_000, 1_000_000

SPACELESS = "぀-ヿ㐀-䶿一-鿿豈-﫿"
TOKEN = re.compile(rf"[{SPACELESS}]|(?:(?![{SPACELESS}])[^\W_])+(?:[.,'’](?:(?![{SPACELESS}])[^\W_])+)*")
BROKEN = re.compile(r"(?<=[^\W\d_])(?:-|­)[ \t]*\n[ \t]*(?=[^\W\d_])")
#: Marks that are put into a text: tags, bracketed references, signs of emphasis.
MARKS = re.compile(r"</?[A-Za-z][^<>]{0,80}>|\[\^?\d{1,4}\]|\(\d{1,3}\)(?=\s)|\*+|_{2,}|`+|~~")
MARKED = re.compile(r"[<\[(*_`~]")
CJK = re.compile(f"[{SPACELESS}]")
#: Slot types; 0 stands for a token that stands for itself.
NUMBER, NAME, UNIT = 1, 2, 3
FIRST_ID = 4
#: Units that may follow a number.
UNITS = frozenset("percent points hours lines units pages prozent stunden seiten pour cent heures pages horas por ciento unidades unités einheiten".split())
ODD = np.uint64(0x9E3779B97F4A7C15)

_form = Canonical()


def tokens(text: str | None) -> list[str]:
    """The tokens of a text in its one character form, without marks; letter case is kept."""
    if not text:
        return []
    if not text.isascii():
        text = _form(text)
    if "\n" in text:
        text = BROKEN.sub("", text)
    if MARKED.search(text):
        text = MARKS.sub("", text)
    return TOKEN.findall(text)


def lower(token: str) -> str:
    return token.lower().replace("’", "'")


#: A word inside a sentence, or beside characters of a script without spaces.
INNER = re.compile(rf"(?:(?<=[^\W_] )|(?<=[,;:] )|(?<=[{SPACELESS}，、；。]))(?:(?![{SPACELESS}])[^\W\d_]){{3,}}")


def names_in(text: str | None) -> set[str]:
    """Tokens written as names: a capital inside a sentence, or Latin letters after a character of a spaceless script."""
    return {t.lower() for t in INNER.findall(text or "") if t[0].isupper() and not t.isupper()}


def common_names(items: DataFrame) -> frozenset[str]:
    """Capitalised words that many items share: nouns of the language or openings, no names.

    At most as many as the items have such words on average, divided by ``NAME_SHARE``.
    """

    def make():
        return lambda values: ((name,) for text in values for name in names_in(text))

    most = max(3.0, items.count() * NAME_SHARE)
    found = map_rows(items.select("text"), make, T.StructType([T.StructField("name", T.StringType())]))
    return frozenset(r["name"] for r in found.groupBy("name").count().filter(F.col("count") > most).toLocalIterator())


def windows(shape: np.ndarray, exact: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the template, hash of the slots' tokens) of every window over template ids and token ids."""
    n = max(0, len(shape) - size + 1)
    slots = np.where(shape < FIRST_ID, exact + 1, 0)
    out = []
    with np.errstate(over="ignore"):
        for codes in (shape.astype(np.uint64), slots.astype(np.uint64)):
            h = np.zeros(n, np.uint64)
            for i in range(size):
                h = (h ^ codes[i : i + n]) * ODD
                h ^= h >> np.uint64(29)
            out.append(h)
    return out[0], out[1]


def slotted(shape: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Whether each window holds a slot."""
    upto = np.concatenate([[0], np.cumsum(shape < FIRST_ID)])
    return upto[size:] > upto[:-size]


@dataclass
class Items:
    """One block of items: their tokens as ids, and their template windows sorted by hash."""

    ids: list[int]
    vocabulary: dict[str, int]
    names: frozenset[str]
    exact: list[np.ndarray]
    kinds: list[np.ndarray]
    sizes: list[np.ndarray]
    spaceless: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    slots: np.ndarray
    has_slot: np.ndarray

    @classmethod
    def build(cls, rows: Sequence[tuple[int, str | None]], common: frozenset[str] = frozenset()) -> Items:
        names = frozenset(n for _, text in rows for n in names_in(text)) - common
        ids, exact, kinds, sizes, spaceless = [], [], [], [], []
        vocabulary: dict[str, int] = {}
        found: list[tuple[np.ndarray, ...]] = []
        for i, text in rows:
            low = [lower(t) for t in tokens(text)]
            if len(low) < WINDOW:
                continue
            code = np.array([vocabulary.setdefault(t, len(vocabulary) + FIRST_ID) for t in low], np.int64)
            kind = kinds_of(np.array([t[0].isdigit() for t in low]), np.array([t in names for t in low]), np.array([t in UNITS for t in low]))
            shape = np.where(kind > 0, kind, code)
            h, s = windows(shape, code)
            n = len(ids)
            ids.append(i)
            exact.append(code)
            kinds.append(kind)
            sizes.append(np.array(list(map(len, low))))
            spaceless.append(sum(len(t) == 1 and CJK.match(t) is not None for t in low) > len(low) / 2)
            found.append((h, np.full(len(h), n), np.arange(len(h)), s, slotted(shape)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2, np.empty(0, np.uint64), np.empty(0, bool)]
        order = np.argsort(columns[0], kind="stable")
        h, item, pos, slots, has_slot = (c[order] for c in columns)
        keys, first = np.unique(h, return_index=True)
        return cls(ids, vocabulary, names, exact, kinds, sizes, np.array(spaceless, bool), keys, np.append(first, len(h)), item, pos, slots, has_slot)


def kinds_of(number: np.ndarray, name: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The slot type of each token, 0 for a token that stands for itself."""
    kind = np.where(number, NUMBER, np.where(name, NAME, 0))
    after = np.concatenate([[False], kind[:-1] == NUMBER])
    return np.where((kind == 0) & unit & after, UNIT, kind)


def best_stretch(equal: Sequence[bool]) -> tuple[int, int]:
    """(length, first position) of the longest allowed stretch: ends equal, at most one token in ``ONE_IN`` differs.

    With +1 for an equal token and 1 - ``ONE_IN`` for a replaced one a stretch is allowed if its sum isn't negative.
    """
    sums = [0]
    for e in equal:
        sums.append(sums[-1] + (1 if e else 1 - ONE_IN))
    # leftmost start for every sum level: starts with ever lower sums, scanned with each end
    starts: list[int] = []
    for i, s in enumerate(sums):
        if not starts or s < sums[starts[-1]]:
            starts.append(i)
    best = (0, 0)
    k = len(starts) - 1
    for j in range(len(sums) - 1, 0, -1):
        if not equal[j - 1]:
            continue
        while k > 0 and sums[starts[k - 1]] <= sums[j]:
            k -= 1
        i = starts[k]
        if sums[i] > sums[j]:
            continue
        while i < j and not equal[i]:
            i += 1
        if j - i > best[0]:
            best = (j - i, i)
    return best


def slots_agree(equal: np.ndarray, kinds: np.ndarray) -> bool:
    """Whether the names and numbers of a stretch are the item's.

    A re-parameterised passage keeps the other words only: half of its slots or more differ, or all its names or numbers.
    """
    slots = equal[kinds > 0]
    if not slots.all() and 2 * int(slots.sum()) <= len(slots):
        return False
    return not any(len(own) >= 2 and not own.any() for own in (equal[kinds == NUMBER], equal[kinds == NAME]))


def leaked_stretch(equal: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, spaceless: bool) -> tuple[int, int] | None:
    """(tokens, replaced) of the longest stretch that leaks, None if there's none.

    The longest allowed stretch counts if its slots agree; otherwise one without any other slot may stand within.
    """

    def long_enough(n: int, at: int) -> bool:
        return n >= MIN_TOKENS and int(sizes[at : at + n].sum()) >= MIN_CHARS if spaceless else n >= MIN_WORDS

    n, at = best_stretch(equal.tolist())
    if not long_enough(n, at):
        return None
    part = equal[at : at + n]
    if slots_agree(part, kinds[at : at + n]):
        return n, n - int(part.sum())
    best: tuple[int, int] | None = None
    walls = np.flatnonzero(~equal & (kinds > 0))
    for a, b in zip([0, *(walls + 1)], [*walls, len(equal)], strict=True):
        n, at = best_stretch(equal[a:b].tolist())
        if long_enough(n, a + at) and (best is None or n > best[0]):
            best = n, n - int(equal[a + at : a + at + n].sum())
    return best


class Finder:
    """Looks the texts of documents up in a block of items."""

    def __init__(self, items: Items):
        self.items = items
        self.coded: dict[str, int] = {}
        self.units = np.array(sorted(items.vocabulary[u] for u in UNITS if u in items.vocabulary), np.int64)

    def _code(self, token: str) -> int:
        """Template id (NUMBER, NAME or the token's own; 0 if no item has the token) and token id, in one number."""
        low = lower(token)
        own = self.items.vocabulary.get(low, 0)
        kind = NUMBER if low[0].isdigit() else NAME if low in self.items.names or (own == 0 and token[0].isupper()) else own
        if len(self.coded) > 500_000:
            self.coded.clear()
        self.coded[token] = packed = kind << 32 | own
        return packed

    def find(self, texts: Sequence[str | None]) -> Iterator[tuple[int, int | None, int, int, int]]:
        """(number of the text, item id, tokens, replaced, 0) of every leak; (number, None, 0, 0, items met by template only)."""
        codes: list[int] = []
        starts, numbers = [0], []
        coded, code = self.coded, self._code
        for n, text in enumerate(texts):
            if text:
                codes += [coded[t] if t in coded else code(t) for t in tokens(text)]
                if len(codes) > starts[-1]:
                    numbers.append(n)
                    starts.append(len(codes))
            if len(codes) > CHUNK:
                yield from self._look_up(codes, starts, numbers)
                codes, starts, numbers = [], [0], []
        if codes:
            yield from self._look_up(codes, starts, numbers)

    def _look_up(self, codes: list[int], starts: list[int], numbers: list[int]) -> Iterator[tuple]:
        it = self.items
        if not len(it.keys):
            return
        packed = np.array(codes, np.int64)
        shape, exact = packed >> 32, packed & 0xFFFFFFFF
        begin = np.array(starts, np.int64)
        of = np.repeat(np.arange(len(numbers)), np.diff(begin))
        unit = np.isin(shape, self.units)
        unit[1:] &= shape[:-1] == NUMBER
        unit[0] = False
        unit[begin[:-1]] = False
        shape = np.where(unit, UNIT, shape)
        known = np.concatenate([[0], np.cumsum(shape > 0)])
        n = max(0, len(shape) - WINDOW + 1)
        at = np.flatnonzero((known[WINDOW:] - known[:-WINDOW] == WINDOW) & (of[:n] == of[WINDOW - 1 :])) if n else np.empty(0, np.int64)
        if not len(at):
            return
        h, s = windows(shape, exact)
        where = np.searchsorted(it.keys, h[at])
        where[where == len(it.keys)] = 0
        hit = it.keys[where] == h[at]
        at, where = at[hit], where[hit]
        if not len(at):
            return
        sizes = it.first[where + 1] - it.first[where]
        votes: list[np.ndarray] = []
        alike: list[np.ndarray] = []
        upto = np.cumsum(sizes)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            reps = sizes[a:b]
            doc_at = np.repeat(at[a:b], reps)
            post = np.arange(len(doc_at)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(it.first[where[a:b]], reps)
            agree = it.slots[post] == s[doc_at]
            pair = of[doc_at] * len(it.ids) + it.item[post]
            diagonal = doc_at - begin[of[doc_at]] - it.pos[post]
            alike.append(np.unique(pair[~agree]))
            votes.append(np.stack([pair[agree], diagonal[agree], np.where(it.has_slot[post[agree]], BARE_WINDOWS, 1)], axis=1))
            a = b
        found: set[int] = set()
        if len(vote := np.concatenate(votes)):
            order = np.lexsort((vote[:, 1], vote[:, 0]))
            vote = vote[order]
            new = np.concatenate([[True], (vote[1:, :2] != vote[:-1, :2]).any(axis=1)])
            group = np.flatnonzero(new)
            weight = np.add.reduceat(vote[:, 2], group)
            best: dict[int, tuple[int, int]] = {}
            for (pair, diagonal, _), w in zip(vote[group].tolist(), weight.tolist(), strict=True):
                d, i = divmod(pair, len(it.ids))
                if w >= (1 if it.spaceless[i] else BARE_WINDOWS) and (got := self._check(exact[begin[d] : begin[d + 1]], i, diagonal)) and got > best.get(pair, (0, 0)):
                    best[pair] = got
            for pair, (length, replaced) in best.items():
                d, i = divmod(pair, len(it.ids))
                yield numbers[d], it.ids[i], length, replaced, 0
            found = set(best)
        met = np.unique(np.concatenate(alike))
        if found:
            met = met[~np.isin(met, list(found))]
        docs, counts = np.unique(met // len(it.ids), return_counts=True)
        for d, k in zip(docs.tolist(), counts.tolist(), strict=True):
            yield numbers[d], None, 0, 0, k

    def _check(self, doc: np.ndarray, i: int, diagonal: int) -> tuple[int, int] | None:
        item = self.items.exact[i]
        a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        return leaked_stretch(doc[a + diagonal : b + diagonal] == item[a:b], self.items.kinds[i][a:b], self.items.sizes[i][a:b], bool(self.items.spaceless[i]))


MET = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("n_replaced", T.IntegerType()),
        T.StructField("n_alike", T.LongType()),
    ]
)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """The distinct items in blocks of about as many characters; the driver holds one at a time."""
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    block: list[tuple[int, str | None]] = []
    chars = 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def met(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_tokens, n_replaced of every leak; with a null item_id: n_alike, the items (of a block) that a
    document meets by template only, since its names and numbers are others."""
    common = common_names(items)
    sc = docs.sparkSession.sparkContext
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out: DataFrame | None = None
    for block in _blocks(items, block_chars):
        spread = sc.broadcast(Items.build(block, common))
        of_block = uuid4().hex

        def make(spread=spread, of_block=of_block):
            finder = once(("leakage", of_block), lambda: Finder(spread.value))

            def work(ids: list, values: list) -> Iterator[tuple]:
                for n, *rest in finder.find(values):
                    yield (ids[n], *rest)

            return work

        part = map_rows(texts, make, MET)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], MET) if out is None else out


def leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_tokens, n_replaced: the longest stretch of each item that a document holds.

    ``docs`` needs doc_id and text, ``items`` item_id and text; extra columns are ignored. Defined results: null ids and
    null, empty or short texts leak nothing; items shorter than the least stretch can't leak; repeated rows count once;
    equal items are reported each; empty tables give no rows.
    """
    found = met(docs, items, block_chars).filter("item_id IS NOT NULL")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_tokens").alias("n_tokens"), F.min("n_replaced").alias("n_replaced"))


def reparameterised(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_items: how many items a document resembles by template windows whose names or numbers are others.

    Leaked items aren't counted. Null ids and texts have no row; a repeated row counts once; empty tables give no rows.
    """
    like = met(docs.select("doc_id", "text").distinct(), items, block_chars).filter("item_id IS NULL")
    return like.groupBy("doc_id").agg(F.sum("n_alike").alias("n_items"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_reparameterised": p8_reparameterised}
