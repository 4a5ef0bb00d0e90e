"""Texts whose end was lost, and how often each source cuts.

Evidence, all from the whole corpus, added up to one score:

* the vocabulary trie, kept as a table of its nodes (prefix -> words that end there, words that go on), met by the final
  tokens in an equi-join: a final token that is no word but a proper prefix of words is a fragment;
* lengths: a length at which the texts of a source pile up is a field limit;
* continuation counts: how often the last tokens of a text end a sentence elsewhere, with back-off from three tokens to
  one and from words to shapes (names, numbers). They tell cuts between words, which no trie can see; where no context
  was seen often enough they say nothing.

Signs of a cut ("…", "[...]", "[truncated]") are taken off first and are evidence of their own.

Only what some text asks for is counted: the asked contexts and final tokens are brought to a table of ``BUCKETS`` bits,
whose size doesn't depend on the corpus, and what falls in no asked bucket never leaves its task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._arrow import map_rows
from corpusloom.llm.quality import content_class
from corpusloom.session import checkpoint
from corpusloom.session import texts as table

SIGN = re.compile(r"\s?(?:\.\.\.|…|\[\s?(?:\.\.\.|…)\s?\]|\((?:\.\.\.|…)\)|[\[(<](?:truncated|cut|cut off|more|snip)[\])>])\s*$", re.I)
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
TOKEN = re.compile(rf"[{CJK}]|\d[\d.,]*\d|\d|[^\W\d_{CJK}]+(?:['’\-][^\W\d_{CJK}]+)*|[.!?…。！？।؟]|\n")
#: Stops as the tokens have them: none within a figure.
STOP = re.compile(r"(?<!\d)[.!?…]|[.!?…](?!\d)|[。！？।؟]")
SIGN_SIZE = 16
STOPS = frozenset(".!?…。！？।؟")
#: Closing marks and signs of emphasis that may stand after the last stop.
AFTER_STOP = "\"'”’»」』）)]*_"
DIGIT_STOP = re.compile(r"\d[.,]$")
STRUCTURE = re.compile(r"```|~~~|#{1,6}\s|\[\^?\d+\]\s|[—–]{1,2}\s?\S|https?://|www\.|<[/A-Za-z]|\||(?:Keywords|Tags|Source|Quelle|Fuente)\s?:|关键词")
TAIL_MARK = re.compile(r"(?:\[\^?\d{1,4}\]|[¹²³⁴-⁹⁰]+)\s*$")
WORD = re.compile(rf"[^\W\d_{CJK}]+(?:['’\-][^\W\d_{CJK}]+)*$")
#: Lengths that pile up: at least this many texts, and this many times the mean of the lengths near by.
PILE, TIMES, NEAR = 5, 8.0, 25
#: Lengths of a source are looked at in stretches of so many.
STRETCH = 1024
#: A figure with a point after it mostly ends a sentence; it was cut within its decimals only where such a figure is hardly ever last.
SELDOM_FIGURE = 0.02
#: A final token that is a word, but so much rarer than the words that go on, is taken for a fragment.
RARER = 500
#: Uses of a context below which the shorter one is asked.
SEEN = 4
#: Log odds of a cut: a fragment; a field limit or a sign; at least and at most by the continuation counts; what a text
#: that isn't open (a heading, a list) needs beyond them.
FRAGMENT, LIMIT, LEAST, MOST, CLOSED = 4.0, 3.0, -2.0, 3.0, -1.0
#: Tokens counted at once.
CHUNK = 400_000
BUCKETS = 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)


class Codes:
    """Tokens as numbers: hashes of their lower case and of their shape (figure, name), and what they are."""

    WORD, IDEOGRAPH, STOP, BREAK = range(4)

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.low: list[str] = []
        self._codes: list[tuple[int, int, int]] = []
        self._table = np.empty((0, 3), np.uint64)

    def index(self, token: str) -> int:
        n = self.at.get(token)
        if n is None:
            n = self.at[token] = len(self.low)
            figure = token[0].isdigit()
            low = "#" if figure else token.lower()
            kind = self.BREAK if token == "\n" else self.STOP if token in STOPS else self.IDEOGRAPH if IDEOGRAPH.match(token) else self.WORD
            self.low.append(low)
            self._codes.append((_hash(low), _hash("^") if token[0].isupper() else _hash(low), kind))
        return n

    def table(self) -> np.ndarray:
        if len(self._table) < len(self._codes):
            self._table = np.concatenate([self._table, np.array(self._codes[len(self._table) :], np.uint64)])
        return self._table

    def table_of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.array([self._codes[self.index(t)] for t in tokens], np.uint64)
        return rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2]

    def clear_if_full(self) -> None:
        if len(self.low) > 500_000:
            self.__init__()


IDEOGRAPH = re.compile(f"[{CJK}]")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def _keys(codes: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Key of the n codes that end at each place, as int64; the first n - 1 places have none."""
    out = np.zeros(len(codes), np.uint64)
    if len(codes) >= n:
        h = np.full(len(codes) - n + 1, np.uint64(17 * n + kind))
        with np.errstate(over="ignore"):
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * ODD
                h ^= h >> np.uint64(29)
        out[n - 1 :] = h
    return out.view(np.int64)


def contexts(low: np.ndarray, shape: np.ndarray, since: np.ndarray, ideograph: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, where they hold) of the contexts that end at each token, the surest first; ``since``: tokens since the stop."""
    for n in (6, 4, 3, 2):
        yield _keys(low, n, 2), ideograph & (since >= n)
    yield _keys(low, 1, 3), ideograph & (since == 1)
    for n in (3, 2, 1):
        for kind, codes in enumerate((low, shape)):
            yield _keys(codes, n, kind), ~ideograph & (since >= n)


def _last_word(bare: str) -> tuple[str | None, bool]:
    """(the final token of a line that is no running text, whether it may be a name); parts of links and codes are none."""
    final = WORD.search(bare)
    if final is None or not (final.start() == 0 or bare[final.start() - 1] in " \t\n|(["):
        return None, False
    return final.group().lower(), final.group()[0].isupper()


def ending(text: str, codes: Codes) -> tuple[str, bool, int, str | None, bool, list[int]]:
    """(state, has a sign of a cut, length without it, final token, final token is a name, context keys).

    States: ended (by a stop), closed (by a heading, reference, fence or the like), other (no prose), open.
    """
    # the longest sign has SIGN_SIZE characters, blanks after it apart
    sign = SIGN.search(text, max(0, len(text.rstrip()) - SIGN_SIZE))
    body = text[: sign.start()] if sign else text
    length = len(body)
    bare = body.rstrip()
    if not bare:
        return "other", False, length, None, False, []
    marked = sign is not None
    if bare[-1] == "�":
        return "broken", marked, length, None, False, []
    figure = DIGIT_STOP.search(bare[-2:]) is not None
    ended = bare.rstrip(AFTER_STOP)[-1:] in STOPS
    if not marked and not figure and ended:
        # a list or table that ends so is whole too
        return "ended", False, length, None, False, []
    kind = content_class(body)
    last_line = bare[bare.rfind("\n") + 1 :].strip()
    if kind is not None:
        return ("junk", marked, length, None, False, []) if kind == "junk" else ("other", marked, length, *_last_word(bare), [])
    if not marked and TAIL_MARK.search(bare):
        return "closed", marked, length, None, False, []
    if bare[-1] in "<{[&":
        return "broken", marked, length, None, False, []
    if STRUCTURE.match(last_line) or last_line.endswith("```"):
        return "closed", marked, length, *_last_word(bare), []
    if ended and not figure:
        return "ended", marked, length, None, False, []
    tail = bare.rstrip(".,") if figure else bare
    stop = None
    for stop in STOP.finditer(tail):
        pass
    last = [t for t in TOKEN.findall(tail, stop.end() if stop else 0) if t != "\n"]
    if not last:
        return "ended", marked, length, None, False, []
    final = WORD.search(bare) if body == bare or marked else None
    word = final.group() if final else None
    if bare[-1] in ",;:，、；：(（-–":
        return "comma", marked, length, None, False, []
    n = min(6, len(last))
    low, shape, kinds = codes.table_of(last[-n:])
    if n == len(last):
        shape[0] = low[0]
    keys = [int(k[-1]) for k, holds in contexts(low, shape, np.arange(len(last) - n, len(last)) + 1, kinds == Codes.IDEOGRAPH) if holds[-1]]
    is_name = bool(word) and len(last) > 1 and last[-1][0].isupper()
    return "figure" if figure else "open", marked, length, word.lower() if word else None, is_name, keys


ENDINGS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("marked", T.BooleanType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("final", T.StringType()),
        T.StructField("is_name", T.BooleanType()),
        T.StructField("contexts", T.ArrayType(T.LongType())),
    ]
)
COUNTS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.LongType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ends", T.LongType())])


def endings(docs: DataFrame) -> DataFrame:
    def make():
        codes = Codes()

        def work(ids: list, sources: list, texts: list) -> Iterator[tuple]:
            codes.clear_if_full()
            for i, source, text in zip(ids, sources, texts, strict=True):
                if text and text.strip():
                    state, marked, length, *rest = ending(text, codes)
                    yield (i, source, state, marked, length, len(text[:length].split()), *rest)

        return work

    return map_rows(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text"), make, ENDINGS)


def asked_buckets(keys: DataFrame, column: str) -> np.ndarray:
    """The buckets of a column (a long, or the hash of a string), one flag for each of ``BUCKETS``: bounded whatever is asked."""
    value = F.col(column) if dict(keys.dtypes)[column] == "bigint" else F.xxhash64(column)
    found = keys.select(F.pmod(value, F.lit(BUCKETS)).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()
    flags = np.zeros(BUCKETS, bool)
    flags[found] = True
    return flags


def _count(codes: Codes, indexes: list[int], starts: list[int], asked: np.ndarray | None) -> Iterator[tuple]:
    """Rows of ``COUNTS`` for texts given as token numbers, of which ``starts`` are the first."""
    table = codes.table()
    index = np.array(indexes, np.int64)
    of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(indexes)]))
    kind = table[index, 2]
    keep = kind != Codes.BREAK
    index, of, kind = index[keep], of[keep], kind[keep]
    if not len(index):
        return
    stop = kind == Codes.STOP
    same = np.append(of[1:] == of[:-1], False)
    follows = np.append(stop[1:], False)
    opens = np.concatenate([[True], stop[:-1] | ~same[:-1]])
    at = np.arange(len(index))
    since = at - np.maximum.accumulate(np.where(opens, at, 0)) + 1
    counted = ~stop & same
    words: Counter = Counter()
    for i, n in enumerate(np.bincount(index[counted], minlength=1).tolist()):
        if n:
            words[codes.low[i]] += n
    for word, n in words.items():
        if len(word) > 1 or word.isalpha():
            yield "w", None, word, n, 0
    low = table[index, 0]
    shape = np.where(opens, low, table[index, 1])
    keys, ends = [], []
    for key, holds in contexts(low, shape, since, kind == Codes.IDEOGRAPH):
        holds = holds & counted
        if asked is not None:
            holds[holds] = asked[key[holds] & (BUCKETS - 1)]
        keys.append(key[holds])
        ends.append(follows[holds])
    key, back, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    yield from (("c", k, None, m, e) for k, m, e in zip(key.tolist(), n.tolist(), np.bincount(back, np.concatenate(ends), len(key)).astype(int).tolist(), strict=True))


def corpus_counts(docs: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """kind, key, word, n, ends: words of the corpus (kind w) and context keys (kind c; those in ``asked`` buckets), counted
    by chunk before the shuffle.

    The last token of a text counts only if a stop follows it, so cut tokens are no words.
    """
    spread = docs.sparkSession.sparkContext.broadcast(asked)

    def make():
        codes = Codes()
        asked = spread.value

        def work(texts: list) -> Iterator[tuple]:
            indexes: list[int] = []
            starts: list[int] = []
            known, index = codes.at, codes.index
            for text in texts:
                if text:
                    starts.append(len(indexes))
                    indexes += [known[t] if t in known else index(t) for t in TOKEN.findall(text)]
                if len(indexes) > CHUNK:
                    yield from _count(codes, indexes, starts, asked)
                    indexes, starts = [], []
                    codes.clear_if_full()
                    known = codes.at
            if indexes:
                yield from _count(codes, indexes, starts, asked)
                codes.clear_if_full()

        return work

    raw = map_rows(docs.select("text"), make, COUNTS)
    return raw.groupBy("kind", "key", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


NODES = T.StructType([T.StructField("prefix", T.StringType()), T.StructField("here", T.LongType()), T.StructField("longer", T.LongType())])


def trie_nodes(words: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """prefix, here (uses of the prefix as a word), longer (uses of words that go on): the trie as a table of its nodes.

    ``asked``: buckets (by hash) of the prefixes that are wanted; the other nodes aren't built.
    """
    spread = words.sparkSession.sparkContext.broadcast(asked)

    def make():
        asked = spread.value

        def work(words: list, counts: list) -> Iterator[tuple]:
            nodes: dict[str, list[int]] = {}
            for word, n in zip(words, counts, strict=True):
                for k in range(1, len(word) + 1):
                    prefix = word[:k]
                    if asked is None or asked[xxhash.xxh64_intdigest(prefix.encode("utf-8", "replace"), 42) % BUCKETS]:
                        node = nodes.setdefault(prefix, [0, 0])
                        node[k < len(word)] += n
            yield from ((prefix, here, longer) for prefix, (here, longer) in nodes.items())

        return work

    return map_rows(words.select("word", "n"), make, NODES).groupBy("prefix").agg(F.sum("here").alias("here"), F.sum("longer").alias("longer"))


def field_limits(ends: DataFrame, measure: str = "length") -> DataFrame:
    """source, length (or n_words): sizes at which the texts of a source pile up.

    Few texts and short ones (under ``NEAR`` of the measure) pile up by chance and are no limit. The sizes of a source are
    looked at in stretches that overlap by what is near, so no source is one task.
    """
    size = F.col(measure)
    counts = ends.filter(size > NEAR).groupBy("source", measure).agg(F.count("*").alias("n"))
    part = lambda x: F.floor(x / STRETCH).cast("int")
    spread = counts.withColumn("part", F.explode(F.array_distinct(F.array(part(size - NEAR), part(size), part(size + NEAR)))))
    near = Window.partitionBy("source", "part").orderBy(measure).rangeBetween(-NEAR, NEAR)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    own = spread.withColumn("around", around).filter(F.col("part") == part(size))
    return own.filter((F.col("n") >= PILE) & (F.col("n") > TIMES * F.col("around"))).select("source", measure)


def _end_share(met: Column) -> Column:
    """Share of ends of the surest context that was seen often enough; null where none was."""
    sure = F.filter(met, lambda m: m["n"] >= SEEN)
    first = F.array_min(F.transform(sure, lambda m: F.struct(m["pos"].alias("pos"), (m["ends"] / m["n"]).alias("share"))))
    return first["share"]


def keyed(ends: DataFrame) -> DataFrame:
    """``ends`` with tail and prefix, by which contexts and final tokens are joined; texts that ask for nothing get keys of
    their own, which meet nothing and gather nowhere."""
    tail = F.when(F.size("contexts") > 0, F.xxhash64("contexts")).otherwise(F.xxhash64("doc_id", F.lit("none")))
    return ends.withColumn("tail", tail).withColumn("prefix", F.coalesce("final", F.concat(F.lit("\x00"), F.col("doc_id").cast("string"))))


def evidence(docs: DataFrame) -> DataFrame:
    """doc_id, source, state, marked, at_limit, final, is_name, here, longer, end_share of every text that isn't blank."""
    ends = checkpoint(endings(docs))
    is_open = F.col("state").isin("open", "figure")
    named = keyed(ends)
    asked = named.filter(is_open).select("tail", F.posexplode("contexts").alias("pos", "key")).distinct()
    finals = ends.filter("final IS NOT NULL").select("final").distinct()
    counts = checkpoint(corpus_counts(docs, asked_buckets(asked, "key")))
    met = (
        asked.join(counts.filter("kind = 'c'").select("key", "n", "ends"), "key")
        .groupBy("tail")
        .agg(F.collect_set(F.struct("pos", "n", "ends")).alias("met"))  # at most six contexts a tail
        .select("tail", _end_share(F.col("met")).alias("end_share"))
    )
    nodes = trie_nodes(counts.filter("kind = 'w'").select("word", "n"), asked_buckets(finals, "final"))
    out = named.join(met, "tail", "left").join(nodes, "prefix", "left")
    # a null source is matched as a text that no source has
    out = out.withColumn("of", F.coalesce("source", F.lit("\x00")))
    for measure, flag in (("length", "char_limit"), ("n_words", "word_limit")):
        piles = field_limits(ends, measure).select(F.coalesce("source", F.lit("\x00")).alias("of"), measure, F.lit(True).alias(flag))
        out = out.join(piles, ["of", measure], "left")
    limit = F.coalesce("char_limit", F.lit(False)) | F.coalesce("word_limit", F.lit(False))
    return out.withColumn("at_limit", limit).select("doc_id", "source", "state", "marked", "at_limit", "final", "is_name", "here", "longer", "end_share")


def score(use_trie: bool = True) -> Column:
    """Log odds that a text with this evidence was cut; a context that wasn't seen says nothing."""
    fragment = F.col("final").isNotNull() & ~F.col("is_name") & (F.coalesce("longer", F.lit(0)) > RARER * F.coalesce("here", F.lit(0)))
    trie = F.when(fragment & F.lit(use_trie), FRAGMENT).otherwise(0.0)
    length = F.when(F.col("at_limit") | F.col("marked"), LIMIT).otherwise(0.0)
    share = F.greatest(F.least(F.col("end_share"), F.lit(0.999)), F.lit(0.001))
    goes_on = F.when(F.col("end_share").isNull(), 0.0).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.log((1 - share) / share))))
    return (
        F.when(F.col("state").isin("broken", "comma"), F.lit(2 * LIMIT))
        .when(F.col("state") == "open", trie + length + goes_on)
        .when(F.col("state") == "figure", F.when(F.col("end_share") < SELDOM_FIGURE, log(1 / SELDOM_FIGURE)).otherwise(-LIMIT))
        .when(F.col("state").isin("closed", "other"), trie + length + CLOSED)
        .otherwise(F.lit(-LIMIT))
    )


def truncated(docs: DataFrame) -> DataFrame:
    """doc_id, source, state, marked, at_limit, end_share, score, cut: every text with its evidence.

    ``docs`` needs doc_id, source and text; extra columns are ignored. Defined results: null ids are left out; null,
    empty and blank texts are never cut and have no row; repeated rows are judged alike; a null source is a source of
    its own; an empty table gives no rows.
    """
    return evidence(docs).withColumn("score", score()).withColumn("cut", F.col("score") > 0)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).filter("cut").select("doc_id").distinct()


def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents"))


def p9_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truncated(table(spark, sf_dir, "documents"))
    return found.groupBy("source").agg(
        F.count("*").alias("n_texts"),
        F.sum(F.col("cut").cast("bigint")).alias("n_cut"),
        F.sum((F.col("cut") & F.col("at_limit")).cast("bigint")).alias("n_at_limit"),
        F.avg(F.col("cut").cast("double")).alias("cut_share"),
    )


QUERIES = {"p9_found": p9_found, "p9_evidence": p9_evidence, "p9_by_source": p9_by_source}
