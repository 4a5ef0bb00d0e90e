"""Languages of texts and of the segments of mixed texts, with a confidence.

One interpolated Kneser-Ney character model per language, all in one pair of sorted hash arrays an order (n-grams with
their discounted share, contexts with their back-off weight; a column a language). Words with spaces are modelled up to
order 5 within word bounds, scripts without spaces by pairs of characters, so a score is a sum over words or pairs and
every distinct one is scored once a worker. The language with the least cross-entropy a character is taken, unless even
that lies beyond what the language's own training texts show (calibrated rejection).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._arrow import map_rows
from corpusloom.session import texts as table

LANGUAGES = ("ar", "de", "en", "es", "fr", "hi", "it", "ja", "nl", "pt", "ru", "th", "zh")
UNKNOWN = "unknown"
#: Labelled texts a language that the models are fitted on, at most.
SAMPLE = 250
ORDER = 5
DISCOUNT = 0.75
#: A unit whose share in a language's sample is smaller than this part of its share in another is taken for foreign.
FOREIGN = 0.3
#: Standard deviations above a language's own cross-entropy at which a segment is rejected.
REJECT_SD = 6.0
#: Letters (characters without spaces count twice) that a segment needs to be a sentence of its own.
SENTENCE = 16

#: Other spellings of the languages' names.
SPELLED = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "italian": "it", "dutch": "nl", "russian": "ru", "arabic": "ar",
    "hindi": "hi", "thai": "th", "japanese": "ja", "chinese": "zh", "mandarin": "zh", "deutsch": "de", "français": "fr", "español": "es", "português": "pt",
    "italiano": "it", "nederlands": "nl", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl",
    "dut": "nl", "rus": "ru", "ara": "ar", "hin": "hi", "tha": "th", "jpn": "ja", "zho": "zh", "chi": "zh", "cmn": "zh", "und": "unknown", "none": "unknown",
}

SPACELESS = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿"
#: Signs of vowels that belong to a word though they aren't letters.
SIGNS = "̀-ͯऀ-ॣॱ-ॿً-ٰٟـ"
WORD = re.compile(rf"(?:(?![{SPACELESS}])[^\W\d_]|[{SIGNS}])+")
RUN = re.compile(rf"[{SPACELESS}]+")
LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+|`[^`]*`|\b[\w-]+(?:/[\w.-]+)+|\b\w+\.(?:md|json|csv|txt|py|html)\b")
BREAK = re.compile(r"\n+|(?<=[.!?])[\"'”’»)]*\s+|(?<=[。！？।؟])[\"'”’»」』）)]*\s*|[(（「『“«\"](?=[^()（）「」『』“”«»\"]{12,}[.!?。！？।؟][)）」』”»\"])|(?<=[^\s][.!?。！？।؟])[)）」』”»\"]")
THAI_GAP = re.compile(r"(?<=[฀-๿]{8}) (?=[฀-๿]{8})")


def code(label: str | None) -> str | None:
    """The two-letter code that a label names; unknown names are given back in lower case, null stays null."""
    if label is None or not label.strip():
        return None
    low = label.strip().lower()
    base = re.split(r"[-_ (]", low)[0]
    return SPELLED.get(low) or SPELLED.get(base) or base


def code_of(label: Column) -> Column:
    """``code`` of a column, on the JVM side."""
    low = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    base = F.split(low, r"[-_ (]")[0]
    spelled = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    return F.when(low != "", F.coalesce(F.try_element_at(spelled, low), F.try_element_at(spelled, base), base))


class KneserNey:
    """Character models of several languages over short sequences."""

    def __init__(self, languages: tuple[str, ...], order: int, keys: list[np.ndarray], shares: list[np.ndarray], ctx_keys: list[np.ndarray], weights: list[np.ndarray]):
        self.languages, self.order = languages, order
        self.keys, self.shares, self.ctx_keys, self.weights = keys, shares, ctx_keys, weights

    @staticmethod
    def _hashes(seqs: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(hash of the n-gram that ends here for n = 1.. (0 where it doesn't fit), position in its sequence) of every character."""
        joined = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
        at = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out, h = [], np.zeros(len(joined), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(order):
                shifted = np.zeros_like(joined)
                shifted[n:] = joined[: len(joined) - n] if n else joined
                h = (h ^ (shifted + np.uint64(0x9E37))) * np.uint64(0x9E3779B97F4A7C15)
                h = h ^ (h >> np.uint64(31)) | np.uint64(1)
                out.append(np.where(at >= n, h, 0))
        return out, at

    @classmethod
    def fit(cls, texts: dict[str, Iterable[str]], order: int, languages: tuple[str, ...] = LANGUAGES) -> KneserNey:
        """From the sequences of each language; their first character is context only."""
        keys: list[np.ndarray] = []
        shares: list[np.ndarray] = []
        ctx_keys: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        size = len(languages)
        grams: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
        for lang in languages:
            seqs = list(texts.get(lang, ()))
            if not seqs:
                for n in range(order):
                    grams[n].append((np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0)))
                continue
            hs, at = cls._hashes(seqs, order)
            # context of an n-gram: the n-1 characters before its last; as a hash, that of the (n-1)-gram one place earlier
            for n in range(order):
                fits = (at >= max(n, 1)) & (hs[n] != 0)
                g = hs[n][fits]
                c = np.zeros(len(g), np.uint64) if n == 0 else np.roll(hs[n - 1], 1)[fits]
                if n + 1 < order:
                    # lower orders count the distinct characters before them, the highest its uses
                    longer = (at >= n + 1) & (hs[n + 1] != 0)
                    pairs = np.unique(np.stack([hs[n][longer], hs[n + 1][longer]]), axis=1)
                    left, counts = np.unique(pairs[0], return_counts=True)
                    u, first = np.unique(g, return_index=True)
                    where = np.searchsorted(left, u) if len(left) else np.zeros(len(u), np.int64)
                    where = np.minimum(where, max(0, len(left) - 1))
                    many = np.where(left[where] == u, counts[where], 1).astype(float) if len(left) else np.ones(len(u))
                else:
                    u, first, many = np.unique(g, return_index=True, return_counts=True)
                    many = many.astype(float)
                grams[n].append((u, c[first], many))
        for n in range(order):
            all_keys = np.unique(np.concatenate([g[0] for g in grams[n]]))
            all_ctx = np.unique(np.concatenate([g[1] for g in grams[n]]))
            share = np.zeros((len(all_keys), size), np.float32)
            weight = np.ones((len(all_ctx), size), np.float32)
            for j, (u, c, many) in enumerate(grams[n]):
                if not len(u):
                    continue
                ctx, inverse = np.unique(c, return_inverse=True)
                total, kinds = np.bincount(inverse, many), np.bincount(inverse)
                share[np.searchsorted(all_keys, u), j] = np.maximum(many - DISCOUNT, 0) / total[inverse]
                weight[np.searchsorted(all_ctx, ctx), j] = DISCOUNT * kinds / total
            keys.append(all_keys)
            shares.append(share)
            ctx_keys.append(all_ctx)
            weights.append(weight)
        return cls(languages, order, keys, shares, ctx_keys, weights)

    @staticmethod
    def _rows(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(asked), values.shape[1]), missing, np.float32)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        out = values[at]
        out[keys[at] != asked] = missing
        return out

    def score(self, seqs: list[str]) -> np.ndarray:
        """Log-probability of each sequence in each language, its first character given."""
        if not seqs:
            return np.zeros((0, len(self.languages)), np.float32)
        hs, at = self._hashes(seqs, self.order)
        p = np.full((len(at), len(self.languages)), 1e-5, np.float32)
        for n in range(self.order):
            fits = np.flatnonzero(at >= max(n, 1))
            ctx = np.zeros(len(fits), np.uint64) if n == 0 else np.roll(hs[n - 1], 1)[fits]
            p[fits] = self._rows(self.keys[n], self.shares[n], hs[n][fits], 0.0) + self._rows(self.ctx_keys[n], self.weights[n], ctx, 1.0) * p[fits]
        logs = np.log(p)
        logs[at == 0] = 0
        return np.add.reduceat(logs, np.flatnonzero(at == 0), axis=0)


def strip_accents(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not "̀" <= ch <= "ͯ")


def clean(text: str) -> str:
    """The text in lower case without links and code."""
    return LINK.sub(" ", text).lower() if any(mark in text for mark in ("/", "@", "`", ".")) else text.lower()


def parts(low: str) -> tuple[list[str], list[str]]:
    """(words, pairs of characters of scripts without spaces) of a cleaned text."""
    pairs: list[str] = []
    if not low.isascii():
        for run in RUN.findall(low):
            pairs += map("".join, zip(run, run[1:], strict=False)) if len(run) > 1 else ["^" + run]
    return WORD.findall(low), pairs


def _own(units: dict[str, list[str]]) -> dict[str, list[str]]:
    """Without the units that another language uses far more often: what wrong labels and foreign sentences brought in."""
    counts = {lang: Counter(us) for lang, us in units.items()}
    totals = {lang: max(1, len(us)) for lang, us in units.items()}
    most: dict[str, float] = {}
    for lang, own in counts.items():
        for u, n in own.items():
            most[u] = max(most.get(u, 0.0), n / totals[lang])
    return {lang: [u for u in us if counts[lang][u] / totals[lang] >= FOREIGN * most[u]] for lang, us in units.items()}


class Detector:
    """Segments and their languages."""

    def __init__(self, words: KneserNey, pairs: KneserNey, limits: dict[str, float]):
        self.models, self.limits = (words, pairs), limits
        self.memory: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.rows: list[np.ndarray] = [np.zeros((0, len(LANGUAGES)), np.float32)] * 2

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]]) -> Detector:
        """From (label, text), some of which may be wrong: a second fit leaves out what the first contradicts."""
        first = cls._fit(labelled)
        first.warm(text for _, text in labelled)
        kept = [(lang, text) for lang, text in labelled if first.language(text)[0] == lang]
        return cls._fit(kept or labelled)

    @classmethod
    def _fit(cls, labelled: list[tuple[str, str]]) -> Detector:
        words: dict[str, list[str]] = defaultdict(list)
        pairs: dict[str, list[str]] = defaultdict(list)
        spaced: Counter = Counter()
        for lang, text in labelled:
            if lang not in LANGUAGES or not text:
                continue
            low = clean(text)
            w, p = parts(low)
            if 2 * len(p) >= sum(map(len, w)):
                pairs[lang] += p
                spaced[lang] -= 1
                continue
            words[lang] += [f"^{x}$" for x in w]
            spaced[lang] += 1
            plain = strip_accents(low)
            if plain != low:
                words[lang] += [f"^{x}$" for x in WORD.findall(plain)]
        # a language is written either way; texts of the other kind have wrong labels
        words = {lang: us for lang, us in words.items() if spaced[lang] > 0}
        pairs = {lang: us for lang, us in pairs.items() if spaced[lang] <= 0}
        out = cls(KneserNey.fit(_own(words), ORDER), KneserNey.fit(_own(pairs), 2), {})
        out.warm(text for _, text in labelled)
        costs: dict[str, list[float]] = defaultdict(list)
        for lang, text in labelled:
            found, cost, _, letters = out.measure(text)
            if found == lang and letters >= SENTENCE:
                costs[lang].append(cost)
        out.limits = {lang: float(np.mean(c) + REJECT_SD * (np.std(c) + 0.05)) for lang, c in costs.items() if len(c) > 3}
        return out

    def _indexes(self, kind: int, seqs: list[str]) -> list[int]:
        memory = self.memory[kind]
        try:
            return [memory[s] for s in seqs]
        except KeyError:
            pass
        new = [s for s in dict.fromkeys(seqs) if s not in memory]
        if new:
            if len(memory) > 300_000:
                memory.clear()
                self.rows[kind] = self.rows[kind][:0]
                new = list(dict.fromkeys(seqs))
            got = self.models[kind].score([f"^{s}$" for s in new] if kind == 0 else new)
            base = len(self.rows[kind])
            self.rows[kind] = np.concatenate([self.rows[kind], got])
            for i, s in enumerate(new):
                memory[s] = base + i
        return [memory[s] for s in seqs]

    def warm(self, texts: Iterable[str]) -> None:
        """Score all distinct words of a batch at once."""
        words: set[str] = set()
        pairs: set[str] = set()
        for text in texts:
            w, p = parts(clean(text))
            words.update(w)
            pairs.update(p)
        self.warm_units(words, pairs)

    def warm_units(self, words: set[str], pairs: set[str]) -> None:
        self._indexes(0, list(words))
        self._indexes(1, list(pairs))

    def measure(self, text: str) -> tuple[str | None, float, float, int]:
        """(language, cross-entropy a character, confidence, letters) without rejection; None without a word."""
        return self.measure_parts(*parts(clean(text)))

    def measure_parts(self, w: list[str], p: list[str]) -> tuple[str | None, float, float, int]:
        """The same from the words and pairs of a text."""
        n_words = sum(map(len, w))
        if not n_words and not p:
            return None, 0.0, 0.0, 0
        kind, seqs, n = (1, p, len(p)) if 2 * len(p) >= n_words else (0, w, n_words + len(w))
        at = self._indexes(kind, seqs)
        total = self.rows[kind][at].sum(0)
        best = int(total.argmax())
        high = float(total[best])
        total[best] = -np.inf
        gap = high - float(total.max())
        return LANGUAGES[best], -high / n, 1 / (1 + float(np.exp(-min(30.0, gap)))), 2 * len(p) if kind else n_words

    def language(self, text: str | None) -> tuple[str, float]:
        """(language or unknown, confidence) of a text taken as a whole."""
        return self.judge(*parts(clean(text))) if text else (UNKNOWN, 1.0)

    def judge(self, w: list[str], p: list[str]) -> tuple[str, float]:
        """The same from the words and pairs of a text."""
        found, cost, sure, _ = self.measure_parts(w, p)
        if found is None:
            return UNKNOWN, 1.0
        return (UNKNOWN, 1 - sure) if self.limits and cost > self.limits.get(found, 99.0) else (found, sure)

    def segments(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """(start, end, language, confidence, letters): runs of sentences of one language.

        A segment too short to be a sentence, or beyond the limit of its language, joins the one before it (the first,
        the one after it): names, terms and links are no segments.
        """
        if not text or not text.strip():
            return []
        cuts = [0]
        for m in BREAK.finditer(text):
            cuts.append(m.end())
        if RUN.search(text):
            cuts += [m.end() for m in THAI_GAP.finditer(text)]
        cuts = sorted({*cuts, len(text)})
        found: list[list] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            lang, cost, sure, letters = self.measure(text[a:b])
            if lang is None or letters < SENTENCE or cost > self.limits.get(lang, 99.0) or sure < 0.9:
                lang = None
            found.append([a, b, lang, sure, letters])
        if all(f[2] is None for f in found):
            lang, sure = self.language(text)
            return [(0, len(text), lang, sure, sum(f[4] for f in found))]
        merged: list[list] = []
        for f in found:
            if merged and (f[2] is None or merged[-1][2] is None or merged[-1][2] == f[2]):
                last = merged[-1]
                last[1], last[2], last[4] = f[1], last[2] or f[2], last[4] + f[4]
                last[3] = min(last[3], f[3]) if f[2] and last[2] else last[3]
            else:
                merged.append(f)
        return [tuple(m) for m in merged]


def training_sample(cases: DataFrame, max_per_label: int = SAMPLE) -> list[tuple[str, str]]:
    """(code, text): at most ``max_per_label`` labelled texts a language, whatever its spelling, chosen by a hash of the key - the only bounded part."""
    label = code_of(F.col("expected.language"))
    light = cases.filter(F.col("expected.language").isNotNull() & (F.length("text") >= 20)).select(label.alias("label"), "text", F.xxhash64("case_id").alias("h"))
    order = Window.partitionBy("label").orderBy("h", "text")
    ranked = light.filter(F.col("label").isin(*LANGUAGES)).withColumn("r", F.row_number().over(order))
    rows = ranked.filter(F.col("r") <= max_per_label).select("label", "text").collect()
    return sorted((r["label"], r["text"]) for r in rows)


def fit_detector(cases: DataFrame, max_per_label: int = SAMPLE) -> Detector:
    return Detector.fit(training_sample(cases, max_per_label))


SEGMENTS = T.StructType(
    [
        T.StructField("rec_key", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("seg_no", T.IntegerType()),
        T.StructField("seg_start", T.LongType()),
        T.StructField("seg_end", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
TALLY = T.StructType([T.StructField("rec_key", T.StringType()), T.StructField("language", T.StringType()), T.StructField("n", T.LongType())])


def language_segments(texts: DataFrame, detector: Detector) -> DataFrame:
    """rec_key, label (its code), seg_no, seg_start, seg_end, language, confidence; offsets in code points.

    ``texts`` needs rec_key, label and text. Null, blank and wordless texts have one segment of language unknown;
    repeated rows are repeated; extra columns are ignored; an empty table gives no rows.
    """
    spread = texts.sparkSession.sparkContext.broadcast((detector.models, detector.limits))

    def make():
        models, limits = spread.value
        own = Detector(*models, limits)

        def work(keys: list, labels: list, values: list) -> Iterator[tuple]:
            own.warm(t for t in values if t)
            for k, label, text in zip(keys, labels, values, strict=True):
                segs = own.segments(text) or [(0, len(text or ""), UNKNOWN, 1.0, 0)]
                for i, (a, b, lang, sure, _) in enumerate(segs):
                    yield k, code(label), i, a, b, lang, sure

        return work

    return map_rows(texts.select("rec_key", "label", "text"), make, SEGMENTS)


def group_languages(texts: DataFrame, detector: Detector) -> DataFrame:
    """rec_key, language, share, n: the characters of a group's texts by language; tallied in the workers before the shuffle."""
    spread = texts.sparkSession.sparkContext.broadcast((detector.models, detector.limits))

    def make():
        models, limits = spread.value
        own = Detector(*models, limits)

        def work(keys: list, values: list) -> Iterator[tuple]:
            units = [parts(clean(t)) if t else ([], []) for t in values]
            own.warm_units({x for w, _ in units for x in w}, {x for _, p in units for x in p})
            tally: dict[tuple[str, str], int] = {}
            for k, text, (w, p) in zip(keys, values, units, strict=True):
                if text:
                    lang, _ = own.judge(w, p)
                    if lang != UNKNOWN:
                        tally[k, lang] = tally.get((k, lang), 0) + len(text)
            for (k, lang), n in tally.items():
                yield k, lang, n

        return work

    sums = map_rows(texts.filter("rec_key IS NOT NULL").select("rec_key", "text"), make, TALLY).groupBy("rec_key", "language").agg(F.sum("n").alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("rec_key")))  # at most one row a language and group


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lang_spec_cases")


def _segments(spark: SparkSession, sf_dir: str, detector: Detector) -> DataFrame:
    cases = _cases(spark, sf_dir).select(F.col("case_id").alias("rec_key"), F.col("expected.language").alias("label"), "text")
    return language_segments(cases, detector)


def _corpora(spark: SparkSession, sf_dir: str, detector: Detector) -> DataFrame:
    blocks = table(spark, sf_dir, "blocks").filter("kind = 'prose' AND text_level IS NULL").select(F.col("corpus_name").alias("rec_key"), F.col("text_plain").alias("text"))
    return group_languages(blocks, detector)


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, fit_detector(_cases(spark, sf_dir)))


def p5_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpora(spark, sf_dir, fit_detector(_cases(spark, sf_dir)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    detector = fit_detector(_cases(spark, sf_dir))
    told = _segments(spark, sf_dir, detector).filter("rec_key IS NOT NULL")
    by_case = told.groupBy("rec_key").agg(F.collect_set("language").alias("found"), F.max("label").alias("label"))  # at most one entry a language
    wrong = by_case.filter((F.size("found") > 1) | F.col("label").isNull() | (F.col("label") != F.col("found")[0]))
    cases = wrong.select(F.lit("lang_spec_cases").alias("src"), "rec_key", F.explode("found").alias("language"))
    best = _corpora(spark, sf_dir, detector).groupBy("rec_key").agg(F.max_by("language", F.struct("n", "language")).alias("language"))
    named = table(spark, sf_dir, "test_corpora").select(F.col("name").alias("rec_key"), code_of(F.col("language")).alias("label"))
    corpora = named.join(best, "rec_key", "left").withColumn("language", F.coalesce("language", F.lit(UNKNOWN)))
    corpora = corpora.filter(F.col("label").isNull() | (F.col("label") != F.col("language"))).select(F.lit("test_corpora").alias("src"), "rec_key", "language").distinct()
    return cases.unionByName(corpora)


QUERIES = {"p5_found": p5_found, "p5_segments": p5_segments, "p5_corpora": p5_corpora}
