"""Scalar text functions as column expressions: they stay in the JVM and in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges of CJK ideographs, as both engines' regexes write them.
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
WORD = r"[A-Za-z][A-Za-z'-]*"
#: Share of ideographs above which a text is Chinese.
CJK_SHARE = 0.10
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of a text; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lower)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def n_cjk(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK)).cast("bigint")


def cjk_units(text: Column) -> Column:
    """Ideographs and ASCII words: the unit in which Chinese texts are measured."""
    return n_cjk(text) + n_tokens(text)


def n_digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[0-9{FULL_DIGITS}]")).cast("bigint")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, FULL_DIGITS, DIGITS)


def language(text: Column) -> Column:
    """zh, en or unknown by the share of ideographs; null where there's no text."""
    cjk, words = n_cjk(text), n_tokens(text)
    return F.when(text.isNull(), None).when(cjk > CJK_SHARE * (cjk + words), "zh").when(words > 0, "en").otherwise("unknown")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_to_text(html: Column) -> Column:
    """Text of an HTML fragment: comments and tags become blanks, the six named entities are decoded, blanks squeezed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return squeeze(out)


def latex_to_text(latex: Column) -> Column:
    """LaTeX without commands and scaffolding."""
    return squeeze(F.regexp_replace(F.regexp_replace(latex, r"\\[A-Za-z]+\*?", " "), r"[$\{\}\\]", " "))


def normal_title(title: Column) -> Column:
    """A section title without numbering and closing marks, in lower case."""
    out = F.regexp_replace(F.trim(title), r"^(?:(?:\d+(?:\.\d+)*|[IVXivx]+|[A-Z])[.、)]?\s+)", "")
    return F.lower(F.trim(F.regexp_replace(out, r"[\s.:：。]+$", "")))


def slug(text: Column) -> Column:
    """Lower-case letters and digits of any script joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def normal_url(url: Column, keep_query: bool = False) -> Column:
    """Scheme and host in lower case without www., closing slash and fragment; the query goes too unless it's kept."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    if not keep_query:
        bare = F.regexp_replace(bare, r"\?.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    tail = F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), r"/+$", "")
    return F.concat(F.regexp_replace(head, r"://www\.", "://"), tail)


def host(url: Column) -> Column:
    return F.regexp_extract(normal_url(url), r"://([^/?:]+)", 1)


def inverted_to_text(index: Column, max_words: int = 1500) -> Column:
    """The text that a map word -> positions stands for, up to ``max_words`` words."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.slice(F.transform(F.array_sort(pairs), lambda s: s["w"]), 1, max_words), " ")


def expand_range(expr: Column, most: int = 50) -> Column:
    """The numbers of "13" or "13-15"; a range that falls or is longer than ``most`` gives its ends only."""
    a = F.regexp_extract(expr, r"^\s*0*(\d+)", 1).try_cast("int")
    b = F.regexp_extract(expr, r"[-–—~]\s*0*(\d+)\s*$", 1).try_cast("int")
    whole = b.isNotNull() & (b >= a) & (b - a < most)
    return F.when(a.isNull(), F.array().cast("array<int>")).when(b.isNull(), F.array(a)).when(whole, F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))


def cited_numbers(text: Column, most: int = 50) -> Column:
    """Distinct numbers of bracketed citations such as [3], [1, 4] and [2-5] in ascending order; [0, 1] is an interval."""
    groups = F.regexp_extract_all(text, F.lit(r"\[((?:\d{1,4}\s*(?:[-–,，]\s*)?)+)\]"), F.lit(1))
    wanted = F.filter(groups, lambda g: ~g.rlike(r"^\s*0\s*[,，]"))
    parts = F.flatten(F.transform(wanted, lambda g: F.split(g, r"\s*[,，]\s*")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda p: p.rlike(r"\d")), lambda p: expand_range(p, most)))))


def first_year(entry: Column) -> Column:
    """The first year from 1900 to 2099 of a reference entry."""
    return F.regexp_extract(entry, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[a-z]?(?:[^0-9]|$))", 1).try_cast("int")


def semver(version: Column) -> Column:
    """struct(major, minor, patch) that orders as versions do; missing parts are 0, no version is null."""
    bare = F.regexp_extract(version, r"(\d+(?:\.\d+){0,2})", 1)
    parts = F.split(bare, r"\.")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(F.length(bare) > 0, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def has_word(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def padded(words: Column) -> Column:
    """Tokens with a blank on either side each, so that neighbouring phrases don't share one."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def phrase_pattern(entries: list[str]) -> str:
    """Alternation of phrases, longest first, over ``padded`` tokens."""
    ordered = sorted({" ".join(e.lower().split()) for e in entries if e.strip()}, key=lambda e: (-len(e.split()), -len(e), e))
    escape = lambda e: "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in e)
    return " (" + "|".join(escape("  ".join(e.split(" "))) for e in ordered) + ") "


def n_phrases(words: Column, entries: list[str]) -> Column:
    """Longest-first, non-overlapping hits of the entries in a token array."""
    return F.regexp_count(padded(words), F.lit(phrase_pattern(entries))).cast("bigint") if entries else F.lit(0).cast("bigint")


def phrase_hits(words: Column, entries: list[str]) -> Column:
    return F.transform(F.regexp_extract_all(padded(words), F.lit(phrase_pattern(entries)), F.lit(1)), lambda e: F.regexp_replace(e, "  ", " "))


def mtld(words: Column, threshold: float = 0.720, least: int = 20) -> Column:
    """Bidirectional MTLD of a token array; null under ``least`` tokens.

    One fold a direction: the seen words since the last factor, their tokens, and the factors so far.
    """

    def one_way(ws: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"), F.lit(0.0).alias("factors"))

        def step(acc: Column, w: Column) -> Column:
            seen = F.array_union(acc["seen"], F.array(w))
            n = acc["n"] + 1
            full = F.size(seen) / n <= threshold
            return F.struct(
                F.when(full, F.array().cast("array<string>")).otherwise(seen).alias("seen"),
                F.when(full, 0).otherwise(n).alias("n"),
                F.when(full, acc["factors"] + 1.0).otherwise(acc["factors"]).alias("factors"),
            )

        def finish(acc: Column) -> Column:
            rest = F.when(acc["n"] > 0, (1 - F.size(acc["seen"]) / acc["n"]) / (1 - threshold)).otherwise(0.0)
            factors = acc["factors"] + rest
            return F.when(factors > 0, F.size(ws) / factors)

        return F.aggregate(ws, start, step, finish)

    both = (one_way(words) + one_way(F.reverse(words))) / 2
    return F.when(F.size(words) >= least, both)
