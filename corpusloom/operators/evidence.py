"""Evidence of metrics, recurring terms, references and identifiers of documents."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Rows of evidence kept a document and metric: a sample that is the feature, in document order.
SAMPLES = 5


def phrase_evidence(docs: DataFrame, metric: str, entries: list[str], samples: int = SAMPLES) -> DataFrame:
    """doc_id, metric, ord, span_start, span_end, excerpt: the first hits of a lexicon with offsets in code points.

    The offsets come from the text before the hit, so they count code points whatever the regex engine counts.
    """
    pattern = r"(?i)(?<![A-Za-z'-])(?:" + "|".join(sorted({r"\s+".join(e.split()) for e in entries}, key=lambda e: (-len(e), e))) + r")(?![A-Za-z'-])"
    marked = F.regexp_replace("text", f"({pattern})", "\x01$1\x02")
    parts = docs.filter("text IS NOT NULL").select("doc_id", F.slice(F.split(marked, "\x01"), 1, samples + 1).alias("p"))
    cut = parts.select("doc_id", F.posexplode(F.transform("p", lambda x: F.regexp_replace(x, "\x02", ""))).alias("i", "piece"), "p")
    start = F.length(F.array_join(F.transform(F.slice("p", 1, F.col("i")), lambda x: F.regexp_replace(x, "\x02", "")), ""))
    hit = F.regexp_extract(F.element_at("p", F.col("i") + 1), "^([^\x02]*)\x02", 1)
    return cut.filter("i > 0").select("doc_id", F.lit(metric).alias("metric"), F.col("i").alias("ord"), start.alias("span_start"), (start + F.length(hit)).alias("span_end"), hit.alias("excerpt"))


def traced(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """metric, n, rate: the share of spans that give their excerpt when sliced from the text."""
    joined = evidence.join(docs.select("doc_id", "text"), "doc_id")
    same = F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("excerpt")
    return joined.groupBy("metric").agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("rate"))


def recurring_terms(text: str | None, least: int = 2, shortest: int = 2, longest: int = 8) -> list[tuple[str, int]]:
    """Runs of ideographs that recur and aren't part of a longer run that recurs as often, with their counts."""
    if not text:
        return []
    counts: Counter = Counter()
    for run in re.findall("[㐀-䶿一-鿿豈-﫿]+", text):
        for n in range(shortest, min(longest, len(run)) + 1):
            counts.update(run[i : i + n] for i in range(len(run) - n + 1))
    often = {g: n for g, n in counts.items() if n >= least}
    inner = {g[i : i + n] for g in often for n in range(shortest, len(g)) for i in range(len(g) - n + 1)}
    return sorted((g, n) for g, n in often.items() if g not in inner)


TERMS = "doc_id bigint, n_terms int, n_clusters int, n_variants int, n_uses bigint, variant_share double"


def term_clusters(docs: DataFrame) -> DataFrame:
    """Terms of each document clustered by their first two characters: how many, how many in clusters of several, their share
    of all uses of recurring terms (null where there's none). One narrow map."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                terms = recurring_terms(text)
                groups: dict[str, list[tuple[str, int]]] = {}
                for g, n in terms:
                    groups.setdefault(g[:2], []).append((g, n))
                several = [ts for ts in groups.values() if len(ts) > 1]
                total, inside = sum(n for _, n in terms), sum(n for ts in several for _, n in ts)
                rows.append((doc, len(terms), len(several), sum(map(len, several)), total, round(inside / total, 6) if total else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_terms", "n_clusters", "n_variants", "n_uses", "variant_share"])

    return docs.select("doc_id", "text").mapInPandas(run, TERMS)


def is_reference(text: Column) -> Column:
    """Whether a line reads like an entry of a reference list: numbered or author first, with a year or an identifier."""
    year, mark = text.rlike(r"(?:19|20)\d{2}"), text.rlike(r"(?i)doi:|https?://|arxiv|vol\.|pp\.|\[[JMCD]\]")
    return text.rlike(r"^\s*\[\d{1,4}\]\s*\S") & (year | mark) | text.rlike(r"^\s*[A-Z][\w'-]+,\s+(?:[A-Z]\.\s*)+") & year | mark & year


def split_references(text: Column) -> Column:
    """Entries of a reference list: by line, and before every packed "[n]"."""
    return F.filter(F.transform(F.split(text, r"\n+|(?=\[\d{1,4}\]\s)"), lambda x: F.trim(x)), lambda x: x != "")


def reference_links(cited: DataFrame, listed: DataFrame) -> DataFrame:
    """doc_id, n_cited, n_listed, dangling, uncited, jaccard of cited numbers (array) and the length of the list (1..N)."""
    both = cited.select("doc_id", "numbers").join(listed.select("doc_id", "n_entries"), "doc_id", "full_outer")
    have = F.when(F.col("n_entries") >= 1, F.sequence(F.lit(1), F.greatest(F.col("n_entries"), F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    c = F.coalesce("numbers", F.array().cast("array<int>"))
    union = F.size(F.array_union(c, have))
    return both.select(
        "doc_id", F.size(c).cast("bigint").alias("n_cited"), F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_listed"), F.size(F.array_except(c, have)).cast("bigint").alias("dangling"),
        F.size(F.array_except(have, c)).cast("bigint").alias("uncited"), F.when(union > 0, F.round(F.size(F.array_intersect(c, have)) / union, 6)).alias("jaccard"),
    )


def unique_slugs(names: DataFrame, name: str) -> DataFrame:
    """name, slug: names that share a stem get the first six digits of their hash."""
    stem = tx.slug(F.col(name))
    rows = names.select(name).distinct().withColumn("stem", stem)
    shared = F.count("*").over(Window.partitionBy("stem")) > 1
    return rows.select(name, F.when(shared, F.concat("stem", F.lit("-"), F.substring(F.sha2(name, 256), 1, 6))).otherwise(F.col("stem")).alias("slug"))


def figure_id(stem: Column, page: Column, block: Column) -> Column:
    return F.concat_ws("-", F.lit("fig"), stem, page, block)


#: Chinese numerals.
NUMERALS = dict(zip("零一二三四五六七八九", range(10), strict=True)) | {"两": 2, "〇": 0}
UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_number(text: str | None) -> int | None:
    """The value of a Chinese numeral below a hundred million, of digits read one by one, or of plain digits; None for others."""
    if not text:
        return None
    if text.isdigit() and text.isascii():
        return int(text)
    if all(ch in NUMERALS for ch in text):
        return int("".join(str(NUMERALS[ch]) for ch in text))
    if "万" in text:
        head, _, tail = text.partition("万")
        a, b = chinese_number(head), chinese_number(tail) if tail else 0
        return None if a is None or b is None else a * 10_000 + b
    total, digit = 0, None
    for ch in text:
        if ch in NUMERALS:
            digit = NUMERALS[ch]
        elif ch in UNITS:
            total += (1 if digit is None else digit) * UNITS[ch]
            digit = None
        else:
            return None
    return total + (digit or 0)


def markdown_to_text(text: Column) -> Column:
    """Markdown without code, images, links' targets, heading and emphasis marks and table pipes."""
    out = F.regexp_replace(text, r"(?s)```.*?```|~~~.*?~~~", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", "")
    return tx.squeeze(F.regexp_replace(out, r"[*_`|]+", " "))


def compact_latex(text: Column) -> Column:
    """Letters spaced out within braces drawn together, blanks at braces dropped."""
    out = F.regexp_replace(text, r"(?<=[{ ][A-Za-z]) (?=[A-Za-z](?:[ }]))", "")
    return F.regexp_replace(F.regexp_replace(out, r"\{\s+", "{"), r"\s+\}", "}")


def heading_tree(heads: DataFrame) -> DataFrame:
    """doc_id, pos, level, parent_pos: a heading's parent is the nearest one before it of a smaller level.

    Per level the last position so far is carried by a window, so a document is passed once and no pairs are made.
    """
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(order) for k in range(1, 7)]
    with_all = heads.select("doc_id", "pos", "level", *[c.alias(f"l{k}") for k, c in enumerate(latest, 1)])
    parent = F.array_max(F.filter(F.array(*[F.when(F.col("level") > k, F.col(f"l{k}")) for k in range(1, 7)]), lambda x: x.isNotNull()))
    return with_all.select("doc_id", "pos", "level", parent.alias("parent_pos"))


def clause_sentences(clauses: DataFrame, sentences: DataFrame) -> DataFrame:
    """Clauses (key, c_start) with the number of the sentence (key, no, s_start, s_end) that holds their start.

    An interval look-up as one window: starts of both kinds in order, the last sentence carried forward, and its end checked.
    """
    s = sentences.select("key", F.col("s_start").alias("at"), F.lit(0).alias("kind"), "no", F.col("s_end").alias("end"))
    c = clauses.select("key", F.col("c_start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("no"), F.lit(None).cast("int").alias("end"))
    order = Window.partitionBy("key").orderBy("at", "kind")
    both = s.unionByName(c).withColumn("ln", F.last("no", ignorenulls=True).over(order)).withColumn("le", F.last("end", ignorenulls=True).over(order))
    return both.filter("kind = 1").select("key", F.col("at").alias("c_start"), F.when(F.col("at") < F.col("le"), F.col("ln")).alias("sentence_no"))


def natural_key(key: Column) -> Column:
    """A sort key: numbers first and by value, then letters."""
    n = key.try_cast("int")
    return F.struct(n.isNull().alias("text"), F.coalesce(n, F.lit(0)).alias("n"), F.upper(key).alias("s"))
