"""Chinese metrics over units (ideographs and words): literal phrases, exclusive groups, token stream, opening connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as lx
from corpusloom.functions import text as tx

STREAM = f"{tx.CJK}|{tx.WORD}"
GROUPS = {"contrastive": "M-CONN-30c", "causal": "M-CONN-30k", "result": "M-CONN-30r", "temporal": "M-CONN-30t", "condition": "M-CONN-30q"}


def literal_pattern(entries: list[str]) -> str:
    """Alternation of literal entries, longest first, so that a longer entry wins where it begins."""
    escape = lambda e: "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in e)
    return "(" + "|".join(escape(e) for e in sorted(set(entries), key=lambda e: (-len(e), e))) + ")"


def n_literal(text: Column, entries: list[str]) -> Column:
    """Literal, non-overlapping hits; entries hold no stop, so none crosses a sentence."""
    return F.regexp_count(text, F.lit(literal_pattern(entries))).cast("bigint")


def grouped_hits(text: Column, groups: dict[str, list[str]]) -> dict[str, Column]:
    """group -> hits in one pass over all groups: every hit belongs to one group, the longest entry's."""
    hits = F.regexp_extract_all(text, F.lit(literal_pattern([e for entries in groups.values() for e in entries])), F.lit(1))

    def own(entries: list[str]) -> Column:
        return F.size(F.filter(hits, lambda h: h.isin(*entries))).cast("bigint")

    return {g: own(entries) for g, entries in groups.items()}


def token_stream(text: Column) -> Column:
    """Ideographs and lower-case words in the order of the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({STREAM})"), F.lit(1)), F.lower)


def chinese_rates(docs: DataFrame) -> DataFrame:
    """doc_id, n_units and, for 1000 units, hedges, boosters and the connectors by group with their total.

    Chinese documents only; without units the rates are null. Null texts have no row.
    """
    zh = docs.filter(tx.language(F.col("text")) == "zh")
    groups = grouped_hits(F.col("text"), lx.CONNECTORS_ZH)
    counted = zh.select("doc_id", tx.cjk_units(F.col("text")).alias("n_units"), n_literal(F.col("text"), lx.HEDGES_ZH).alias("hedges"), n_literal(F.col("text"), lx.BOOSTERS_ZH).alias("boosters"), *[c.alias(g) for g, c in groups.items()])
    rate = lambda c: F.round(F.try_divide(F.col(c) * F.lit(1000.0), F.col("n_units").cast("double")), 6)
    total = rate("contrastive") + rate("causal") + rate("result")
    return counted.select("doc_id", "n_units", rate("hedges").alias("m_hed_14"), rate("boosters").alias("m_boo_15"), *[rate(g).alias(m.lower().replace("-", "_")) for g, m in GROUPS.items()], F.round(total, 6).alias("m_conn_30"))


def opening_share(sentences: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """doc_id, n_sentences, n_open, value: the share of sentences that open with a connector."""
    opens = F.col("text").rlike("^" + literal_pattern([e for entries in groups.values() for e in entries]))
    per = sentences.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(opens.cast("bigint")).alias("n_open"))
    return per.withColumn("value", F.round(F.try_divide(F.col("n_open").cast("double"), F.col("n_sentences").cast("double")), 6))


def spans(texts: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, tok_no, token, span_start, span_end: matches with their offsets, from the gaps between them.

    The lengths before a token are summed by a window over its text, so long texts need no nested loops.
    """
    from pyspark.sql import Window

    parts = texts.select(key, F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("token")).alias("z"))
    rows = parts.select(key, F.posexplode("z").alias("tok_no", "z")).select(key, "tok_no", F.length("z.gap").alias("g"), F.length("z.token").alias("n"), F.col("z.token").alias("token"))
    before = Window.partitionBy(key).orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("g") + F.coalesce("n", F.lit(0))).over(before)
    return rows.withColumn("span_end", end.cast("bigint")).filter("token IS NOT NULL").select(key, "tok_no", F.lower("token").alias("token"), (F.col("span_end") - F.col("n")).cast("bigint").alias("span_start"), "span_end")
