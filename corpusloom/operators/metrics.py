"""Text metrics of documents as a long table: doc_id, metric, value, n, denominator, unit, warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as lx
from corpusloom.functions import split
from corpusloom.functions import text as tx

#: The lists of each metric; every function takes other lists. The academic words are a sample: give the whole list as a table.
LEXICONS: dict[str, list[str]] = {
    "M-HED-14": lx.HEDGES_EN,
    "M-BOO-15": lx.BOOSTERS_EN,
    "M-CONN-30c": lx.CONTRASTIVE_EN,
    "M-CONN-30k": lx.CAUSAL_EN,
    "M-CONN-30r": lx.RESULT_EN,
    "M-AWR-03": ["analyse", "approach", "assume", "concept", "context", "data", "define", "derive", "distribute", "document", "estimate", "evidence", "factor", "formula", "function", "identify", "indicate", "interpret", "method", "percent", "principle", "process", "reject", "section", "significant", "similar", "source", "specific", "structure", "theory", "vary"],
}
MODALS = ["can", "could", "may", "might", "must", "shall", "should", "will", "would"]
BE_PRESENT, BE_PAST, BE_BARE = ["am", "are", "is"], ["was", "were"], ["be", "been", "being"]
AUXILIARIES = [*BE_PRESENT, *BE_PAST, *BE_BARE]
ADVERBS = ["also", "not", "often", "only", "then", "thus", "usually", "widely", "well", "recently", "always", "never", "still"]
IRREGULAR_PAST = ["became", "began", "came", "did", "fell", "found", "gave", "got", "grew", "had", "held", "kept", "knew", "led", "lost", "made", "met", "rose", "said", "saw", "took", "went", "wrote"]
PARTICIPLES = ["begun", "brought", "built", "chosen", "done", "drawn", "found", "given", "held", "kept", "known", "led", "lost", "made", "run", "seen", "sent", "set", "shown", "taken", "told", "written"]
NO_PARTICIPLE = ["complicated", "interested", "limited", "need", "tired", "indeed", "exceed", "proceed", "speed", "seed", "feed", "hundred", "embed"]
PRESENT = ["compares", "describes", "documents", "explains", "finds", "flags", "holds", "limits", "merges", "records", "reduces", "reports", "shows", "simplifies", "has", "does", "have", "do"]
VERBS = ["approximate", "assert", "assign", "compare", "complete", "conclude", "convert", "describe", "detect", "discuss", "document", "evaluate", "explain", "express", "improve", "measure", "move", "permit", "quote", "reduce", "relate", "simplify", "treat", "translate"]
NOMINAL_SUFFIXES = ["ation", "tion", "sion", "ion", "ment", "ance", "ence", "al"]
NO_NOMINAL = ["section", "mention", "nation", "station", "version", "question", "experiment", "document", "moment"]
LONG_SENTENCE = {"en": 40, "zh": 80}


#: A text is Chinese from this share of ideographs among ideographs and words.
CHINESE_SHARE = 0.10


def word_set(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def count_in(words: Column, entries: list[str]) -> Column:
    """Tokens that are in a list, by set look-up in generated code."""
    return F.size(F.filter(words, lambda w: w.isin(*entries))).cast("bigint")


def nominal_forms() -> list[str]:
    """Every word that is a suffix on a known verb's stem: the verb itself, or without its closing e, y or ate."""
    stems = {v[: len(v) - len(end)] for v in VERBS for end in ("", "e", "y", "ate") if v.endswith(end) and len(v) > len(end)}
    return sorted({s + suffix for s in stems for suffix in NOMINAL_SUFFIXES} - set(NO_NOMINAL))


def is_nominal(w: Column) -> Column:
    """A nominal form or its plural, by one look-up in generated code."""
    return F.regexp_replace(w, r"s$", "").isin(*nominal_forms())


def is_past(w: Column) -> Column:
    return w.isin(*BE_PAST, *IRREGULAR_PAST) | ((F.length(w) >= 4) & w.endswith("ed") & ~w.isin(*NO_PARTICIPLE))


def passive_pattern() -> str:
    """Auxiliary, up to two adverbs, participle, over padded tokens."""
    part = "(?:" + "|".join(PARTICIPLES) + "|[a-z][a-z'-]*[a-z'-]ed)"
    return " (?:" + "|".join(AUXILIARIES) + ") (?: (?:" + "|".join(ADVERBS) + ") ){0,2} " + part + " "


def token_metrics(docs: DataFrame) -> DataFrame:
    """One row a document (doc_id) with n_tokens, n_types, n_units, n_digits, language and the counts of every token metric.

    ``docs`` needs doc_id and text; a null text counts as missing and has null counts. No shuffle, no Python.
    """
    words = tx.tokens(F.col("text"))
    base = docs.select("doc_id", "text", words.alias("w"))
    plain = F.transform(F.col("w"), lambda x: x)
    return base.select(
        "doc_id",
        F.size(F.col("w")).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_types"),
        tx.cjk_units(F.col("text")).alias("n_units"),
        tx.n_digits(F.col("text")).alias("n_digits"),
        tx.language(F.col("text")).alias("language"),
        *[tx.n_phrases(plain, entries).alias(name.replace("-", "_")) for name, entries in LEXICONS.items()],
        count_in(F.col("w"), [*PRESENT, *BE_PRESENT]).alias("n_present"),
        F.size(F.filter("w", is_past)).cast("bigint").alias("n_past"),
        count_in(F.col("w"), [*MODALS, *BE_BARE]).alias("n_unresolved"),
        F.size(F.filter("w", is_nominal)).cast("bigint").alias("n_nominal"),
    )


def sentence_table(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no, text, n_tokens, n_units, n_clauses, passive: one row a sentence; everything after the split is built in."""
    parts = docs.select("doc_id", F.explode(split.sentences_udf()(F.col("text"))).alias("s"))
    s = F.col("s.text")
    return parts.select(
        "doc_id",
        F.col("s.no").alias("sent_no"),
        s.alias("text"),
        tx.n_tokens(s).alias("n_tokens"),
        tx.cjk_units(s).alias("n_units"),
        F.col("s.n_clauses").cast("bigint").alias("n_clauses"),
        tx.padded(tx.tokens(s)).rlike(passive_pattern()).alias("passive"),
    )


def sentence_metrics(sentences: DataFrame) -> DataFrame:
    """doc_id, n_sentences, mean_len, sd_len, long_share, passive_share, clauses_per_sentence, p90_len, p95_len (Q1).

    The unit is the document's: units (ideographs and words) where it is Chinese by its own text, words elsewhere.
    """
    units, words = F.sum(F.col("n_units") - F.col("n_tokens")).over(Window.partitionBy("doc_id")), F.sum("n_tokens").over(Window.partitionBy("doc_id"))
    zh = units > CHINESE_SHARE * (units + words)
    sized = sentences.withColumn("zh", zh).withColumn("size", F.when(F.col("zh"), F.col("n_units")).otherwise(F.col("n_tokens")))
    size = F.col("size")
    share = lambda c: F.avg(c.cast("double"))
    return sized.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"),
        F.avg(size.cast("double")).alias("mean_len"),
        F.stddev_pop(size.cast("double")).alias("sd_len"),
        share(size >= F.when(F.col("zh"), LONG_SENTENCE["zh"]).otherwise(LONG_SENTENCE["en"])).alias("long_share"),
        share(F.col("passive")).alias("passive_share"),
        F.avg(F.col("n_clauses").cast("double")).alias("clauses_per_sentence"),
        share(F.col("n_clauses") > 1).alias("multi_clause_share"),
        F.percentile(size, F.lit(0.90)).alias("p90_len"),
        F.percentile(size, F.lit(0.95)).alias("p95_len"),
    )


def long_metrics(counts: DataFrame) -> DataFrame:
    """The long table of the rates in ``token_metrics``: doc_id, metric, value, n, denominator, unit, n_tokens, warning.

    A text without tokens has null values and the warning EMPTY_TEXT; one that isn't English has LANGUAGE_NOT_SUPPORTED.
    The connector total is the sum of the three rounded components.
    """
    per, ratio = "per_1000_tokens", "ratio"
    rate = lambda n, scale: F.round(F.try_divide(F.col(n) * F.lit(scale), F.col("n_tokens").cast("double")), 6)
    conn = ["M_CONN_30c", "M_CONN_30k", "M_CONN_30r"]
    total = rate(conn[0], 1000) + rate(conn[1], 1000) + rate(conn[2], 1000)
    tense = F.col("n_present") + F.col("n_past")
    rows = [
        *[("M-" + n[2:].replace("_", "-"), rate(n, 1), n, "n_tokens", ratio) for n in ("M_HED_14", "M_BOO_15", "M_AWR_03")],
        *[("M-" + n[2:].replace("_", "-"), rate(n, 1000), n, "n_tokens", per) for n in conn],
        ("M-CONN-30", F.round(total, 6), None, "n_tokens", per),
        ("M-NOM-10", rate("n_nominal", 1), "n_nominal", "n_tokens", ratio),
        ("M-TENSE-28", F.round(F.try_divide(F.col("n_present").cast("double"), tense.cast("double")), 6), "n_present", None, ratio),
    ]
    ok = F.col("language") == "en"
    count = F.col(conn[0]) + F.col(conn[1]) + F.col(conn[2])
    structs = [
        F.struct(F.lit(name).alias("metric"), F.when(ok, value).alias("value"), (F.col(n) if n else count).alias("n"), (F.col(d) if d else tense).alias("denominator"), F.lit(unit).alias("unit"))
        for name, value, n, d, unit in rows
    ]
    warning = F.when(F.coalesce("n_tokens", F.lit(0)) == 0, "EMPTY_TEXT").when(~ok, "LANGUAGE_NOT_SUPPORTED").otherwise("")
    out = counts.select("doc_id", "n_tokens", warning.alias("warning"), F.explode(F.array(*structs)).alias("m"))
    return out.select("doc_id", "m.metric", "m.value", "m.n", "m.denominator", "m.unit", "n_tokens", "warning")
