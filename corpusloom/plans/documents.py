"""Queries of the text and document-metric operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import split, stats
from corpusloom.functions import text as tx
from corpusloom.operators import corpus, metrics
from corpusloom.session import table, texts

W = "[A-Za-z][A-Za-z''-]*"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "section")


def sql_count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, '{pattern}'))"


def sql_padded() -> str:
    return f"' ' || array_to_string(list_transform(regexp_extract_all(text, '{W}'), lambda x: lower(x)), '  ') || ' '"


def sql_phrases(entries: list[str]) -> str:
    pattern = tx.phrase_pattern(entries).replace("'", "''")
    return f"len(regexp_extract_all(padded, '{pattern}'))"


def sql_in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    t = F.col("text")
    return d.select("doc_id", tx.n_tokens(t).alias("n_tokens"), F.size(F.array_distinct(tx.tokens(t))).cast("bigint").alias("n_types"), tx.n_cjk(t).alias("n_cjk"), tx.cjk_units(t).alias("n_units"), tx.n_digits(t).alias("n_digits"))


def language_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(tx.language(F.col("text")).alias("rule_language")).agg(F.count("*").alias("n_docs"), F.count("lang").alias("n_labelled"))


def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", *[tx.n_phrases(words, e).alias(n.lower().replace("-", "_")) for n, e in metrics.LEXICONS.items()])


def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_metrics(_docs(spark, sf_dir)).select("doc_id", "n_present", "n_past", "n_unresolved", "n_nominal")


def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.long_metrics(metrics.token_metrics(_docs(spark, sf_dir)))


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.summary(doc_metrics(spark, sf_dir), ["metric"])


def corpus_summary_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = doc_metrics(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return corpus.summary(long, ["metric", "source"])


def length_confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.length_confounds(doc_metrics(spark, sf_dir))
    return found.select("metric", "n", F.round("rho", 6).alias("rho"), "confounded")


def target_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.contract(corpus_summary(spark, sf_dir), derived={"M-CONN-30": ["M-CONN-30c", "M-CONN-30k", "M-CONN-30r"]})


def band_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draft of thesis_draft against bands from the other sources: hold-out, contract and validation in one plan."""
    long = doc_metrics(spark, sf_dir)
    sources = _docs(spark, sf_dir).select("doc_id", "source")
    known = long.join(sources.filter("source <> 'thesis_draft'"), "doc_id", "left_semi")
    drafts = long.join(sources.filter("source = 'thesis_draft'"), "doc_id", "left_semi").select(F.col("doc_id").alias("draft_id"), "metric", "value")
    return corpus.validate(corpus.contract(corpus.summary(known, ["metric"])), drafts)


def draft_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.verdicts(band_validation(spark, sf_dir))


def mtld_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(split.mtld_udf()(F.col("text")), 6).alias("mtld"))


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sentence_table(_docs(spark, sf_dir))


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its words and units."""
    return sentence_rows(spark, sf_dir).select("doc_id", "sent_no", "text", "n_tokens", "n_units")


def sentence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sentence_metrics(sentence_rows(spark, sf_dir))


def sentence_length_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean words a sentence and share of long sentences, as means of documents' values, by language."""
    per = metrics.sentence_metrics(sentence_rows(spark, sf_dir)).join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return per.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg("mean_len"), 6).alias("mean_len"), F.round(F.avg("long_share"), 6).alias("long_share"))


def section_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and strata of the hedge rate in one pass, with a grouping set a level."""
    long = doc_metrics(spark, sf_dir).filter("metric = 'M-HED-14'").join(_docs(spark, sf_dir).select("doc_id", "section"), "doc_id")
    named = long.withColumn("section", F.coalesce("section", F.lit("none")))
    return named.groupingSets([["metric"], ["metric", "section"]], "metric", "section").agg(F.count("value").alias("n_valid"), F.round(F.avg("value"), 6).alias("mean"))


def abstract_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of each metric's mean in abstracts to that in the other sections; null where the latter is 0."""
    long = doc_metrics(spark, sf_dir).join(_docs(spark, sf_dir).filter("section IS NOT NULL").select("doc_id", "section"), "doc_id")
    inside = F.col("section") == "abstract"
    means = long.groupBy("metric").agg(F.avg(F.when(inside, F.col("value"))).alias("a"), F.avg(F.when(~inside, F.col("value"))).alias("b"))
    return means.select("metric", F.round("a", 6).alias("abstract_mean"), F.round("b", 6).alias("body_mean"), F.round(F.when(F.col("b") != 0, F.col("a") / F.col("b")), 6).alias("ratio"))


def lexicon_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its hits and documents; entries that never fired have 0."""
    words = tx.tokens(F.col("text"))
    named = lambda n: lambda x: F.struct(F.lit(n).alias("lexicon"), x.alias("entry"))
    hits = [F.transform(tx.phrase_hits(words, e), named(n)) for n, e in metrics.LEXICONS.items()]
    found = _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.explode(F.concat(*hits)).alias("h"))
    all_hits = found.select("doc_id", "h.lexicon", "h.entry")
    used = all_hits.groupBy("lexicon", "entry").agg(F.count("*").alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"))
    entries = spark.createDataFrame([(n, e) for n, es in metrics.LEXICONS.items() for e in sorted(set(es))], "lexicon string, entry string")
    return entries.join(used, ["lexicon", "entry"], "left").na.fill(0, ["n_hits", "n_docs"])


def cjk_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent runs of 2 to 4 ideographs that no connector list has."""
    runs = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(f"({tx.CJK}+)"), F.lit(1))).alias("run"))
    grams = runs.select(F.explode(F.flatten(F.array(*[F.expr(f"CASE WHEN length(run) >= {n} THEN transform(sequence(1, length(run) - {n - 1}), i -> substring(run, i, {n})) ELSE array() END") for n in (2, 3, 4)]))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count("*").alias("n"))
    known = table(spark, sf_dir, "connectors").select(F.explode(F.flatten(F.map_values("groups"))).alias("gram")).distinct()
    return counted.join(known, "gram", "left_anti").orderBy(F.col("n").desc(), "gram").limit(20)


def citation_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numeric, author_year, mixed or none by the share of bracketed numbers among all citations of a text."""
    t = F.coalesce("text", F.lit(""))
    numeric, author = F.regexp_count(t, F.lit(r"\[\d{1,4}(?:\s*[,-]\s*\d{1,4})*\]")), F.regexp_count(t, F.lit(r"\([A-Z][A-Za-z-]+(?: et al\.)?,? (?:19|20)\d\d[a-z]?\)|[A-Z][A-Za-z-]+(?: et al\.)? \((?:19|20)\d\d[a-z]?\)"))
    share = F.try_divide(numeric.cast("double"), (numeric + author).cast("double"))
    style = F.when(share.isNull(), "none").when(share >= 0.85, "numeric").when(share <= 0.15, "author_year").otherwise("mixed")
    d = _docs(spark, sf_dir).select(numeric.cast("bigint").alias("n_numeric"), author.cast("bigint").alias("n_author"), style.alias("style"))
    return d.groupBy("style").agg(F.count("*").alias("n_docs"), F.sum("n_numeric").alias("n_numeric"), F.sum("n_author").alias("n_author"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = tx.cited_numbers(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.size(cited).cast("bigint").alias("n_cited"), F.array_max(cited).cast("bigint").alias("largest"))


def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.length(tx.html_to_text(t)).cast("bigint").alias("html_len"), F.length(tx.latex_to_text(t)).cast("bigint").alias("latex_len"), F.md5(tx.html_to_text(t)).alias("html_md5"))


def paragraph_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of at least 15 words (40 units in Chinese) by draft: count, mean and half-even quartiles."""
    p = table(spark, sf_dir, "paragraphs").select("draft_key", "para_id", "text").distinct()
    zh = tx.language(F.col("text")) == "zh"
    size = F.when(zh, tx.cjk_units(F.col("text"))).otherwise(tx.n_tokens(F.col("text")))
    kept = p.select("draft_key", size.alias("size"), zh.alias("zh")).filter(F.col("size") >= F.when(F.col("zh"), 40).otherwise(15))
    q = stats.ranked_quantiles(kept, ["draft_key"], "size", corpus.QUARTILES)
    return kept.groupBy("draft_key").agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean")).join(q, "draft_key")


def stance_of_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred stance by source: a sentence with more distinct boosters than hedges is boosting, fewer hedging, else assertive."""
    s = sentence_rows(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    boost = F.size(F.array_distinct(tx.phrase_hits(F.col("w"), metrics.LEXICONS["M-BOO-15"])))
    hedge = F.size(F.array_distinct(tx.phrase_hits(F.col("w"), metrics.LEXICONS["M-HED-14"])))
    stance = F.when(boost > hedge, "boosting").when(hedge > boost, "hedging").otherwise("assertive")
    return s.select("doc_id", stance.alias("stance")).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source", "stance").agg(F.count("*").alias("n_sentences"))


def chinese_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese documents: sentences, clauses a sentence, units a clause, separators a sentence, passive and abstract-noun marks."""
    docs = _docs(spark, sf_dir).filter(tx.language(F.col("text")) == "zh")
    s = metrics.sentence_table(docs)
    marks = F.regexp_count("text", F.lit("[，；：,;:]")).cast("bigint")
    passive = F.regexp_count("text", F.lit(f"(?:受到|得到|加以|予以|被)(?={tx.CJK})")).cast("bigint")
    nouns = F.regexp_count("text", F.lit(f"(?<={tx.CJK})[性度率]")).cast("bigint")
    per = s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("n_clauses").alias("n_clauses"), F.sum("n_units").alias("n_units"), F.sum(marks).alias("n_marks"), F.sum(passive).alias("n_passive"), F.sum(nouns).alias("n_abstract"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return per.select("doc_id", "n_sentences", "n_clauses", ratio("n_clauses", "n_sentences").alias("clauses_per_sentence"), ratio("n_units", "n_clauses").alias("units_per_clause"), ratio("n_marks", "n_sentences").alias("marks_per_sentence"), ratio("n_passive", "n_sentences").alias("passive_per_sentence"), F.round(F.try_divide(F.col("n_abstract") * F.lit(1000.0), F.col("n_units").cast("double")), 6).alias("abstract_per_1000"))


QUERIES = {
    f.__name__: f
    for f in (token_counts, language_rule, phrase_counts, token_metrics, doc_metrics, corpus_summary, corpus_summary_by_source, length_confounds, target_bands, band_validation, draft_outcomes, mtld_by_doc,
              sentence_rows, sentence_spans, sentence_metrics, sentence_length_by_lang, section_strata, abstract_divergence, lexicon_usage, cjk_ngrams, citation_style, citations, text_cleaning, paragraph_length, stance_of_sentences, chinese_clauses)
}

M = metrics
_BASE = f"""b AS (SELECT doc_id, section, source, text, {sql_count('text', W)} AS n_tokens, {sql_count('text', CJK)} AS n_cjk, {sql_padded()} AS padded,
  list_transform(regexp_extract_all(text, '{W}'), lambda x: lower(x)) AS w FROM documents)"""
_NOMINAL = " OR ".join(
    f"(regexp_matches(base, '{s}$') AND length(base) > {len(s)} AND (" + " OR ".join(f"regexp_replace(base, '{s}$', '') || '{e}' IN {sql_in(M.VERBS)}" for e in ("", "e", "y", "ate")) + "))" for s in M.NOMINAL_SUFFIXES
)
_COUNTS = f"""c AS (SELECT doc_id, section, source, n_tokens,
  CASE WHEN text IS NULL THEN NULL WHEN n_cjk > 0.10 * (n_cjk + n_tokens) THEN 'zh' WHEN n_tokens > 0 THEN 'en' ELSE 'unknown' END AS language,
  {", ".join(f"{sql_phrases(e)} AS {n.replace('-', '_')}" for n, e in M.LEXICONS.items())},
  len(list_filter(w, lambda x: x IN {sql_in([*M.PRESENT, *M.BE_PRESENT])})) AS n_present,
  len(list_filter(w, lambda x: x IN {sql_in([*M.BE_PAST, *M.IRREGULAR_PAST])} OR (length(x) >= 4 AND x LIKE '%ed' AND x NOT IN {sql_in(M.NO_PARTICIPLE)}))) AS n_past,
  len(list_filter(w, lambda x: x IN {sql_in([*M.MODALS, *M.BE_BARE])})) AS n_unresolved,
  len(list_filter(list_transform(w, lambda x: regexp_replace(x, 's$', '')), lambda base: ({_NOMINAL}) AND base NOT IN {sql_in(M.NO_NOMINAL)})) AS n_nominal FROM b)"""


def _rate(n: str, scale: int) -> str:
    return f"round(CASE WHEN n_tokens > 0 THEN CAST({n} * {scale} AS DOUBLE) / n_tokens END, 6)"


def _long_sql() -> str:
    conn = ["M_CONN_30c", "M_CONN_30k", "M_CONN_30r"]
    total, count = " + ".join(_rate(n, 1000) for n in conn), " + ".join(conn)
    rows = [("M-HED-14", _rate("M_HED_14", 1), "M_HED_14", "n_tokens", "ratio"), ("M-BOO-15", _rate("M_BOO_15", 1), "M_BOO_15", "n_tokens", "ratio"), ("M-AWR-03", _rate("M_AWR_03", 1), "M_AWR_03", "n_tokens", "ratio"),
            *[("M-" + n[2:].replace("_", "-"), _rate(n, 1000), n, "n_tokens", "per_1000_tokens") for n in conn],
            ("M-CONN-30", f"round({total}, 6)", count, "n_tokens", "per_1000_tokens"), ("M-NOM-10", _rate("n_nominal", 1), "n_nominal", "n_tokens", "ratio"),
            ("M-TENSE-28", "round(CASE WHEN n_present + n_past > 0 THEN CAST(n_present AS DOUBLE) / (n_present + n_past) END, 6)", "n_present", "n_present + n_past", "ratio")]
    warn = "CASE WHEN coalesce(n_tokens, 0) = 0 THEN 'EMPTY_TEXT' WHEN language IS DISTINCT FROM 'en' THEN 'LANGUAGE_NOT_SUPPORTED' ELSE '' END"
    one = " UNION ALL ".join(f"SELECT doc_id, section, source, '{m}' AS metric, CASE WHEN language = 'en' THEN {v} END AS value, CAST({n} AS BIGINT) AS n, CAST({d} AS BIGINT) AS denominator, '{u}' AS unit, CAST(n_tokens AS BIGINT) AS n_tokens, {warn} AS warning FROM c" for m, v, n, d, u in rows)
    return f"{_BASE}, {_COUNTS}, m AS ({one})"


def _summary_sql(keys: str, source: str = "m") -> str:
    half = "(CASE WHEN n_valid < 2 THEN NULL WHEN n_valid <= 31 THEN list_extract([" + ", ".join(map(str, stats.T_95)) + "], CAST(n_valid - 1 AS INTEGER)) ELSE 1.96 END) * sd / sqrt(n_valid)"
    return f"""r AS (SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY value) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE value IS NOT NULL),
 q AS (SELECT {keys}, max(CASE WHEN k = CAST(round_even(0.25 * (n - 1), 0) AS BIGINT) + 1 THEN value END) AS p25, max(CASE WHEN k = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1 THEN value END) AS median,
   max(CASE WHEN k = CAST(round_even(0.75 * (n - 1), 0) AS BIGINT) + 1 THEN value END) AS p75 FROM r GROUP BY ALL),
 s0 AS (SELECT {keys}, min(CASE WHEN value IS NOT NULL THEN unit END) AS unit, count(value) AS n_valid, count(*) - count(value) AS n_missing, avg(value) AS mean,
   CASE WHEN count(value) >= 1 THEN coalesce(stddev_samp(value), 0) END AS sd, min(value) AS min, max(value) AS max FROM {source} GROUP BY ALL),
 s AS (SELECT {", ".join("s0." + k.strip() for k in keys.split(","))}, unit, n_valid, n_missing, round(mean, 6) AS mean, round(sd, 6) AS sd, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, round(p75 - p25, 6) AS iqr,
   round(min, 6) AS min, round(max, 6) AS max, round(mean - {half}, 6) AS ci95_low, round(mean + {half}, 6) AS ci95_high,
   array_to_string(list_filter([CASE WHEN n_missing > 0.3 * (n_valid + n_missing) THEN 'HIGH_MISSING' END, CASE WHEN n_valid < 3 THEN 'TINY_SAMPLE' END, CASE WHEN n_valid >= 3 AND n_valid < 5 THEN 'SMALL_SAMPLE' END,
     CASE WHEN n_valid >= 3 AND p75 - p25 = 0 THEN 'IQR_ZERO' END], lambda x: x IS NOT NULL), ',') AS warnings
   FROM s0 LEFT JOIN q USING ({keys}))"""


def _bands(summary: str = "s") -> str:
    return f"""k0 AS (SELECT metric, n_valid, CASE WHEN p25 IS NULL THEN 'missing' WHEN iqr = 0 THEN 'iqr_zero' ELSE '' END AS reason,
  greatest(0, p25 - CASE WHEN n_valid < 10 THEN 0.15 * iqr ELSE 0 END) AS lo, p75 + CASE WHEN n_valid < 10 THEN 0.15 * iqr ELSE 0 END AS hi FROM {summary}),
 k AS (SELECT metric, n_valid, reason, CASE WHEN reason = '' THEN lo END AS low, CASE WHEN reason = '' THEN hi END AS high FROM k0)"""


SQL = {
    "token_counts": f"SELECT doc_id, CAST({sql_count('text', W)} AS BIGINT) AS n_tokens, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '{W}'), lambda x: lower(x)))) AS BIGINT) AS n_types, CAST({sql_count('text', CJK)} AS BIGINT) AS n_cjk, CAST({sql_count('text', CJK)} + {sql_count('text', W)} AS BIGINT) AS n_units, CAST({sql_count('text', '[0-9０-９]')} AS BIGINT) AS n_digits FROM documents",
    "language_rule": f"WITH b AS (SELECT text, lang, {sql_count('text', W)} AS t, {sql_count('text', CJK)} AS c FROM documents) SELECT CASE WHEN text IS NULL THEN NULL WHEN c > 0.10 * (c + t) THEN 'zh' WHEN t > 0 THEN 'en' ELSE 'unknown' END AS rule_language, count(*) AS n_docs, count(lang) AS n_labelled FROM b GROUP BY 1",
    "phrase_counts": f"WITH {_BASE} SELECT doc_id, {', '.join(f'CAST({sql_phrases(e)} AS BIGINT) AS ' + n.lower().replace('-', '_') for n, e in M.LEXICONS.items())} FROM b",
    "token_metrics": f"WITH {_BASE}, {_COUNTS} SELECT doc_id, CAST(n_present AS BIGINT) AS n_present, CAST(n_past AS BIGINT) AS n_past, CAST(n_unresolved AS BIGINT) AS n_unresolved, CAST(n_nominal AS BIGINT) AS n_nominal FROM c",
    "doc_metrics": f"WITH {_long_sql()} SELECT doc_id, metric, value, n, denominator, unit, n_tokens, warning FROM m",
    "corpus_summary": f"WITH {_long_sql()}, {_summary_sql('metric')} SELECT * FROM s",
    "corpus_summary_by_source": f"WITH {_long_sql()}, {_summary_sql('metric, source')} SELECT * FROM s",
    "length_confounds": f"""WITH {_long_sql()}, p AS (SELECT metric, value, n_tokens FROM m WHERE value IS NOT NULL AND n_tokens IS NOT NULL),
 a AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS x, rank() OVER (PARTITION BY metric ORDER BY n_tokens) + (count(*) OVER (PARTITION BY metric, n_tokens) - 1) / 2.0 AS y FROM p),
 g AS (SELECT metric, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(x, y) END AS rho FROM a GROUP BY 1)
 SELECT metric, n, round(rho, 6) AS rho, n >= 5 AND abs(coalesce(rho, 0)) > 0.3 AS confounded FROM g""",
    "target_bands": f"""WITH {_long_sql()}, {_summary_sql('metric')}, {_bands()},
 d AS (SELECT 'M-CONN-30' AS metric, min(n_valid) AS n_valid, CASE WHEN count(low) < 3 THEN 'component_missing' ELSE '' END AS reason, CASE WHEN count(low) = 3 THEN sum(low) END AS low, CASE WHEN count(low) = 3 THEN sum(high) END AS high FROM k WHERE metric IN ('M-CONN-30c', 'M-CONN-30k', 'M-CONN-30r')),
 u AS (SELECT * FROM k WHERE metric <> 'M-CONN-30' UNION ALL SELECT * FROM d)
 SELECT metric, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN reason = '' AND n_valid >= 8 THEN 'gate' ELSE 'warn' END AS level, reason FROM u""",
    "section_strata": f"WITH {_long_sql()}, h AS (SELECT metric, coalesce(section, 'none') AS section, value FROM m WHERE metric = 'M-HED-14') SELECT metric, section, count(value) AS n_valid, round(avg(value), 6) AS mean FROM h GROUP BY GROUPING SETS ((metric), (metric, section))",
    "abstract_divergence": f"WITH {_long_sql()}, g AS (SELECT metric, avg(CASE WHEN section = 'abstract' THEN value END) AS a, avg(CASE WHEN section <> 'abstract' THEN value END) AS b FROM m WHERE section IS NOT NULL GROUP BY 1) SELECT metric, round(a, 6) AS abstract_mean, round(b, 6) AS body_mean, round(CASE WHEN b <> 0 THEN a / b END, 6) AS ratio FROM g",
    "cjk_ngrams": f"""WITH r AS (SELECT unnest(regexp_extract_all(text, '{CJK}+')) AS run FROM documents), n AS (SELECT unnest([2, 3, 4]) AS n),
 g AS (SELECT unnest(list_transform(range(1, length(run) - n.n + 2), lambda i: substring(run, i, n.n))) AS gram FROM r JOIN n ON length(run) >= n.n),
 k AS (SELECT unnest(flatten(map_values(groups))) AS gram FROM connectors)
 SELECT gram, count(*) AS n FROM g WHERE gram NOT IN (SELECT gram FROM k WHERE gram IS NOT NULL) GROUP BY 1 ORDER BY n DESC, gram LIMIT 20""",
    "citation_style": r"""WITH b AS (SELECT len(regexp_extract_all(coalesce(text, ''), '\[\d{1,4}(?:\s*[,-]\s*\d{1,4})*\]')) AS x, len(regexp_extract_all(coalesce(text, ''), '\([A-Z][A-Za-z-]+(?: et al\.)?,? (?:19|20)\d\d[a-z]?\)|[A-Z][A-Za-z-]+(?: et al\.)? \((?:19|20)\d\d[a-z]?\)')) AS y FROM documents)
 SELECT CASE WHEN x + y = 0 THEN 'none' WHEN x >= 0.85 * (x + y) THEN 'numeric' WHEN x <= 0.15 * (x + y) THEN 'author_year' ELSE 'mixed' END AS style, count(*) AS n_docs, CAST(sum(x) AS BIGINT) AS n_numeric, CAST(sum(y) AS BIGINT) AS n_author FROM b GROUP BY 1""",
    "text_cleaning": r"""WITH b AS (SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS h,
 trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[A-Za-z]+\*?', ' ', 'g'), '[$\{\}\\]', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS l FROM documents)
 SELECT doc_id, CAST(length(h) AS BIGINT) AS html_len, CAST(length(l) AS BIGINT) AS latex_len, md5(h) AS html_md5 FROM b""",
    "paragraph_length": f"""WITH p AS (SELECT DISTINCT draft_key, para_id, text FROM paragraphs), c AS (SELECT draft_key, {sql_count('text', W)} AS t, {sql_count('text', CJK)} AS c FROM p),
 z AS (SELECT draft_key, CAST(CASE WHEN c > 0.10 * (c + t) THEN c + t ELSE t END AS BIGINT) AS size, CASE WHEN c > 0.10 * (c + t) THEN 40 ELSE 15 END AS least FROM c),
 k AS (SELECT draft_key, size, row_number() OVER (PARTITION BY draft_key ORDER BY size) AS k, count(*) OVER (PARTITION BY draft_key) AS n FROM z WHERE size >= least)
 SELECT draft_key, count(*) AS n, round(avg(size), 6) AS mean, max(CASE WHEN k = CAST(round_even(0.25 * (n - 1), 0) AS BIGINT) + 1 THEN size END) AS p25, max(CASE WHEN k = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1 THEN size END) AS median, max(CASE WHEN k = CAST(round_even(0.75 * (n - 1), 0) AS BIGINT) + 1 THEN size END) AS p75 FROM k GROUP BY draft_key""",
}
_VALID = f"""WITH {_long_sql()}, known AS (SELECT * FROM m WHERE source <> 'thesis_draft'), {_summary_sql('metric', 'known')}, {_bands()},
 v AS (SELECT m.doc_id AS draft_id, metric, value, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN k.reason = '' AND k.n_valid >= 8 THEN 'gate' ELSE 'warn' END AS level FROM m JOIN k USING (metric) WHERE source = 'thesis_draft'),
 x AS (SELECT draft_id, metric, value, CASE WHEN low IS NULL OR value IS NULL THEN 'skipped' WHEN greatest(low - value, value - high, 0) <= 0 THEN 'pass' WHEN level = 'gate' THEN 'fail' ELSE 'warn' END AS verdict,
   CASE WHEN low IS NOT NULL AND value IS NOT NULL THEN round(greatest(low - value, value - high, 0), 6) END AS deviation FROM v)"""
SQL["band_validation"] = _VALID + " SELECT * FROM x"
SQL["draft_outcomes"] = _VALID + """, o AS (SELECT draft_id, CAST(sum(CAST(verdict = 'pass' AS INT)) AS BIGINT) AS n_pass, CAST(sum(CAST(verdict = 'fail' AS INT)) AS BIGINT) AS n_fail, CAST(sum(CAST(verdict = 'warn' AS INT)) AS BIGINT) AS n_warn, CAST(sum(CAST(verdict = 'skipped' AS INT)) AS BIGINT) AS n_skipped, count(*) AS n FROM x GROUP BY 1)
 SELECT draft_id, n_pass, n_fail, n_warn, n_skipped, CASE WHEN n - n_skipped < 0.5 * n THEN 'unusable' WHEN n_fail > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM o"""
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS lexicon, replace(trim(unnest(regexp_extract_all(padded, '{tx.phrase_pattern(e).replace(chr(39), chr(39) * 2)}'))), '  ', ' ') AS entry FROM b" for n, e in M.LEXICONS.items()
)
_ENTRIES = ", ".join("('" + n + "', '" + e.replace("'", "''") + "')" for n, es in M.LEXICONS.items() for e in sorted(set(es)))
SQL["lexicon_usage"] = f"WITH {_BASE}, h AS ({_HITS}), e(lexicon, entry) AS (VALUES {_ENTRIES}) SELECT lexicon, entry, count(doc_id) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM e LEFT JOIN h USING (lexicon, entry) GROUP BY 1, 2"

_WS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLOSE = "[\"'')\\]}»”’]"
_MASKED = r"(?im)^[ \t]*(?:keywords?|key[ \t]+words|关键词|关键字)[ \t]*[:：][^\n]*|\$\$[^$\n]*\$\$|\$[^$\n]*\$|</?(?:sub|sup)\b[^>]*>"
_SENTENCES = rf"""m AS (SELECT doc_id, lang, text, list_reduce(list_prepend(text, regexp_extract_all(text, '{_MASKED}')), lambda a, x: replace(a, x, repeat(' ', length(x)))) AS t FROM documents WHERE text IS NOT NULL),
 i AS (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM m WHERE regexp_matches(t, '[.!?。！？…]')),
 c AS (SELECT doc_id, i, substr(t, i, 1) AS ch, CASE WHEN i > 1 THEN substr(t, i - 1, 1) ELSE '' END AS pv, substr(t, i + 1, 1) AS nx, CASE WHEN i > 1 THEN substr(t, 1, i - 1) ELSE '' END AS l, substr(t, i + 1) AS r FROM i WHERE substr(t, i, 1) IN ('.', '!', '?', '。', '！', '？', '…')),
 w AS (SELECT *, regexp_extract(l, '[A-Za-z]+(?:\.[A-Za-z]+)*$') AS word, regexp_extract(r, '^{_CLOSE}*[ \t\f\v]*(.)', 1) AS f FROM c),
 e AS (SELECT doc_id, i + CASE WHEN ch IN ('。', '！', '？', '…') THEN length(regexp_extract(r, '^[」』】》）］＞〉]*')) ELSE 0 END AS e FROM w WHERE CASE
  WHEN ch IN ('。', '！', '？', '…') THEN nx NOT IN ('。', '！', '？', '…', '.')
  WHEN ch IN ('!', '?') THEN regexp_matches(r, '^{_CLOSE}*(?:{_WS}|$)')
  ELSE (regexp_matches(r, '^{_CLOSE}*(?:{_WS}|$)') AND NOT (regexp_matches(regexp_extract(l, '[^\n]*$'), '^{_WS}*(?:\d{{1,3}}|\[\d{{1,3}}\]|\(\d{{1,3}}\))$') OR lower(word) IN {sql_in(sorted(split.ABBREVIATIONS))}
   OR (regexp_matches(word, '^[A-Z]$') AND regexp_matches(r, '^[ \t]+[A-Z][A-Za-z.]')) OR (f <> '' AND lower(f) = f AND upper(f) <> f)))
   OR (NOT regexp_matches(pv, '[\p{{Nd}}A-Za-z]') AND NOT regexp_matches(nx, '[\p{{Nd}}A-Za-z]') AND nx NOT IN ('。', '！', '？', '…', '.', '!', '?')) END),
 a AS (SELECT doc_id, e FROM e UNION SELECT doc_id, length(t) FROM m),
 b AS (SELECT doc_id, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS s FROM a),
 p AS (SELECT doc_id, s, lang, text, substr(t, s + 1, e - s) AS x FROM b JOIN m USING (doc_id)),
 q AS (SELECT doc_id, lang, s + length(x) - length(regexp_replace(x, '^{_WS}+', '')) AS s, length(regexp_replace(regexp_replace(x, '^{_WS}+', ''), '{_WS}+$', '')) AS n, text FROM p WHERE regexp_matches(x, '[A-Za-z\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]')),
 z AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS sent_no, substr(text, s + 1, n) AS text FROM q),
 y AS (SELECT *, CAST({sql_count("text", W)} AS BIGINT) AS n_tokens, CAST({sql_count("text", W)} + {sql_count("text", CJK)} AS BIGINT) AS n_units FROM z)"""
SQL["sentence_spans"] = f"WITH {_SENTENCES} SELECT doc_id, sent_no, text, n_tokens, n_units FROM y"
SQL["sentence_length_by_lang"] = f"""WITH {_SENTENCES}, v AS (SELECT *, sum(n_units - n_tokens) OVER (PARTITION BY doc_id) > 0.1 * (sum(n_units) OVER (PARTITION BY doc_id)) AS zh FROM y),
 u AS (SELECT doc_id, any_value(lang) AS lang, avg(CASE WHEN zh THEN n_units ELSE n_tokens END) AS mean_len, avg(CAST(CASE WHEN zh THEN n_units >= 80 ELSE n_tokens >= 40 END AS INT)) AS long_share FROM v GROUP BY 1) SELECT lang, count(*) AS n_docs, round(avg(mean_len), 6) AS mean_len, round(avg(long_share), 6) AS long_share FROM u GROUP BY 1"""
