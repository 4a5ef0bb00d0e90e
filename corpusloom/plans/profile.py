"""Queries of the Chinese metrics and of the profile-level operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as lx
from corpusloom.functions import stats
from corpusloom.functions import text as tx
from corpusloom.operators import blocks as bl
from corpusloom.operators import chinese as zh
from corpusloom.operators import corpus, metrics, search
from corpusloom.operators import federation as fd
from corpusloom.operators import profile as pr
from corpusloom.plans import documents as docs_plan
from corpusloom.plans.documents import CJK, W, _docs, sql_count, sql_in
from corpusloom.plans.structure import _HTML, _LABEL, _NEWEST, _SECTIONED, _TITLE, _TYPED, _light, _newest, _typed, table_shapes
from corpusloom.plans.structure import SQL as STRUCTURE_SQL
from corpusloom.session import table


def chinese_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zh.chinese_rates(_docs(spark, sf_dir))


def chinese_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and types of the stream of ideographs and words, by document."""
    stream = _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", zh.token_stream(F.col("text")).alias("w"))
    return stream.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_types"))


def opening_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the sentences of Chinese documents that open with a connector."""
    chinese = _docs(spark, sf_dir).filter(tx.language(F.col("text")) == "zh")
    return zh.opening_share(metrics.sentence_table(chinese), lx.CONNECTORS_ZH)


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document with its offsets."""
    return zh.spans(_docs(spark, sf_dir).filter("text IS NOT NULL"), "doc_id", tx.WORD)


def table_columns_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the declared columns of a paper's tables that have cells."""
    return stats.ranked_quantiles(table_shapes(spark, sf_dir).filter("n_cells > 0"), ["paper_key"], "n_columns", {"median_columns": ("upper", 0.5)})


def table_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables for 1000 words (units in Chinese) of prose, by paper; null without prose."""
    t = _typed(spark, sf_dir).filter(F.col("stream").isin("prose", "tables"))
    prose = F.col("stream") == "prose"
    plain = F.col("plain")
    per = t.groupBy("paper_key").agg(
        F.sum((~prose).cast("bigint")).alias("n_tables"),
        F.coalesce(F.sum(F.when(prose, tx.n_tokens(plain))), F.lit(0)).cast("bigint").alias("w"),
        F.coalesce(F.sum(F.when(prose, tx.n_cjk(plain))), F.lit(0)).cast("bigint").alias("c"),
    )
    size = F.when(F.col("c") > metrics.CHINESE_SHARE * (F.col("c") + F.col("w")), F.col("c") + F.col("w")).otherwise(F.col("w"))
    return per.select("paper_key", "n_tables", size.alias("n_units"), F.round(F.try_divide(F.col("n_tables") * F.lit(1000.0), size.cast("double")), 6).alias("value"))


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every block within its stream of a paper, from 0."""
    order = Window.partitionBy("paper_key", "stream").orderBy("block_index", "block_id")
    return _light(spark, sf_dir).select("block_id", "stream", (F.row_number().over(order) - 1).cast("bigint").alias("stream_no"))


def section_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section headings by label and by how surely they were told."""
    label, how = pr.section_resolution(F.col("plain"))
    heads = _light(spark, sf_dir).filter("level = 2 AND stream = 'prose'")
    return heads.select(label.alias("label"), how.alias("how")).groupBy("label", "how").agg(F.count("*").alias("n"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with the section they stand in."""
    placed = bl.with_sections(_light(spark, sf_dir)).filter("stream = 'figures'").select("block_id", "section")
    own = _newest(spark, sf_dir, ["block_id", "paper_key", "type", "img_path", "caption", "page_idx", "bbox"]).select("block_id", "paper_key", "type", "img_path", "caption")
    return placed.join(own, "block_id")


def figure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(spark, sf_dir).groupBy(pr.figure_class(F.col("section"), F.col("type")).alias("figure_class")).agg(F.count("*").alias("n_figures"), F.count_distinct("paper_key").alias("n_papers"))


def figure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by type: images, captions, numbered captions, mean length of captions."""
    size = F.length(F.trim(F.coalesce("caption", F.lit(""))))
    numbered = bl.declared_number(F.col("caption")).isNotNull()
    return _figures(spark, sf_dir).groupBy("type").agg(
        F.count("*").alias("n_figures"), F.count_distinct("img_path").alias("n_images"), F.sum((size > 0).cast("bigint")).alias("n_captioned"),
        F.sum(F.when(size > 0, numbered.cast("bigint")).otherwise(0)).alias("n_numbered"), F.round(F.avg(F.when(size > 0, size.cast("double"))), 6).alias("mean_chars"),
    )


def lexicon_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a language's lexicon releases: sorted pairs of name and version (few by language)."""
    c = table(spark, sf_dir, "connectors").select(F.coalesce("language", F.lit("")).alias("language"), F.concat("name", F.lit("="), "version").alias("p")).distinct()
    return c.groupBy("language").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_set("p")), ";"), 256).alias("fingerprint"))


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of the papers' provenance, all deliveries and the last ones: which corpora come out alike."""
    p = table(spark, sf_dir, "papers").select("paper_key", "corpus_name", "language", "registered_at").filter("corpus_name IS NOT NULL")
    first = Window.partitionBy("paper_key").orderBy("registered_at", F.xxhash64("language"))
    last = Window.partitionBy("paper_key").orderBy(F.col("registered_at").desc(), F.xxhash64("language"))
    parts = [F.col("paper_key"), F.col("language")]
    runs = [pr.fingerprints(p.withColumn("r", F.row_number().over(w)).filter("r = 1"), "corpus_name", parts) for w in (first, last)]
    return pr.compared(*runs, "corpus_name").groupBy("status").agg(F.count("*").alias("n_corpora"))


def quantile_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quartiles of the corpus summary against a second computation from the long table."""
    long = docs_plan.doc_metrics(spark, sf_dir).filter("value IS NOT NULL")
    ours = corpus.summary(long, ["metric"]).select("metric", "p25", "median", "p75")
    up = stats.cumulative(long.select("metric", "value"), ["metric"], "value")
    sizes = long.groupBy("metric").agg(F.count("*").alias("n"))
    placed = up.join(sizes, "metric")
    at = lambda q: F.min(F.when(F.col("upto") >= F.bround(q * (F.col("n") - 1)).cast("bigint") + 1, F.col("value")))
    second = placed.groupBy("metric").agg(at(0.25).alias("b25"), at(0.5).alias("b50"), at(0.75).alias("b75"))
    same = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-6
    return ours.join(second, "metric").select("metric", (same("p25", "b25") & same("p75", "b75")).alias("quartiles_same"))


def missing_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warning codes expected of each corpus: causes, noise and others, and the codes that are left."""
    t = table(spark, sf_dir, "test_corpora").select("name", F.map_keys("expected_corpus_warnings").alias("codes")).filter("codes IS NOT NULL")
    return t.select("name", F.size(F.filter("codes", pr.is_cause)).cast("bigint").alias("n_causes"), F.array_join(pr.collapsed(F.col("codes"), F.col("codes")), ",").alias("left"))


def checkable_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics expected of the corpora that may stand in a draft's contract: prose metrics and those allowed by name."""
    m = table(spark, sf_dir, "test_corpora").select(F.explode(F.map_keys("expected_metrics")).alias("metric")).distinct()
    scope = F.when(F.col("metric").startswith("M-"), F.array(F.lit("prose"))).otherwise(F.array(F.lit("prose"), F.lit("tables")))
    return m.select("metric", pr.draft_checkable(F.col("metric"), scope, ["S-REF-03"]).alias("checkable"))


def embedded_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of the same page that covers most of each figure, by paper."""
    b = _newest(spark, sf_dir, ["block_id", "paper_key", "page_idx", "bbox", "type"]).filter("size(bbox) = 4 AND page_idx IS NOT NULL AND paper_key IS NOT NULL")
    b = b.select("paper_key", "page_idx", "type", F.col("block_id").alias("id"), *[F.col("bbox")[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    return pr.best_embedded(b.filter(F.col("type").isin("image", "chart")).drop("type"), b.drop("type"), ["paper_key", "page_idx"], 0.1)


def annotation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the converter's type agrees with the stream, in and out of prose."""
    b = table(spark, sf_dir, "blocks").select(F.when(F.col("kind") == "prose", "P").otherwise("N").alias("stratum"), F.coalesce(F.col("type") == "text", F.lit(False)).alias("marked"))
    return pr.annotation_score(b)


def sample_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    placed = stats.cumulative(d, ["source"], "doc_id").join(d.groupBy("source").agg(F.count("*").alias("n")), "source")
    return pr.stratum_sample(placed, ["source"], 30).select("source", "doc_id")


def chapter_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of figures within the sections of a paper, by what they are."""
    placed = bl.with_sections(_light(spark, sf_dir)).filter("stream = 'figures'").select("block_id", "paper_key", "section_no", "position")
    own = _newest(spark, sf_dir, ["block_id", "caption"]).select("block_id", bl.declared_number(F.col("caption")).alias("number")).filter("number IS NOT NULL")
    found = pr.chapter_continuity(placed.join(own, "block_id").select(F.col("paper_key").alias("key"), F.col("section_no").alias("chapter"), F.col("position").alias("at"), "number"))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def numbered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short numbered lines without a stop, by level."""
    b = table(spark, sf_dir, "blocks").filter("text_plain IS NOT NULL").select(pr.heading_level(F.trim("text_plain")).alias("level"))
    return b.filter("level IS NOT NULL").groupBy("level").agg(F.count("*").alias("n"))


def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "blocks").filter("kind = 'tables'").select("block_id", "table_body").distinct()
    return t.select("block_id", pr.pipe_table(F.col("table_body")).alias("pipe")).filter("pipe IS NOT NULL")


def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI, arXiv id, mail address, host of a link and year of a document by their forms; empty where there's none."""
    d = _docs(spark, sf_dir).filter("text IS NOT NULL")
    pick = lambda p: F.regexp_extract("text", p, 1)
    found = d.select("doc_id", pick(DOI).alias("doi"), pick(ARXIV).alias("arxiv_id"), pick(MAIL).alias("mail"), pick(LINK).alias("host"), pick(YEAR).alias("year"))
    return found.filter("host <> '' OR doi <> '' OR arxiv_id <> '' OR mail <> '' OR year <> ''")


def info_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, table rows, formulas, images and digits of Markdown documents."""
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    return _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", *[count(p).alias(n) for n, p in INFO.items()], tx.n_digits(F.col("text")).alias("digits"))


def lexicon_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How concentrated the hits of each list are, and what share is left without its most frequent entry."""
    used = docs_plan.lexicon_usage(spark, sf_dir)
    by = Window.partitionBy("lexicon").orderBy(F.col("n_hits").desc(), "entry")
    ranked = used.withColumn("r", F.row_number().over(by))
    n = F.sum("n_hits")
    share = lambda c: F.round(F.try_divide(c.cast("double"), n.cast("double")), 6)
    return ranked.groupBy("lexicon").agg(n.alias("n_hits"), F.sum((F.col("n_hits") > 0).cast("bigint")).alias("n_used"), share(F.sum(F.when(F.col("r") <= 5, F.col("n_hits")).otherwise(0))).alias("top5_share"), share(F.sum(F.when(F.col("r") > 1, F.col("n_hits")).otherwise(0))).alias("without_first"))


def _titles(query: str) -> list[dict]:
    """A source for the query below: a page of the query's words, named by their number."""
    words = query.split()
    return [{"title": query, "url": f"https://one.example/{len(words)}", "score": 1.0}]


def _mirrors(query: str) -> list[dict]:
    if query.startswith("c"):
        raise ValueError("no answer")
    return [{"title": query.upper(), "url": f"https://www.one.example/{len(query.split())}/", "score": 0.5}, {"title": query, "url": f"https://two.example/{len(query)}", "score": 0.4}]


def federated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of the documents asked of two engines, merged and ranked: the engines' answers are made from the query."""
    queries = table(spark, sf_dir, "documents").select(F.regexp_replace("source", "_", " ").alias("query"))
    weights = spark.createDataFrame([("titles", 1.0, 0), ("mirrors", 0.5, 1)], "source string, weight double, source_order int")
    found = fd.answers(fd.fan_out(queries, {"titles": _titles, "mirrors": _mirrors}), weights, 5)
    return found.select("query", F.col("rank").cast("bigint").alias("rank"), "key", F.round("score", 6).alias("score"), "n_found")


def engine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "documents").select(F.regexp_replace("source", "_", " ").alias("query"))
    return search.source_health(fd.fan_out(queries, {"titles": _titles, "mirrors": _mirrors}, breaks_after=1 << 30))


def adapter_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every document in the unit of its language's adapter."""
    adapters = fd.Adapters()
    adapters.register("en", lambda text: tx.n_tokens(text))
    adapters.register("zh", lambda text: tx.cjk_units(text))
    d = _docs(spark, sf_dir).filter("text IS NOT NULL")
    return d.select("doc_id", tx.language(F.col("text")).alias("language"), "text").select("doc_id", "language", adapters.column(F.col("language"), text=F.col("text")).alias("size"))


def resumed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that a second run must convert: new ones, and those whose file changed since the first."""
    p = table(spark, sf_dir, "papers").select("paper_key", F.coalesce("pdf_sha256", F.lit("")).alias("digest"), "registered_at")
    first = Window.partitionBy("paper_key").orderBy("registered_at", "digest")
    state = p.withColumn("r", F.row_number().over(first)).filter("r = 1").select("paper_key", "digest", F.when(F.length("digest") > 0, "done").otherwise("failed").alias("status"))
    return fd.unfinished(p.select("paper_key", "digest").distinct(), state, "paper_key", "digest").groupBy((F.col("digest") == "").alias("without_file")).agg(F.count("*").alias("n"))


DOI = r"\b(10\.\d{4,9}/[^\s\"<>]+[A-Za-z0-9])"
ARXIV = r"(?i:arxiv:\s*)(\d{4}\.\d{4,5})"
MAIL = r"\b([A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]*[A-Za-z])\b"
LINK = r"https?://([A-Za-z0-9.-]+)"
YEAR = r"\(((?:19|20)[0-9]{2})\)"
INFO = {"headings": r"(?m)^#{1,6}[ \t]+[^\s]", "table_rows": r"(?m)^[ \t]*\|[^\n]*\|[ \t]*$", "formulas": r"\$\$[^$]+\$\$", "images": r"!\[[^\]\n]*\]\([^)\n]*\)"}

QUERIES = {
    f.__name__: f
    for f in (chinese_rates, chinese_tokens, opening_connectors, token_spans, table_columns_median, table_density, stream_index, section_resolution, figure_classes, figure_summary, lexicon_fingerprint, run_comparison,
              quantile_recompute, missing_causes, checkable_metrics, embedded_figures, annotation_score, sample_topup, chapter_continuity, numbered_titles, pipe_tables, metadata_fields, info_classes, lexicon_validity, federated_search, engine_errors, adapter_units, resumed_work)
}


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_ZH = f"z AS (SELECT doc_id, text, {sql_count('text', CJK)} + {sql_count('text', W)} AS u FROM documents WHERE text IS NOT NULL AND {sql_count('text', CJK)} > 0.1 * ({sql_count('text', CJK)} + {sql_count('text', W)}))"
_ALL_ZH = [e for entries in lx.CONNECTORS_ZH.values() for e in entries]
_RATE = "round({0} * 1000.0 / nullif(u, 0), 6)"
_GROUP_RATES = {g: _RATE.format(f"len(list_filter(h, lambda x: x IN {sql_in(entries)}))") for g, entries in lx.CONNECTORS_ZH.items()}
_FIG = f"{_SECTIONED}, f AS (SELECT s.block_id, s.section, s.section_no, s.paper_key, nb.type, nb.img_path, nb.caption, nb.block_index FROM s JOIN nb USING (block_id) WHERE s.stream = 'figures')"
_DECLARED = r"TRY_CAST(regexp_extract(trim(translate(coalesce(caption, ''), '０１２３４５６７８９', '0123456789'), ' '), '^(?i:fig(?:ure)?|table|tab|图|表)\s*\.?\s*([0-9]+|[A-Z][0-9]*)', 1) AS INTEGER)"
_SIZE = "length(trim(coalesce(caption, ''), ' '))"
_EXACT = " OR ".join(f"regexp_matches({_TITLE}, '{p}$')" for _, p in bl.SECTIONS)

SQL = {
    "chinese_rates": f"WITH {_ZH}, c AS (SELECT *, regexp_extract_all(text, '{zh.literal_pattern(_ALL_ZH)}', 1) AS h FROM z) SELECT doc_id, CAST(u AS BIGINT) AS n_units, {_RATE.format(sql_count('text', zh.literal_pattern(lx.HEDGES_ZH)))} AS m_hed_14, {_RATE.format(sql_count('text', zh.literal_pattern(lx.BOOSTERS_ZH)))} AS m_boo_15, "
    + ", ".join(f"{_GROUP_RATES[g]} AS {m.lower().replace('-', '_')}" for g, m in zh.GROUPS.items()) + f", round({_GROUP_RATES['contrastive']} + {_GROUP_RATES['causal']} + {_GROUP_RATES['result']}, 6) AS m_conn_30 FROM c",
    "chinese_tokens": f"WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{CJK}|{W}'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_types FROM t",
    "opening_connectors": f"WITH {docs_plan._SENTENCES}, k AS (SELECT y.doc_id, CAST(regexp_matches(y.text, '^{zh.literal_pattern(_ALL_ZH)}') AS INT) AS o FROM y JOIN documents d USING (doc_id) WHERE {sql_count('d.text', CJK)} > 0.1 * ({sql_count('d.text', CJK)} + {sql_count('d.text', W)})) SELECT doc_id, count(*) AS n_sentences, CAST(sum(o) AS BIGINT) AS n_open, round(avg(o), 6) AS value FROM k GROUP BY 1",
    "token_spans": f"""WITH g AS (SELECT doc_id, regexp_split_to_array(text, '{W}') AS gaps, regexp_extract_all(text, '{W}') AS toks FROM documents WHERE text IS NOT NULL),
 r AS (SELECT doc_id, unnest(range(1, len(toks) + 1)) AS k, unnest(toks) AS token, unnest(gaps[1:len(toks)]) AS gap FROM g)
 SELECT doc_id, CAST(k - 1 AS INTEGER) AS tok_no, lower(token) AS token, CAST(sum(length(gap) + length(token)) OVER w - length(token) AS BIGINT) AS span_start, CAST(sum(length(gap) + length(token)) OVER w AS BIGINT) AS span_end FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)""",
    "table_columns_median": "WITH s AS (" + STRUCTURE_SQL["table_shapes"] + "), r AS (SELECT paper_key, n_columns, row_number() OVER (PARTITION BY paper_key ORDER BY n_columns) AS k, count(*) OVER (PARTITION BY paper_key) AS n FROM s WHERE n_cells > 0) SELECT paper_key, n_columns AS median_columns FROM r WHERE k = n // 2 + 1",
    "table_density": f"WITH {_TYPED}, p AS (SELECT paper_key, CAST(sum(CAST(stream = 'tables' AS INT)) AS BIGINT) AS n_tables, coalesce(sum(CASE WHEN stream = 'prose' THEN {sql_count('plain', W)} END), 0) AS w, coalesce(sum(CASE WHEN stream = 'prose' THEN {sql_count('plain', CJK)} END), 0) AS c FROM t WHERE stream IN ('prose', 'tables') GROUP BY 1), q AS (SELECT *, CASE WHEN c > 0.1 * (c + w) THEN c + w ELSE w END AS n_units FROM p) SELECT paper_key, n_tables, CAST(n_units AS BIGINT) AS n_units, round(n_tables * 1000.0 / nullif(n_units, 0), 6) AS value FROM q",
    "stream_index": f"WITH {_TYPED} SELECT block_id, stream, row_number() OVER (PARTITION BY paper_key, stream ORDER BY block_index NULLS FIRST, block_id) - 1 AS stream_no FROM t",
    "section_resolution": f"WITH {_TYPED}, h AS (SELECT {_LABEL} AS label, {_TITLE} AS bare, {_EXACT} AS exact FROM t WHERE level = 2 AND stream = 'prose') SELECT label, CASE WHEN exact THEN 'exact' WHEN label <> bare THEN 'keyword' ELSE 'verbatim' END AS how, count(*) AS n FROM h GROUP BY 1, 2",
    "figure_classes": f"WITH {_FIG} SELECT CASE WHEN type = 'chart' THEN CASE WHEN section IN {sql_in(pr.RESULT_LABELS)} THEN 'data-plot' ELSE 'chart-other' END WHEN section IN {sql_in(pr.METHOD_LABELS)} THEN 'framework-overview' WHEN section IN {sql_in(pr.RESULT_LABELS)} THEN 'result-figure' WHEN section = 'introduction' THEN 'concept-diagram' ELSE 'image-other' END AS figure_class, count(*) AS n_figures, count(DISTINCT paper_key) AS n_papers FROM f GROUP BY 1",
    "figure_summary": f"WITH {_FIG} SELECT type, count(*) AS n_figures, count(DISTINCT img_path) AS n_images, CAST(sum(CAST({_SIZE} > 0 AS INT)) AS BIGINT) AS n_captioned, CAST(sum(CASE WHEN {_SIZE} > 0 THEN CAST({_DECLARED} IS NOT NULL AS INT) ELSE 0 END) AS BIGINT) AS n_numbered, round(avg(CASE WHEN {_SIZE} > 0 THEN {_SIZE} END), 6) AS mean_chars FROM f GROUP BY 1",
    "lexicon_fingerprint": "WITH c AS (SELECT DISTINCT coalesce(language, '') AS language, name || '=' || version AS p FROM connectors) SELECT language, count(*) AS n, sha256(string_agg(p, ';' ORDER BY p)) AS fingerprint FROM c GROUP BY 1",
    "missing_causes": f"WITH c AS (SELECT name, map_keys(expected_corpus_warnings) AS codes FROM test_corpora WHERE expected_corpus_warnings IS NOT NULL), k AS (SELECT name, codes, list_filter(codes, lambda x: x NOT IN {sql_in(pr.SMALL_N)} AND (starts_with(x, 'NO_') OR ends_with(x, '_NOT_SUPPORTED') OR x IN {sql_in(pr.CAUSES)})) AS causes FROM c) SELECT name, CAST(len(causes) AS BIGINT) AS n_causes, array_to_string(list_sort(CASE WHEN len(causes) > 0 THEN list_filter(codes, lambda x: x NOT IN {sql_in(pr.SMALL_N)}) ELSE codes END), ',') AS left FROM k",
    "checkable_metrics": "WITH m AS (SELECT DISTINCT unnest(map_keys(expected_metrics)) AS metric FROM test_corpora) SELECT metric, starts_with(metric, 'M-') OR metric = 'S-REF-03' AS checkable FROM m",
    "embedded_figures": f"""WITH {_NEWEST}, b AS (SELECT paper_key, page_idx, type, block_id AS id, CAST(bbox[1] AS DOUBLE) AS x1, CAST(bbox[2] AS DOUBLE) AS y1, CAST(bbox[3] AS DOUBLE) AS x2, CAST(bbox[4] AS DOUBLE) AS y2 FROM nb WHERE len(bbox) = 4 AND page_idx IS NOT NULL AND paper_key IS NOT NULL),
 f AS (SELECT * FROM b WHERE type IN ('image', 'chart')), j AS (SELECT f.id, c.id AS c_id, least(f.x2, c.x2) - greatest(f.x1, c.x1) AS w, least(f.y2, c.y2) - greatest(f.y1, c.y1) AS h, (f.x2 - f.x1) * (f.y2 - f.y1) AS area FROM f JOIN b c ON f.paper_key = c.paper_key AND f.page_idx = c.page_idx AND f.id <> c.id),
 k AS (SELECT id, c_id, CASE WHEN w > 0 AND h > 0 AND area > 0 THEN w * h / area ELSE 0 END AS share FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, c_id) AS r FROM k)
 SELECT f.id, CASE WHEN round(coalesce(share, 0), 6) >= 0.1 THEN c_id END AS best, round(coalesce(share, 0), 6) AS share, CASE WHEN round(coalesce(share, 0), 6) >= 0.1 THEN 'embedded' ELSE 'rendered' END AS source FROM f LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (id)""",
    "annotation_score": "WITH b AS (SELECT CASE WHEN kind = 'prose' THEN 'P' ELSE 'N' END AS stratum, coalesce(type = 'text', false) AS marked FROM blocks), p AS (SELECT stratum, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(marked AS INT)) AS DOUBLE) AS k FROM b GROUP BY 1), q AS (SELECT *, k / n AS p, @Z ^ 2 AS z2 FROM p) SELECT stratum, CAST(n AS BIGINT) AS sampled, CAST(k AS BIGINT) AS positive, round(p, 6) AS rate, round(greatest(0, (p + z2 / (2 * n) - sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (p + z2 / (2 * n) + sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high FROM q".replace("@Z", str(stats.Z_95)),
    "sample_topup": "WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), q AS (SELECT *, greatest(1, n // 30) AS stride FROM p) SELECT source, doc_id FROM q WHERE i % stride = 0 AND i // stride < 30",
    "chapter_continuity": f"WITH {_FIG}, d AS (SELECT paper_key, section_no, block_index, block_id, {_DECLARED} AS number FROM f), e AS (SELECT *, lag(number) OVER (PARTITION BY paper_key, section_no ORDER BY block_index NULLS FIRST, block_id) AS before FROM d WHERE number IS NOT NULL) SELECT CASE WHEN number = coalesce(before + 1, 1) THEN 'ok' WHEN number = before THEN 'duplicate' WHEN number > coalesce(before + 1, 1) THEN 'gap' ELSE 'backward' END AS kind, count(*) AS n FROM e GROUP BY 1",
    "numbered_titles": rf"WITH t AS (SELECT trim(text_plain, ' ') AS x FROM blocks WHERE text_plain IS NOT NULL) SELECT CAST(least(len(string_split(regexp_extract(x, '{pr.NUMBERED}', 1), '.')), 3) AS INTEGER) AS level, count(*) AS n FROM t WHERE regexp_matches(x, '{pr.NUMBERED}') AND NOT regexp_matches(x, '[。！？；!?;]|[.]$') GROUP BY 1",
    "pipe_tables": f"""WITH t AS (SELECT DISTINCT block_id, table_body FROM blocks WHERE kind = 'tables'), r AS (SELECT block_id, list_filter(list_transform(regexp_extract_all(coalesce(table_body, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: {_HTML.replace("@", "c")})), lambda r: len(r) > 0) AS rs FROM t),
 l AS (SELECT block_id, list_transform(rs, lambda r: '| ' || array_to_string(r, ' | ') || ' |') AS ls, '|' || repeat('---|', len(rs[1])) AS rule FROM r WHERE len(rs) > 0) SELECT block_id, ls[1] || chr(10) || rule || CASE WHEN len(ls) > 1 THEN chr(10) || array_to_string(ls[2:], chr(10)) ELSE '' END AS pipe FROM l""",
    "metadata_fields": f"WITH x AS (SELECT doc_id, regexp_extract(text, '{_quoted(DOI)}', 1) AS doi, regexp_extract(text, '{_quoted(ARXIV)}', 1) AS arxiv_id, regexp_extract(text, '{_quoted(MAIL)}', 1) AS mail, regexp_extract(text, '{LINK}', 1) AS host, regexp_extract(text, '{_quoted(YEAR)}', 1) AS year FROM documents WHERE text IS NOT NULL) SELECT * FROM x WHERE host <> '' OR doi <> '' OR arxiv_id <> '' OR mail <> '' OR year <> ''",
    "info_classes": "SELECT doc_id, " + ", ".join(f"CAST({sql_count('text', p)} AS BIGINT) AS {n}" for n, p in INFO.items()) + f", CAST({sql_count('text', '[0-9０-９]')} AS BIGINT) AS digits FROM documents WHERE text IS NOT NULL",
    "lexicon_validity": f"WITH u AS ({docs_plan.SQL['lexicon_usage']}), r AS (SELECT *, row_number() OVER (PARTITION BY lexicon ORDER BY n_hits DESC, entry) AS r FROM u) SELECT lexicon, CAST(sum(n_hits) AS BIGINT) AS n_hits, CAST(sum(CAST(n_hits > 0 AS INT)) AS BIGINT) AS n_used, round(sum(CASE WHEN r <= 5 THEN n_hits ELSE 0 END) / nullif(sum(n_hits), 0), 6) AS top5_share, round(sum(CASE WHEN r > 1 THEN n_hits ELSE 0 END) / nullif(sum(n_hits), 0), 6) AS without_first FROM r GROUP BY 1",
    "federated_search": """WITH q AS (SELECT DISTINCT replace(source, '_', ' ') AS query FROM documents WHERE source IS NOT NULL),
 r AS (SELECT query, 'url:https://one.example/' || len(string_split(query, ' ')) AS key, 1.0 AS s FROM q UNION ALL SELECT query, 'url:https://one.example/' || len(string_split(query, ' ')), 0 FROM q WHERE NOT starts_with(query, 'c') UNION ALL SELECT query, 'url:https://two.example/' || length(query), 0.2 FROM q WHERE NOT starts_with(query, 'c')),
 m AS (SELECT query, key, max(s) + CASE WHEN count(*) > 1 THEN 0.15 * 0.5 ELSE 0 END AS score, count(*) AS n_found FROM r GROUP BY 1, 2)
 SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank, key, round(score, 6) AS score, n_found FROM m""",
    "engine_errors": "WITH q AS (SELECT DISTINCT source AS query FROM documents WHERE source IS NOT NULL) SELECT 'titles' AS source, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_errors, false AS failed FROM q UNION ALL SELECT 'mirrors', CAST(sum(CASE WHEN starts_with(query, 'c') THEN 1 ELSE 2 END) AS BIGINT), CAST(sum(CAST(starts_with(query, 'c') AS INT)) AS BIGINT), bool_and(starts_with(query, 'c')) FROM q",
    "adapter_units": f"WITH t AS (SELECT doc_id, {sql_count('text', W)} AS w, {sql_count('text', CJK)} AS c FROM documents WHERE text IS NOT NULL), l AS (SELECT *, CASE WHEN c > 0.1 * (c + w) THEN 'zh' WHEN w > 0 THEN 'en' ELSE 'unknown' END AS language FROM t) SELECT doc_id, language, CAST(CASE WHEN language = 'zh' THEN w + c ELSE w END AS BIGINT) AS size FROM l",
    "resumed_work": "WITH p AS (SELECT paper_key, coalesce(pdf_sha256, '') AS digest, row_number() OVER (PARTITION BY paper_key ORDER BY registered_at, coalesce(pdf_sha256, '')) AS r FROM papers), w AS (SELECT DISTINCT paper_key, digest FROM p), d AS (SELECT paper_key, digest FROM p WHERE r = 1 AND length(digest) > 0) SELECT digest = '' AS without_file, count(*) AS n FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.paper_key = w.paper_key AND d.digest = w.digest) GROUP BY 1",
}
