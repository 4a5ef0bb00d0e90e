"""Queries of the draft linter, evidence, terms, references and trees, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import blocks as bl
from corpusloom.operators import evidence as ev
from corpusloom.operators import lint as li
from corpusloom.operators import metrics
from corpusloom.plans.structure import _NEWEST, _light, _newest
from corpusloom.session import table, texts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", "text", "source", "section")


def draft_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.lint(_docs(spark, sf_dir))


def findings_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft_findings(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source", "level", "code").agg(F.count("*").alias("n"))


def draft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = li.lines(_docs(spark, sf_dir))
    return ls.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("heading_level").alias("n_headings"), F.sum(F.col("in_code").cast("bigint")).alias("n_code"), F.max("section_no").alias("n_sections"))


def hedge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.phrase_evidence(_docs(spark, sf_dir), "M-HED-14", metrics.LEXICONS["M-HED-14"])


def evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of evidence spans that slice back from their text."""
    return ev.traced(hedge_evidence(spark, sf_dir), _docs(spark, sf_dir))


def term_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.term_clusters(_docs(spark, sf_dir).filter(tx.language(F.col("text")) == "zh"))


def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers cited in a paper's prose against its reference blocks."""
    b = _newest(spark, sf_dir, ["block_id", "paper_key", "kind", "sub_type", "text_plain"])
    cited = b.filter("kind = 'prose' AND text_plain IS NOT NULL").select("paper_key", F.explode(tx.cited_numbers(F.col("text_plain"))).alias("n")).distinct()
    numbers = cited.groupBy(F.col("paper_key").alias("doc_id")).agg(F.array_sort(F.collect_set("n")).alias("numbers"))  # distinct numbers of up to four digits
    listed = b.filter("sub_type = 'ref_text'").groupBy(F.col("paper_key").alias("doc_id")).agg(F.count("*").alias("n_entries"))
    return ev.reference_links(numbers, listed)


def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _newest(spark, sf_dir, ["block_id", "kind", "text_plain"]).filter("text_plain IS NOT NULL")
    return b.groupBy("kind").agg(F.count("*").alias("n_blocks"), F.sum(ev.is_reference(F.col("text_plain")).cast("bigint")).alias("n_reference_like"))


def corpus_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.unique_slugs(table(spark, sf_dir, "part").select("p_name"), "p_name")


def heading_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _newest(spark, sf_dir, ["block_id", "paper_key", "kind", "text_level", "block_index"]).filter("kind = 'prose' AND text_level BETWEEN 1 AND 6 AND block_index IS NOT NULL").groupBy(F.col("paper_key").alias("doc_id"), F.col("block_index").alias("pos")).agg(F.min("text_level").alias("level"))
    return ev.heading_tree(b)


def longest_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest paragraphs of each draft, by words, then by place."""
    p = table(spark, sf_dir, "paragraphs").select("draft_key", "para_index", "para_id", F.coalesce(tx.n_tokens(F.col("text")), F.lit(0)).alias("size")).distinct()
    order = Window.partitionBy("draft_key").orderBy(F.col("size").desc(), "para_index", "para_id")
    return p.withColumn("rank", F.row_number().over(order).cast("bigint")).filter("rank <= 3").select("draft_key", "para_id", "size", "rank")


def section_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that more than 70 % of the papers have."""
    s = bl.with_sections(_light(spark, sf_dir)).filter("section <> 'front'").select("paper_key", "section").distinct()
    n = table(spark, sf_dir, "blocks").filter("block_id IS NOT NULL").agg(F.count_distinct("paper_key").alias("total")).first()["total"]
    per = s.groupBy("section").agg(F.count("*").alias("n_papers"))
    return per.withColumn("share", F.round(F.col("n_papers") / F.lit(max(1, n)), 6)).withColumn("skewed", F.col("share") > 0.7)


def language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued: true if all assessed papers are supported, false if one isn't, null if none was assessed."""
    p = table(spark, sf_dir, "papers").select("corpus_name", "paper_key", F.when(F.col("cjk_ratio").isNull(), None).otherwise(F.col("language").isin("en", "zh")).alias("ok")).distinct()
    return p.groupBy("corpus_name").agg(F.count("*").alias("n_papers"), F.count("ok").alias("n_assessed"), F.bool_and("ok").alias("supported"))


def prose_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prose filter keeps and drops, with blocks and characters by reason."""
    b = _newest(spark, sf_dir, ["block_id", "kind", "text_level", "text_plain"])
    t = F.coalesce("text_plain", F.lit(""))
    reason = (
        F.when(F.col("kind") != "prose", "not_prose").when(F.coalesce("text_level", F.lit(0)) >= 1, "heading").when(F.trim(t) == "", "blank")
        .when(t.rlike(r"(?i)^\s*(?:keywords?|key\s+words|关键词|关键字)\s*[:：]"), "keywords").otherwise("kept")
    )
    return b.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_blocks"), F.sum(F.length(t)).cast("bigint").alias("n_chars"))


def plain_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length(ev.markdown_to_text(F.col("text"))).cast("bigint").alias("plain_len"), F.md5(ev.markdown_to_text(F.col("text"))).alias("plain_md5"))


QUERIES = {
    f.__name__: f
    for f in (draft_findings, findings_by_source, draft_lines, hedge_evidence, evidence_trace, term_clusters, reference_links, reference_entries, corpus_slugs, heading_trees, longest_paragraphs, section_skew,
              language_coverage, prose_ledger, plain_markdown)
}

_LINES = r"""r0 AS (SELECT doc_id, source, string_split_regex(text, '\r?\n') AS ls FROM documents WHERE text IS NOT NULL),
 r1 AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM r0),
 r2 AS (SELECT *, sum(CAST(regexp_matches(line, '^\s*(```|~~~)') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 OR regexp_matches(line, '^\s*(```|~~~)') AS in_code FROM r1),
 r3 AS (SELECT *, CASE WHEN NOT in_code AND regexp_matches(line, '^#{1,6}\s+\S') THEN length(regexp_extract(line, '^(#{1,6})', 1)) END AS heading_level FROM r2),
 ls AS (SELECT *, CAST(sum(CASE WHEN heading_level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section_no FROM r3)"""
_FIND = (
    _LINES
    + r""", h AS (SELECT doc_id, line_no, heading_level, lag(heading_level, 1, 0) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM ls WHERE heading_level IS NOT NULL),
 p0 AS (SELECT doc_id, line_no, line, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run, len(string_split(replace(regexp_replace(trim(line, ' '), '^\||\|$', '', 'g'), '\|', ''), '|')) AS cells FROM ls WHERE NOT in_code AND regexp_matches(line, '^\s*\|.*\|\s*$')),
 p1 AS (SELECT *, first_value(cells) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS f, max(CAST(regexp_matches(line, '<<\d|\^\^') AS INT)) OVER (PARTITION BY doc_id, run) AS m FROM p0),
 u AS (SELECT doc_id, section_no, min(line_no) AS line_no, sum(len(list_filter(string_split_regex(line, '\s+'), lambda w: w <> ''))) AS w, max(CAST(regexp_matches(line, '\[\d{1,4}(?:\s*[-,–]\s*\d{1,4})*\]') AS INT)) AS c FROM ls WHERE NOT in_code GROUP BY 1, 2),
 l0 AS (SELECT *, regexp_matches(line, '^\s*(?:!\[|\|)') AS blk FROM ls),
 l1 AS (SELECT *, CASE WHEN NOT in_code AND trim(line, ' ') <> '' AND NOT blk AND heading_level IS NULL THEN line_no END AS t FROM l0),
 l2 AS (SELECT *, max(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS b, min(t) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a, coalesce(lag(blk) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS pb FROM l1),
 n0 AS (SELECT doc_id, line_no, heading_level, regexp_extract(line, '^#{1,6}\s+(\d+(?:\.\d+)*)', 1) AS number FROM ls WHERE heading_level IS NOT NULL),
 n1 AS (SELECT *, CAST(regexp_extract(number, '(\d+)$', 1) AS INT) AS own, regexp_replace(number, '\.?\d+$', '') AS parent FROM n0 WHERE number <> ''),
 n2 AS (SELECT *, lag(own, 1, 0) OVER (PARTITION BY doc_id, heading_level, parent ORDER BY line_no) AS b FROM n1),
 fd AS (SELECT doc_id, line_no, 'warn' AS level, 'HEADING_JUMP' AS code FROM h WHERE heading_level > b + 1 UNION ALL SELECT doc_id, line_no, 'error', 'TABLE_COLUMNS' FROM p1 WHERE m = 0 AND cells <> f
  UNION ALL SELECT doc_id, line_no, 'warn', 'NO_CITATION' FROM u WHERE w >= 500 AND c = 0 UNION ALL SELECT doc_id, line_no, 'warn', 'NO_TEXT_AROUND' FROM l2 WHERE blk AND NOT pb AND NOT in_code AND (a IS NULL OR b IS NULL)
  UNION ALL SELECT doc_id, line_no, 'error', 'HEADING_NUMBER' FROM n2 WHERE own <> b + 1)"""
)
_W = "[A-Za-z][A-Za-z''-]*"
SQL = {
    "draft_findings": f"WITH {_FIND} SELECT doc_id, line_no, level, code FROM fd",
    "findings_by_source": f"WITH {_FIND} SELECT source, level, code, count(*) AS n FROM fd JOIN documents USING (doc_id) GROUP BY 1, 2, 3",
    "draft_lines": f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(heading_level) AS n_headings, CAST(sum(CAST(in_code AS INT)) AS BIGINT) AS n_code, max(section_no) AS n_sections FROM ls GROUP BY 1",
    "reference_entries": f"WITH {_NEWEST} SELECT kind, count(*) AS n_blocks, CAST(sum(CAST((regexp_matches(t, '^\\s*\\[\\d{{1,4}}\\]\\s*\\S') AND (y OR m)) OR (regexp_matches(t, '^\\s*[A-Z][\\w''-]+,\\s+(?:[A-Z]\\.\\s*)+') AND y) OR (m AND y) AS INT)) AS BIGINT) AS n_reference_like FROM (SELECT kind, text_plain AS t, regexp_matches(text_plain, '(?:19|20)\\d{{2}}') AS y, regexp_matches(text_plain, '(?i)doi:|https?://|arxiv|vol\\.|pp\\.|\\[[JMCD]\\]') AS m FROM nb WHERE text_plain IS NOT NULL) GROUP BY 1",
    "longest_paragraphs": f"WITH p AS (SELECT DISTINCT draft_key, para_index, para_id, coalesce(len(regexp_extract_all(text, '{_W}')), 0) AS size FROM paragraphs), r AS (SELECT *, row_number() OVER (PARTITION BY draft_key ORDER BY size DESC, para_index, para_id) AS rank FROM p) SELECT draft_key, para_id, CAST(size AS BIGINT) AS size, rank FROM r WHERE rank <= 3",
    "language_coverage": "WITH p AS (SELECT DISTINCT corpus_name, paper_key, CASE WHEN cjk_ratio IS NOT NULL THEN language IN ('en', 'zh') END AS ok FROM papers) SELECT corpus_name, count(*) AS n_papers, count(ok) AS n_assessed, bool_and(ok) AS supported FROM p GROUP BY 1",
    "prose_ledger": f"WITH {_NEWEST} SELECT CASE WHEN kind <> 'prose' THEN 'not_prose' WHEN coalesce(text_level, 0) >= 1 THEN 'heading' WHEN trim(coalesce(text_plain, ''), ' ') = '' THEN 'blank' WHEN regexp_matches(coalesce(text_plain, ''), '(?i)^\\s*(?:keywords?|key\\s+words|关键词|关键字)\\s*[:：]') THEN 'keywords' ELSE 'kept' END AS reason, count(*) AS n_blocks, CAST(sum(length(coalesce(text_plain, ''))) AS BIGINT) AS n_chars FROM nb GROUP BY 1",
    "heading_trees": f"WITH {_NEWEST}, h AS (SELECT paper_key AS doc_id, block_index AS pos, min(text_level) AS level FROM nb WHERE kind = 'prose' AND text_level BETWEEN 1 AND 6 AND block_index IS NOT NULL GROUP BY 1, 2) SELECT a.doc_id, a.pos, a.level, max(b.pos) AS parent_pos FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY 1, 2, 3",
    "corpus_slugs": r"WITH s AS (SELECT DISTINCT p_name, regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS stem FROM part) SELECT p_name, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN stem || '-' || substring(sha256(p_name), 1, 6) ELSE stem END AS slug FROM s",
    "plain_markdown": r"""WITH m AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)', '', 'g'), '[*_`|]+', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS p FROM documents)
 SELECT doc_id, CAST(length(p) AS BIGINT) AS plain_len, md5(p) AS plain_md5 FROM m""",
}
