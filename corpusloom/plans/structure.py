"""Queries of the block, table, numbering and section operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.functions import text as tx
from corpusloom.operators import blocks as bl
from corpusloom.operators import checks
from corpusloom.session import table


TYPED = ["block_id", "paper_key", "block_index", "type", "text_plain", "text_level", "list_items", "code_body", "table_body", "caption"]


def _newest(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return bl.newest(table(spark, sf_dir, "blocks").select(*columns, "loaded_at"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.typed(_newest(spark, sf_dir, TYPED))


def _light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks with the lengths of their texts and only the headings' texts: what the windows over a paper sort."""
    t = _typed(spark, sf_dir)
    return t.select("block_id", "paper_key", "block_index", "stream", "level", F.length("plain").cast("bigint").alias("n_chars"), F.when(F.col("level") == 2, F.col("plain")).alias("plain"))


def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks")
    return b.groupBy("type", "kind", bl.stream_of(F.col("type")).alias("stream")).agg(F.count("*").alias("n_blocks"))


def block_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks").select("block_id", "paper_key", "block_index", "type", "text_plain", "text_level", "list_items", "code_body", "table_body", "caption")
    return bl.census(b, ["paper_key"])


def census_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = block_census(spark, sf_dir)
    return per.groupBy("stream").agg(F.count("*").alias("n_papers"), *[F.sum(c).alias(c) for c in ("n_blocks", "n_chars", "n_digits", "n_captions")])


def newest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _newest(spark, sf_dir, ["block_id", "corpus_name", "paper_key"])
    return b.groupBy("corpus_name").agg(F.count("*").alias("n_blocks"), F.count_distinct("paper_key").alias("n_papers"), F.max("loaded_at").cast("timestamp_ntz").alias("last_load"))


def caption_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captioned share of figures and tables, and the upper-middle caption length, by paper."""
    t = table(spark, sf_dir, "blocks").filter(F.col("kind").isin("figures", "tables")).select("paper_key", F.length(F.trim(F.coalesce("caption", F.lit("")))).cast("bigint").alias("size"))
    share = t.groupBy("paper_key").agg(F.count("*").alias("n_assets"), F.round(F.avg((F.col("size") > 0).cast("double")), 6).alias("caption_share"))
    q = stats.ranked_quantiles(t.filter("size > 0"), ["paper_key"], "size", {"median_chars": ("upper", 0.5)})
    return share.join(q, "paper_key", "left")


def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "blocks").filter("kind = 'tables'").select("block_id", "paper_key", "table_body").distinct()
    return bl.table_shapes(t)


def table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a paper: missing bodies, empty, numeric and LaTeX cell shares, numeric row share."""
    s = table_shapes(spark, sf_dir)
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), 6)
    return s.groupBy("paper_key").agg(
        F.count("*").alias("n_tables"), F.round(F.avg((F.col("n_cells") == 0).cast("double")), 6).alias("missing_body"), ratio("n_empty", "n_cells").alias("empty_cells"),
        ratio("n_numeric", "n_cells").alias("numeric_cells"), ratio("n_latex", "n_cells").alias("latex_cells"), ratio("n_numeric_rows", "n_rows").alias("numeric_rows"),
    )


def block_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and characters by section label: the nearest second-level heading before a block."""
    s = bl.with_sections(_light(spark, sf_dir))
    return s.groupBy("section").agg(F.count("*").alias("n_blocks"), F.count_distinct("paper_key").alias("n_papers"), F.sum("n_chars").alias("n_chars"))


def section_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section labels with the papers that have them, their mean share of blocks and averaged-middle position."""
    s = bl.with_sections(_light(spark, sf_dir))
    parts = bl.section_extents(s).join(s.groupBy("paper_key").agg(F.count("*").alias("total")), "paper_key")
    return parts.groupBy("section").agg(F.count_distinct("paper_key").alias("n_papers"), F.round(F.percentile("section_no", F.lit(0.5)), 6).alias("median_no"), F.round(F.avg(F.col("n_blocks") / F.col("total")), 6).alias("mean_share"))


def asset_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bl.with_sections(_light(spark, sf_dir)).filter(F.col("stream").isin("figures", "tables", "equations"))
    return s.groupBy("section", "stream").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "section", "stream")


def table_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section with most tables of each paper (the first by name of equals) and its share."""
    s = bl.with_sections(_light(spark, sf_dir)).filter("stream = 'tables'").groupBy("paper_key", "section").agg(F.count("*").alias("n"))
    best = s.groupBy("paper_key").agg(F.min_by(F.struct("section", "n"), F.struct(-F.col("n"), F.col("section"))).alias("b"), F.sum("n").alias("n_tables"))
    return best.select("paper_key", F.col("b.section").alias("section"), F.round(F.col("b.n") / F.col("n_tables"), 6).alias("share"), "n_tables")


def figure_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _typed(spark, sf_dir)
    r = bl.reference_consistency(t, "figures", "figures?|figs?|abbildung|figura|图|図")
    return r.withColumn("jaccard", F.round("jaccard", 6))


def table_reference_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each declared table number in the prose; the paper's value is the upper middle."""
    t = _typed(spark, sf_dir)
    declared = t.filter("stream = 'tables'").select("paper_key", bl.declared_number(F.col("caption")).try_cast("int").alias("n")).filter("n IS NOT NULL").distinct()
    said = t.filter("stream = 'prose'").select("paper_key", F.explode(bl.all_mentions(F.col("plain"), "tables?|tabelle|tableau|tabla|表")).alias("n")).groupBy("paper_key", "n").agg(F.count("*").alias("k"))
    per = declared.join(said, ["paper_key", "n"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return per.groupBy("paper_key").agg(F.count("*").alias("n_declared"), F.sum("k").alias("n_mentions")).join(stats.ranked_quantiles(per, ["paper_key"], "k", {"depth": ("upper", 0.5)}), "paper_key")


def figure_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.numbering(_typed(spark, sf_dir), "figures").withColumn("value", F.round("value", 6))


def block_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose blocks of a paper whose index isn't the next one."""
    b = _newest(spark, sf_dir, ["block_id", "paper_key", "block_index", "kind"]).filter("kind = 'prose'").select("paper_key", (F.col("block_index") + 1).alias("number"), "block_id")
    return checks.continuity(b, ["paper_key"], "number", ["number", "block_id"]).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("paper_key").alias("n_papers"))


def running_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a paper with their occurrence and total, in paper order."""
    b = _newest(spark, sf_dir, ["block_id", "paper_key", "block_index", "img_path"]).filter("img_path IS NOT NULL").select("paper_key", "img_path", "block_index", "block_id")
    same = Window.partitionBy("paper_key", "img_path")
    out = b.select("paper_key", "img_path", "block_id", F.row_number().over(same.orderBy("block_index", "block_id")).cast("bigint").alias("occurrence"), F.count("*").over(same).alias("n_same"))
    return out


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page whose boxes share more than half of the smaller one."""
    b = _newest(spark, sf_dir, ["block_id", "paper_key", "page_idx", "bbox"]).filter("size(bbox) = 4").select("paper_key", "page_idx", F.col("block_id").alias("id"), *[F.col("bbox")[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    found = checks.overlaps(b.filter("page_idx IS NOT NULL AND paper_key IS NOT NULL"), ["paper_key", "page_idx"]).filter("share > 0.5")
    return found.groupBy("paper_key").agg(F.count("*").alias("n_pairs"), F.round(F.max("share"), 6).alias("largest"))


def reference_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference blocks by paper: entries, dated ones, and the share within five years of the newest."""
    r = _newest(spark, sf_dir, ["block_id", "paper_key", "sub_type", "text_plain"]).filter("sub_type = 'ref_text'").select("paper_key", tx.first_year(F.col("text_plain")).alias("year"))
    newest = F.max("year").over(Window.partitionBy("paper_key"))
    near = r.withColumn("near", F.when(F.col("year").isNotNull(), (F.col("year") >= newest - 5).cast("double")))
    return near.groupBy("paper_key").agg(F.count("*").alias("n_entries"), F.count("year").alias("n_dated"), F.round(F.avg("near"), 6).alias("fresh_share"))


QUERIES = {
    f.__name__: f
    for f in (block_types, block_census, census_totals, newest_blocks, caption_coverage, table_shapes, table_metrics, block_sections, section_skeleton, asset_patterns, table_placement, figure_references,
              table_reference_depth, figure_numbering, block_continuity, running_index, box_overlaps, reference_years)
}

_STREAM = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in bl.STREAMS.items()) + " ELSE 'other' END"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"
_HTML = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ')".replace('\\"', '"')
_LATEX = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\[A-Za-z]+\*?', ' ', 'g'), '[$\{\}\\]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_HTML, _LATEX, _SQUEEZE = (x.replace("{0}", "@") for x in (_HTML, _LATEX, _SQUEEZE))
_PLAIN = f"""CASE {_STREAM} WHEN 'tables' THEN {_HTML.replace("@", "coalesce(table_body, '')")} WHEN 'equations' THEN {_LATEX.replace("@", "coalesce(text_plain, '')")}
 WHEN 'lists' THEN {_SQUEEZE.replace("@", "coalesce(array_to_string(list_items, ' '), '')")} WHEN 'code' THEN coalesce(code_body, '') WHEN 'figures' THEN '' ELSE {_SQUEEZE.replace("@", "coalesce(text_plain, '')")} END"""
_NEWEST = "nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC) AS rn FROM blocks WHERE block_id IS NOT NULL) WHERE rn = 1)"
_TYPED = f"{_NEWEST}, t AS (SELECT block_id, paper_key, block_index, {_STREAM} AS stream, {_PLAIN} AS plain, text_level AS level, caption, table_body FROM nb)"
_TITLE = r"lower(trim(regexp_replace(regexp_replace(trim(plain, ' '), '^(?:(?:\d+(?:\.\d+)*|[IVXivx]+|[A-Z])[.、)]?\s+)', ''), '[\s.:：。]+$', ''), ' '))"
_LABEL = "CASE " + " ".join(f"WHEN regexp_matches({_TITLE}, '{p}') THEN '{n}'" for n, p in bl.SECTIONS) + f" ELSE {_TITLE} END"
_SECTIONED = f"""{_TYPED}, h AS (SELECT *, CASE WHEN level = 2 AND stream = 'prose' THEN {_LABEL} END AS own FROM t),
 s AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER w, 'front') AS section, CAST(sum(CASE WHEN level = 2 AND stream = 'prose' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section_no FROM h WINDOW w AS (PARTITION BY paper_key ORDER BY block_index NULLS FIRST, block_id ROWS UNBOUNDED PRECEDING))"""
_NUM = r"CASE WHEN regexp_extract(trim(coalesce(caption, ''), ' '), '^(?i:fig(?:ure)?|table|tab|图|表)\s*\.?\s*([0-9]+|[A-Z][0-9]*)', 1) <> '' THEN TRY_CAST(upper(regexp_extract(trim(translate(coalesce(caption, ''), '０１２３４５６７８９', '0123456789'), ' '), '^(?i:fig(?:ure)?|table|tab|图|表)\s*\.?\s*([0-9]+|[A-Z][0-9]*)', 1)) AS INTEGER) END"


def _mention_sql(words: str) -> str:
    return rf"""mm AS (SELECT paper_key, block_id, unnest(regexp_extract_all(translate(plain, '０１２３４５６７８９', '0123456789'), '(?i:{words})\s*\.?\s*(\d+(?:\s*[-–—~]\s*\d+)?)', 1)) AS e FROM t WHERE stream = 'prose'),
 ab AS (SELECT paper_key, TRY_CAST(regexp_extract(e, '^\s*0*(\d+)', 1) AS INTEGER) AS a, TRY_CAST(nullif(regexp_extract(e, '[-–—~]\s*0*(\d+)\s*$', 1), '') AS INTEGER) AS b FROM mm),
 ex AS (SELECT paper_key, unnest(CASE WHEN a IS NULL THEN [] WHEN b IS NULL THEN [a] WHEN b >= a AND b - a < 50 THEN range(a, b + 1) ELSE [a, b] END) AS n FROM ab)"""


SQL = {
    "block_types": f"SELECT type, kind, {_STREAM} AS stream, count(*) AS n_blocks FROM blocks GROUP BY 1, 2, 3",
    "block_census": f"WITH t AS (SELECT paper_key, {_STREAM} AS stream, {_PLAIN} AS plain, caption FROM blocks) SELECT paper_key, stream, count(*) AS n_blocks, CAST(sum(length(plain)) AS BIGINT) AS n_chars, CAST(sum(len(regexp_extract_all(plain, '[0-9０-９]'))) AS BIGINT) AS n_digits, CAST(sum(CAST(length(trim(coalesce(caption, ''), ' ')) > 0 AS INT)) AS BIGINT) AS n_captions FROM t GROUP BY 1, 2",
    "newest_blocks": f"WITH {_NEWEST} SELECT corpus_name, count(*) AS n_blocks, count(DISTINCT paper_key) AS n_papers, max(loaded_at) AS last_load FROM nb GROUP BY 1",
    "caption_coverage": "WITH t AS (SELECT paper_key, length(trim(coalesce(caption, ''), ' ')) AS size FROM blocks WHERE kind IN ('figures', 'tables')), r AS (SELECT paper_key, size, row_number() OVER (PARTITION BY paper_key ORDER BY size) AS k, count(*) OVER (PARTITION BY paper_key) AS n FROM t WHERE size > 0), q AS (SELECT paper_key, max(CASE WHEN k = n // 2 + 1 THEN size END) AS median_chars FROM r GROUP BY 1), s AS (SELECT paper_key, count(*) AS n_assets, round(avg(CAST(size > 0 AS INT)), 6) AS caption_share FROM t GROUP BY 1) SELECT s.*, median_chars FROM s LEFT JOIN q USING (paper_key)",
    "block_sections": f"WITH {_SECTIONED} SELECT section, count(*) AS n_blocks, count(DISTINCT paper_key) AS n_papers, CAST(sum(length(plain)) AS BIGINT) AS n_chars FROM s GROUP BY 1",
    "section_skeleton": f"WITH {_SECTIONED}, p AS (SELECT paper_key, section_no, section, count(*) AS k FROM s GROUP BY ALL), n AS (SELECT paper_key, count(*) AS total FROM s GROUP BY 1) SELECT section, count(DISTINCT paper_key) AS n_papers, round(quantile_cont(section_no, 0.5), 6) AS median_no, round(avg(k / total), 6) AS mean_share FROM p JOIN n USING (paper_key) GROUP BY 1",
    "asset_patterns": f"WITH {_SECTIONED} SELECT section, stream, count(*) AS n FROM s WHERE stream IN ('figures', 'tables', 'equations') GROUP BY 1, 2",
    "table_placement": f"WITH {_SECTIONED}, c AS (SELECT paper_key, section, count(*) AS n FROM s WHERE stream = 'tables' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY n DESC, section) AS k, sum(n) OVER (PARTITION BY paper_key) AS n_tables FROM c) SELECT paper_key, section, round(n / n_tables, 6) AS share, CAST(n_tables AS BIGINT) AS n_tables FROM r WHERE k = 1",
    "figure_references": f"WITH {_TYPED}, {_mention_sql('figures?|figs?|abbildung|figura|图|図')}, d AS (SELECT DISTINCT paper_key, {_NUM} AS n FROM t WHERE stream = 'figures'), u AS (SELECT paper_key, n, max(d) AS d, max(r) AS r FROM (SELECT paper_key, n, 1 AS d, 0 AS r FROM d WHERE n IS NOT NULL UNION ALL SELECT paper_key, n, 0, 1 FROM ex) GROUP BY 1, 2) SELECT paper_key, CAST(sum(d) AS BIGINT) AS declared, CAST(sum(r) AS BIGINT) AS referenced, CAST(sum(d * r) AS BIGINT) AS shared, CAST(sum(r * (1 - d)) AS BIGINT) AS dangling, CAST(sum(d * (1 - r)) AS BIGINT) AS uncited, round(sum(d * r) / count(*), 6) AS jaccard FROM u GROUP BY 1",
    "table_reference_depth": f"WITH {_TYPED}, {_mention_sql('tables?|tabelle|tableau|tabla|表')}, d AS (SELECT DISTINCT paper_key, {_NUM} AS n FROM t WHERE stream = 'tables'), k AS (SELECT d.paper_key, d.n, count(ex.n) AS k FROM d LEFT JOIN ex ON d.paper_key = ex.paper_key AND d.n = ex.n WHERE d.n IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY k) AS i, count(*) OVER (PARTITION BY paper_key) AS c FROM k) SELECT paper_key, count(*) AS n_declared, CAST(sum(k) AS BIGINT) AS n_mentions, max(CASE WHEN i = c // 2 + 1 THEN k END) AS depth FROM r GROUP BY 1",
    "figure_numbering": f"WITH {_TYPED}, d AS (SELECT paper_key, {_NUM} AS n FROM t WHERE stream = 'figures'), p AS (SELECT paper_key, n, count(*) AS k FROM d WHERE n IS NOT NULL GROUP BY 1, 2) SELECT paper_key, CAST(sum(k) AS BIGINT) AS n_declared, count(*) AS n_distinct, CAST(sum(k) - count(*) AS BIGINT) AS n_duplicate, CAST(max(n) - sum(CASE WHEN n >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, round(count(*) / sum(k), 6) AS value FROM p GROUP BY 1",
    "block_continuity": f"WITH {_NEWEST}, l AS (SELECT paper_key, block_index + 1 AS number, coalesce(lag(block_index + 1) OVER (PARTITION BY paper_key ORDER BY block_index, block_id) + 1, 1) AS expected, count(*) OVER (PARTITION BY paper_key, block_index) > 1 AS again FROM nb WHERE block_index IS NOT NULL AND kind = 'prose'), p AS (SELECT paper_key, CASE WHEN number = expected THEN NULL WHEN again AND number < expected THEN 'duplicate' WHEN number > expected THEN 'gap' ELSE 'backward' END AS problem FROM l) SELECT problem, count(*) AS n, count(DISTINCT paper_key) AS n_papers FROM p WHERE problem IS NOT NULL GROUP BY 1",
    "running_index": f"WITH {_NEWEST} SELECT * FROM (SELECT paper_key, img_path, block_id, row_number() OVER (PARTITION BY paper_key, img_path ORDER BY block_index, block_id) AS occurrence, count(*) OVER (PARTITION BY paper_key, img_path) AS n_same FROM nb WHERE img_path IS NOT NULL)",
    "box_overlaps": f"""WITH {_NEWEST}, b AS (SELECT paper_key, page_idx, block_id AS id, CAST(bbox[1] AS DOUBLE) AS x1, CAST(bbox[2] AS DOUBLE) AS y1, CAST(bbox[3] AS DOUBLE) AS x2, CAST(bbox[4] AS DOUBLE) AS y2 FROM nb WHERE len(bbox) = 4 AND page_idx IS NOT NULL),
 k AS (SELECT * FROM b WHERE x2 > x1 AND y2 > y1),
 p AS (SELECT a.paper_key, (least(a.x2, c.x2) - greatest(a.x1, c.x1)) * (least(a.y2, c.y2) - greatest(a.y1, c.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (c.x2 - c.x1) * (c.y2 - c.y1)) AS share FROM k a JOIN k c ON a.paper_key = c.paper_key AND a.page_idx = c.page_idx AND a.id < c.id AND a.x1 < c.x2 AND c.x1 < a.x2 AND a.y1 < c.y2 AND c.y1 < a.y2)
 SELECT paper_key, count(*) AS n_pairs, round(max(share), 6) AS largest FROM p WHERE share > 0.5 GROUP BY 1""",
    "reference_years": rf"WITH {_NEWEST}, y AS (SELECT paper_key, TRY_CAST(nullif(regexp_extract(text_plain, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[a-z]?(?:[^0-9]|$))', 1), '') AS INTEGER) AS year FROM nb WHERE sub_type = 'ref_text'), m AS (SELECT *, max(year) OVER (PARTITION BY paper_key) AS newest FROM y) SELECT paper_key, count(*) AS n_entries, count(year) AS n_dated, round(avg(CASE WHEN year IS NOT NULL THEN CAST(year >= newest - 5 AS INT) END), 6) AS fresh_share FROM m GROUP BY 1",
}
SQL["census_totals"] = "WITH p AS (" + SQL["block_census"] + ") SELECT stream, count(*) AS n_papers, CAST(sum(n_blocks) AS BIGINT) AS n_blocks, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(n_digits) AS BIGINT) AS n_digits, CAST(sum(n_captions) AS BIGINT) AS n_captions FROM p GROUP BY 1"
_ROWS = f"""r0 AS (SELECT DISTINCT block_id, paper_key, table_body FROM blocks WHERE kind = 'tables'), r1 AS (SELECT block_id, paper_key, regexp_extract_all(coalesce(table_body, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1) AS rs FROM r0),
 r2 AS (SELECT block_id, paper_key, len(rs) AS n_rows, unnest(rs) AS r FROM r1),
 r3 AS (SELECT block_id, regexp_extract_all(r, '(?is)<t[dh]([^>]*)>(.*?)</t[dh]>', 1) AS attrs, list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: {_HTML.replace("@", "c")}) AS tx FROM r2),
 r4 AS (SELECT block_id, len(tx) AS c, coalesce(list_sum(list_transform(attrs, lambda a: coalesce(TRY_CAST(nullif(regexp_extract(a, '(?i)colspan\\s*=\\s*[\"'']?(\\d+)', 1), '') AS INTEGER), 1))), 0) AS w, len(list_filter(tx, lambda c: c = '')) AS e, len(list_filter(tx, lambda c: regexp_matches(c, '{bl.NUMERIC_CELL}'))) AS n, len(list_filter(tx, lambda c: regexp_matches(c, '{bl.LATEX_MARK}'))) AS l FROM r3)""".replace('\\"', '"')
SQL["table_shapes"] = f"WITH {_ROWS} SELECT r1.block_id, r1.paper_key, CAST(len(rs) AS BIGINT) AS n_rows, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_cells, CAST(coalesce(max(w), 0) AS BIGINT) AS n_columns, CAST(coalesce(sum(e), 0) AS BIGINT) AS n_empty, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_numeric, CAST(coalesce(sum(l), 0) AS BIGINT) AS n_latex, CAST(coalesce(sum(CASE WHEN c > 0 AND n >= greatest(1, c // 2) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_numeric_rows FROM r1 LEFT JOIN r4 USING (block_id) GROUP BY r1.block_id, r1.paper_key, rs"
SQL["table_metrics"] = "WITH s AS (" + SQL["table_shapes"] + ") SELECT paper_key, count(*) AS n_tables, round(avg(CAST(n_cells = 0 AS INT)), 6) AS missing_body, round(sum(n_empty) / nullif(sum(n_cells), 0), 6) AS empty_cells, round(sum(n_numeric) / nullif(sum(n_cells), 0), 6) AS numeric_cells, round(sum(n_latex) / nullif(sum(n_cells), 0), 6) AS latex_cells, round(sum(n_numeric_rows) / nullif(sum(n_rows), 0), 6) AS numeric_rows FROM s GROUP BY 1"
