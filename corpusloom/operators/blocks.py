"""Blocks of converted documents: typing, projection, sections, and the figure and table metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Block type -> stream; any other type is of the stream other.
STREAMS = {
    "text": "prose", "table": "tables", "equation": "equations", "image": "figures", "chart": "figures", "list": "lists", "page_footnote": "footnotes",
    "header": "running_heads", "footer": "running_heads", "page_number": "page_numbers", "aside_text": "asides", "code": "code",
}
#: Words of a section title -> label, in the order in which they are tried.
SECTIONS = [
    ("abstract", r"^(abstract|summary|摘要)"),
    ("introduction", r"^(introduction|引言|绪论|前言)"),
    ("related", r"^(related work|background|literature|相关工作|文献综述)"),
    ("method", r"^(methods?|methodology|approach|model|preliminaries|problem|方法|模型)"),
    ("experiments", r"^(experiments?|evaluation|results?|实验|结果)"),
    ("discussion", r"^(discussion|limitations?|讨论)"),
    ("conclusion", r"^(conclusions?|结论|总结)"),
    ("references", r"^(references|bibliography|参考文献)"),
    ("appendix", r"^(appendix|supplement|附录)"),
]
DECLARED = r"^(?i:fig(?:ure)?|table|tab|图|表)\s*\.?\s*([0-9]+|[A-Z][0-9]*)"
NUMERIC_CELL = r"^\s*[<>≈~]?\s*[-+−±]?\s*\d[\d,]*(?:\.\d+)?\s*%?(?:\s*[±–—-]\s*\d[\d,.]*\s*%?)?\s*$"
LATEX_MARK = r"\\[A-Za-z]+|\$|[\^_]\{"
ROW, CELL, TAG = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[dh]([^>]*)>(.*?)</t[dh]>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def stream_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STREAMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(kind, F.lit(""))), F.lit("other"))


def plain_text(stream: Column, block: dict[str, Column]) -> Column:
    """The text that a block of a stream holds, normalised; empty where it has none."""
    text = F.coalesce(block["text_plain"], F.lit(""))
    return (
        F.when(stream == "tables", tx.html_to_text(F.coalesce(block["table_body"], F.lit(""))))
        .when(stream == "equations", tx.latex_to_text(text))
        .when(stream == "lists", tx.squeeze(F.concat_ws(" ", block["list_items"])))
        .when(stream == "code", F.coalesce(block["code_body"], F.lit("")))
        .when(stream == "figures", F.lit(""))
        .otherwise(tx.squeeze(text))
    )


def typed(blocks: DataFrame) -> DataFrame:
    """block_id, paper_key, block_index, kind by type, plain, raw_len, n_digits, has_caption, level."""
    stream = stream_of(F.col("type"))
    out = blocks.withColumn("stream", stream)
    cols = {c: F.col(c) for c in ("text_plain", "table_body", "list_items", "code_body")}
    plain = plain_text(F.col("stream"), cols)
    return out.select(
        "block_id", "paper_key", "block_index", "stream", plain.alias("plain"), F.col("text_level").alias("level"),
        F.length(F.trim(F.coalesce("caption", F.lit("")))).cast("bigint").alias("caption_chars"), "caption", "table_body",
    )


def newest(blocks: DataFrame) -> DataFrame:
    """One row per block_id: the latest delivery; equal times are settled by a hash of the columns given, so give only those needed."""
    order = Window.partitionBy("block_id").orderBy(F.col("loaded_at").desc(), F.xxhash64(F.to_json(F.struct(*blocks.columns))))
    return blocks.filter("block_id IS NOT NULL").withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def census(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stream: blocks, characters, digits and captions."""
    t = typed(blocks) if keys == ["paper_key"] else typed(blocks).drop("paper_key")
    return t.groupBy(*keys, "stream").agg(
        F.count("*").alias("n_blocks"),
        F.sum(F.length("plain")).cast("bigint").alias("n_chars"),
        F.sum(tx.n_digits(F.col("plain"))).cast("bigint").alias("n_digits"),
        F.sum((F.col("caption_chars") > 0).cast("bigint")).alias("n_captions"),
    )


def section_label(title: Column) -> Column:
    """The canonical label of a section title; an unknown title stands for itself."""
    bare = tx.normal_title(title)
    out = F.when(F.lit(False), "")
    for label, pattern in SECTIONS:
        out = out.when(bare.rlike(pattern), label)
    return out.otherwise(bare)


def with_sections(blocks: DataFrame, level: int = 2) -> DataFrame:
    """Every block with the label of the nearest heading of ``level`` before it (or at it), its position and the section's extent.

    A range lookup as a window over each paper, so no join. Blocks before the first heading have the label front; a null
    index comes first; equal indexes are ordered by block_id.
    """
    is_head = (F.col("level") == level) & (F.col("stream") == "prose")
    order = Window.partitionBy("paper_key").orderBy("block_index", "block_id")
    heads = F.last(F.when(is_head, section_label(F.col("plain"))), ignorenulls=True).over(order)
    no = F.sum(F.when(is_head, 1).otherwise(0)).over(order)
    return blocks.withColumn("section", F.coalesce(heads, F.lit("front"))).withColumn("section_no", no.cast("bigint")).withColumn("position", F.row_number().over(order).cast("bigint"))


def section_extents(sectioned: DataFrame) -> DataFrame:
    """paper_key, section_no, section, first_position, next_position, n_blocks."""
    parts = sectioned.groupBy("paper_key", "section_no", "section").agg(F.min("position").alias("first_position"), F.count("*").alias("n_blocks"))
    following = Window.partitionBy("paper_key").orderBy("section_no")
    return parts.withColumn("next_position", F.lead("first_position").over(following))


def table_rows(html: Column) -> Column:
    """array<array<struct<attributes, text>>>: the rows of an HTML table."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ROW), F.lit(1))
    return F.transform(
        rows,
        lambda r: F.transform(
            F.arrays_zip(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)).alias("a"), F.regexp_extract_all(r, F.lit(TAG), F.lit(1)).alias("t")),
            lambda c: F.struct(c["a"].alias("attributes"), tx.html_to_text(c["t"]).alias("text")),
        ),
    )


def span_of(attributes: Column, name: str) -> Column:
    return F.coalesce(F.regexp_extract(attributes, rf"(?i){name}\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1))


def table_shapes(tables: DataFrame, key: str = "block_id", html: str = "table_body") -> DataFrame:
    """key, n_rows, n_cells, n_columns (colspans counted), n_empty, n_numeric, n_latex, n_numeric_rows of each table."""
    cells = tables.select(key, *[c for c in ("paper_key",) if c in tables.columns], table_rows(F.col(html)).alias("rows"))
    flat = F.flatten("rows")
    numeric = lambda c: c["text"].rlike(NUMERIC_CELL)
    width = lambda r: F.aggregate(r, F.lit(0), lambda acc, c: acc + span_of(c["attributes"], "colspan"))
    heavy = lambda r: F.size(F.filter(r, numeric)) >= F.greatest(F.lit(1), F.floor(F.size(r) / 2).cast("int"))
    return cells.select(
        *[c for c in cells.columns if c != "rows"],
        F.size("rows").cast("bigint").alias("n_rows"),
        F.size(flat).cast("bigint").alias("n_cells"),
        F.coalesce(F.array_max(F.transform("rows", width)), F.lit(0)).cast("bigint").alias("n_columns"),
        F.size(F.filter(flat, lambda c: c["text"] == "")).cast("bigint").alias("n_empty"),
        F.size(F.filter(flat, numeric)).cast("bigint").alias("n_numeric"),
        F.size(F.filter(flat, lambda c: c["text"].rlike(LATEX_MARK))).cast("bigint").alias("n_latex"),
        F.size(F.filter("rows", lambda r: (F.size(r) > 0) & heavy(r))).cast("bigint").alias("n_numeric_rows"),
    )


def declared_number(caption: Column) -> Column:
    """The number that a caption declares, zeros stripped, letters in upper case; null for none."""
    raw = F.regexp_extract(F.trim(tx.ascii_digits(F.coalesce(caption, F.lit("")))), DECLARED, 1)
    return F.when(F.length(raw) > 0, F.regexp_replace(F.upper(raw), r"^0+(?=\d)", ""))


def mentions(text: Column, words: str) -> Column:
    """Distinct numbers mentioned as "Figure 3", "Figs. 2-4" and the like; ranges are expanded."""
    found = F.regexp_extract_all(tx.ascii_digits(text), F.lit(rf"(?i:{words})\s*\.?\s*(\d+(?:\s*[-–—~]\s*\d+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda f: tx.expand_range(f)))))


def all_mentions(text: Column, words: str) -> Column:
    found = F.regexp_extract_all(tx.ascii_digits(text), F.lit(rf"(?i:{words})\s*\.?\s*(\d+(?:\s*[-–—~]\s*\d+)?)"), F.lit(1))
    return F.flatten(F.transform(found, lambda f: tx.expand_range(f)))


def reference_consistency(blocks: DataFrame, stream: str, words: str) -> DataFrame:
    """paper_key, declared, referenced, shared, dangling, uncited, jaccard of the captions' and the prose's numbers.

    Both sides are reduced to distinct numbers before they meet, so a paper with many blocks moves few rows.
    """
    declared = (
        blocks.filter(F.col("stream") == stream)
        .select("paper_key", declared_number(F.col("caption")).try_cast("int").alias("n"), F.lit(1).alias("d"), F.lit(0).alias("r"))
        .filter("n IS NOT NULL").distinct()
    )
    prose = blocks.filter("stream = 'prose'").select("paper_key", F.explode(mentions(F.col("plain"), words)).alias("n"), F.lit(0).alias("d"), F.lit(1).alias("r")).distinct()
    both = declared.unionByName(prose).groupBy("paper_key", "n").agg(F.max("d").alias("d"), F.max("r").alias("r"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    d, r = F.col("d") == 1, F.col("r") == 1
    return both.groupBy("paper_key").agg(
        count(d).alias("declared"), count(r).alias("referenced"), count(d & r).alias("shared"), count(r & ~d).alias("dangling"), count(d & ~r).alias("uncited"),
        F.try_divide(count(d & r), F.count("*")).alias("jaccard"),
    )


def numbering(blocks: DataFrame, stream: str) -> DataFrame:
    """paper_key, n_declared, n_distinct, n_duplicate, n_missing (of 1 to the largest), value = 1 - duplicates' share."""
    declared = blocks.filter(F.col("stream") == stream).select("paper_key", declared_number(F.col("caption")).try_cast("int").alias("n")).filter("n IS NOT NULL")
    per = declared.groupBy("paper_key", "n").agg(F.count("*").alias("k"))
    return per.groupBy("paper_key").agg(
        F.sum("k").alias("n_declared"),
        F.count("*").alias("n_distinct"),
        (F.sum("k") - F.count("*")).alias("n_duplicate"),
        (F.max("n") - F.sum(F.when(F.col("n") >= 1, 1).otherwise(0))).cast("bigint").alias("n_missing"),
        (F.count("*") / F.sum("k")).alias("value"),
    )
