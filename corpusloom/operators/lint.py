"""Checks of Markdown drafts over a table of lines: headings, tables, numbers, citations and neighbours as findings.

``lines(doc_id, text)`` explodes texts into rows; every rule is a window over a document's lines, findings are
(doc_id, line_no, level, code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITATION = r"\[\d{1,4}(?:\s*[-,–]\s*\d{1,4})*+\]"
FENCE = r"^\s*(```|~~~)"
#: Words from which a section without a citation is a finding.
LONG_SECTION = 500


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line, in_code, heading_level, section_no: null texts have no lines."""
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    fences = F.sum(F.col("line").rlike(FENCE).cast("int")).over(order)
    coded = rows.withColumn("in_code", (fences % 2 == 1) | F.col("line").rlike(FENCE))
    level = F.when(~F.col("in_code") & F.col("line").rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1)))
    return coded.withColumn("heading_level", level).withColumn("section_no", F.sum(F.when(F.col("heading_level") == 1, 1).otherwise(0)).over(order).cast("bigint"))


def finding(rows: DataFrame, level: str, code: str) -> DataFrame:
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.lit(level).alias("level"), F.lit(code).alias("code"))


def heading_jumps(ls: DataFrame) -> DataFrame:
    """Headings more than one level below the heading before."""
    heads = ls.filter("heading_level IS NOT NULL")
    before = F.lag("heading_level", 1, 0).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return finding(heads.withColumn("b", before).filter(F.col("heading_level") > F.col("b") + 1), "warn", "HEADING_JUMP")


def table_columns(ls: DataFrame) -> DataFrame:
    """Rows of a pipe table whose number of cells isn't that of the first row of their run; tables with merge marks are left alone."""
    piped = ls.filter(~F.col("in_code") & F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = piped.withColumn("run", island).withColumn("cells", F.size(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|")))
    run = Window.partitionBy("doc_id", "run")
    first = F.first("cells").over(run.orderBy("line_no"))
    merged = F.max(F.col("line").rlike(r"<<\d|\^\^").cast("int")).over(run)
    return finding(rows.withColumn("f", first).withColumn("m", merged).filter("m = 0 AND cells <> f"), "error", "TABLE_COLUMNS")


def uncited_sections(ls: DataFrame, least: int = LONG_SECTION) -> DataFrame:
    """First lines of first-level sections of ``least`` words or more without a citation."""
    words = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    per = ls.filter("NOT in_code").groupBy("doc_id", "section_no").agg(F.min("line_no").alias("line_no"), F.sum(words).alias("w"), F.max(F.col("line").rlike(CITATION).cast("int")).alias("c"))
    return finding(per.filter(f"w >= {least} AND c = 0"), "warn", "NO_CITATION")


def lonely_blocks(ls: DataFrame, pattern: str = r"^\s*(?:!\[|\|)") -> DataFrame:
    """Images and tables without a line of text before or after them: the nearest lines that aren't blank are looked up."""
    block = F.col("line").rlike(pattern)
    text = F.when(~F.col("in_code") & (F.trim("line") != "") & ~block & F.col("heading_level").isNull(), F.col("line_no"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.last(text, ignorenulls=True).over(order)
    after = F.first(text, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    starts = block & ~F.coalesce(F.lag(block).over(order), F.lit(False))
    return finding(ls.withColumn("s", starts).withColumn("b", before).withColumn("a", after).filter("s AND NOT in_code AND (b IS NULL OR a IS NULL)"), "warn", "NO_TEXT_AROUND")


def successor(number: Column) -> Column:
    """The whole number after one, both as digits without leading zeros: 0 is the empty string, and there may be more digits than any numeric type holds."""
    kept = F.rtrim(number, F.lit("9"))  # the nines become zeros, the digit before them grows
    grown = F.when(kept == "", "1").otherwise(F.concat(F.substring(kept, F.lit(1), F.length(kept) - 1), F.translate(F.right(kept, F.lit(1)), "012345678", "123456789")))
    return F.concat(grown, F.repeat(F.lit("0"), F.length(number) - F.length(kept)))


def numbered_headings(ls: DataFrame) -> DataFrame:
    """Numbered headings whose last number doesn't follow the one before under the same parent number."""
    number = F.regexp_extract("line", r"^#{1,6}\s+(\d+(?:\.\d+)*+)", 1)  # possessive: an ordinary group repeats by recursion, which deep numbers exhaust
    heads = ls.filter("heading_level IS NOT NULL").withColumn("number", number).filter("number <> ''")
    parent, own = F.regexp_replace("number", r"\.?\d+$", ""), F.ltrim(F.regexp_extract("number", r"(\d+)$", 1), F.lit("0"))
    split = heads.withColumn("parent", parent).withColumn("own", own)
    before = F.lag("own", 1, "").over(Window.partitionBy("doc_id", "heading_level", "parent").orderBy("line_no"))
    return finding(split.withColumn("b", before).filter(F.col("own") != successor(F.col("b"))), "error", "HEADING_NUMBER")


def lint(docs: DataFrame) -> DataFrame:
    ls = lines(docs)
    out = heading_jumps(ls)
    for rule in (table_columns, uncited_sections, lonely_blocks, numbered_headings):
        out = out.unionByName(rule(ls))
    return out


def line_of(offset: Column, text: Column) -> Column:
    """The line, from 1, that a code-point offset lies in."""
    return F.regexp_count(F.substring(text, F.lit(1), offset.cast("int")), F.lit("\n")) + 1
