"""Readers that turn files into block rows: block lists in JSON, Markdown, plain text and Word documents.

Every reader is a scan of files followed by one narrow map; nothing passes through the driver. Broken files are rows of
a ledger, never dropped in silence.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_LIST = T.ArrayType(
    T.StructType(
        [
            *[T.StructField(n, T.StringType()) for n in ("type", "sub_type", "text")],
            T.StructField("text_level", T.IntegerType()),
            T.StructField("text_format", T.StringType()),
            T.StructField("list_items", T.ArrayType(T.StringType())),
            *[T.StructField(n, T.StringType()) for n in ("code_body", "table_body", "img_path")],
            *[T.StructField(f"{n}_caption", T.ArrayType(T.StringType())) for n in ("image", "table", "chart", "code")],
            T.StructField("bbox", T.ArrayType(T.IntegerType())),
            T.StructField("page_idx", T.IntegerType()),
        ]
    )
)
BLOCKS = T.StructType(
    [
        T.StructField("doc", T.StringType()),
        T.StructField("block_index", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("table_body", T.StringType()),
    ]
)


def files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, content, sha256 of the files below a folder, by name pattern."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return read.select("path", "content", F.sha2("content", 256).alias("sha256"))


def discover(spark: SparkSession, folder: str, glob: str = "*_content_list.json") -> tuple[DataFrame, DataFrame]:
    """(doc, path, sha256 of the first file by path of each document; skipped: doc, reason) of a corpus folder.

    A document is a folder right below ``folder``; one without a matching file is skipped with a reason.
    """
    base = re.escape(folder.rstrip("/").removeprefix("file:"))
    doc = lambda c: F.regexp_extract(c, rf"^(?:file:/*)?/?{base.lstrip('/')}/([^/]+)/", 1)
    found = files(spark, folder, glob).select(doc(F.col("path")).alias("doc"), "path", "sha256").filter("doc <> ''")
    first = found.groupBy("doc").agg(F.min_by(F.struct("path", "sha256"), "path").alias("f")).select("doc", "f.path", "f.sha256")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(doc(F.col("path")).alias("doc")).filter("doc <> ''").distinct()
    skipped = every.join(first, "doc", "left_anti").select("doc", F.lit("no block list").alias("reason"))
    return first, skipped


def read_block_lists(spark: SparkSession, folder: str, glob: str = "*_content_list.json") -> tuple[DataFrame, DataFrame]:
    """(one row a block with path and block_index; ledger of files that hold no list: path, reason)."""
    raw = files(spark, folder, glob).select("path", F.decode("content", "UTF-8").alias("json"))
    parsed = raw.select("path", F.from_json("json", BLOCK_LIST).alias("blocks"), F.trim("json").startswith("[").alias("is_list"))
    rows = parsed.filter("is_list AND blocks IS NOT NULL").select("path", F.posexplode("blocks").alias("block_index", "b")).select("path", "block_index", "b.*")
    broken = parsed.filter("NOT is_list OR blocks IS NULL").select("path", F.when(F.col("is_list"), "not valid JSON").otherwise("not a list").alias("reason"))
    captions = F.filter(F.flatten(F.array(*[F.coalesce(F.col(f"{n}_caption"), F.array().cast("array<string>")) for n in ("image", "table", "chart", "code")])), lambda x: x.isNotNull())
    return rows.withColumn("caption", F.array_join(captions, " ")), broken


def front_matter(text: str) -> tuple[str, str]:
    """(body, YAML header) of a Markdown text; no header gives an empty one."""
    if not text.startswith("---"):
        return text, ""
    end = re.search(r"\n(?:---|\.\.\.)[ \t]*(?:\n|$)", text[3:])
    return (text[3 + end.end() :], text[3 : 3 + end.start()].strip()) if end else (text, "")


def pipe_cells(line: str) -> list[str]:
    """Cells of a pipe-table row; escaped pipes stay in their cell."""
    bare = line.strip()
    bare = bare[1:] if bare.startswith("|") else bare
    cells = re.split(r"(?<!\\)\|", bare)
    if cells and not cells[-1].strip():
        cells.pop()
    return [c.replace("\\|", "|").strip() for c in cells]


def merge_parts(cell: str) -> tuple[str, int, int]:
    """(text, columns, rows) of a cell: marks close it ("text ^^2 <<3"); a bare "^^" goes on the cell above and has no rows."""
    text, wide, tall = cell.strip(), 1, 1
    if span := re.fullmatch(r"(.*?)\s*<<(\d+)", text, re.S):
        text, wide = span.group(1), max(1, int(span.group(2)))
    if text == "^^":
        return "", 1, 0
    if span := re.fullmatch(r"(.*?)\s*\^\^(\d+)", text, re.S):
        text, tall = span.group(1), max(1, int(span.group(2)))
    return text, wide, tall


def grid_html(grid: list[list[str]]) -> str:
    """An HTML table of a grid; a closing "<<n" spans n columns, "^^n" n rows, a bare "^^" goes on the cell above.

    Placeholders (bare or empty cells) under a span are covered by it; a span ends with the grid.
    """
    parsed = [[merge_parts(x) for x in row] for row in grid]
    height = len(grid)
    gone: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(parsed):
        cells = []
        c = 0
        while c < len(row):
            text, wide, rows = row[c]
            if (r, c) in gone or rows == 0:
                c += 1
                continue
            wide = min(wide, len(row) - c)
            tall = 1
            while r + tall < height and c < len(parsed[r + tall]):
                below = parsed[r + tall][c]
                if below[2] and not (tall < rows and below[0] == ""):
                    break
                gone.add((r + tall, c))
                tall += 1
            tall = max(tall, min(rows, height - r))
            escaped = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            cells.append(f"<td{f' colspan=\"{wide}\"' if wide > 1 else ''}{f' rowspan=\"{tall}\"' if tall > 1 else ''}>{escaped}</td>")
            c += wide
        out.append("<tr>" + "".join(cells) + "</tr>")
    return "<table>" + "".join(out) + "</table>"


def merge_problems(grid: list[list[str]]) -> list[tuple[int, int, str]]:
    """(row, column, problem) of merge marks: spans beyond the row or the grid, and continuations without a cell above."""
    out = []
    for r, row in enumerate(grid):
        for c, cell in enumerate(row):
            _, wide, tall = merge_parts(cell)
            if c + wide > len(row):
                out.append((r, c, "columns beyond the row"))
            if r + tall > len(grid):
                out.append((r, c, "rows beyond the table"))
            if tall == 0 and (r == 0 or c >= len(grid[r - 1])):
                out.append((r, c, "nothing above"))
    return out


def markdown_blocks(text: str) -> list[tuple[str, str, int | None, str | None]]:
    """(type, text, heading level, table HTML) of a Markdown text: headings, fences, display math, tables, images, lists, text."""
    body, _ = front_matter(text)
    out: list[tuple[str, str, int | None, str | None]] = []
    para: list[str] = []

    def flush() -> None:
        if para:
            joined = " ".join(x.strip() for x in para)
            items = [re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", x) for x in para]
            kind = "list" if all(re.match(r"\s*(?:[-*+]|\d+[.)])\s+", x) for x in para) else "text"
            out.append((kind, "\n".join(items) if kind == "list" else joined, None, None))
            para.clear()

    lines = body.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        heading = re.match(r"(#{1,6})\s+(.*?)\s*#*$", bare)
        fence = re.match(r"(`{3,}|~{3,})", bare)
        if fence or bare.startswith("$$"):
            flush()
            closes = (lambda x, f=fence: x.strip().startswith(f.group(1))) if fence else (lambda x: x.strip().endswith("$$"))
            held = [] if fence else [bare[2:]]
            if not fence and len(bare) > 3 and bare.endswith("$$"):
                held = [bare[2:-2]]
            else:
                i += 1
                while i < len(lines) and not closes(lines[i]):
                    held.append(lines[i])
                    i += 1
                if not fence and i < len(lines):
                    held.append(lines[i].strip()[:-2])
            out.append(("code" if fence else "equation", "\n".join(held).strip("\n"), None, None))
        elif heading:
            flush()
            out.append(("text", heading.group(2), len(heading.group(1)), None))
        elif bare.startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\|?[\s:|-]*-[\s:|-]*\|?", lines[i + 1].strip() or "x"):
            flush()
            grid = [pipe_cells(line)]
            i += 2
            while i < len(lines) and lines[i].strip().startswith("|"):
                grid.append(pipe_cells(lines[i]))
                i += 1
            out.append(("table", "", None, grid_html(grid)))
            continue
        elif image := re.fullmatch(r"!\[(.*?)\]\((.*?)\)", bare):
            flush()
            out.append(("image", image.group(1), None, None))
        elif not bare:
            flush()
        else:
            para.append(line)
        i += 1
    flush()
    return out


def plain_blocks(text: str) -> list[tuple[str, str, int | None, str | None]]:
    """Groups of lines between blank lines."""
    return [("text", " ".join(p.split()), None, None) for p in re.split(r"\n\s*\n", text) if p.strip()]


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _word_text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{W}t"))


def _word_grid(tbl: ElementTree.Element) -> list[list[str]]:
    """Cells of a Word table after merges: a horizontal span repeats as "<<n", a vertical one goes on as "^^"."""
    grid = []
    for tr in tbl.findall(f"{W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            pr = tc.find(f"{W}tcPr")
            span, merge = (pr.find(f"{W}gridSpan"), pr.find(f"{W}vMerge")) if pr is not None else (None, None)
            n = int(span.get(f"{W}val", "1")) if span is not None else 1
            goes_on = merge is not None and merge.get(f"{W}val", "continue") != "restart"
            text = " ".join(_word_text(p) for p in tc.findall(f"{W}p")).strip()
            row.append("^^" if goes_on else f"{text} <<{n}" if n > 1 else text)
            row += [""] * (n - 1)
        grid.append(row)
    return grid


def docx_blocks(content: bytes) -> list[tuple[str, str, int | None, str | None]]:
    """Paragraphs and tables of a Word file in the order of its body; headings by style name or number."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out: list[tuple[str, str, int | None, str | None]] = []
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            text = _word_text(node).strip()
            if not text:
                continue
            style = node.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            level = re.search(r"(?i)(?:heading|标题)\s*(\d)", name)
            numbered = re.match(r"(\d+(?:\.\d+)*)\s+\S", text) if len(text) < 60 and text[-1] not in ".。;；" else None
            out.append(("text", text, int(level.group(1)) if level else len(numbered.group(1).split(".")) if numbered else None, None))
        elif node.tag == f"{W}tbl":
            out.append(("table", "", None, grid_html(_word_grid(node))))
    return out


def _parse(split: Callable, decode: bool) -> Callable:
    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = split(content.decode("utf-8", "replace") if decode else content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = [("broken", "", None, None)]
                rows += [(path, i, kind, text, level, html) for i, (kind, text, level, html) in enumerate(found)]
            out = pd.DataFrame(rows, columns=BLOCKS.names)
            out["level"] = out["level"].astype("Int32")
            yield out

    return run


READERS = {"*.md": (markdown_blocks, True), "*.txt": (plain_blocks, True), "*.docx": (docx_blocks, False)}


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of every Markdown, text and Word file below a folder (schema ``BLOCKS``); unreadable files have a block of type broken."""
    out = None
    for glob, (split, decode) in READERS.items():
        part = files(spark, folder, glob).select("path", "content").mapInPandas(_parse(split, decode), BLOCKS)
        out = part if out is None else out.unionByName(part)
    return out
