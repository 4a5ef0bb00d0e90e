"""Word files in depth: comments with the text they mark, pictures, heading tree and special sections."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.blocks import W, docx_blocks, files

#: Titles of sections of a thesis -> their kind.
SPECIAL = [("abstract", r"^(abstract|摘\s*要)"), ("keywords", r"^(key\s*words|关键词)"), ("references", r"^(references|bibliography|参考文献)"), ("thanks", r"^(acknowledge?ments?|致\s*谢)"), ("appendix", r"^(appendix|附录)")]
PARTS = "path string, kind string, no int, text string, detail string"


def word_comments(content: bytes) -> list[tuple[str, str, str]]:
    """(author, comment, marked text) of every comment, in order; marks may span paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/comments.xml" not in z.namelist():
            return []
        notes = {c.get(f"{W}id"): (c.get(f"{W}author", ""), "".join(t.text or "" for t in c.iter(f"{W}t"))) for c in ElementTree.fromstring(z.read("word/comments.xml")).findall(f"{W}comment")}
        doc = ElementTree.fromstring(z.read("word/document.xml"))
    open_now: list[str] = []
    marked: dict[str, list[str]] = {k: [] for k in notes}
    for node in doc.iter():
        key = node.get(f"{W}id")
        if node.tag == f"{W}commentRangeStart" and key in marked:
            open_now.append(key)
        elif node.tag == f"{W}commentRangeEnd" and key in open_now:
            open_now.remove(key)
        elif node.tag == f"{W}p":
            for k in open_now:
                if marked[k]:
                    marked[k].append("\n")
        elif node.tag == f"{W}t":
            for k in open_now:
                marked[k].append(node.text or "")
    return [(*notes[k], "".join(marked[k])) for k in notes]


def special_sections(blocks: list[tuple[str, str, int | None, str | None]]) -> list[tuple[str, str]]:
    """(kind, text) of the special sections: from their title to the next heading."""
    out: list[tuple[str, list[str]]] = []
    now: str | None = None
    for _, text, level, _ in blocks:
        low = text.strip().lower()
        kind = next((k for k, p in SPECIAL if re.match(p, low) and len(low) < 200), None)
        inline = re.match(r"(?i)(?:abstract|key\s*words|摘\s*要|关键词)\s*[:：]\s*(.+)", text.strip(), re.S)
        if kind and (level is not None or len(low) < 20 or inline):
            now = kind
            out.append((kind, [inline.group(1)] if inline else []))
        elif level is not None:
            now = None
        elif now and out and text.strip():
            out[-1][1].append(text.strip())
    return [(k, "\n".join(ts)) for k, ts in out]


def word_parts(content: bytes) -> list[tuple[str, str, str]]:
    """(kind, text, detail): comments, pictures, headings and special sections of a Word file."""
    blocks = docx_blocks(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        pictures = sorted(n for n in z.namelist() if n.startswith("word/media/"))
    out = [("comment", note, marked) for _, note, marked in word_comments(content)]
    out += [("picture", n.rsplit("/", 1)[-1], "") for n in pictures]
    out += [("heading", text, str(level)) for _, text, level, _ in blocks if level is not None]
    return out + [(kind, text, "") for kind, text in special_sections(blocks)]


def read_word(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, no, text, detail of every Word file below a folder; an unreadable one is one row of kind broken."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = word_parts(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = [("broken", "", "")]
                rows += [(path, kind, i, text, detail) for i, (kind, text, detail) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "kind", "no", "text", "detail"])

    return files(spark, folder, "*.docx").select("path", "content").mapInPandas(run, PARTS)
