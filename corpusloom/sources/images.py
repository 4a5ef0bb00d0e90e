"""Image sizes from the first bytes of PNG, JPEG, GIF and SVG files."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.blocks import files

HEAD = 65_536


def image_size(head: bytes | None) -> tuple[int, int] | None:
    """(width, height), None where the header isn't known or is cut."""
    if not head or len(head) < 10:
        return None
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head):
            if head[at] != 0xFF:
                at += 1
                continue
            kind = head[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            if kind in (0x01, *range(0xD0, 0xDA)):
                at += 2
                continue
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
        return None
    tag = re.search(rb"<svg\b[^>]*>", head)
    if tag:
        get = lambda name: re.search(rb"\b" + name + rb"\s*=\s*[\"']\s*([\d.]+)\s*(?:px)?\s*[\"']", tag.group())
        w, h = get(b"width"), get(b"height")
        if w and h:
            return round(float(w.group(1))), round(float(h.group(1)))
        box = re.search(rb"viewBox\s*=\s*[\"']\s*[-\d.]+[\s,]+[-\d.]+[\s,]+([\d.]+)[\s,]+([\d.]+)", tag.group())
        if box:
            return round(float(box.group(1))), round(float(box.group(2)))
    return None


def image_sizes(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg,gif,svg}") -> DataFrame:
    """path, width, height, sha256; sizes are null where the header isn't known."""

    @F.pandas_udf("width int, height int")
    def size(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(h) or (None, None) for h in heads], columns=["width", "height"]).astype("Int32")

    found = files(spark, folder, glob).select("path", size(F.substring("content", 1, HEAD)).alias("s"), "sha256")
    return found.select("path", "s.width", "s.height", "sha256")
