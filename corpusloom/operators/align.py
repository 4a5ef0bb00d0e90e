"""Two extractions of a document aligned paragraph by paragraph, merged, and their losses measured."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ratios from which two paragraphs are the same, and from which they are versions of one.
SAME, VERSION = 0.85, 0.30
ALIGNED = "doc_id bigint, pos int, kind string, left_no int, right_no int, ratio double, text string"


def info_score(text: str) -> tuple[int, int, int, int]:
    """Digits, formula signs, non-ASCII characters, length: what a version must have more of to be kept."""
    return sum(c.isdigit() for c in text), text.count("$") + text.count("\\"), sum(not c.isascii() for c in text), len(text)


def align_paragraphs(left: list[str], right: list[str]) -> list[tuple[str, int | None, int | None, float, str]]:
    """(SAME, DIFF, ONLY_LEFT or ONLY_RIGHT, left index, right index, ratio, kept text) in the order of the left side.

    Greedy best match: each left paragraph takes the free right one of the highest ratio from ``VERSION`` on, the first
    of equals; exact copies are matched before anything is compared.
    """
    free: dict[int, str] = dict(enumerate(right))
    exact: dict[str, list[int]] = {}
    for j, text in free.items():
        exact.setdefault(text, []).append(j)
    out: list[tuple[str, int | None, int | None, float, str]] = []
    for i, a in enumerate(left):
        best, ratio = None, 0.0
        while exact.get(a) and exact[a][0] not in free:
            exact[a].pop(0)
        if exact.get(a):
            best, ratio = exact[a].pop(0), 1.0
        else:
            m = SequenceMatcher(None, autojunk=False)
            m.set_seq2(a)
            for j, b in free.items():
                m.set_seq1(b)
                if m.real_quick_ratio() > ratio and m.quick_ratio() > ratio and (r := m.ratio()) > ratio:
                    best, ratio = j, r
        if best is None or ratio < VERSION:
            out.append(("ONLY_LEFT", i, None, ratio, a))
            continue
        b = free.pop(best)
        out.append(("SAME" if ratio >= SAME else "DIFF", i, best, ratio, b if info_score(b) > info_score(a) else a))
    return out + [("ONLY_RIGHT", None, j, 0.0, b) for j, b in free.items()]


def aligned(pairs: DataFrame) -> DataFrame:
    """Rows of ``ALIGNED`` for each document of ``pairs`` (doc_id, left, right as arrays of paragraphs): one narrow map."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, a, b in zip(batch["doc_id"], batch["left"], batch["right"], strict=True):
                found = align_paragraphs(list(a) if a is not None else [], list(b) if b is not None else [])
                rows += [(doc, p, kind, i, j, round(r, 6), text) for p, (kind, i, j, r, text) in enumerate(found)]
            out = pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "left_no", "right_no", "ratio", "text"])
            yield out.astype({"left_no": "Int32", "right_no": "Int32"})

    return pairs.select("doc_id", "left", "right").mapInPandas(run, ALIGNED)


def loss(a: Column, b: Column) -> Column:
    """Share of ``a`` that is missing in ``b``, between 0 and 1; null where a is 0."""
    return F.when(a > 0, F.greatest(F.lit(0.0), (a - b) / a))


def text_layer_loss(pairs: DataFrame) -> DataFrame:
    """doc_id, digit_loss, punct_loss of a converted text against the text layer (columns layer, converted)."""
    digits = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[0-9０-９]"))
    puncts = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[.,;:!?，。；：！？、]"))
    return pairs.select("doc_id", F.round(loss(digits("layer"), digits("converted")), 6).alias("digit_loss"), F.round(loss(puncts("layer"), puncts("converted")), 6).alias("punct_loss"))
