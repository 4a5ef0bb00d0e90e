"""Profile-level operators: fingerprints and comparisons of runs, causes of missing values, section and figure classes, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.operators import blocks as bl

#: Warning codes that name no cause of a missing value, and causes that no naming rule covers.
SMALL_N = ["NO_VALID_VALUES", "N_LT_5", "N_VALID_LT_3"]
CAUSES = ["CANONICAL_UNPARSEABLE", "SECTIONS_UNAVAILABLE", "METRIC_SCOPE_MISSING", "CITATION_STYLE_NOT_NUMERIC", "IMAGE_UNREADABLE", "TABLE_BODY_EMPTY", "NO_FIGURES_OR_TABLES"]
#: Section labels in which figures are overviews or results.
METHOD_LABELS, RESULT_LABELS = ["method", "preliminaries", "background"], ["experiments", "results", "discussion"]
NUMBERED = r"^(\d{1,2}(?:\.\d{1,2})*)[.、]?\s+(\S.{0,39})$"


def is_cause(code: Column) -> Column:
    """Whether a warning code explains a missing value."""
    return ~code.isin(*SMALL_N) & (code.startswith("NO_") | code.endswith("_NOT_SUPPORTED") | code.isin(*CAUSES))


def collapsed(codes: Column, causes: Column) -> Column:
    """Warning codes of a metric without values: the small-n codes give way to known causes; sorted."""
    known = F.filter(causes, is_cause)
    return F.when(F.size(known) > 0, F.array_sort(F.array_union(F.array_except(codes, F.array(*map(F.lit, SMALL_N))), known))).otherwise(F.array_sort(codes))


def draft_checkable(metric: Column, scope: Column, allowed: list[str]) -> Column:
    """Whether a metric may stand in a draft's contract: prose only, unspecified, or allowed by name."""
    return metric.isin(*allowed) | scope.isNull() | (F.size(F.array_except(scope, F.array(F.lit("prose")))) == 0)


def section_resolution(title: Column) -> tuple[Column, Column]:
    """(label, how): exact where the whole title is a section's word, keyword where it begins with one, else verbatim."""
    from corpusloom.functions import text as tx

    bare, label = tx.normal_title(title), bl.section_label(title)
    exact = F.lit(False)
    for _, pattern in bl.SECTIONS:
        exact = exact | bare.rlike(pattern + "$")
    return label, F.when(exact, "exact").when(label != bare, "keyword").otherwise("verbatim")


def figure_class(section: Column, kind: Column) -> Column:
    """What a figure is likely to show, by where it stands."""
    result = section.isin(*RESULT_LABELS)
    chart = F.when(result, "data-plot").otherwise("chart-other")
    image = F.when(section.isin(*METHOD_LABELS), "framework-overview").when(result, "result-figure").when(section == "introduction", "concept-diagram").otherwise("image-other")
    return F.when(kind == "chart", chart).otherwise(image)


def fingerprints(rows: DataFrame, key: str, parts: list[Column]) -> DataFrame:
    """key, n, fingerprint: a digest over the sorted digests of a group's rows, folded by sums so that no group is gathered.

    The fold adds the four 64-bit words of each row's digest apart and digests the sums; order and partitioning don't matter.
    """
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])), 256)
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select(key, "n", F.sha2(F.concat_ws(":", *[F.col(f"w{i}").cast("string") for i in range(8)]), 256).alias("fingerprint"))


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, status: same, differs, only_a or only_b, of two runs' fingerprints."""
    met = a.select(key, F.col("fingerprint").alias("fa")).join(b.select(key, F.col("fingerprint").alias("fb")), key, "full_outer")
    return met.select(key, F.when(F.col("fa").isNull(), "only_b").when(F.col("fb").isNull(), "only_a").when(F.col("fa") == F.col("fb"), "same").otherwise("differs").alias("status"))


def coverage(block: list[Column], other: list[Column]) -> Column:
    """Share of the first box that the other covers; 0 for boxes without area."""
    wide = F.least(block[2], other[2]) - F.greatest(block[0], other[0])
    high = F.least(block[3], other[3]) - F.greatest(block[1], other[1])
    area = (block[2] - block[0]) * (block[3] - block[1])
    return F.when((wide > 0) & (high > 0) & (area > 0), wide * high / area).otherwise(0.0)


def best_embedded(figures: DataFrame, candidates: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """id, best, share, source: the candidate box of the page that covers most of a figure; below ``least`` it is rendered.

    ``figures`` and ``candidates`` have the page's keys, id and box x1, y1, x2, y2. Ties go to the smaller id; a figure
    without a candidate is rendered too.
    """
    box = lambda p: [F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")]
    renamed = candidates.select(*page, F.col("id").alias("c_id"), *[F.col(c).alias(f"c_{c}") for c in ("x1", "y1", "x2", "y2")])
    met = figures.join(renamed, page).filter("c_id <> id").withColumn("share", coverage(box(""), box("c_")))
    best = met.groupBy("id").agg(F.max(F.struct("share", (-F.col("c_id")).alias("c"))).alias("m")).select("id", (-F.col("m.c")).alias("best"), F.round("m.share", 6).alias("share"))
    out = figures.select("id").join(best, "id", "left")
    found = F.coalesce("share", F.lit(0.0)) >= least
    return out.select("id", F.when(found, F.col("best")).alias("best"), F.coalesce("share", F.lit(0.0)).alias("share"), F.when(found, "embedded").otherwise("rendered").alias("source"))


def annotation_score(rows: DataFrame) -> DataFrame:
    """stratum, sampled, positive, rate, low, high: how many rows of each stratum were marked, with the 95 % interval."""
    per = rows.groupBy("stratum").agg(F.count("*").alias("sampled"), F.sum(F.col("marked").cast("bigint")).alias("positive"))
    low, high = stats.wilson(F.col("positive").cast("double"), F.col("sampled").cast("double"))
    return per.select("stratum", "sampled", "positive", F.round(F.col("positive") / F.col("sampled"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def stratum_sample(placed: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Up to ``k`` rows a group, a stride apart, topped up with the first ones not taken.

    ``placed``: keys, upto (position from 1) and n. A group of up to ``k`` rows is taken whole.
    """
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    at = F.col("upto") - 1
    picked = (at % stride == 0) & (F.floor(at / stride) < k)
    marked = placed.withColumn("picked", picked)
    rest = Window.partitionBy(*keys, "picked").orderBy("upto")
    short = k - F.least(F.lit(k), F.ceil(F.col("n") / stride))
    return marked.withColumn("r", F.row_number().over(rest)).filter(F.col("picked") | (F.col("r") <= short)).drop("picked", "r")


def chapter_continuity(numbers: DataFrame) -> DataFrame:
    """Numbers of a chapter in order: what was expected and what it is (ok, gap, duplicate, backward).

    ``numbers``: key, chapter, at, number. After a break the count goes on from the number seen.
    """
    order = Window.partitionBy("key", "chapter").orderBy("at")
    before = F.lag("number").over(order)
    expected = F.coalesce(before + 1, F.lit(1))
    kind = F.when(F.col("number") == expected, "ok").when(F.col("number") == before, "duplicate").when(F.col("number") > expected, "gap").otherwise("backward")
    return numbers.select("key", "chapter", "at", "number", expected.alias("expected"), kind.alias("kind"))


def heading_level(text: Column) -> Column:
    """Level 1 to 3 of a short numbered heading without a stop, else null."""
    numbering = F.regexp_extract(text, NUMBERED, 1)
    return F.when(text.rlike(NUMBERED) & ~text.rlike("[。！？；!?;]|[.]$"), F.least(F.size(F.split(numbering, r"\.")), F.lit(3)))


def pipe_table(html: Column) -> Column:
    """An HTML table as pipe rows with a rule after the first; null where it has no row with cells."""
    rows = F.filter(bl.table_rows(html), lambda r: F.size(r) > 0)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: c["text"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(rows[0])))
    lines = F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), F.lit("\n"), rule)).otherwise(line(r)))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n"))
