"""Continuity, retention, inventory, geometry and set checks over ordered or keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def continuity(df: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """Rows whose number isn't one more than the row's before in its group (the first must be 1): keys, number, expected, problem.

    The expected value follows the number seen, so one gap gives one finding. Null numbers are left out.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.filter(F.col(number).isNotNull()).withColumn("expected", F.coalesce(F.lag(number).over(w) + 1, F.lit(1)))
    again = F.count("*").over(Window.partitionBy(*keys, number)) > 1
    problem = F.when(F.col(number) == F.col("expected"), None).when(again & (F.col(number) < F.col("expected")), "duplicate").when(F.col(number) > F.col("expected"), "gap").otherwise("backward")
    return rows.withColumn("problem", problem).filter("problem IS NOT NULL").select(*keys, F.col(number).cast("bigint").alias(number), F.col("expected").cast("bigint").alias("expected"), "problem")


def retention(df: DataFrame, category: list[str], order: list[Column], keep: int, key: str) -> DataFrame:
    """The rows that go when only the newest ``keep`` of a category stay; ``key`` identifies a row.

    The kept rows come from a limited rank, which is cut before the shuffle, so a large category isn't sorted in a task.
    """
    kept = df.withColumn("__r", F.row_number().over(Window.partitionBy(*category).orderBy(*order))).filter(F.col("__r") <= keep).select(F.col(key).alias("__key"))
    return df.join(kept, F.col(key).eqNullSafe(F.col("__key")), "left_anti")


def overlaps(boxes: DataFrame, keys: list[str], cells: float = 200.0) -> DataFrame:
    """Pairs id_a < id_b of rectangles (id, x1, y1, x2, y2) of one page that share an area, with the share of the smaller.

    A rectangle is filed under every grid cell it touches, so rectangles meet by equality of page and cell, never all
    with all; a pair is reported in the first cell they share only. Null, empty and inverted rectangles meet nothing.
    """
    ok = boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    lo = lambda c: F.floor(F.col(c) / cells).cast("int")
    filed = ok.withColumn("gx", F.explode(F.sequence(lo("x1"), lo("x2")))).withColumn("gy", F.explode(F.sequence(lo("y1"), lo("y2"))))
    a = filed.select(*keys, "gx", "gy", *[F.col(c).alias(f"{c}_a") for c in ("id", "x1", "y1", "x2", "y2")])
    b = filed.select(*keys, "gx", "gy", *[F.col(c).alias(f"{c}_b") for c in ("id", "x1", "y1", "x2", "y2")])
    met = a.join(b, [*keys, "gx", "gy"]).filter("id_a < id_b AND x1_a < x2_b AND x1_b < x2_a AND y1_a < y2_b AND y1_b < y2_a")
    first = (F.col("gx") == F.floor(F.greatest("x1_a", "x1_b") / cells)) & (F.col("gy") == F.floor(F.greatest("y1_a", "y1_b") / cells))
    area = (F.least("x2_a", "x2_b") - F.greatest("x1_a", "x1_b")) * (F.least("y2_a", "y2_b") - F.greatest("y1_a", "y1_b"))
    size = lambda s: (F.col(f"x2_{s}") - F.col(f"x1_{s}")) * (F.col(f"y2_{s}") - F.col(f"y1_{s}"))
    return met.filter(first).select(*keys, "id_a", "id_b", F.try_divide(area, F.least(size("a"), size("b"))).alias("share"))


def orphans(edges: DataFrame, nodes: DataFrame, ends: list[str], node: str) -> DataFrame:
    """Edges of which an end isn't among the nodes: the edge's columns and which end is missing."""
    known = nodes.select(F.col(node).alias("__n")).filter("__n IS NOT NULL").distinct()
    parts = [edges.join(known, F.col(end) == F.col("__n"), "left_anti").withColumn("missing_end", F.lit(end)) for end in ends]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inventory(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: both sides of an inventory compared by a full join; missing, extra or present."""
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    p = present.select(*keys).distinct().withColumn("__p", F.lit(True))
    state = F.when(F.col("__p").isNull(), "missing").when(F.col("__e").isNull(), "extra").otherwise("present")
    return e.join(p, keys, "full_outer").select(*keys, state.alias("state"))


def audit(expected: DataFrame, actual: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """key, expected, actual, verdict (match, drift, missing, unexpected) of a registry against what is measured."""
    e = expected.select(F.col(key), F.col(value).cast("double").alias("expected"), F.lit(1).alias("__e"))
    a = actual.select(F.col(key), F.col(value).cast("double").alias("actual"), F.lit(1).alias("__a"))
    verdict = (
        F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected")
        .when(F.col("expected").eqNullSafe(F.col("actual")) | (F.abs(F.col("expected") - F.col("actual")) <= tolerance), "match").otherwise("drift")
    )
    return e.join(a, key, "full_outer").select(key, "expected", "actual", verdict.alias("verdict"))


def jaccard_matches(queries: DataFrame, rows: DataFrame, least: float, top: int = 5) -> DataFrame:
    """query_id, row_id, jaccard, rank: for each query (id, words) the ``top`` rows (id, words) by Jaccard of their word sets.

    Sets meet by the words they share, the rarest first: of a set of n words only the first n - ceil(least n) + 1 in the
    order of rarity are filed (prefix filtering), which loses no pair of ``least`` or more and never files common words
    of long sets. The surviving pairs are measured exactly.
    """
    q = queries.select(F.col("id").alias("query_id"), F.array_distinct("words").alias("qw")).filter("size(qw) > 0")
    r = rows.select(F.col("id").alias("row_id"), F.array_distinct("words").alias("rw")).filter("size(rw) > 0")
    common = r.select(F.explode("rw").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, key: str, words: str) -> DataFrame:
        each = df.select(key, F.size(words).alias("n"), F.explode(words).alias("w")).join(common, "w", "left")
        order = Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "w")
        kept = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
        return kept.select(key, "w")

    met = prefix(q, "query_id", "qw").join(prefix(r, "row_id", "rw"), "w").select("query_id", "row_id").distinct()
    pairs = met.join(q, "query_id").join(r, "row_id")
    score = F.size(F.array_intersect("qw", "rw")) / F.size(F.array_union("qw", "rw"))
    scored = pairs.select("query_id", "row_id", score.alias("jaccard")).filter(F.col("jaccard") >= least)
    order = Window.partitionBy("query_id").orderBy(F.col("jaccard").desc(), "row_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
