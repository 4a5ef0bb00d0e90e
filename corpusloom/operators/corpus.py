"""Corpus statistics over a long table of document metrics, target bands from them, and drafts checked against the bands.

``metrics``: doc_id, metric, value, unit, n_tokens (the document's length) and any grouping columns. Null values are
missing values, never zeros; a corpus mean is the mean of documents' values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import stats

#: Thresholds of the warnings.
HIGH_MISSING, SMALL_N, TINY_N = 0.3, 5, 3
CONFOUND = 0.3
QUARTILES = {"p25": ("half_even", 0.25), "median": ("half_even", 0.5), "p75": ("half_even", 0.75)}


def codes(*pairs: tuple[Column, str]) -> Column:
    """The warning codes whose condition holds, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]), lambda c: c.isNotNull())


def summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys: unit, n_valid, n_missing, mean, sd, p25, median, p75, iqr, min, max, ci95_low, ci95_high, warnings.

    More than one measured unit gives null statistics and a warning. sd of a single value is 0. All sums are rounded to
    six digits at the end, so the partitioning doesn't show.
    """
    v = F.col("value")
    base = metrics.groupBy(*keys).agg(
        F.min(F.when(v.isNotNull(), F.col("unit"))).alias("unit"),
        (F.min(F.when(v.isNotNull(), F.col("unit"))) != F.max(F.when(v.isNotNull(), F.col("unit")))).alias("mixed"),
        F.count(v).alias("n_valid"),
        (F.count("*") - F.count(v)).alias("n_missing"),
        F.avg(v).alias("mean"),
        F.when(F.count(v) >= 1, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    q = stats.ranked_quantiles(metrics, keys, "value", QUARTILES)
    half = stats.t_95(F.col("n_valid")) * stats.standard_error(F.col("sd"), F.col("n_valid"))
    mixed, n = F.coalesce("mixed", F.lit(False)), F.col("n_valid")
    out = base.join(q, keys, "left").withColumn("iqr", F.col("p75") - F.col("p25"))
    warned = codes(
        (mixed, "MIXED_UNIT_AGGREGATION"),
        (F.col("n_missing") > HIGH_MISSING * (n + F.col("n_missing")), "HIGH_MISSING"),
        (n < TINY_N, "TINY_SAMPLE"),
        ((n >= TINY_N) & (n < SMALL_N), "SMALL_SAMPLE"),
        ((n >= TINY_N) & (F.col("iqr") == 0), "IQR_ZERO"),
    )
    round6 = lambda c: F.round(F.when(~mixed, c), 6)
    return out.select(
        *keys, F.when(~mixed, F.col("unit")).alias("unit"), "n_valid", "n_missing",
        *[round6(F.col(c)).alias(c) for c in ("mean", "sd", "p25", "median", "p75", "iqr", "min", "max")],
        round6(F.col("mean") - half).alias("ci95_low"), round6(F.col("mean") + half).alias("ci95_high"),
        F.array_join(warned, ",").alias("warnings"),
    )


def length_confounds(metrics: DataFrame) -> DataFrame:
    """metric, n, rho, confounded: Spearman's rho of each metric with the documents' length."""
    rho = stats.spearman(metrics.select("metric", "value", "n_tokens"), ["metric"], "value", "n_tokens")
    return rho.withColumn("confounded", (F.col("n") >= 5) & (F.abs(F.coalesce("rho", F.lit(0.0))) > CONFOUND))


def holdout(metrics: DataFrame, held: DataFrame) -> DataFrame:
    """Metrics without the held-out documents; a held-out id that isn't there is an error, raised when the rows are read.

    The unknown ids are counted apart from the rows, so no row depends on a check of all others.
    """
    unknown = held.select("doc_id").distinct().join(metrics.select("doc_id").distinct(), "doc_id", "left_anti")
    if unknown.limit(1).count():
        raise ValueError("held-out documents that aren't in the corpus")
    return metrics.join(held.select("doc_id").distinct(), "doc_id", "left_anti")


def contract(summaries: DataFrame, min_gate_n: int = 8, small_n: int = 10, derived: dict[str, list[str]] | None = None) -> DataFrame:
    """metric, low, high, level (gate or warn), reason: a target band a metric.

    The band is [p25, p75]; with fewer than ``small_n`` values it's widened by 0.15 IQR on either side (not below 0).
    No band where the metric is missing, its IQR is 0 or the band is inverted. A derived metric's band is the sum of its
    components' bands, never a quantile of its own.
    """
    s = summaries.select("metric", "n_valid", "p25", "p75", "iqr")
    widen = F.when(F.col("n_valid") < small_n, 0.15 * F.col("iqr")).otherwise(0.0)
    low, high = F.greatest(F.lit(0.0), F.col("p25") - widen), F.col("p75") + widen
    reason = F.when(F.col("p25").isNull(), "missing").when(F.col("iqr") == 0, "iqr_zero").when(low > high, "inverted")
    bands = s.select("metric", "n_valid", reason.alias("reason"), F.when(reason.isNull(), low).alias("low"), F.when(reason.isNull(), high).alias("high"))
    if derived:
        pairs = [(d, c) for d, cs in derived.items() for c in cs]
        spark = summaries.sparkSession
        links = spark.createDataFrame(pairs, "derived string, metric string")
        sizes = {d: len(cs) for d, cs in derived.items()}
        need = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
        sums = (
            links.join(bands, "metric").groupBy(F.col("derived").alias("metric"))
            .agg(F.min("n_valid").alias("n_valid"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.count("low").alias("k"))
            .withColumn("reason", F.when(F.col("k") < need[F.col("metric")], "component_missing"))
        )
        sums = sums.select("metric", "n_valid", "reason", F.when(F.col("reason").isNull(), F.col("low")).alias("low"), F.when(F.col("reason").isNull(), F.col("high")).alias("high"))
        bands = bands.join(links.select(F.col("derived").alias("metric")).distinct(), "metric", "left_anti").unionByName(sums)
    level = F.when(F.col("reason").isNull() & (F.col("n_valid") >= min_gate_n), "gate").otherwise("warn")
    return bands.select("metric", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), level.alias("level"), F.coalesce("reason", F.lit("")).alias("reason"))


def validate(clauses: DataFrame, drafts: DataFrame) -> DataFrame:
    """draft_id, metric, value, verdict (pass, fail, warn, skipped), deviation from the band for every clause and draft.

    ``drafts``: draft_id, metric, value, long. A draft without the metric and a clause without a band are skipped.
    """
    met = clauses.join(drafts, "metric", "left").filter("draft_id IS NOT NULL")
    out = F.greatest(F.col("low") - F.col("value"), F.col("value") - F.col("high"), F.lit(0.0))
    checked = F.col("low").isNotNull() & F.col("value").isNotNull()
    verdict = F.when(~checked, "skipped").when(out <= 0, "pass").when(F.col("level") == "gate", "fail").otherwise("warn")
    return met.select("draft_id", "metric", "value", verdict.alias("verdict"), F.round(F.when(checked, out), 6).alias("deviation"))


def verdicts(validated: DataFrame, least_evaluable: float = 0.5) -> DataFrame:
    """draft_id, n_pass, n_fail, n_warn, n_skipped, outcome (unusable, fail, pass)."""
    count = lambda v: F.sum((F.col("verdict") == v).cast("bigint"))
    per = validated.groupBy("draft_id").agg(*[count(v).alias(f"n_{v}") for v in ("pass", "fail", "warn", "skipped")], F.count("*").alias("n"))
    outcome = F.when(F.col("n") - F.col("n_skipped") < least_evaluable * F.col("n"), "unusable").when(F.col("n_fail") > 0, "fail").otherwise("pass")
    return per.select("draft_id", "n_pass", "n_fail", "n_warn", "n_skipped", outcome.alias("outcome"))


def fingerprint(inputs: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """keys, sha256 of the group's rows whatever their order: the rows' hashes are folded by sums, never gathered.

    Each row's SHA-256 is cut into eight 32-bit numbers; the sums of these (and the number of rows) are hashed again.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(p) for p in parts]), {"ignoreNullFields": "false"}), 256)
    hashed = inputs.select(*keys, row.alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)]
    out = hashed.groupBy(*keys).agg(F.count("*").alias("n_rows"), *sums)
    return out.select(*keys, "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows"), *[F.col(f"s{i}") for i in range(8)]), 256).alias("sha256"))
