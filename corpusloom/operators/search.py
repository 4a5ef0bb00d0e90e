"""Results of several search sources: one key each, merged, weighted, ranked and watched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Share of a later source's weight that a repeated result adds.
BONUS = 0.15
#: Words that make a query an academic one.
ACADEMIC = ["paper", "arxiv", "doi", "citation", "survey", "dataset", "论文", "文献", "综述"]


def dedup_key(doi: Column, arxiv: Column, url: Column, title: Column, source: Column) -> Column:
    """DOI, else arXiv id, else normal URL, else title and source; empty values count as missing."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("doi:"), F.lower(some(doi))),
        F.concat(F.lit("arxiv:"), F.regexp_replace(F.lower(some(arxiv)), r"v\d+$", "")),
        F.concat(F.lit("url:"), some(tx.normal_url(url))),
        F.concat(F.lit("title:"), F.lower(tx.squeeze(F.coalesce(title, F.lit("")))), F.lit("|"), F.coalesce(source, F.lit(""))),
    )


def merged(results: DataFrame, weights: DataFrame) -> DataFrame:
    """One row a key: the first result (by source order and place) with its weighted score and what the others add.

    ``results``: source, place, key, score, error and any other columns; ``weights``: source, weight, source_order.
    Rows with an error are left out, a source without weight has weight 1 and comes last. The repeats of a key are
    summed, not gathered, so a key that a third of the rows share stays one sum.
    """
    good = results.filter("error IS NULL").join(weights, "source", "left")
    weighed = good.withColumn("w", F.coalesce("weight", F.lit(1.0))).withColumn("o", F.coalesce("source_order", F.lit(1 << 30)))
    rest = [c for c in results.columns if c not in ("key", "error")]
    first = F.min_by(F.struct(*rest, "w"), F.struct("o", "place", "source"))
    out = weighed.groupBy("key").agg(first.alias("f"), F.sum("w").alias("all_w"), F.count("*").alias("n_found"), F.array_sort(F.collect_set("source")).alias("sources"))
    score = F.col("f.score") * F.col("f.w") + BONUS * (F.col("all_w") - F.col("f.w"))
    return out.select("key", *[F.col(f"f.{c}").alias(c) for c in rest if c != "score"], score.alias("score"), "n_found", "sources")


def top(results: DataFrame, k: int) -> DataFrame:
    """The k best; equal scores are ordered by key."""
    return results.orderBy(F.col("score").desc(), "key").limit(k)


def source_health(results: DataFrame) -> DataFrame:
    """source, n_rows, n_errors, failed (no row without an error)."""
    return results.groupBy("source").agg(F.count("*").alias("n_rows"), F.count("error").alias("n_errors"), F.bool_and(F.col("error").isNotNull()).alias("failed"))


def host_agreement(results: DataFrame, a: str, b: str) -> DataFrame:
    """shared, either, agreement of the hosts that two sources name."""
    hosts = results.filter(F.col("source").isin(a, b)).select("source", tx.host(F.col("url")).alias("h")).filter("h <> ''")
    per = hosts.groupBy("h").agg(F.max((F.col("source") == a).cast("int")).alias("ia"), F.max((F.col("source") == b).cast("int")).alias("ib"))
    return per.agg(F.coalesce(F.sum(F.col("ia") * F.col("ib")), F.lit(0)).alias("shared"), F.count("*").alias("either")).select("shared", "either", F.try_divide("shared", "either").alias("agreement"))


def arbitrated(results: DataFrame, first: str, second: str, third: str, least: float) -> DataFrame:
    """The rows of the first two sources, and those of the third only if the two agree on fewer hosts than ``least``."""
    agreement = host_agreement(results, first, second).select((F.coalesce("agreement", F.lit(0.0)) < least).alias("ask"), F.lit(third).alias("source"))
    extra = results.join(agreement.filter("ask").select("source"), "source", "left_semi")
    return results.filter(F.col("source").isin(first, second)).unionByName(extra)


def quota(calls: DataFrame, at: str, source: str, limits: DataFrame) -> DataFrame:
    """source, month, used, monthly_limit, remaining (at least 0; null without a limit)."""
    used = calls.groupBy(F.col(source).alias("source"), F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))
    left = F.greatest(F.lit(0).cast("bigint"), F.col("monthly_limit") - F.col("used"))
    return used.join(limits, "source", "left").select("source", "month", "used", "monthly_limit", F.when(F.col("monthly_limit").isNotNull(), left).alias("remaining"))


def intent(query: Column) -> Column:
    return F.when(tx.has_word(query, ACADEMIC), "academic").otherwise("general")


def manifest(results: DataFrame) -> DataFrame:
    """key, file_name, duplicate: download names from arXiv id, DOI or title, and whether another result has the same."""
    name = F.coalesce(F.nullif(F.regexp_replace("arxiv_id", r"[^\w.-]+", "_"), F.lit("")), F.nullif(F.regexp_replace("doi", r"[^\w.-]+", "_"), F.lit("")), F.nullif(F.substring(tx.slug(F.col("title")), 1, 60), F.lit("")), F.lit("unnamed"))
    named = results.select("key", F.concat(name, F.lit(".pdf")).alias("file_name"))
    return named.withColumn("duplicate", F.count("*").over(Window.partitionBy("file_name")) > 1)


def history(log: DataFrame, text: str, k: int) -> DataFrame:
    """The newest k entries whose query contains ``text``."""
    return log.filter(F.col("query").contains(text)).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(k)
