"""Lexicon files: read in parallel, validated, and fingerprinted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEXICON = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "version", "source", "language")]
    + [T.StructField("entries", T.ArrayType(T.StringType())), T.StructField("groups", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
)


def read_lexicons(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, version, language, grp, entry: the distinct trimmed entries of all files; plain lists have the group ''."""
    raw = spark.read.schema(LEXICON).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("path", F.input_file_name())
    groups = F.coalesce("groups", F.create_map(F.lit(""), F.coalesce("entries", F.array().cast("array<string>"))))
    exploded = raw.select("path", "name", "version", "language", F.explode(groups).alias("grp", "es"))
    rows = exploded.select("path", "name", "version", "language", "grp", F.explode("es").alias("entry"))
    return rows.withColumn("entry", F.lower(F.trim("entry"))).filter("entry <> ''").distinct()


def lexicon_problems(entries: DataFrame, apart: tuple[str, str] = ("hedges", "boosters")) -> DataFrame:
    """problem, detail: several versions, entries shared by the two lists that must be apart, entries in two groups of a lexicon."""
    versions = entries.agg(F.array_sort(F.collect_set("version")).alias("v")).filter("size(v) > 1").select(F.lit("versions differ").alias("problem"), F.array_join("v", ",").alias("detail"))
    a, b = (entries.filter(F.col("name") == n).select("entry", F.coalesce("language", F.lit("")).alias("language")).distinct() for n in apart)
    shared = a.join(b, ["entry", "language"], "left_semi").select(F.lit(f"in {apart[0]} and {apart[1]}").alias("problem"), F.col("entry").alias("detail"))
    twice = entries.groupBy("path", "name", "entry").agg(F.count_distinct("grp").alias("n")).filter("n > 1").select(F.lit("in two groups").alias("problem"), F.col("entry").alias("detail"))
    return versions.unionByName(shared).unionByName(twice)
