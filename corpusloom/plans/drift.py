"""Queries of the schema-drift operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import schema_drift as sd
from corpusloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.schema_changes(table(spark, sf_dir, "registry_files")).select("stream_name", "file_id", "change", "field_path", "new_path")


def p2_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.schema_changes(table(spark, sf_dir, "registry_files"))


def p2_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.union_table(table(spark, sf_dir, "registry_files"))


def p2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.union_schema(sd.flat_records(table(spark, sf_dir, "registry_files"))).withColumn("n_files", F.col("n_files").cast("bigint"))


QUERIES = {"p2_found": p2_found, "p2_log": p2_log, "p2_union": p2_union, "p2_fields": p2_fields}
SQL: dict[str, str] = {}
