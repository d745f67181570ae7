"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans import extras, genomics, phased, problems, registry, spine  # noqa: F401  (importing registers the queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["locus_catalogue"](spark, sf_dir)


def queries() -> dict:
    return problems.queries() | registry.QUERIES


def oracle_sql() -> dict:
    return problems.oracle_sql() | registry.SQL
