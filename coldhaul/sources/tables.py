"""Reading tables and offering them to SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from coldhaul.plans.ledger import Ledger, archived


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Latest state of a table."""
    return spark.read.table(name)


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Make frames available to ``spark.sql`` under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_archives(spark: SparkSession, targets: Mapping[str, str], ledger: Ledger) -> None:
    """Make archive tables available to ``spark.sql``: rows of committed batches only."""
    register_views(spark, {name: archived(spark, target, ledger) for name, target in targets.items()})
