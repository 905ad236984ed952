"""Table lifecycle: create, append, evolve, rewrite batches, delete keys.

Tables are named, as in ``spark.read.table``. Names that resolve to a V2
catalog use the V2 writer; tables of the built-in session catalog, which the V2
writer refuses to append to, use the V1 writer with the same by-name semantics.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import columns_ddl, quote
from coldhaul.operators.conform import SchemaReport, conform, lost_values
from coldhaul.operators.growth import split_growth
from coldhaul.operators.key_ranges import keys_left, rows_of_keys_left
from coldhaul.operators.keys import text_bytes
from coldhaul.operators.restrict import KEYS_ALONE_BYTES, fits_broadcast, restrict_to_keys, rows_left
from coldhaul.operators.shape import old_columns_first
from coldhaul.session import setting
from coldhaul.sinks.rewrites import (
    finish_rewrites,
    in_partitions,
    partition_columns,
    partition_spec,
    rewrite_partitions,
    sql_literal,
    table_location,
)


def in_v2_catalog(spark: SparkSession, name: str) -> bool:
    first = name.split(".")[0].strip("`")
    named = "." in name and spark.conf.get(f"spark.sql.catalog.{first}", None) is not None
    catalog = first if named else spark.catalog.currentCatalog()
    return catalog != "spark_catalog"


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    partition_by: Sequence[str] = (),
    location: str | None = None,
    if_missing: bool = False,
) -> None:
    """An empty table with the given columns; fails if present unless told otherwise."""
    clause = "" if in_v2_catalog(spark, name) else "USING parquet"
    if partition_by:
        clause += f" PARTITIONED BY ({', '.join(map(quote, partition_by))})"
    if location:
        clause += f" LOCATION '{location}'"
    guard = "IF NOT EXISTS " if if_missing else ""
    spark.sql(f"CREATE TABLE {guard}{name} ({columns_ddl(schema.fields)}) {clause}")


def append(df: DataFrame, name: str, files: int | None = None) -> None:
    """Append by column name; the columns must be the table's.

    ``files`` bounds the number of writing tasks where a job's output is small; what
    comes before them keeps its own parallelism.
    """
    spark = df.sparkSession
    table = spark.read.table(name).columns
    if set(df.columns) != set(table):
        raise ValueError(f"columns {df.columns} are not those of {name}: {table}")
    out = df.repartition(files) if files else df
    if in_v2_catalog(spark, name):
        out.writeTo(name).append()
    else:
        # Later positions resolve by order, so put the table's order first.
        out.select(*map(quote, table)).write.insertInto(name)


def append_or_create(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    location: str | None = None,
    files: int | None = None,
) -> None:
    """Append, creating the table first when it is missing."""
    create_table(df.sparkSession, name, df.schema, partition_by, location, if_missing=True)
    append(df, name, files)


def conform_append(df: DataFrame, name: str, files: int | None = None) -> SchemaReport:
    """Append data cast to the table's columns only.

    Extra columns and values that cannot be cast are left out; the report names
    the columns. ``evolve_append`` leaves nothing out.
    """
    out, report = conform(df, df.sparkSession.read.table(name).schema)
    append(out, name, files)
    return report


def add_missing_columns(spark: SparkSession, name: str, schema: T.StructType) -> list[str]:
    """Widen a table by the columns it lacks; old rows read NULL there."""
    known = set(spark.read.table(name).columns)
    fresh = [f for f in schema.fields if f.name not in known]
    if fresh:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns_ddl(fresh)})")
    return [f.name for f in fresh]


def evolve_append(
    df: DataFrame, name: str, files: int | None = None, lost_column: str = "lost_values"
) -> SchemaReport:
    """Append, adding new columns to the table and casting drifted ones.

    New fields inside its structs go to columns beside them, see ``operators.growth``.
    Values that a cast would drop or change are kept as text in ``lost_column``,
    which exists once types have drifted that far. The name is reserved: data that
    has such a column is refused.
    """
    spark = df.sparkSession
    if lost_column in df.columns:
        raise ValueError(f"the data has a column named {lost_column}, which is kept for values that do not fit")
    table = spark.read.table(name).schema
    incoming = split_growth(old_columns_first(df, table.fieldNames()), table)
    lost = lost_values(incoming.schema, table)
    if lost is not None:
        incoming = incoming.withColumn(lost_column, lost)
    add_missing_columns(spark, name, incoming.schema)
    return conform_append(incoming, name, files)


def overwrite_partitions(df: DataFrame, name: str, cluster_by: Sequence[str] = ()) -> None:
    """Replace exactly the partitions present in the frame.

    Writing a batch twice leaves one copy. ``cluster_by`` gathers the rows of a
    partition into few files; partitions larger than the advisory size are
    split again, so a heavy batch is still written by many tasks.
    """
    spark = df.sparkSession
    table = spark.read.table(name).columns
    out = df.select(*map(quote, table))
    if cluster_by:
        out = out.hint("rebalance", *cluster_by)
    if in_v2_catalog(spark, name):
        out.writeTo(name).overwritePartitions()
    else:
        # A writer option does not reach catalog tables; the setting does.
        with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            out.write.mode("overwrite").insertInto(name)


def next_batch_index(spark: SparkSession, name: str, column: str = "batch_index") -> int:
    """One more than the largest index in the table; 1 for an empty table.

    A partition column of the session catalog is answered from the partition
    list, without touching a data file.
    """
    if not in_v2_catalog(spark, name) and partition_columns(spark, name) == [column]:
        listed = spark.sql(f"SHOW PARTITIONS {name}")
        values = listed.select(F.substring_index("partition", "=", -1).try_cast("int").alias(column))
    else:
        values = spark.read.table(name).select(column)
    return values.agg(F.coalesce(F.max(column), F.lit(0)) + 1).first()[0]


def delete_keys(
    spark: SparkSession,
    name: str,
    keys: DataFrame,
    key: str,
    keys_key: str | None = None,
    n_keys: int | None = None,
    location: str | None = None,
) -> None:
    """Remove the rows of the given keys from a lake table.

    V2 tables take a row-level DELETE. Of a partitioned session-catalog table only
    the partitions that hold a key are rewritten, each in a fresh folder to which it
    is switched; a delete that stops at any point leaves every row it should keep, and
    the next call completes it. A table without partitions is rewritten beside its own
    folder before its location moves there, so a failed rewrite changes nothing; the
    old folder stays for the caller to remove. Name and properties do not change.
    """
    if in_v2_catalog(spark, name):
        view = "coldhaul_deleted_keys"
        keys.select(F.col(keys_key or key).alias(key)).createOrReplaceTempView(view)
        spark.sql(f"DELETE FROM {name} WHERE {quote(key)} IN (SELECT {quote(key)} FROM {view})")
        return
    only = keys.select(F.col(quote(keys_key or key)).alias(key))
    n_bytes = None
    if n_keys is None:
        n_keys, n_bytes = only.agg(F.count("*"), text_bytes(only)).first()
    few = fits_broadcast(n_keys, only.schema, n_bytes, KEYS_ALONE_BYTES)
    partition_by = partition_columns(spark, name)
    with ExitStack() as filters:

        def kept(rows: DataFrame) -> DataFrame:
            if few:
                return rows_left(rows, keys, key, keys_key, n_keys, n_bytes)
            left = keys_left(rows, keys, key, keys_key, KEYS_ALONE_BYTES)
            filters.enter_context(left.sized_filters(spark))
            return rows_of_keys_left(rows, left, key)

        if partition_by:
            finish_rewrites(spark, name)
            table = spark.read.table(name)
            keyed = restrict_to_keys(table, keys, key, keys_key, n_keys if few else None, n_bytes)
            hit = keyed.select(*map(quote, partition_by)).distinct().collect()
            rewrite_partitions(spark, name, lambda: kept(in_partitions(table, partition_by, hit)), hit)
            return
        table = spark.read.table(name)
        location = location or f"{table_location(spark, name).rstrip('/')}__{uuid.uuid4().hex}"
        kept(table).select(*map(quote, table.columns)).write.parquet(location)
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
        spark.catalog.refreshTable(name)


def drop_partitions(spark: SparkSession, name: str, partitions: DataFrame) -> None:
    """Drop the listed partitions, one statement for each; V2 tables delete their rows.

    ``partitions`` holds values of some or all partition columns. It is read on the
    driver: partitions to drop are few, as they failed or lost their last row.
    """
    v2 = in_v2_catalog(spark, name)
    for row in partitions.toLocalIterator():
        values = row.asDict()
        if v2:
            tests = " AND ".join(f"{quote(c)} <=> {sql_literal(v)}" for c, v in values.items())
            spark.sql(f"DELETE FROM {name} WHERE {tests}")
        else:
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({partition_spec(list(values), list(values.values()))})")
    spark.catalog.refreshTable(name)
