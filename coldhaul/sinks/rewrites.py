"""Replace whole partitions of a session-catalog table so that a stop at any point loses nothing.

The new rows are written to fresh folders beside the table and a journal records, for
each partition, the old and the new folder; only then are the partitions switched, one
``ALTER TABLE ... PARTITION ... SET LOCATION`` each, and the old folders removed. A stop
before the journal entry leaves the table as it was, a stop after it is made good by
replaying the journal, which every rewrite of the table does first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import quote
from coldhaul.session import setting
from coldhaul.sinks import folders

_JOURNAL = T.StructType([T.StructField(n, T.StringType()) for n in ("rewrite", "state", "spec", "old", "new", "before")])
# Fixed value: the folder name of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


class PartitionChanged(RuntimeError):
    """Partitions got other files while they were rewritten; they were left as they are."""


def table_location(spark: SparkSession, name: str) -> str:
    return spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def partition_spec(columns: Sequence[str], values: Sequence[object]) -> str:
    return ", ".join(f"{quote(c)} = {sql_literal(v)}" for c, v in zip(columns, values))


def in_partitions(df: DataFrame, columns: Sequence[str], parts: Sequence[Row]) -> DataFrame:
    """Rows of the listed partitions. The filter is on partition columns alone, so that others are not read."""
    if not parts:
        return df.limit(0)
    tests = []
    for i, c in enumerate(columns):
        known = {p[i] for p in parts}
        test = F.col(quote(c)).isin([v for v in known if v is not None])
        tests.append(test | F.col(quote(c)).isNull() if None in known else test)
    pruned = df.where(reduce(Column.__and__, tests))
    if len(columns) == 1:
        return pruned
    listed = df.sparkSession.createDataFrame(parts, T.StructType([df.schema[c] for c in columns]))
    listed = listed.select(*[F.col(quote(c)).alias(f"listed_{i}") for i, c in enumerate(columns)])
    same = [F.col(quote(c)).eqNullSafe(F.col(f"listed_{i}")) for i, c in enumerate(columns)]
    return pruned.join(listed, reduce(Column.__and__, same), "left_semi")


def _home(spark: SparkSession, name: str) -> str:
    return f"{table_location(spark, name).rstrip('/')}__rewrites"


def _record(spark: SparkSession, home: str, rewrite: str, state: str, partitions: Sequence[tuple] = ()) -> None:
    rows = [(rewrite, state, *p) for p in partitions] or [(rewrite, state, None, None, None, None)]
    spark.createDataFrame(rows, _JOURNAL).coalesce(1).write.mode("append").parquet(f"{home}/journal")


def _partition_location(spark: SparkSession, name: str, spec: str) -> str | None:
    try:
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {name} PARTITION ({spec})")
    except AnalysisException as error:
        if "PARTITIONS_NOT_FOUND" in str(error) or "NoSuchPartition" in str(error):
            return None
        raise
    return folders.qualified(spark, described.where("col_name = 'Location'").first()["data_type"])


def _folder(spark: SparkSession, columns: Sequence[str], values: Sequence[str | None]) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join(f"{escape(c)}={NULL_PARTITION if v is None else escape(v)}" for c, v in zip(columns, values))


def rewrite_partitions(
    spark: SparkSession,
    name: str,
    rows: DataFrame | Callable[[], DataFrame],
    partitions: Sequence[Row],
    file_bytes: int | None = None,
) -> None:
    """Replace the listed partitions by ``rows``; those without rows are dropped.

    ``rows`` may read the table; a function is called when the files of the partitions have
    been noted, for rows that take several passes over them. Rows of a partition are
    gathered into files of about the advisory size, or ``file_bytes``. A partition that gets
    other files meanwhile is left alone and PartitionChanged is raised.
    """
    finish_rewrites(spark, name)
    if not partitions:
        return
    columns, schema = partition_columns(spark, name), spark.read.table(name).schema
    home, rewrite = _home(spark, name), uuid.uuid4().hex
    root = folders.qualified(spark, f"{home}/{rewrite}")
    specs = [partition_spec(columns, p) for p in partitions]
    old = [_partition_location(spark, name, s) for s in specs]
    before = [folders.content(spark, o) if o else None for o in old]
    _record(spark, home, rewrite, "started")
    try:
        size = str(file_bytes or spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
        with setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", size):
            rows = rows() if callable(rows) else rows
            out = rows.select(*map(quote, schema.fieldNames())).hint("rebalance", *columns)
            out.write.partitionBy(*columns).parquet(root)
    except Exception:
        _forget(spark, home, rewrite)
        raise
    texts = [F.col(quote(c)).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
    written = {tuple(r) for r in spark.read.schema(schema).parquet(root).select(*texts).distinct().collect()}
    listed = spark.createDataFrame(partitions, T.StructType([schema[c] for c in columns])).select(*texts).collect()
    new = [f"{root}/{_folder(spark, columns, tuple(r))}" if tuple(r) in written else None for r in listed]
    _record(spark, home, rewrite, "planned", list(zip(specs, old, new, before)))
    finish_rewrites(spark, name)


def _forget(spark: SparkSession, home: str, rewrite: str) -> None:
    folders.remove(spark, f"{home}/{rewrite}")
    _record(spark, home, rewrite, "done")


def finish_rewrites(spark: SparkSession, name: str) -> None:
    """Complete rewrites that stopped after their journal entry; undo those that stopped before it."""
    home = _home(spark, name)
    if not folders.exists(spark, f"{home}/journal"):
        return
    entries: dict[str, list[Row]] = {}
    for row in spark.read.schema(_JOURNAL).parquet(f"{home}/journal").toLocalIterator():
        entries.setdefault(row["rewrite"], []).append(row)
    changed: list[str] = []
    for rewrite, rows in entries.items():
        states = {r["state"] for r in rows}
        if "done" in states:
            continue
        if "planned" not in states:
            _forget(spark, home, rewrite)
            continue
        planned = [r for r in rows if r["state"] == "planned"]
        left = [r for r in planned if not _switch(spark, name, r)]
        spark.catalog.refreshTable(name)
        for r in planned:
            folder = r["new"] if r in left else r["old"]
            if folder:
                folders.remove(spark, folder)
        _record(spark, home, rewrite, "done")
        changed += [r["spec"] for r in left]
    if changed:
        raise PartitionChanged(f"{name} got other files while it was rewritten: {'; '.join(changed)}")


def _switch(spark: SparkSession, name: str, planned: Row) -> bool:
    """Point one partition to its new folder, or drop it; False if its old one has changed. Repeating is harmless."""
    spec, old, new = planned["spec"], planned["old"], planned["new"]
    now = _partition_location(spark, name, spec)
    if now == new:
        return True
    if now != old or (old and folders.content(spark, old) != planned["before"]):
        return False
    if new is None:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
    elif old is None:
        spark.sql(f"ALTER TABLE {name} ADD PARTITION ({spec}) LOCATION '{new}'")
    else:
        spark.sql(f"ALTER TABLE {name} PARTITION ({spec}) SET LOCATION '{new}'")
    return True


def compact_partitions(spark: SparkSession, name: str, file_bytes: int, where: Column | None = None) -> list[Row]:
    """Gather the files of partitions that have more of them than their size needs; returns those partitions.

    ``file_bytes`` is the size aimed at; ``where`` picks partitions. Other partitions keep
    their files. Sizes are those on disk, so files shrink further where rows compress better
    side by side.
    """
    finish_rewrites(spark, name)
    columns = partition_columns(spark, name)
    table = spark.read.table(name)
    chosen = table if where is None else table.where(where)
    files = chosen.select(*map(quote, columns), "_metadata.file_path", "_metadata.file_size").distinct()
    sizes = files.groupBy(*map(quote, columns)).agg(F.count("*").alias("coldhaul_files"), F.sum("file_size").alias("coldhaul_bytes"))
    loose = sizes.where(F.col("coldhaul_files") > F.ceil(F.col("coldhaul_bytes") / F.lit(file_bytes)))
    parts = loose.select(*map(quote, columns)).collect()
    rewrite_partitions(spark, name, in_partitions(table, columns, parts), parts, file_bytes)
    return parts
