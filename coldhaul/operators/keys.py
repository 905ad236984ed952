"""Run scope: which keys a run archives, and in which batch."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import quote
from coldhaul.session import scratch_path

# Rows of (time, key) that one task may sort. Above it, ranking is distributed.
ONE_TASK_ROWS = 1_000_000


def ceil_division(a: int, b: int) -> int:
    return -(-a // b)


def batch_count(df: DataFrame, size: int) -> DataFrame:
    """Number of batches of ``size`` rows; exact multiples give no extra batch."""
    return df.agg(F.ceil(F.count("*") / F.lit(size)).cast("bigint").alias("n_batches"))


def older_than(df: DataFrame, ts: str, as_of: datetime | str, age_days: int = 7) -> DataFrame:
    """Rows strictly older than ``age_days`` at ``as_of``; NULL times never qualify."""
    now = F.lit(str(as_of)).cast(df.schema[ts].dataType)
    return df.where(F.col(ts) < now - F.expr(f"INTERVAL {int(age_days)} DAYS"))


def expired_keys(
    df: DataFrame,
    key: str,
    ts: str,
    as_of: datetime | str,
    age_days: int = 7,
    limit: int | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Keys and times of expired rows, the oldest ``limit`` of them if given.

    The cap first counts rows per day, which yields the day the cap falls in.
    Later days are then excluded by a plain filter that the source can prune
    with, so the exact ranking only sees the rows up to that day.
    """
    expired = older_than(df, ts, as_of, age_days).where(F.col(key).isNotNull()).select(key, ts)
    if limit is None:
        return expired
    days = (
        expired.groupBy(F.to_date(ts).alias("day"))
        .count()
        .withColumn("seen", F.sum("count").over(Window.orderBy("day")))
        .where(F.col("seen") - F.col("count") < limit)
        .agg(F.max("day").alias("last"), F.max("seen").alias("rows"))
        .first()
    )
    if days["rows"] is None:
        return expired.limit(0)
    after = F.date_add(F.lit(days["last"]), 1).cast(df.schema[ts].dataType)
    upto = expired.where(F.col(ts) < after)
    if days["rows"] <= limit:
        return upto
    if limit <= one_task_rows and days["rows"] <= one_task_rows:
        return upto.orderBy(ts, key).limit(limit)
    ranked = rank_rows(upto, [F.col(ts), F.col(key)], days["rows"], one_task_rows)
    return ranked.where(F.col("rank") <= limit).drop("rank")


def rank_rows(
    df: DataFrame,
    order: list[Column],
    n_rows: int,
    one_task_rows: int = ONE_TASK_ROWS,
    rank: str = "rank",
) -> DataFrame:
    """Add the 1-based position of each row in a total order.

    Up to ``one_task_rows`` rows a single window is enough. Beyond, rows are
    split into ranges of the order, each ranked on its own and shifted by the
    size of the ranges before it. The ranges are written out first: their
    bounds come from a sample, and must not move if a task is run again.
    """
    if n_rows <= one_task_rows:
        return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    ranges = ceil_division(n_rows, one_task_rows) + 1
    (
        df.repartitionByRange(ranges, *order)
        .withColumn("range_no", F.spark_partition_id())
        .write.parquet(path)
    )
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("rows"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so both the window and the broadcast stay small.
    starts = sizes.select("range_no", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return (
        ranged.withColumn("within", within)
        .join(F.broadcast(starts), "range_no")
        .withColumn(rank, F.col("start") + F.col("within"))
        .drop("range_no", "start", "within")
    )


def assign_batches(
    keys: DataFrame,
    key: str,
    ts: str,
    size: int,
    n_rows: int | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Number batches of ``size`` keys from 0, oldest first; ties go by key."""
    n_rows = keys.count() if n_rows is None else n_rows
    ranked = rank_rows(keys, [F.col(ts), F.col(key)], n_rows, one_task_rows)
    batch = F.floor((F.col("rank") - 1) / F.lit(size)).cast("int")
    return ranked.withColumn("batch_no", batch).drop("rank")


@dataclass(frozen=True)
class RunKeys:
    """The keys of one run, read back from where they were written."""

    frame: DataFrame
    key: str
    n_keys: int
    n_batches: int
    # Measured width of the texts among the keys; unknown for keys made elsewhere.
    n_bytes: int | None = None


def text_bytes(df: DataFrame) -> Column:
    """Sum of the bytes of all text and binary columns."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    widths = [F.coalesce(F.octet_length(quote(name)), F.lit(0)).cast("bigint") for name in wide]
    return F.coalesce(F.sum(sum(widths, F.lit(0))), F.lit(0)).cast("bigint")


def batched_keys(
    keys: DataFrame, key: str, ts: str, size: int, one_task_rows: int = ONE_TASK_ROWS
) -> tuple[DataFrame, int, int]:
    """One row per key with its batch, the number of keys and the bytes of their texts.

    The distinct keys are written out before they are counted and ranked, so
    that both see the same ones while the source goes on changing.
    """
    spark = keys.sparkSession
    path = scratch_path(spark, "chosen")
    keys.groupBy(key).agg(F.min(ts).alias(ts)).write.parquet(path)
    unique = spark.read.parquet(path)
    n_keys, n_bytes = unique.agg(F.count("*"), text_bytes(unique.select(key))).first()
    return assign_batches(unique, key, ts, size, n_keys, one_task_rows).select(key, "batch_no"), n_keys, n_bytes


def stage_keys(
    keys: DataFrame, key: str, ts: str, size: int, one_task_rows: int = ONE_TASK_ROWS
) -> RunKeys:
    """Fix the run scope in a written table that every table of the run joins."""
    spark = keys.sparkSession
    batched, n_keys, n_bytes = batched_keys(keys, key, ts, size, one_task_rows)
    path = scratch_path(spark, "keys")
    batched.write.parquet(path)
    return RunKeys(spark.read.parquet(path), key, n_keys, ceil_division(n_keys, size), n_bytes)
