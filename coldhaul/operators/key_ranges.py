"""Key filters for more keys than one filter holds: sorted ranges of keys, each on its own.

Every range is a plain predicate on the table, which its scan prunes files and row groups
with, and a semi join with the keys of that range, whose Bloom filter has the same number
of bits for each key however many ranges there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import quote
from coldhaul.operators.keys import ceil_division, text_bytes
from coldhaul.operators.restrict import BLOOM_BITS, bloom_filter_of, fits_broadcast, hinted
from coldhaul.session import scratch_path

KEYS_PER_RANGE = BLOOM_BITS // 8
TASKS_PER_RANGE = 16
# Types whose bounds go to the driver and back unchanged and that files keep bounds of.
# Times go as microseconds; floating point has values that do not compare.
_ORDERED = (T.IntegralType, T.DecimalType, T.StringType, T.DateType, T.TimestampType)


@dataclass(frozen=True)
class KeyRange:
    number: int
    low: object
    high: object
    n_keys: int
    n_bytes: int


@dataclass(frozen=True)
class KeyRanges:
    """Distinct keys, written out as (key, range_no), and what was measured of each range.

    A range is broadcast up to ``bound`` bytes, by default ``restrict.BROADCAST_BYTES``.
    """

    frame: DataFrame
    ranges: list[KeyRange]
    bound: int | None = None

    @property
    def n_keys(self) -> int:
        return sum(r.n_keys for r in self.ranges)

    @contextmanager
    def sized_filters(self, spark: SparkSession) -> Iterator[None]:
        """Size Spark's runtime filters for the largest range; run the action in this block."""
        widest = max(self.ranges, key=lambda r: r.n_keys, default=None)
        schema = self.frame.select("key").schema
        if widest is None or all(fits_broadcast(r.n_keys, schema, r.n_bytes, self.bound) for r in self.ranges):
            yield
        else:
            with bloom_filter_of(spark, widest.n_keys):
                yield


def _is_ordered(data_type: T.DataType) -> bool:
    return isinstance(data_type, _ORDERED)


def _sent(bound: Column, data_type: T.DataType) -> Column:
    return F.unix_micros(bound) if isinstance(data_type, T.TimestampType) else bound


def _received(value: object, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(data_type)


def key_ranges(
    keys: DataFrame,
    key: str,
    per_range: int = KEYS_PER_RANGE,
    tasks_per_range: int = TASKS_PER_RANGE,
    bound: int | None = None,
) -> KeyRanges:
    """Cut the distinct keys of a frame into ranges of about ``per_range`` keys.

    NULL keys match nothing and go. The driver gets one row per range. Keys are written
    twice: once distinct, so that count and cut see the same ones, and once cut.
    """
    spark = keys.sparkSession
    path = scratch_path(spark, "distinct-keys")
    keys.select(F.col(quote(key)).alias("key")).where("key IS NOT NULL").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    n = ceil_division(distinct.count(), per_range)
    data_type = distinct.schema["key"].dataType
    if not _is_ordered(data_type):
        n = min(n, 1)
    path = scratch_path(spark, "key-ranges")
    (
        distinct.repartitionByRange(max(n, 1) * tasks_per_range, "key")
        .withColumn("range_no", F.floor(F.spark_partition_id() / F.lit(tasks_per_range)).cast("int"))
        .write.partitionBy("range_no")
        .parquet(path)
    )
    schema = T.StructType([distinct.schema["key"], T.StructField("range_no", T.IntegerType())])
    frame = spark.read.schema(schema).parquet(path)
    bounds = [_sent(f("key"), data_type) if _is_ordered(data_type) else F.lit(None) for f in (F.min, F.max)]
    measured = frame.groupBy("range_no").agg(
        bounds[0].alias("low"), bounds[1].alias("high"), F.count("*").alias("n"), text_bytes(frame.select("key")).alias("bytes")
    )
    found: list[Row] = measured.orderBy("range_no").collect()
    return KeyRanges(frame, [KeyRange(*row) for row in found], bound)


def within_range(df: DataFrame, key: str, found: KeyRange, data_type: T.DataType) -> DataFrame:
    """Rows of a table between the bounds of a range."""
    if found.low is None:
        return df
    of_row = F.col(quote(key))
    return df.where((of_row >= _received(found.low, data_type)) & (of_row <= _received(found.high, data_type)))


def restrict_in_ranges(df: DataFrame, keys: KeyRanges, key: str) -> DataFrame:
    """Rows whose key is in one of the ranges; multiplicity is kept.

    The table is scanned once for each range, less what the bounds prune, so it should be
    sorted or clustered by the key, as tables with rising keys are. One range is one scan.
    """
    data_type = keys.frame.schema["key"].dataType
    columns = [quote(c) for c in df.columns]

    def part(found: KeyRange) -> DataFrame:
        mine = keys.frame.where(F.col("range_no") == found.number).select(F.col("key").alias(key))
        rows = within_range(df, key, found, data_type)
        return rows.join(hinted(mine, found.n_keys, found.n_bytes, keys.bound), key, "left_semi").select(*columns)

    return reduce(DataFrame.unionAll, map(part, keys.ranges)) if keys.ranges else df.limit(0)


def keys_left(df: DataFrame, keys: DataFrame, key: str, keys_key: str | None = None, bound: int | None = None) -> KeyRanges:
    """The keys of a table that are not in a key frame too large to broadcast.

    Only keys are shuffled, each of the table once for every task that reads it.
    """
    mine = df.select(F.col(quote(key)).alias("key")).where("key IS NOT NULL").distinct()
    gone = keys.select(F.col(quote(keys_key or key)).alias("key"))
    return key_ranges(mine.join(gone, "key", "left_anti"), "key", bound=bound)


def rows_of_keys_left(df: DataFrame, left: KeyRanges, key: str) -> DataFrame:
    """The table's rows with one of the keys left, and those without a key.

    Rows of other keys mostly leave the scan by the filters of the ranges, so the join
    shuffles what stays rather than the whole table. Read the same files as ``keys_left``.
    """
    return restrict_in_ranges(df, left, key).unionAll(df.where(F.col(quote(key)).isNull()))
