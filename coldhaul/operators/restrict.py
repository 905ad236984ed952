"""Key-restricted reads: the rows of a run, and the rows that remain."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.operators.keys import RunKeys
from coldhaul.session import setting

BROADCAST_BYTES = 256 * 1024 * 1024
# A filter of 2 ** 31 bits takes 256 MB; it has 8 bits a key up to 268 million keys,
# and fewer beyond, where it lets more rows pass.
BLOOM_BITS = 1 << 31
TEXT_BYTES = 112
# What is broadcast goes through the driver, for every table again; where a shuffle moves keys
# alone instead of rows, fewer of them do.
KEYS_ALONE_BYTES = 32 * 1024 * 1024
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def fits_broadcast(n_rows: int, schema: T.StructType, n_bytes: int | None = None, bound: int | None = None) -> bool:
    """Whether a key frame of known length is small enough to send everywhere.

    ``n_bytes`` is the measured width of its texts; without it they are taken to have
    ``TEXT_BYTES`` each. ``bound`` is ``BROADCAST_BYTES`` unless given.
    """
    texts = sum(not isinstance(f.dataType, _FIXED_WIDTH) for f in schema.fields)
    width = TEXT_BYTES * texts * n_rows if n_bytes is None else n_bytes
    return n_rows * 16 * len(schema.fields) + width <= (BROADCAST_BYTES if bound is None else bound)


def run_fits_broadcast(run: RunKeys, bound: int | None = None) -> bool:
    return fits_broadcast(run.n_keys, run.frame.schema, run.n_bytes, bound)


def hinted(keys: DataFrame, n_keys: int | None, n_bytes: int | None = None, bound: int | None = None) -> DataFrame:
    """Broadcast hint for a counted, small key frame.

    Uncounted or larger frames get no hint: Spark then plans a shuffled join,
    whose hot partitions the adaptive skew handling splits.
    """
    if n_keys is not None and fits_broadcast(n_keys, keys.schema, n_bytes, bound):
        return F.broadcast(keys)
    return keys


@contextmanager
def sized_bloom_filter(spark: SparkSession, run: RunKeys, keys: DataFrame | None = None) -> Iterator[None]:
    """Size Spark's runtime filter for a run whose keys are too many to broadcast.

    Rows of other keys then mostly leave the scan before the join shuffles
    them. The default size suits a million keys and lets nearly all rows pass
    for many more. ``keys`` is the part of them that is joined, which is counted.
    """
    if run_fits_broadcast(run):
        yield
    else:
        with bloom_filter_of(spark, run.n_keys if keys is None else max(1, keys.count())):
            yield


@contextmanager
def bloom_filter_of(spark: SparkSession, n_keys: int) -> Iterator[None]:
    """Spark's runtime filter with eight bits for each of ``n_keys`` keys, on tables of any size."""
    bits = min(8 * n_keys, BLOOM_BITS)
    sizes = {"expectedNumItems": n_keys, "maxNumItems": n_keys, "numBits": bits, "maxNumBits": bits}
    sides = {"creationSideThreshold": "10GB", "applicationSideScanSizeThreshold": "0"}
    with ExitStack() as stack:
        for name, value in {**sizes, **sides}.items():
            stack.enter_context(setting(spark, f"spark.sql.optimizer.runtime.bloomFilter.{name}", str(value)))
        yield


def _renamed(keys: DataFrame, key: str, keys_key: str | None) -> DataFrame:
    return keys.select(F.col(keys_key or key).alias(key))


def restrict_to_keys(
    df: DataFrame,
    keys: DataFrame,
    key: str,
    keys_key: str | None = None,
    n_keys: int | None = None,
    n_bytes: int | None = None,
) -> DataFrame:
    """Rows whose key is in the key frame; multiplicity is kept."""
    return df.join(hinted(_renamed(keys, key, keys_key), n_keys, n_bytes), key, "left_semi")


def rows_left(
    df: DataFrame,
    keys: DataFrame,
    key: str,
    keys_key: str | None = None,
    n_keys: int | None = None,
    n_bytes: int | None = None,
) -> DataFrame:
    """Rows whose key is not in the key frame; rows without a key stay."""
    return df.join(hinted(_renamed(keys, key, keys_key), n_keys, n_bytes), key, "left_anti")


def with_batch(
    df: DataFrame, run: RunKeys, key: str, keys: DataFrame | None = None, bound: int | None = None
) -> DataFrame:
    """The run's rows of one table, each with its batch number.

    Keys are unique in a run, so the inner join neither drops nor repeats rows
    of the table. They are broadcast up to ``bound`` bytes.
    """
    keys = run.frame if keys is None else keys
    keys = keys.select(F.col(run.key).alias(key), "batch_no")
    return df.join(hinted(keys, run.n_keys, run.n_bytes, bound), key)


def counted_by_batch(df: DataFrame, run: RunKeys, key: str) -> DataFrame:
    """(batch_no, n), which sum to the run's rows of one table in each batch.

    Many keys are not broadcast for it: the rows are counted by key, so that the join
    shuffles keys alone, and a key with many rows is one row there.
    """
    if run_fits_broadcast(run, KEYS_ALONE_BYTES):
        return with_batch(df.select(key), run, key).select("batch_no", F.lit(1).cast("bigint").alias("n"))
    counts = df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(run.frame.select(F.col(run.key).alias(key), "batch_no"), key).select("batch_no", "n")
