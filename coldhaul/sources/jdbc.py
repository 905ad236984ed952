"""JDBC reads. Connection details always come from the caller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldhaul.operators.keys import RunKeys

FETCH_SIZE = 1_000


def as_dbtable(query: str, alias: str = "q") -> str:
    """A query in the form the ``dbtable`` option takes."""
    return f"({query}) AS {alias}"


def read_jdbc(
    spark: SparkSession,
    url: str,
    dbtable: str,
    properties: Mapping[str, str],
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A table or query; with ``split_column`` and ``bounds`` in parallel ranges."""
    options = {"url": url, "dbtable": dbtable, "fetchsize": str(FETCH_SIZE), **properties}
    if split_column is not None and bounds is not None:
        low, high = bounds
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(low),
            "upperBound": str(high + 1),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def stage_keys_in_database(run: RunKeys, url: str, table: str, properties: Mapping[str, str]) -> None:
    """Write the run's keys to a staging table next to the source tables."""
    writer = run.frame.select(run.key).write.format("jdbc").mode("overwrite")
    writer.options(url=url, dbtable=table, **properties).save()


def key_range_predicates(key: str, cuts: Sequence[int], slices: tuple[str, int] | None = None) -> list[str]:
    """Disjoint predicates that together cover every non-NULL key.

    ``slices`` names a second integral column and a count, and splits each key
    range again, so that a single key holding most rows is still read by
    several tasks.
    """
    cuts = sorted(set(cuts))
    edges = [None, *cuts, None]
    ranges = []
    for low, high in zip(edges, edges[1:]):
        parts = [f"{key} >= {low}"] if low is not None else []
        parts += [f"{key} < {high}"] if high is not None else []
        ranges.append(" AND ".join(parts) or f"{key} IS NOT NULL")
    if slices is None:
        return ranges
    column, n = slices
    split = [f"MOD(ABS({column}), {n}) = {i}" for i in range(n)]
    split[0] = f"({split[0]} OR {column} IS NULL)"
    return [f"{r} AND {s}" for r in ranges for s in split]


def key_cuts(run: RunKeys, partitions: int) -> list[int]:
    """Cut points that give every range about as many of the run's keys."""
    if partitions < 2:
        return []
    shares = [i / partitions for i in range(1, partitions)]
    row = run.frame.agg(F.percentile_approx(run.key, shares).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def read_run_rows(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    run: RunKeys,
    staging_table: str,
    properties: Mapping[str, str],
    partitions: int,
    slices: tuple[str, int] | None = None,
) -> DataFrame:
    """The run's rows of a source table, selected inside the database.

    The keys must have been staged there. Each task reads one key range.
    """
    query = f"SELECT t.* FROM {table} t WHERE t.{key} IN (SELECT {run.key} FROM {staging_table})"
    predicates = key_range_predicates(key, key_cuts(run, partitions), slices)
    settings = {"fetchsize": str(FETCH_SIZE), **properties}
    return spark.read.jdbc(url, as_dbtable(query), predicates=predicates, properties=settings)
