"""Append a heterogeneous JSON snapshot to a growing, evolving table.

A journal table beside it, ``<table>_ingests``, says which index holds which files, before
the rows are written and after. A snapshot that is there already is recognised by its
lines and not taken twice; one that stopped half way is taken away by the next call.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.json_text import CORRUPT
from coldhaul.operators.growth import with_growth
from coldhaul.operators.shape import flatten_structs, union_all
from coldhaul.plans.claims import LEASE_SECONDS, Claim, claim
from coldhaul.session import scratch_path
from coldhaul.sinks import folders
from coldhaul.sinks.rewrites import table_location
from coldhaul.sinks.tables import append, create_table, drop_partitions, evolve_append, next_batch_index
from coldhaul.sources.json_lines import land_xz_lines, read_json_lines

log = logging.getLogger(__name__)

INDEX = "batch_index"
_JOURNAL = (
    T.StructType()
    .add(INDEX, "integer")
    .add("state", "string")
    .add("path", "string")
    .add("size", "string")
    .add("n_lines", "long")
    .add("checksum", "string")
)


@dataclass(frozen=True)
class IngestJournal:
    """An index is ``started`` before its rows are written and ``committed`` after.

    One that only ever started is not whole; its rows are removed and the index is used again.
    """

    table: str
    location: str | None = None

    @property
    def name(self) -> str:
        return f"{self.table}_ingests"

    def create(self, spark: SparkSession) -> None:
        where = f"{self.location.rstrip('/')}__ingests" if self.location else None
        create_table(spark, self.name, _JOURNAL, location=where, if_missing=True)

    def claim(self, spark: SparkSession, owner: str, seconds: float = LEASE_SECONDS) -> Claim:
        """The right to append to the table; the journal must exist."""
        return claim(spark, f"{table_location(spark, self.name).rstrip('/')}__claims", owner, seconds)

    def record(
        self, spark: SparkSession, index: int, state: str, paths: Sequence[str] = (), n_lines: int | None = None, checksum: str | None = None
    ) -> None:
        files = [(p, folders.content(spark, p)) for p in paths] or [(None, None)]
        rows = [(index, state, path, size, n_lines, checksum) for path, size in files]
        append(spark.createDataFrame(rows, _JOURNAL).coalesce(1), self.name)

    def unfinished(self, spark: SparkSession) -> list[int]:
        """Indexes whose rows may be there in part."""
        entries = spark.read.table(self.name).groupBy(INDEX).agg(F.bool_or(F.col("state") == "committed").alias("whole"))
        return [r[INDEX] for r in entries.where("NOT whole").select(INDEX).collect()]

    def index_of(self, spark: SparkSession, n_lines: int, checksum: str) -> int | None:
        """The committed index that holds these lines."""
        same = (F.col("state") == "committed") & (F.col("n_lines") == n_lines) & (F.col("checksum") == checksum)
        return spark.read.table(self.name).where(same).agg(F.min(INDEX)).first()[0]

    def clear_unfinished(self, spark: SparkSession) -> None:
        """Take away what stopped ingests have written, registered or not."""
        for index in self.unfinished(spark):
            if spark.catalog.tableExists(self.table):
                drop_partitions(spark, self.table, spark.createDataFrame([(index,)], f"{INDEX} int"))
                folders.remove(spark, f"{table_location(spark, self.table).rstrip('/')}/{INDEX}={index}")


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """Rows of a snapshot table without those of an ingest that is running or has stopped, nested fields together."""
    unfinished, rows = IngestJournal(table).unfinished(spark), spark.read.table(table)
    return with_growth(rows.where(~F.col(INDEX).isin(unfinished)) if unfinished else rows)


def fingerprint(lines: DataFrame) -> tuple[int, str]:
    """Number and checksum of the lines that are not blank, whatever their order and files."""
    value = F.col("value")
    sums = [F.sum(F.xxhash64(F.lit(seed), value).cast("decimal(38,0)")) for seed in (1, 2)]
    row = lines.where(value.rlike(r"\S")).agg(F.count("*"), *sums).first()
    return row[0], f"{row[1] or 0}/{row[2] or 0}"


def _prepared(df: DataFrame, table: str, location: str | None) -> tuple[DataFrame, int]:
    """The flattened snapshot with its index; the table is created if it is missing."""
    spark = df.sparkSession
    flat = flatten_structs(df)
    if not flat.columns:
        raise ValueError(f"the snapshot for {table} has no fields")
    if flat.columns == [CORRUPT]:
        raise ValueError(f"the snapshot for {table} has no readable line")
    if INDEX in flat.columns:
        raise ValueError(f"the snapshot has a field named {INDEX}")
    index_only = T.StructType([T.StructField(INDEX, T.IntegerType())])
    schema = T.StructType(flat.schema.fields + index_only.fields)
    create_table(spark, table, schema, [INDEX], location, if_missing=True)
    index = next_batch_index(spark, table, INDEX)
    return flat.withColumn(INDEX, F.lit(index)), index


def append_snapshot(df: DataFrame, table: str, location: str | None = None) -> int:
    """Flatten a snapshot and append it under the next index, which is returned. The journal is not asked."""
    rows, index = _prepared(df, table, location)
    evolve_append(rows, table)
    return index


def ingest_snapshot(
    spark: SparkSession,
    paths: Sequence[str],
    table: str,
    location: str | None = None,
    again: bool = False,
    lease_seconds: float = LEASE_SECONDS,
) -> int:
    """Read the files of one snapshot and append them; returns their index.

    Lines that a committed index holds already are not appended, unless ``again`` is set;
    their index is returned. What a stopped call left is removed first. The table is
    claimed for the length of the call, and Claimed raised while another call holds it.
    """
    if not paths:
        raise ValueError("the snapshot has no files")
    journal = IngestJournal(table, location)
    journal.create(spark)
    with journal.claim(spark, ", ".join(paths)[:200], lease_seconds) as held:
        journal.clear_unfinished(spark)
        packed = [p for p in paths if p.endswith(".xz")]
        plain = [p for p in paths if not p.endswith(".xz")]
        landed = scratch_path(spark, "lines")
        try:
            if packed:
                plain += land_xz_lines(spark, packed, landed)
            n_lines, checksum = fingerprint(spark.read.text(plain))
            known = None if again else journal.index_of(spark, n_lines, checksum)
            if known is not None:
                log.info("%s: the snapshot is there already, as %d", table, known)
                return known
            rows, index = _prepared(read_json_lines(spark, plain), table, location)
            held.renew()
            journal.record(spark, index, "started", paths, n_lines, checksum)
            evolve_append(rows, table)
            held.check()
            journal.record(spark, index, "committed", paths, n_lines, checksum)
            return index
        finally:
            folders.remove(spark, landed)


def ingest_frames(frames: Sequence[DataFrame], table: str, location: str | None = None) -> int:
    """As ``append_snapshot`` for frames that were read separately."""
    return append_snapshot(union_all(frames), table, location)
