"""Archive expired keys of several related tables, then delete them at the source."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from py4j.protocol import Py4JNetworkError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.json_text import CORRUPT, infer_with_fallback, unescape_json, with_parsed
from coldhaul.functions.types import quote
from coldhaul.operators.conform import conform, lossy_rows, may_lose
from coldhaul.operators.growth import split_growth
from coldhaul.operators.keys import ONE_TASK_ROWS, RunKeys, batched_keys, ceil_division, expired_keys
from coldhaul.operators.restrict import KEYS_ALONE_BYTES, counted_by_batch, rows_left, sized_bloom_filter, with_batch
from coldhaul.operators.shape import cast_columns, expand_struct, fill_empty_strings, union_all
from coldhaul.plans.claims import LEASE_SECONDS, Claim
from coldhaul.plans.ledger import BATCH, Ledger
from coldhaul.session import scratch_path
from coldhaul.sinks import folders
from coldhaul.sinks.tables import add_missing_columns, create_table, drop_partitions, overwrite_partitions

log = logging.getLogger(__name__)

# The spellings of one document field, preferred first; the column
# that stands in when no document has any field; the field whose type drifts.
PASS_NAME_FIELDS = ("LPMPassName", "LPMPASSNAME")
EMPTY_SHAPE_COLUMN = "LPMPASSNAME"
PINNED_TYPES = {"HYXRunMergeID": "string"}
PARSED = "document"


@dataclass(frozen=True)
class JsonColumn:
    """A JSON text column to spread into wide columns.

    All documents of the run count for the schema. ``casts`` pins the types of
    fields that exist. ``keep`` names the source columns to carry along beside the
    key, by default all. ``evolve`` adds new fields to the target; otherwise they
    are left out of it, and documents having them are marked.
    """

    column: str
    decode: Callable[[Column], Column] = unescape_json
    casts: Mapping[str, str] = field(default_factory=lambda: dict(PINNED_TYPES))
    keep: tuple[str, ...] | None = None
    evolve: bool = True


@dataclass(frozen=True)
class ArchiveTable:
    """One source table and its archive.

    ``rows`` is the whole source table, or a function that reads just the
    run's rows, for sources that can select them by a staged key list.
    """

    name: str
    rows: DataFrame | Callable[[RunKeys], DataFrame]
    key: str
    target: str
    json: JsonColumn | None = None
    location: str | None = None


@dataclass(frozen=True)
class RunScope:
    """Which keys a run takes: all that are old enough, or the ``limit`` oldest.

    Each batch becomes a partition of every archive table, so a larger ``limit``
    wants a larger ``batch_size``.
    """

    source: DataFrame
    key: str
    ts: str
    as_of: datetime | str
    age_days: int = 7
    limit: int | None = None
    batch_size: int = 10_000
    one_task_rows: int = ONE_TASK_ROWS


@dataclass(frozen=True)
class ArchiveResult:
    run_id: str
    n_keys: int
    n_batches: int
    failed: dict[int, str]


class ArchiveFailed(RuntimeError):
    """Some batches were not archived; their keys are still at the source."""

    def __init__(self, result: ArchiveResult):
        super().__init__(f"run {result.run_id}: batches {sorted(result.failed)} failed")
        self.result = result


def empty_documents(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Output shape when no document has any field."""
    return df.select(*keep, F.lit("").alias(EMPTY_SHAPE_COLUMN))


def spread_documents(df: DataFrame, spec: JsonColumn, schema: T.StructType, decode, keep: Sequence[str]) -> DataFrame:
    """One row per document, NULL ones included: kept columns, parse outcome, fields."""
    parsed = with_parsed(df, spec.column, schema, decode, PARSED)
    keep = [*keep, spec.column, "parse_status"]
    if not schema.fields:
        return empty_documents(parsed, keep)
    reserved = [*BATCH, "rejected_text"]
    return cast_columns(expand_struct(parsed, PARSED, keep, [CORRUPT], reserved), spec.casts)


def _refuse_loss(df: DataFrame, lossy: Column, target: str) -> DataFrame:
    # Naming the batch keeps the check behind the join with the keys; pushed
    # below it, rows outside the batches being written would fail them too.
    text = F.concat(F.lit(f"a value does not fit its column in {target}, batch "), F.col("batch_no"))
    return df.where(F.when(lossy, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


class _TableWriter:
    """Writes any range of a run's batches of one table; safe to repeat."""

    def __init__(self, spark: SparkSession, table: ArchiveTable, run: RunKeys, run_id: str):
        self.spark, self.table, self.run, self.run_id = spark, table, run, run_id
        self.rows = table.rows(run) if callable(table.rows) else table.rows
        reserved = set(BATCH) & set(self.rows.columns)
        if reserved:
            raise ValueError(f"{table.name} already has columns {sorted(reserved)}")
        self.staged: DataFrame | None = None
        self.scratch: list[str] = []
        self.parts: list[str] = []
        if table.json:
            self._prepare_documents(table.json)

    def _prepare_documents(self, spec: JsonColumn) -> None:
        others = [c for c in self.rows.columns if c not in (self.table.key, spec.column)]
        self.keep = others if spec.keep is None else list(spec.keep)
        ours = {"parse_status", "rejected_text"} & {self.table.key, spec.column, *self.keep}
        if ours:
            raise ValueError(f"{self.table.name} already has columns {sorted(ours)}")
        self.document_path = scratch_path(self.spark, "documents")
        self.scratch.append(self.document_path)
        wanted = self.rows.select(*[F.col(quote(c)) for c in (self.table.key, spec.column, *self.keep)])
        self.wanted = with_batch(wanted, self.run, self.table.key)
        # An empty first part, so that the copy has its columns whatever fails later.
        self.wanted.limit(0).write.parquet(self.document_path)

    def stage_documents(self, batches: Column) -> None:
        """Copy documents of some batches; inference and parsing each read them."""
        part = scratch_path(self.spark, "documents-part")
        self.scratch.append(part)
        keys = self.run.frame.where(batches)
        wanted = self.rows.select(*[F.col(quote(c)) for c in (self.table.key, self.table.json.column, *self.keep)])
        with sized_bloom_filter(self.spark, self.run, keys):
            with_batch(wanted, self.run, self.table.key, keys).write.parquet(part)
        self.parts.append(part)

    def infer(self) -> None:
        """Read what was copied and find the schema of its documents."""
        spec = self.table.json
        self.documents = self.spark.read.schema(self.wanted.schema).parquet(self.document_path, *self.parts)
        try:
            self.schema, self.decode = infer_with_fallback(self.documents, spec.column, spec.decode)
        except ValueError:
            log.warning("%s: no documents in run %s", self.table.name, self.run_id)
            self.schema, self.decode = T.StructType([]), spec.decode

    def frame(self, batches: Column, bound: int | None = None) -> DataFrame:
        """Rows of some batches, as far as the target can take them; new nested fields in columns of their own."""
        df, spec = self._source_frame(batches, bound), self.table.json
        if (spec is None or spec.evolve) and self.spark.catalog.tableExists(self.table.target):
            df = split_growth(df, self.spark.read.table(self.table.target).schema)
        return df

    def _source_frame(self, batches: Column, bound: int | None) -> DataFrame:
        table, spec = self.table, self.table.json
        run_id = F.lit(self.run_id).alias("run_id")
        if spec is None:
            if self.staged is not None:
                rows = self.staged.where(batches)
            else:
                rows = with_batch(self.rows, self.run, table.key, self.run.frame.where(batches), bound)
            return fill_empty_strings(rows).select("*", run_id)
        docs = self.documents.where(batches)
        keep = [table.key, *self.keep, "batch_no"]
        return spread_documents(docs, spec, self.schema, self.decode, keep).select("*", run_id)

    def _target_schema(self, df: DataFrame) -> T.StructType:
        spec = self.table.json
        fields = [f for f in df.schema.fields if spec is None or f.name != spec.column]
        if spec is not None:
            fields.append(T.StructField("rejected_text", T.StringType()))
        fields.sort(key=lambda f: f.name in BATCH)
        incoming, target = T.StructType(fields), self.table.target
        create_table(self.spark, target, incoming, BATCH, self.table.location, if_missing=True)
        if spec is not None and not spec.evolve:
            ours = (*self.keep, "parse_status", "rejected_text")
            incoming = T.StructType([f for f in fields if f.name in ours])
        add_missing_columns(self.spark, target, incoming)
        return self.spark.read.table(target).schema

    def stage_rows(self) -> None:
        """Copy the run's rows by batch, so that retries do not scan the whole source."""
        if self.table.json or self.staged is not None:
            return
        path = scratch_path(self.spark, "rows")
        self.scratch.append(path)
        rows = with_batch(self.rows, self.run, self.table.key)
        try:
            with sized_bloom_filter(self.spark, self.run):
                rows.hint("rebalance", "batch_no").write.partitionBy("batch_no").parquet(path)
        except Exception as error:
            log.warning("%s: retries will read the source: %s", self.table.name, error)
        else:
            self.staged = self.spark.read.parquet(path)

    def lossy_batches(self) -> list[int]:
        """Batches with a value that does not fit the target, found in one pass.

        JSON tables mark such documents instead. Where the types allow no loss,
        nothing is read.
        """
        if self.table.json:
            return []
        df = self.frame(F.lit(True), KEYS_ALONE_BYTES)
        lossy = lossy_rows(df.schema, self._target_schema(df))
        if not may_lose(df.schema, self.spark.read.table(self.table.target).schema):
            return []
        # The filter goes below the join, which then has the keys of such rows alone.
        return [r["batch_no"] for r in df.where(lossy).select("batch_no").distinct().collect()]

    def write(self, batches: Column) -> None:
        df, spec = self.frame(batches), self.table.json
        target = self._target_schema(df)
        if spec is None:
            df = _refuse_loss(df, lossy_rows(df.schema, target), self.table.target)
        else:
            lossy = lossy_rows(df.schema, target, ignore=(spec.column,))
            status = F.when((F.col("parse_status") == "ok") & lossy, "lossy").otherwise(F.col("parse_status"))
            text = F.when(F.col("parse_status") != "ok", F.col(quote(spec.column)))
            df = df.withColumn("parse_status", status).withColumn("rejected_text", text).drop(spec.column)
        out, report = conform(df, target)
        if not report.identical:
            log.info("%s: %s", self.table.target, report)
        with sized_bloom_filter(self.spark, self.run):
            overwrite_partitions(out, self.table.target, cluster_by=["batch_no"])

    def remove_scratch(self) -> None:
        """Delete the copies this writer made in the scratch folder."""
        for path in self.scratch:
            folders.remove(self.spark, path)

    def expected(self) -> DataFrame:
        """Rows of each batch at the source, as numbers ``n`` to be summed."""
        return counted_by_batch(self.rows, self.run, self.table.key)


def _counts(frames: Mapping[str, DataFrame], count: str, rows: Column) -> DataFrame:
    """(batch_no, table, count) over frames with a batch number."""
    each = [df.groupBy("batch_no").agg(rows.alias(count)).withColumn("table", F.lit(n)) for n, df in frames.items()]
    return union_all(each)


# Errors of the session, the plan or the cluster say nothing about a batch.
_NOT_ABOUT_ROWS = (AnalysisException, ParseException, Py4JNetworkError, ConnectionError, KeyboardInterrupt)


def write_isolated(
    write: Callable[[Column], None],
    low: int,
    high: int,
    failed: dict[int, str],
    before_retry: Callable[[], None] | None = None,
) -> None:
    """Write batches ``low`` to ``high - 1`` in one pass, halving the range on failure.

    A run without failures costs one pass for all batches; a bad batch is cut
    out in a number of passes that grows with the logarithm of their count, and
    ``before_retry`` runs once ahead of those. Every healthy batch is written, however
    many are bad. Errors that are not about rows are raised at once.
    """
    skipped = [b for b in failed if low <= b < high]
    if len(skipped) == high - low:
        return
    batches = F.col("batch_no").between(low, high - 1)
    try:
        write(batches & ~F.col("batch_no").isin(skipped) if skipped else batches)
    except _NOT_ABOUT_ROWS:
        raise
    except Exception as error:
        if high - low == 1:
            failed[low] = str(error)
            log.error("batch %d failed: %s", low, failed[low])
            return
        if before_retry is not None:
            before_retry()
        middle = (low + high) // 2
        write_isolated(write, low, middle, failed)
        write_isolated(write, middle, high, failed)


def _run_keys(spark: SparkSession, run_id: str, scope: RunScope, ledger: Ledger) -> RunKeys | None:
    known = ledger.load_keys(spark, run_id)
    if known is not None:
        return known
    source = scope.source
    if not ledger.pending(spark).isEmpty():
        source = rows_left(source, ledger.deletable_keys(spark), scope.key, "key")
    keys = expired_keys(source, scope.key, scope.ts, scope.as_of, scope.age_days, scope.limit, scope.one_task_rows)
    batched, n_keys, n_bytes = batched_keys(keys, scope.key, scope.ts, scope.batch_size, scope.one_task_rows)
    if not n_keys:
        return None
    ledger.save_keys(run_id, batched, scope.key)
    return RunKeys(ledger.keys_of(spark, run_id), "key", n_keys, ceil_division(n_keys, scope.batch_size), n_bytes)


def delete_archived(spark: SparkSession, ledger: Ledger, delete: Callable[[DataFrame], None]) -> None:
    """Delete the keys of committed batches at the source and record it."""
    path = scratch_path(spark, "deleting")
    try:
        ledger.pending(spark).write.parquet(path)
        batches = spark.read.parquet(path)
        # One entry per pending run, so that only their partitions are read.
        runs = [r["run_id"] for r in batches.select("run_id").distinct().collect()]
        if not runs:
            return
        keys = spark.read.table(ledger.keys).where(F.col("run_id").isin(runs))
        delete(keys.join(batches, BATCH, "left_semi").select("key"))
        ledger.record_deletes(batches)
    finally:
        folders.remove(spark, path)


def archive(
    spark: SparkSession,
    run_id: str,
    scope: RunScope,
    tables: Sequence[ArchiveTable],
    ledger: Ledger,
    delete: Callable[[DataFrame], None] | None = None,
    lease_seconds: float = LEASE_SECONDS,
) -> ArchiveResult:
    """Copy the run's rows of every table, commit whole batches, delete their keys.

    Each table is written in one pass for all batches. A run that stopped half
    way is resumed by calling again with its ``run_id`` before any other run:
    the keys are the same and rewritten batches replace themselves. Calling for
    a finished run only completes its deletes. ``delete`` gets a frame with the
    column ``key``; without it, archived keys are left out of later runs.

    The ledger is claimed for the length of the call, and Claimed raised while another
    call holds it. The claim is renewed before each table, and checked before the commit
    and the deletes; one that was not renewed for ``lease_seconds`` may be taken over.
    """
    ledger.create(spark, scope.source.schema[scope.key].dataType)
    with ledger.claim(spark, run_id, lease_seconds) as held:
        return _claimed_archive(spark, run_id, scope, tables, ledger, delete, held)


def _claimed_archive(
    spark: SparkSession,
    run_id: str,
    scope: RunScope,
    tables: Sequence[ArchiveTable],
    ledger: Ledger,
    delete: Callable[[DataFrame], None] | None,
    held: Claim,
) -> ArchiveResult:
    for closed in ledger.abandon_unfinished(spark, run_id):
        for table in tables:
            if spark.catalog.tableExists(table.target):
                drop_partitions(spark, table.target, spark.createDataFrame([(closed,)], "run_id string"))
    failed = ledger.outcome(spark, run_id)
    if failed is None:
        run = _run_keys(spark, run_id, scope, ledger)
        failed = _copy(spark, run_id, run, tables, ledger, held) if run else {}
    else:
        run = ledger.load_keys(spark, run_id)
    if delete is not None:
        held.renew()
        delete_archived(spark, ledger, delete)
    result = ArchiveResult(run_id, run.n_keys if run else 0, run.n_batches if run else 0, failed)
    log.info("%s", result)
    if failed:
        raise ArchiveFailed(result)
    return result


def _copy(
    spark: SparkSession,
    run_id: str,
    run: RunKeys,
    tables: Sequence[ArchiveTable],
    ledger: Ledger,
    held: Claim,
) -> dict[int, str]:
    """Write every table of a run and its manifest; returns the failed batches.

    A batch counts only if each table has as many rows of it as its source. Rows of
    the others leave the targets again.
    """
    writers: list[_TableWriter] = []
    try:
        return _copy_tables(spark, run_id, run, tables, ledger, held, writers)
    finally:
        for writer in writers:
            writer.remove_scratch()


def _copy_tables(
    spark: SparkSession,
    run_id: str,
    run: RunKeys,
    tables: Sequence[ArchiveTable],
    ledger: Ledger,
    held: Claim,
    writers: list[_TableWriter],
) -> dict[int, str]:
    failed: dict[int, str] = {}
    blame: dict[int, str] = {}
    for table in tables:
        held.renew()
        writer = _TableWriter(spark, table, run, run_id)
        writers.append(writer)
        if table.json:
            write_isolated(writer.stage_documents, 0, run.n_batches, failed)
            writer.infer()
        text = f"a value does not fit its column in {table.target}"
        for batch in writer.lossy_batches():
            failed.setdefault(batch, f"{text}, batch {batch}")
        write_isolated(writer.write, 0, run.n_batches, failed, writer.stage_rows)
        for batch in failed:
            blame.setdefault(batch, table.name)
    landed = {t.name: spark.read.table(t.target).where(F.col("run_id") == run_id) for t in tables}
    errors = [(b, blame[b], e) for b, e in failed.items()]
    bad = spark.createDataFrame(errors, "batch_no int, blamed string, error string")
    manifest = (
        run.frame.select("batch_no").distinct()
        .select("batch_no", F.explode(F.array(*[F.lit(t.name) for t in tables])).alias("table"))
        .join(_counts({w.table.name: w.expected() for w in writers}, "expected", F.sum("n")), ["batch_no", "table"], "left")
        .join(_counts(landed, "rows", F.count("*")), ["batch_no", "table"], "left")
        .join(bad, "batch_no", "left")
        .fillna(0, ["expected", "rows"])
        .withColumn("short", F.col("blamed").isNull() & (F.col("rows") != F.col("expected")))
    )
    error = F.when(F.col("blamed") == F.col("table"), F.col("error")).when(
        F.col("short"), F.concat("rows", F.lit(" of "), "expected", F.lit(" rows arrived"))
    )
    status = F.when(F.col("blamed").isNotNull() | F.col("short"), "failed").otherwise("ok")
    held.check()
    ledger.save_manifest(spark, run_id, manifest.withColumns({"error": error, "status": status}))
    failed = ledger.outcome(spark, run_id) or {}
    if failed:
        gone = spark.createDataFrame([(run_id, b) for b in failed], "run_id string, batch_no int")
        for table in tables:
            drop_partitions(spark, table.target, gone)
    return failed
