"""Record of runs: their keys, the outcome per batch and table, the deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.operators.growth import with_growth
from coldhaul.operators.keys import RunKeys, text_bytes
from coldhaul.plans.claims import LEASE_SECONDS, Claim, claim
from coldhaul.sinks.rewrites import table_location
from coldhaul.sinks.tables import append, create_table, overwrite_partitions

BATCH = ["run_id", "batch_no"]
_DELETES = T.StructType().add("batch_no", "integer").add("run_id", "string")
_MANIFEST = (
    T.StructType()
    .add("batch_no", "integer")
    .add("table", "string")
    .add("status", "string")
    .add("rows", "long")
    .add("error", "string")
    .add("run_id", "string")
)


@dataclass(frozen=True)
class Ledger:
    """Three tables named after a common prefix.

    The manifest rows of a run are its commit: archived rows whose batch has
    none, or a failed one, are not part of the archive.
    """

    prefix: str
    location: str | None = None

    @property
    def keys(self) -> str:
        return f"{self.prefix}_keys"

    @property
    def manifest(self) -> str:
        return f"{self.prefix}_manifest"

    @property
    def deletes(self) -> str:
        return f"{self.prefix}_deletes"

    def claim(self, spark: SparkSession, owner: str, seconds: float = LEASE_SECONDS) -> Claim:
        """The right to run; the ledger must exist."""
        return claim(spark, f"{table_location(spark, self.manifest).rstrip('/')}__claims", owner, seconds)

    def create(self, spark: SparkSession, key_type: T.DataType) -> None:
        keys = T.StructType().add("key", key_type).add("batch_no", "integer").add("run_id", "string")
        for name, schema in ((self.keys, keys), (self.manifest, _MANIFEST), (self.deletes, _DELETES)):
            where = f"{self.location}/{name.split('.')[-1]}" if self.location else None
            create_table(spark, name, schema, ["run_id"], where, if_missing=True)

    def save_keys(self, run_id: str, batched: DataFrame, key: str) -> None:
        rows = batched.select(F.col(key).alias("key"), "batch_no", F.lit(run_id).alias("run_id"))
        overwrite_partitions(rows, self.keys)

    def keys_of(self, spark: SparkSession, run_id: str) -> DataFrame:
        return spark.read.table(self.keys).where(F.col("run_id") == run_id).select("key", "batch_no")

    def load_keys(self, spark: SparkSession, run_id: str) -> RunKeys | None:
        frame = self.keys_of(spark, run_id)
        size = frame.agg(
            F.count("*").alias("n"),
            (F.max("batch_no") + 1).alias("batches"),
            text_bytes(frame.select("key")).alias("bytes"),
        ).first()
        if not size["n"]:
            return None
        return RunKeys(frame, "key", size["n"], size["batches"], size["bytes"])

    def save_manifest(self, spark: SparkSession, run_id: str, outcome: DataFrame) -> None:
        """``outcome`` has batch_no, table, status, rows and error, a row per batch and table."""
        rows = outcome.select("batch_no", "table", "status", "rows", "error", F.lit(run_id).alias("run_id"))
        overwrite_partitions(rows, self.manifest, cluster_by=["run_id"])

    def committed(self, spark: SparkSession) -> DataFrame:
        """Batches of which every table was written."""
        outcome = spark.read.table(self.manifest).groupBy(*BATCH)
        whole = outcome.agg(F.bool_and(F.col("status") == "ok").alias("whole"))
        return whole.where("whole").select(*BATCH)

    def pending(self, spark: SparkSession) -> DataFrame:
        """Committed batches whose keys were not yet deleted at the source."""
        deleted = spark.read.table(self.deletes)
        return self.committed(spark).join(deleted, BATCH, "left_anti")

    def deletable_keys(self, spark: SparkSession) -> DataFrame:
        """Keys that may be deleted: archived whole, and still at the source."""
        return spark.read.table(self.keys).join(self.pending(spark), BATCH, "left_semi").select("key")

    def record_deletes(self, done: DataFrame) -> None:
        """Mark batches as deleted."""
        append(done.select("batch_no", "run_id"), self.deletes)

    def outcome(self, spark: SparkSession, run_id: str) -> dict[int, str] | None:
        """Failed batches of a finished run and their errors; None if unfinished."""
        mine = spark.read.table(self.manifest).where(F.col("run_id") == run_id)
        if mine.isEmpty():
            return None
        bad = mine.where("status <> 'ok'").groupBy("batch_no").agg(F.max("error").alias("error"))
        return {r["batch_no"]: r["error"] or "failed" for r in bad.collect()}

    def abandon_unfinished(self, spark: SparkSession, current: str) -> list[str]:
        """Close runs that stopped before their manifest was written; returns them.

        A later run takes their keys again, so they must not be resumed after it.
        """
        started = spark.read.table(self.keys).select("run_id").distinct()
        finished = spark.read.table(self.manifest).select("run_id").distinct()
        open_runs = started.join(finished, "run_id", "left_anti").where(F.col("run_id") != current)
        marks = open_runs.select(
            F.lit(-1).alias("batch_no"),
            F.lit("*").alias("table"),
            F.lit("abandoned").alias("status"),
            F.lit(0).cast("bigint").alias("rows"),
            F.lit("closed by a later run").alias("error"),
            "run_id",
        )
        rows = [tuple(r) for r in marks.collect()]
        if rows:
            append(spark.createDataFrame(rows, _MANIFEST), self.manifest)
        return [r[-1] for r in rows]


def archived(spark: SparkSession, target: str, ledger: Ledger) -> DataFrame:
    """Rows of an archive table that belong to committed batches, nested fields of all runs together."""
    return with_growth(spark.read.table(target).join(ledger.committed(spark), BATCH, "left_semi"))
