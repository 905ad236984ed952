"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# JSON keys may differ by case only, so names must not be folded. The skew
# settings let one join key or one output batch hold a large part of the rows.
RUNTIME_SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Join without sorting the large side when each part of the small one is
    # measured to fit in a task.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128MB",
}

_local_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator here relies on to a running session."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """One session setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    A temporary folder is used only when the setting is absent and Spark runs
    in this process; on a cluster a missing setting is an error.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="coldhaul-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; never reused."""
    return f"{shared_dir(spark)}/coldhaul/{label}-{uuid.uuid4().hex}"
