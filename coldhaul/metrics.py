"""Row and parse counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from coldhaul.operators.keys import RunKeys
from coldhaul.operators.restrict import restrict_to_keys, run_fits_broadcast, with_batch

STATUSES = ("null_input", "blank", "malformed", "ok")


def observed_parse(df: DataFrame, status: str = "parse_status") -> tuple[DataFrame, Observation]:
    """Attach parse counts to the pass that writes the frame; for logs.

    A stage that is run again may be counted twice, so nothing that decides
    about deletes uses these numbers.
    """
    seen = Observation()
    counts = [F.count_if(F.col(status) == s).alias(s) for s in STATUSES]
    return df.observe(seen, F.count(F.lit(1)).alias("total"), *counts), seen


def parse_counts(df: DataFrame, status: str = "parse_status") -> DataFrame:
    """Documents per parse outcome."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def run_summary(run: RunKeys, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Keys and child rows per batch; ``children`` maps a column name to (frame, key).

    With few keys the batch number is looked up in a broadcast table and only
    per-batch sums are shuffled. Otherwise child rows are first counted per
    key, which takes the weight out of a hot key before the join.
    """
    out = run.frame.groupBy("batch_no").agg(F.count("*").alias("n_jobs"))
    for name, (df, key) in children.items():
        if run_fits_broadcast(run):
            per_row = with_batch(df.select(key), run, key).select("batch_no", F.lit(1).alias("n"))
        else:
            mine = restrict_to_keys(df.select(key), run.frame, key, run.key, run.n_keys, run.n_bytes)
            per_key = mine.groupBy(key).agg(F.count("*").alias("n"))
            per_row = with_batch(per_key, run, key)
        counted = per_row.groupBy("batch_no").agg(F.sum("n").cast("bigint").alias(name))
        out = out.join(counted, "batch_no", "left")
    return out.fillna(0)
