import datetime as dt
from contextlib import ExitStack
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coldhaul.operators import keys as K
from coldhaul.operators import restrict
from coldhaul.operators.key_ranges import key_ranges, keys_left, restrict_in_ranges, rows_of_keys_left
from coldhaul.operators.restrict import fits_broadcast, restrict_to_keys
from coldhaul.session import setting


def rows(df):
    return sorted(map(str, df.collect()))


def both_ways(table, keys, key, keys_key, per_range):
    ranges = key_ranges(keys, keys_key, per_range, tasks_per_range=2)
    got = restrict_in_ranges(table, ranges, key)
    want = restrict_to_keys(table, keys, key, keys_key).select(*table.columns)
    assert got.columns == table.columns and rows(got) == rows(want)
    return ranges


VALUES = {
    "bigint": lambda i: i,
    "string": lambda i: f"{i:04d}" + "x" * 5_000,
    "date": lambda i: dt.date(2020, 1, 1) + dt.timedelta(i),
    "decimal(30,2)": lambda i: Decimal(i) / 4 * 10**20,
    "timestamp": lambda i: dt.datetime(2020, 10, 25) + dt.timedelta(minutes=7 * i, microseconds=i),
    "double": lambda i: [float("nan"), -0.0, 0.0, float("inf")][i] if i < 4 else i / 3,
}


@pytest.mark.parametrize("kind", VALUES)
def test_same_rows_as_one_join(spark, kind):
    value = VALUES[kind]
    table = spark.createDataFrame(
        [(n, value(i)) for n, i in enumerate([*range(60), 3, 3, 3, 41])] + [(99, None)], f"n int, k {kind}"
    )
    keys = spark.createDataFrame([(value(i),) for i in range(0, 60, 3)] * 2 + [(None,)], f"id {kind}")
    ranges = both_ways(table, keys, "k", "id", per_range=6)
    # Minus zero and zero are one key.
    assert ranges.n_keys == 20
    assert len(ranges.ranges) == (1 if kind == "double" else 4)


def test_no_keys_and_hot_keys(spark):
    table = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("a.b"), "id")
    none = key_ranges(spark.range(0), "id")
    assert none.ranges == [] and restrict_in_ranges(table, none, "a.b").count() == 0
    with none.sized_filters(spark):
        pass
    hot = spark.range(2_000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("id"))
    ranges = key_ranges(hot, "id", 300, tasks_per_range=2)
    assert [r.n_keys for r in ranges.ranges][0] < 600 and ranges.n_keys == 1_000


def test_bounds_reach_the_scan_and_filters_have_the_size_of_a_range(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(0, 40_000, 1, 4).select(F.col("id").alias("k"), F.lit("v").alias("v")).write.parquet(path)
    table = spark.read.parquet(path)
    monkeypatch.setattr(restrict, "BROADCAST_BYTES", 0)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    ranges = key_ranges(spark.range(0, 20_000, 2), "id", 2_500)
    with ExitStack() as stack:
        for name, value in small.items():
            stack.enter_context(setting(spark, name, value))
        stack.enter_context(ranges.sized_filters(spark))
        out = restrict_in_ranges(table, ranges, "k")
        assert len(out.collect()) == 10_000
        plan = out._jdf.queryExecution().executedPlan().toString()
    largest = max(r.n_keys for r in ranges.ranges)
    assert "GreaterThanOrEqual(k," in plan and "LessThanOrEqual(k," in plan
    assert "might_contain" in plan and f"{largest}, {8 * largest}" in plan


def test_rows_of_deleted_keys_leave_a_small_table_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(0, 40_000, 1, 4).selectExpr("nullif(id, 5) AS k", "'v' AS v").write.parquet(path)
    table = spark.read.parquet(path)
    with ExitStack() as stack:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            stack.enter_context(setting(spark, name, "-1"))
        left = keys_left(table, spark.range(30_000), "k", "id", bound=0)
        stack.enter_context(left.sized_filters(spark))
        out = rows_of_keys_left(table, left, "k")
        assert sorted(r["k"] or -1 for r in out.collect()) == [-1, *range(30_000, 40_000)]
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert "might_contain" in plan and "10000, 80000" in plan and "BroadcastHashJoin" not in plan


def test_broadcast_choice_rests_on_measured_bytes(spark):
    schema = spark.createDataFrame([], "k string").schema
    assert fits_broadcast(2_000_000, schema) and not fits_broadcast(2_000_000, schema, 2_000_000 * 10_000)
    assert fits_broadcast(10_000_000, schema, 10_000_000 * 8)
    jobs = spark.range(40).select(F.repeat(F.col("id").cast("string"), 1_000).alias("k"), F.current_timestamp().alias("t"))
    run = K.stage_keys(jobs, "k", "t", 10)
    assert (run.n_keys, run.n_bytes) == (40, 10 * 1_000 + 30 * 2_000)
