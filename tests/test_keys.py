from contextlib import ExitStack
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coldhaul.metrics import run_summary
from coldhaul.operators import keys as K
from coldhaul.operators import restrict
from coldhaul.operators.restrict import fits_broadcast, restrict_to_keys, rows_left, sized_bloom_filter, with_batch
from coldhaul.session import setting
from coldhaul.sources.jdbc import key_cuts
from tests.conftest import rows

NOW = datetime(2020, 1, 31)


def jobs(spark, n=300, hot_every=3):
    """Keys with times; one in ``hot_every`` shares one single time."""
    start = NOW - timedelta(days=40)
    data = []
    for i in range(n):
        hot = i % hot_every == 0
        data.append((i * 7 % n, start if hot else start + timedelta(hours=i % 97)))
    return spark.createDataFrame(data, "k bigint, t timestamp_ntz").repartition(5)


def oldest(df, limit):
    return [r.k for r in df.orderBy("t", "k").limit(limit).collect()]


@pytest.mark.parametrize("limit", [1, 50, 99, 100, 101, 250, 300, 1_000])
@pytest.mark.parametrize("one_task_rows", [1_000, 40])
def test_cap_takes_exactly_the_oldest(spark, limit, one_task_rows):
    df = jobs(spark)
    got = K.expired_keys(df, "k", "t", NOW, limit=limit, one_task_rows=one_task_rows)
    assert sorted(r.k for r in got.collect()) == sorted(oldest(df, limit))


def test_age_is_strict_and_missing_values_stay(spark):
    edge = NOW - timedelta(days=7)
    data = [(1, edge), (2, edge - timedelta(microseconds=1)), (3, None), (None, edge - timedelta(days=1))]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(data, "k bigint, t timestamp").withColumn("t", F.col("t").cast(kind))
        assert rows(K.expired_keys(df, "k", "t", NOW), "k") == [(2,)]
        assert rows(K.expired_keys(df, "k", "t", NOW, limit=5), "k") == [(2,)]


def test_cap_on_nothing(spark):
    df = jobs(spark).where("k < 0")
    assert K.expired_keys(df, "k", "t", NOW, limit=5).isEmpty()


def test_age_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "jobs")
    jobs(spark).withColumn("wide", F.lit("w")).write.parquet(path)
    plan = K.expired_keys(spark.read.parquet(path), "k", "t", NOW, limit=50)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(t,2020-01-24T00:00)" in text and "wide" not in text


@pytest.mark.parametrize("one_task_rows", [1_000, 30])
@pytest.mark.parametrize("size, batches", [(100, 3), (299, 2), (300, 1), (301, 1), (7, 43)])
def test_batches_follow_age_and_are_full(spark, size, batches, one_task_rows):
    df = jobs(spark)
    got = K.assign_batches(df, "k", "t", size, one_task_rows=one_task_rows)
    want = {k: i // size for i, k in enumerate(oldest(df, 300))}
    assert {r.k: r.batch_no for r in got.collect()} == want
    assert len(set(want.values())) == batches == K.ceil_division(300, size)
    assert K.batch_count(df, size).first().n_batches == batches


def test_ranks_are_computed_in_parallel_ranges(spark):
    df = jobs(spark)
    ranked = K.rank_rows(df, [F.col("t"), F.col("k")], 300, one_task_rows=30)
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 301))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "hashpartitioning(range_no" in window


def test_staged_keys_are_unique_and_fixed(spark):
    df = jobs(spark).union(jobs(spark).where("k < 10"))
    run = K.stage_keys(df, "k", "t", 100)
    assert (run.n_keys, run.n_batches, run.frame.count()) == (300, 3, 300)
    assert "parquet" in run.frame._jdf.queryExecution().executedPlan().toString()


def test_semi_and_anti_split_the_rows(spark):
    children = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (9, "d")], "ck bigint, v string")
    keys = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k bigint")
    for n in (None, 4, 10**9):
        kept = restrict_to_keys(children, keys, "ck", "k", n)
        left = rows_left(children, keys, "ck", "k", n)
        assert rows(kept) == [(1, "a"), (1, "a"), (9, "d")]
        assert rows(left) == [(2, "b"), (None, "c")]


def test_broadcast_only_below_the_bound(spark, tmp_path):
    schema = spark.range(1).schema
    assert fits_broadcast(1_000_000, schema) and not fits_broadcast(100_000_000, schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys, rows_ = spark.range(10), spark.range(100)
        small = restrict_to_keys(rows_, keys, "id", n_keys=10)
        large = restrict_to_keys(rows_, keys, "id", n_keys=100_000_000)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (small, large)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]


@pytest.fixture
def shuffled_joins(spark):
    """Joins beyond the broadcast bound, with skew limits sized for test data."""
    small = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    with ExitStack() as stack:
        for name, value in small.items():
            stack.enter_context(setting(spark, name, value))
        yield


def test_a_key_with_a_third_of_the_rows_is_split(spark, tmp_path, shuffled_joins):
    path = str(tmp_path / "children")
    key = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 1_000)
    children = spark.range(0, 60_000, 1, 12).select(key.alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    children.write.parquet(path)
    children = spark.read.parquet(path).repartition(12)
    keys = spark.range(0, 500).withColumnRenamed("id", "k")
    kept = restrict_to_keys(children, keys, "k", n_keys=10**9)
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin(skew=true)" in plan
    assert kept.count() == children.where("k < 500").count()


def test_rows_of_many_keys_are_filtered_and_split_before_the_write(spark, tmp_path, shuffled_joins):
    path = str(tmp_path / "rows")
    key = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 1_000)
    text = F.md5(F.col("id").cast("string"))
    spark.range(0, 60_000, 1, 12).select(key.alias("ck"), text.alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    staged = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("batch_no"))
    staged.write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys")).where("batch_no >= 0")
    run = K.RunKeys(keys, "k", 15_000_000, 2)
    with setting(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0"):
        with sized_bloom_filter(spark, run):
            out = with_batch(df, run, "ck").hint("rebalance", "batch_no")
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bloom_filter_agg(xxhash64(ck" in plan and "15000000, 120000000" in plan
    assert "ShuffledHashJoin(skew=true)" in plan
    assert out.count() == df.where("ck < 500").count()
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.numBits") == "8388608"


@pytest.mark.parametrize("bound", [64 * 1024 * 1024, 0])
def test_summary_is_the_same_on_both_paths(spark, monkeypatch, bound):
    monkeypatch.setattr(restrict, "BROADCAST_BYTES", bound)
    run = K.stage_keys(jobs(spark), "k", "t", 100)
    hot = spark.range(0, 900).select(F.when(F.col("id") % 3 == 0, F.lit(4)).otherwise(F.col("id")).alias("ck"))
    out = run_summary(run, {"n_rows": (hot, "ck"), "none": (hot.where("ck < 0"), "ck")})
    batch = {r.k: r.batch_no for r in run.frame.collect()}
    want = {b: [100, 0, 0] for b in range(3)}
    for r in hot.collect():
        if r.ck in batch:
            want[batch[r.ck]][1] += 1
    assert rows(out) == [(b, *v) for b, v in sorted(want.items())]


def test_key_cuts_balance_the_keys(spark):
    run = K.stage_keys(jobs(spark), "k", "t", 100)
    cuts = key_cuts(run, 4)
    assert len(cuts) == 3 and cuts == sorted(cuts) and 60 < cuts[0] < 90
    assert key_cuts(run, 1) == []
