"""Deletes and compaction that stop at any step end with the same rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from coldhaul.sinks import folders, rewrites
from coldhaul.sinks import tables as lake
from tests.conftest import rows


class Stopped(Exception):
    """Stands for the death of the driver."""


def filled(spark, table, partition_by=("p",)):
    name, location = table("rewrite")
    df = spark.range(60).selectExpr("id AS k", "repeat('v', CAST(id AS INT)) AS v", "CAST(nullif(id % 5, 4) AS INT) AS p", "concat('x/', id % 2) AS q")
    lake.append_or_create(df, name, list(partition_by), location)
    return name


def stop_at(monkeypatch, step):
    """Stop before the step-th call of those that change anything."""
    calls = []

    def wrap(module, name):
        original = getattr(module, name)

        def call(*args, **kwargs):
            calls.append(name)
            if len(calls) - 1 == step:
                raise Stopped(name)
            return original(*args, **kwargs)

        monkeypatch.setattr(module, name, call)

    for module, name in ((rewrites, "_record"), (rewrites, "_switch"), (rewrites.folders, "remove")):
        wrap(module, name)
    return calls


KEPT = [k for k in range(60) if k not in (0, 5, 7, 12) and k % 5 != 1]


def keys(spark):
    """Keys in three partitions, one of which loses all its rows."""
    return spark.createDataFrame([(k,) for k in range(60) if k not in KEPT], "id long")


@pytest.mark.parametrize("step", range(10))
def test_a_delete_that_stops_is_completed(spark, table, step):
    name = filled(spark, table)
    untouched = {f for f in spark.read.table(name).inputFiles() if "p=3" in f or "p=__HIVE" in f}
    with pytest.MonkeyPatch.context() as patch:
        calls = stop_at(patch, step)
        try:
            lake.delete_keys(spark, name, keys(spark), "k", "id")
            assert len(calls) <= step
        except Stopped:
            pass
    spark.catalog.refreshTable(name)
    now = [r[0] for r in rows(spark.read.table(name).select("k"))]
    assert set(KEPT) <= set(now) and len(now) == len(set(now))
    lake.delete_keys(spark, name, keys(spark), "k", "id")
    assert sorted(r[0] for r in spark.read.table(name).select("k").collect()) == KEPT
    assert untouched <= set(spark.read.table(name).inputFiles())
    # No folder is left that the table does not use.
    home = rewrites._home(spark, name)
    used = {f.split("__rewrites/")[1].split("/")[0] for f in spark.read.table(name).inputFiles() if "__rewrites" in f}
    left = {n for n in folders.names(spark, home) if n != "journal" and folders.content(spark, f"{home}/{n}") != "0 files"}
    assert {n for n in left if "p=" in str(folders.names(spark, f"{home}/{n}"))} <= used
    lake.append(spark.createDataFrame([(500, "new", 2, "z")], "k long, v string, p int, q string"), name)
    assert spark.read.table(name).count() == len(KEPT) + 1


@pytest.mark.parametrize("partition_by", [("p", "q"), ("q",), ("d",)])
def test_partition_values_of_all_kinds(spark, table, partition_by):
    name, location = table("rewrite")
    day = F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("id") % 3).cast("int"))
    df = spark.range(40).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("a/b=c 'ä' %"), (F.col("id") % 4).cast("string"))).alias("q"),
        (F.col("id") % 2).cast("int").alias("p"),
        day.alias("d"),
    )
    lake.append_or_create(df, name, list(partition_by), location)
    for gone in ((1, 2, 3), (4, 5, 11)):
        lake.delete_keys(spark, name, spark.createDataFrame([(k,) for k in gone], "k long"), "k")
    want = df.where(~F.col("k").isin(1, 2, 3, 4, 5, 11))
    assert rows(spark.read.table(name), "k", "q", "p", "d") == rows(want, "k", "q", "p", "d")
    # Rewriting a switched partition by the usual way, too.
    lake.overwrite_partitions(df.where("k < 20").select(*spark.read.table(name).columns), name)
    assert spark.read.table(name).where("k < 20").count() == 20


def test_only_hit_partitions_are_read(spark, table):
    name = filled(spark, table)
    parts = spark.read.table(name).where("p = 2").select("p").distinct().collect()
    kept = rewrites.in_partitions(spark.read.table(name), ["p"], parts)
    assert all("p=2" in f for f in kept.select("v").inputFiles())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan or "PartitionFilters: [(p" in plan


def test_appended_files_are_not_lost(spark, table, monkeypatch):
    """A partition that another writer appends to between the copy and the switch keeps all rows."""
    name = filled(spark, table)
    original, done = rewrites._switch, []

    def append_first(*args):
        if not done:
            done.append(1)
            lake.append(spark.createDataFrame([(700, "late", 0, "z")], "k long, v string, p int, q string"), name)
        return original(*args)

    monkeypatch.setattr(rewrites, "_switch", append_first)
    with pytest.raises(rewrites.PartitionChanged, match="p"):
        lake.delete_keys(spark, name, keys(spark), "k", "id")
    assert spark.read.table(name).where("k = 700").count() == 1
    lake.delete_keys(spark, name, keys(spark), "k", "id")
    assert sorted(r[0] for r in spark.read.table(name).select("k").collect()) == [*KEPT, 700]


def test_a_write_that_fails_changes_nothing(spark, table):
    name = filled(spark, table)
    bad = spark.read.table(name).withColumn("v", F.raise_error(F.lit("unreadable")).cast("string"))
    parts = spark.read.table(name).select("p").distinct().collect()
    with pytest.raises(Exception, match="unreadable"):
        rewrites.rewrite_partitions(spark, name, bad, parts)
    assert spark.read.table(name).count() == 60 and folders.names(spark, rewrites._home(spark, name)) == ["journal"]


def test_compaction_gathers_files_and_leaves_others(spark, table):
    name, location = table("compact")
    df = spark.range(200).selectExpr("id AS k", "CAST(id % 4 AS INT) AS p")
    lake.create_table(spark, name, df.schema, ["p"], location)
    for i in range(6):
        lake.append(df.where(f"k div 34 = {i} AND (p < 3 OR {i} = 0)"), name, files=1)
    before = set(spark.read.table(name).inputFiles())
    done = rewrites.compact_partitions(spark, name, 1 << 20, F.col("p") != 0)
    after = set(spark.read.table(name).inputFiles())
    assert sorted(r["p"] for r in done) == [1, 2]
    assert all(sum(f"p={p}/" in f for f in after) == 1 for p in (1, 2, 3))
    assert {f for f in before if "p=0/" in f or "p=3/" in f} <= after
    want = df.where("p < 3 OR k < 34")
    assert rows(spark.read.table(name), "k", "p") == rows(want, "k", "p")
    assert rewrites.compact_partitions(spark, name, 1 << 20, F.col("p") != 0) == []
