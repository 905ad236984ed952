import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.session import setting
from coldhaul.sinks import tables as lake
from coldhaul.sources.tables import register_views
from tests.conftest import rows


def test_create_refuses_an_existing_table(spark, table):
    name, location = table()
    schema = T.StructType().add("id", "long")
    lake.create_table(spark, name, schema, location=location)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_ALREADY_EXISTS"):
        lake.create_table(spark, name, schema)
    lake.create_table(spark, name, schema, if_missing=True)


def test_append_is_by_name(spark, table):
    name, location = table()
    lake.append_or_create(spark.createDataFrame([(1, "x")], "a int, b string"), name, location=location)
    lake.append(spark.createDataFrame([("y", 2)], "b string, a int"), name, files=1)
    assert rows(spark.read.table(name)) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="columns"):
        lake.append(spark.createDataFrame([(1,)], "a int"), name)


def test_partitions_are_pruned(spark, table):
    name, location = table()
    df = spark.range(30).withColumn("p", F.col("id") % 3)
    lake.append_or_create(df, name, ["p"], location)
    one = spark.read.table(name).where("p = 1")
    assert one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    assert all("p=1" in f for f in one.inputFiles())


def test_file_count(spark, table):
    name, location = table()
    lake.append_or_create(spark.range(0, 1_000, 1, 16), name, location=location, files=2)
    assert len(spark.read.table(name).inputFiles()) == 2


def test_clustered_rewrite_gathers_partitions(spark, table):
    name, location = table()
    df = spark.range(0, 1_000, 1, 16).withColumn("p", F.col("id") % 3)
    lake.create_table(spark, name, df.schema, ["p"], location)
    lake.overwrite_partitions(df, name, cluster_by=["p"])
    assert len(spark.read.table(name).inputFiles()) == 3


def test_a_heavy_partition_is_written_by_many_tasks(spark, table):
    name, location = table()
    text = F.concat_ws("", *[F.sha2(F.concat("id", F.lit(i)), 512) for i in range(4)])
    df = spark.range(0, 20_000, 1, 8).select("id", text.alias("v"), F.lit(1).alias("p"))
    lake.create_table(spark, name, df.schema, ["p"], location)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        lake.overwrite_partitions(df, name, cluster_by=["p"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(spark.read.table(name).inputFiles()) > 4
    assert spark.read.table(name).count() == 20_000


def test_rewrite_replaces_only_its_partitions(spark, table):
    name, location = table()
    df = spark.range(9).withColumn("p", (F.col("id") % 3).cast("int"))
    lake.create_table(spark, name, df.schema, ["p"], location)
    lake.overwrite_partitions(df, name)
    lake.overwrite_partitions(df.where("p = 1 and id > 3"), name)
    assert rows(spark.read.table(name).groupBy("p").count()) == [(0, 3), (1, 2), (2, 3)]


def test_evolving_append(spark, table):
    name, location = table()
    lake.append_or_create(spark.createDataFrame([(1, "a")], "k bigint, v string"), name, location=location)
    drifted = spark.createDataFrame(
        [(2.0, ("q", [1]), 7)], "v double, `new one` struct<`x y`:string,l:array<int>>, k int"
    )
    report = lake.evolve_append(drifted, name)
    assert spark.read.table(name).columns == ["k", "v", "new one"]
    assert rows(spark.read.table(name)) == [(1, "a", None), (7, "2.0", ("q", [1]))]
    assert [m[0] for m in report.mismatched] == ["k", "v"]


def test_evolving_append_keeps_values_that_do_not_fit(spark, table):
    name, location = table()
    lake.append_or_create(spark.createDataFrame([(1, 1, [1])], "k int, v bigint, l array<int>"), name, location=location)
    drifted = spark.createDataFrame(
        [(2, 2.5, ["7", "x"]), (3, 3.0, ["8"]), (4, None, None)], "k int, v double, l array<string>"
    )
    lake.evolve_append(drifted, name)
    assert rows(spark.read.table(name)) == [
        (1, 1, [1], None),
        (2, 2, [7, None], '{"v":"2.5","l":"[\\"7\\",\\"x\\"]"}'),
        (3, 3, [8], None),
        (4, None, None, None),
    ]


def test_conforming_append_drops_extra_columns(spark, table):
    name, location = table()
    lake.append_or_create(spark.createDataFrame([(1,)], "k bigint"), name, location=location)
    report = lake.conform_append(spark.createDataFrame([("2", 3)], "k string, extra int"), name)
    assert report.extra == ["extra"] and rows(spark.read.table(name)) == [(1,), (2,)]


def test_names_differing_by_case_are_two_columns(spark, table):
    name, location = table()
    df = spark.createDataFrame([("a", "b")], "LPMPassName string, LPMPASSNAME string")
    lake.append_or_create(df, name, location=location)
    assert rows(spark.read.table(name).select("LPMPASSNAME", "LPMPassName")) == [("b", "a")]


@pytest.mark.parametrize("partition_by", [[], ["batch_index"], ["other", "batch_index"]])
def test_next_index(spark, table, partition_by):
    name, location = table()
    schema = T.StructType().add("v", "long").add("other", "integer").add("batch_index", "integer")
    lake.create_table(spark, name, schema, partition_by, location)
    assert lake.next_batch_index(spark, name) == 1
    df = spark.createDataFrame([(1, 0, 2), (1, 0, 10), (1, 0, 9)], schema)
    lake.append(df, name)
    assert lake.next_batch_index(spark, name) == 11


@pytest.mark.parametrize("partition_by", [[], ["p"]])
def test_delete_keys(spark, table, partition_by):
    name, location = table()
    df = spark.range(10).selectExpr("nullif(id, 9) AS k", "CAST(id % 2 AS INT) AS p")
    lake.append_or_create(df, name, partition_by, location)
    keys = spark.createDataFrame([(0,), (3,), (77,)], "id bigint")
    lake.delete_keys(spark, name, keys, "k", "id", n_keys=3)
    left = rows(spark.read.table(name).select("k"))
    assert left == [(1,), (2,), (4,), (5,), (6,), (7,), (8,), (None,)]
    lake.append(spark.createDataFrame([(50, 1)], "k bigint, p int"), name)
    assert spark.read.table(name).count() == 9


@pytest.mark.parametrize("partition_by", [[], ["p"]])
@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_many_deleted_keys_never_shuffle_whole_rows(spark, table, partition_by, kind, monkeypatch):
    monkeypatch.setattr(lake, "KEYS_ALONE_BYTES", 0)
    name, location = table()
    key = F.when(F.col("id") % 5 != 0, F.floor(F.col("id") / 4)).cast(kind)
    df = spark.range(0, 2_000, 1, 4).select(key.alias("k"), F.md5(F.col("id").cast("string")).alias("v"), (F.col("id") % 2).cast("int").alias("p"))
    lake.append_or_create(df, name, partition_by, location)
    keys = spark.range(490).union(spark.range(100)).selectExpr(f"CAST(nullif(id, 7) AS {kind}) AS id")
    wanted = [r for r in rows(df) if r[0] is None or float(r[0]) == 7 or float(r[0]) >= 490]
    joins = []
    original = type(df).join

    def join(left, right, on=None, how=None):
        joins.append((how, left.columns))
        return original(left, right, on, how)

    monkeypatch.setattr(type(df), "join", join)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        lake.delete_keys(spark, name, keys, "k", "id")
    assert rows(spark.read.table(name).select("k", "v", "p")) == wanted
    assert [columns for how, columns in joins if how == "left_anti"] == [["key"]]


def test_sql_over_registered_tables(spark):
    register_views(spark, {"some_rows": spark.range(4)})
    assert spark.sql("SELECT sum(id) FROM some_rows").first()[0] == 6
