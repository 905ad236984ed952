import pytest
from pyspark.sql import functions as F

from coldhaul.llm import common
from llm_data import DOC_SCHEMA


@pytest.fixture
def whole_partitions(spark):
    """Small partitions are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def some(spark):
    """A third without id, a third with one id and one text."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "same" if i % 3 < 2 else f"t{i}", "en", "s") for i in range(3000)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def test_an_id_that_many_rows_have_is_split(spark, whole_partitions):
    parts = common.by_id(some(spark)).withColumn("p", F.spark_partition_id())
    assert max(r["count"] for r in parts.groupBy("p").count().collect()) < 800
    ranges = parts.groupBy("p").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("a"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("b"))
    found = [(r["a"], r["b"]) for r in ranges.orderBy("p").collect()]
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_keys_are_numbered_without_gaps_in_the_order_of_ids(spark, whole_partitions):
    docs = some(spark)
    rows = sorted(common.keyed(docs).select("key", "doc_id").collect(), key=lambda r: r["key"])
    assert [r["key"] for r in rows] == list(range(3000))
    ids = [r["doc_id"] for r in docs.collect()]
    assert [r["doc_id"] for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert common.keyed(docs).columns == [*docs.columns, "key"]


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for i in range(blocks.size()) if (b := blocks.apply(i).name()).startswith("shuffle_")}


def test_storing_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    grouped = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids"))
    assert common.stored(grouped, "test").count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    # Counting leaves one of its own.
    left = {b.split("_")[1] for b in shuffle_files(spark) - before}
    assert len(left) <= 1
