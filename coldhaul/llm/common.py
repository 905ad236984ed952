"""Table access, scratch tables and distributed ranks shared by the operators here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldhaul.session import scratch_path, setting

WHITE_SPACE = r"[\x20\x09-\x0D]+"
KEY_BITS = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back, which cuts the lineage.

    The shuffle files of the write go with it; else they would stay on the executors' disks
    until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(docs: DataFrame, text: str = "text") -> Column:
    """The text, empty when null."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def numbered(df: DataFrame, label: str) -> DataFrame:
    """Store rows with a distinct ``row``; its high bits name the task that wrote it."""
    return stored(df.withColumn("row", F.monotonically_increasing_id()), label)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a distinct whole-number ``key`` in the order of doc_id.

    Ids that are distinct whole numbers are their own key. Otherwise the rows are
    sorted by id, nulls first, and numbered from 0 without gaps.
    """
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or doc_id < 0 or n > 1")
        top = docs.agg(F.max("doc_id")).first()[0]
        if not ids.take(1) and (top is None or top < 1 << KEY_BITS):
            return docs.withColumn("key", F.col("doc_id").cast("long"))
    ordered = numbered(by_id(docs), "keyed-documents").withColumn("chunk", F.shiftright("row", 33))
    # A row per task that wrote, so this window is short.
    before = Window.orderBy("of_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(F.col("chunk").alias("of_chunk")).agg(F.count("*").alias("size"))
    bases = sizes.select("of_chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    placed = ordered.join(F.broadcast(bases), F.col("chunk") == F.col("of_chunk"))
    return placed.withColumn("key", F.col("base") + F.expr("row & 8589934591")).drop("row", "chunk", "of_chunk", "base")


def by_id(docs: DataFrame) -> DataFrame:
    """Rows in ranges of doc_id, sorted, nulls first; an id that many rows have is split by their place."""
    salted = docs.withColumn("salt", F.monotonically_increasing_id())
    return salted.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").drop("salt")


def least_hash_sample(docs: DataFrame, n: int) -> DataFrame:
    """(text) of the ``n`` distinct texts of least hash, fewer if there are fewer; null is empty.

    Only hashes are sorted and sent; the texts are then picked by the n-th hash.
    """
    texts = docs.select(whole_text(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    least = texts.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if least is None:
        return texts.select("text").limit(0)
    return texts.where(F.col("h") <= least).groupBy("h").agg(F.first("text").alias("text")).select("text")


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rank`` from 0 without gaps inside each combination of ``keys``.

    ``rows`` comes from :func:`numbered`. Rows are ranked within (keys, writing
    task) and shifted by the counts of earlier tasks, so a key that holds most rows
    is spread over as many groups as tasks wrote it. Null keys form a group.
    """
    rows = rows.withColumn("chunk", F.shiftright("row", 33))
    sizes = rows.groupBy(*keys, "chunk").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        *[F.col(k).alias(f"base_{k}") for k in keys],
        F.col("chunk").alias("base_chunk"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
    )
    match = [F.col(k).eqNullSafe(F.col(f"base_{k}")) for k in [*keys, "chunk"]]
    condition = match[0]
    for part in match[1:]:
        condition = condition & part
    place = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("row")) - 1
    local = rows.withColumn("place", place)
    return (
        local.join(bases, condition, "left")
        .withColumn("rank", F.col("base") + F.col("place"))
        .drop("chunk", "place", "base", "base_chunk", *[f"base_{k}" for k in keys])
    )
