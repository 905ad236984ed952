"""The operators on the shared test tables, one query per operator.

``orders`` stands for the table that drives a run, ``lineitem`` for tables with
many rows per key, ``events`` for a table with a JSON text column. NULLs,
escapes, malformed text and type drift are derived from the rows' keys.
"""

from __future__ import annotations

import lzma
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.json_text import infer_with_fallback, rejected_rows, unescape_json, with_parsed
from coldhaul.metrics import parse_counts, run_summary
from coldhaul.operators import keys as K
from coldhaul.operators import shape
from coldhaul.operators.conform import conform
from coldhaul.operators.key_ranges import KEYS_PER_RANGE, key_ranges, restrict_in_ranges
from coldhaul.operators.restrict import restrict_to_keys, rows_left
from coldhaul.plans.archive import (
    PASS_NAME_FIELDS,
    ArchiveFailed,
    ArchiveTable,
    JsonColumn,
    RunScope,
    archive,
    spread_documents,
)
from coldhaul.plans.ledger import Ledger, archived
from coldhaul.plans.snapshot import IngestJournal, ingest_snapshot, ingested
from coldhaul.session import configure, scratch_path
from coldhaul.sinks import rewrites
from coldhaul.sinks import tables as lake
from coldhaul.sources.json_lines import read_json_lines
from coldhaul.sources.tables import read_table, register_archives

AS_OF = "2000-01-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """A table name not used before and a place for its files."""
    return f"coldhaul_{label}_{uuid.uuid4().hex[:12]}", scratch_path(spark, label)


def _expired(spark: SparkSession, sf_dir: str, limit: int | None = None, **options: int) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return K.expired_keys(orders, "o_orderkey", "o_orderdate", AS_OF, limit=limit, **options)


def expired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expired(spark, sf_dir, limit=5_000).select(F.col("o_orderkey").alias("job_id"))


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _expired(spark, sf_dir)
    n = keys.count()
    # At least eight ranges, so that ranking is distributed on small tables too.
    rows = min(K.ONE_TASK_ROWS, max(1, n // 8))
    batched = K.assign_batches(keys, "o_orderkey", "o_orderdate", 1_000, n, one_task_rows=rows)
    return batched.select(F.col("o_orderkey").alias("job_id"), "batch_no")


def batch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.batch_count(load(spark, sf_dir, "orders"), 700)


def children_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restrict_to_keys(
        load(spark, sf_dir, "lineitem"), _expired(spark, sf_dir), "l_orderkey", "o_orderkey"
    )


def children_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _expired(spark, sf_dir).select("o_orderkey")
    # At least four ranges, so that small tables take the ranged way too.
    per_range = min(KEYS_PER_RANGE, max(1, keys.count() // 4))
    return restrict_in_ranges(
        load(spark, sf_dir, "lineitem"), key_ranges(keys, "o_orderkey", per_range, tasks_per_range=2), "l_orderkey"
    )


def retained_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_left(load(spark, sf_dir, "lineitem"), _expired(spark, sf_dir), "l_orderkey", "o_orderkey")


def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, location = _new_table(spark, "delete")
    orders = load(spark, sf_dir, "orders").select("*", F.year("o_orderdate").alias("year"))
    left = []
    for kind, partition_by in (("whole", []), ("by year", ["year"])):
        name, location = _new_table(spark, "delete")
        lake.append_or_create(orders, name, partition_by, location)
        lake.delete_keys(spark, name, _expired(spark, sf_dir), "o_orderkey")
        left.append(read_table(spark, name).select(F.lit(kind).alias("kind"), *orders.columns))
    return left[0].union(left[1])


def summary_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = K.stage_keys(_expired(spark, sf_dir), "o_orderkey", "o_orderdate", 1_000)
    return run_summary(run, {"n_trace": (load(spark, sf_dir, "lineitem"), "l_orderkey")})


def _k_of(df: DataFrame, decode: Callable[[Column], Column]) -> DataFrame:
    schema = T.StructType.fromDDL("k bigint")
    return shape.expand_struct(with_parsed(df, "props", schema, decode), "j", ["event_id"], ["_corrupt_record"])


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _k_of(load(spark, sf_dir, "events"), lambda c: c)


def json_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    escaped = F.replace("props", F.lit('"'), F.lit('\\"'))
    mixed = F.when(F.col("event_id") % 3 == 0, escaped).otherwise(F.col("props"))
    return _k_of(events.withColumn("props", mixed), unescape_json)


def xz_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write xz files of JSON lines in blocks that cut the lines anywhere, ingest them as a snapshot, and read the table back."""
    lines = load(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "props")).alias("value"))
    folder = scratch_path(spark, "xz")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            name = f"part-{uuid.uuid4().hex}.xz"
            text = "\n".join(batch.column("value").to_pylist()).encode()
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for at in range(0, len(text), 100_001):
                    out.write(lzma.compress(text[at : at + 100_001], preset=1))
            yield pa.record_batch([pa.array([f"{folder}/{name}"])], names=["path"])

    paths = [r["path"] for r in lines.mapInArrow(pack, "path string").collect()]
    name, location = _new_table(spark, "xz")
    ingest_snapshot(spark, paths, name, location)
    return _k_of(read_table(spark, name).drop("batch_index"), lambda c: c)


def _troubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose documents are NULL, empty, malformed or fine, by key."""
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, "")
        .when(kind == 2, F.concat(F.lit("not json "), F.repeat("props", F.lit(30))))
        .otherwise(F.col("props"))
    )
    events = load(spark, sf_dir, "events").select("event_id", text.alias("props"))
    return with_parsed(events, "props", T.StructType.fromDDL("k bigint"))


def json_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_counts(_troubled(spark, sf_dir)).withColumnRenamed("parse_status", "status")


def sample_failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = rejected_rows(_troubled(spark, sf_dir), "props")
    return rejected.orderBy("event_id").limit(3).select("event_id", "snippet", F.col("props").alias("text"))


def _write_lines(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.select(F.to_json(F.struct("*"))).write.text(path)
    return path


def json_infer_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.when(F.col("o_orderkey") % 2 == 1, F.struct(F.col("o_orderpriority").alias("pri")))
    docs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), meta.alias("meta"))
    return shape.flatten_structs(read_json_lines(spark, _write_lines(docs, "docs")))


def json_infer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    doc = F.to_json(F.struct(k, F.lit('say "hi"').alias("s")))
    docs = load(spark, sf_dir, "events").select("event_id", doc.alias("doc"))

    def drop_backslashes(c: Column) -> Column:
        return F.replace(c, F.lit("\\"), F.lit(""))

    schema, decode = infer_with_fallback(docs, "doc", drop_backslashes)
    parsed = with_parsed(docs, "doc", schema, decode)
    return shape.expand_struct(parsed, "j", ["event_id"], ["_corrupt_record"])


def blank_json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    blanks = F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int"))
    docs = load(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), blanks.alias("doc"))
    spec = JsonColumn("doc")
    schema, decode = infer_with_fallback(docs, "doc")
    return spread_documents(docs, spec, schema, decode, ["job_id"]).drop("doc", "parse_status")


def preferred_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("event_id") % 2 == 1
    doc = F.to_json(
        F.struct(
            F.when(odd, F.col("event_type")).alias(PASS_NAME_FIELDS[0]),
            F.when(~odd, F.col("event_type")).alias(PASS_NAME_FIELDS[1]),
        )
    )
    docs = load(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    schema, decode = infer_with_fallback(docs, "doc")
    name = shape.prefer_values(schema, PASS_NAME_FIELDS, "j")
    return with_parsed(docs, "doc", schema, decode).select("event_id", name.alias("pass_name"))


def to_json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = T.StructType.fromDDL("key bigint, arr_json array<bigint>, obj_json struct<name:string>")
    target = T.StructType.fromDDL("key bigint, arr_json string, obj_json string")
    cells = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"),
        F.array("c_custkey", F.col("c_nationkey").cast("bigint")).alias("arr_json"),
        F.struct(F.col("c_name").alias("name")).alias("obj_json"),
    )
    return conform(cells.to(source), target)[0]


def fill_empty_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
        F.nullif("o_custkey", F.lit(1)).alias("o_custkey"),
    )
    return shape.fill_empty_strings(orders)


def flatten_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct(F.col("c_nationkey").alias("nation")).alias("loc")
    packed = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.struct(F.col("c_name").alias("name"), place).alias("info")
    )
    return shape.flatten_structs(packed)


def cast_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return shape.cast_columns(orders, {"o_custkey": "string", "no_such_column": "string"})


def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    supplier = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")
    )
    region = load(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey")).alias("key"), F.col("r_name").alias("name")
    )
    return shape.union_all([customer, supplier, region])


def reconcile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    incoming = load(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 4 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("num"),
        F.when(key % 3 != 0, F.col("o_orderstatus")).alias("tags"),
        F.array(F.lit(1), (key % 7).cast("int")).alias("note"),
        F.struct(F.col("o_orderstatus").alias("s")).alias("obj"),
        F.lit(1).alias("extra"),
    )
    table = T.StructType.fromDDL(
        "id bigint, num bigint, tags array<string>, note string, obj string, gone double"
    )
    out, _ = conform(incoming, table)
    tags = [F.size("tags").alias("tags_n"), F.get("tags", F.lit(0)).alias("tags_0")]
    return out.select("id", "num", *tags, "note", "obj", "gone")


def create_append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, location = _new_table(spark, "roundtrip")
    orders = load(spark, sf_dir, "orders")
    for _ in range(2):
        lake.append_or_create(orders, name, location=location)
    return read_table(spark, name)


def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, location = _new_table(spark, "partitioned")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    lake.create_table(spark, name, orders.schema, ["o_orderstatus"], location)
    lake.overwrite_partitions(orders, name, cluster_by=["o_orderstatus"])
    return read_table(spark, name)


def evolve_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, location = _new_table(spark, "evolve")
    columns = {"p_name": "name", "p_partkey": "key", "p_size": "size", "p_type": "type"}
    part = load(spark, sf_dir, "part").select(*[F.col(a).alias(b) for a, b in columns.items()])
    odd = F.col("key") % 2 == 1
    lake.append_or_create(part.where(~odd).select("key", "name", "size"), name, location=location)
    # A new column, and a type that drifts with values that do not fit.
    size = F.when(F.col("key") % 5 == 0, "unknown").otherwise(F.col("size").cast("string"))
    lake.evolve_append(part.where(odd).withColumn("size", size), name)
    return read_table(spark, name)


def nested_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of JSON documents, the second with new fields inside structs and arrays, archived into one table."""
    prefix, location = _new_table(spark, "growth")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    late = F.year(day) >= 1996
    orders = load(spark, sf_dir, "orders")
    old = F.struct(F.struct(F.col("o_orderstatus").alias("code")).alias("state"), F.array(F.struct(key.alias("k"))).alias("items"))
    state = F.struct(F.col("o_orderstatus").alias("code"), F.struct(F.col("o_orderpriority").alias("name")).alias("pri"))
    weights = (F.lit(None).cast("double"), (key % 9 + 0.5).cast("double"))
    items = F.array(*[F.struct(key.alias("k"), w.alias("w")) for w in weights])
    new = F.struct(state.alias("state"), items.alias("items"))
    documents = orders.select("o_orderkey", "o_orderdate", F.when(late, F.to_json(new)).otherwise(F.to_json(old)).alias("doc"))
    ledger = Ledger(prefix, location)
    for run_id, as_of in (("first", "1996-01-08 00:00:00"), ("second", AS_OF)):
        part = documents.where(late if run_id == "second" else ~late)
        table = ArchiveTable("docs", part.drop("o_orderdate"), "o_orderkey", f"{prefix}_docs", JsonColumn("doc"), f"{location}/docs")
        scope = RunScope(part, "o_orderkey", "o_orderdate", as_of, batch_size=1 << 20)
        archive(spark, run_id, scope, [table], ledger)
    rows = archived(spark, f"{prefix}_docs", ledger)
    return rows.select(
        F.col("o_orderkey").alias("id"),
        "parse_status",
        F.col("state.code").alias("code"),
        F.col("state.pri.name").alias("pri"),
        F.size("items").alias("n_items"),
        F.get("items", F.lit(0))["k"].alias("first_k"),
        F.get("items", F.lit(1))["w"].alias("second_w"),
    )


def next_batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, location = _new_table(spark, "indexed")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("batch_index"))
    lake.create_table(spark, name, items.schema, ["batch_index"], location)
    states = [("empty", lake.next_batch_index(spark, name))]
    lake.overwrite_partitions(items, name, cluster_by=["batch_index"])
    states.append(("loaded", lake.next_batch_index(spark, name)))
    return spark.createDataFrame(states, "state string, next_index int")


def batch_index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots, the first ingested twice and the last after a call that stopped half way."""
    name, location = _new_table(spark, "snapshots")
    events = load(spark, sf_dir, "events")
    paths = [_write_lines(events.where(F.col("event_id") % 3 == i), "snapshot") for i in range(3)]
    for path in (paths[0], paths[0], paths[1]):
        ingest_snapshot(spark, [path], name, location)
    IngestJournal(name).record(spark, 3, "started", paths[2:])
    half = events.where("event_id % 6 = 2").withColumn("batch_index", F.lit(3))
    lake.evolve_append(half, name)
    ingest_snapshot(spark, paths[2:], name, location)
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("event_id", "user_id")]
    return ingested(spark, name).groupBy("batch_index").agg(F.count("*").alias("n"), *sums)


def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, location = _new_table(spark, "idempotent")
    batch = (F.col("o_orderkey") % 4).cast("int").alias("batch_no")
    orders = load(spark, sf_dir, "orders").select("*", batch)
    lake.create_table(spark, name, orders.schema, ["batch_no"], location)
    for _ in range(2):
        lake.overwrite_partitions(orders, name, cluster_by=["batch_no"])
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("o_orderkey", "o_custkey")]
    return read_table(spark, name).groupBy("batch_no").agg(F.count("*").alias("n"), *sums)


def compact_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve appends, the files of all batches but the last gathered, and what each batch holds then."""
    name, location = _new_table(spark, "compact")
    batch = (F.col("o_orderkey") % 3).cast("int").alias("batch_no")
    orders = load(spark, sf_dir, "orders").select("*", batch)
    lake.create_table(spark, name, orders.schema, ["batch_no"], location)
    for month in range(1, 13):
        lake.append(orders.where(F.month("o_orderdate") == month), name, files=1)
    rewrites.compact_partitions(spark, name, 1 << 30, F.col("batch_no") < 2)
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("o_orderkey", "o_custkey")]
    files = F.count_distinct("_metadata.file_path").alias("n_files")
    return read_table(spark, name).groupBy("batch_no").agg(F.count("*").alias("n"), files, *sums)


def _share_of_expired(spark: SparkSession, sf_dir: str, batches: int) -> int:
    """Batch size that splits the expired orders into that many batches."""
    return max(1, K.ceil_division(_expired(spark, sf_dir).count(), batches))


def archive_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, location = _new_table(spark, "archive")
    orders, items, events = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, F.replace("props", F.lit('"'), F.lit('\\"')))
        .when(kind == 2, F.lit("not json"))
        .otherwise(F.col("props"))
    )

    documents = events.withColumn("doc", text).drop("props")
    sources = {
        "jobs": (orders, "o_orderkey"),
        "details": (items, "l_orderkey"),
        "documents": (documents, "event_id"),
        "trace": (items, "l_orderkey"),
    }
    tables = []
    for name, (rows, key) in sources.items():
        # Lake copies, as the archived keys are deleted from them.
        lake.append_or_create(rows, f"{prefix}_from_{name}", location=f"{location}/from_{name}")
        copy = read_table(spark, f"{prefix}_from_{name}")
        json = JsonColumn("doc") if name == "documents" else None
        tables.append(ArchiveTable(name, copy, key, f"{prefix}_{name}", json, f"{location}/{name}"))

    def delete(keys: DataFrame) -> None:
        for name, (_, key) in sources.items():
            lake.delete_keys(spark, f"{prefix}_from_{name}", keys, key, "key")

    size = max(10_000, _share_of_expired(spark, sf_dir, 50))
    scope = RunScope(tables[0].rows, "o_orderkey", "o_orderdate", AS_OF, batch_size=size)
    ledger = Ledger(prefix, location)
    archive(spark, "run", scope, tables, ledger, delete)
    left = [
        read_table(spark, f"{prefix}_from_{name}").select(F.lit(name).alias("part")).groupBy("part").agg(F.count("*").alias("n_jobs"))
        for name in sources
    ]
    jobs, details, documents, trace = (archived(spark, t.target, ledger) for t in tables)
    # Counted per key before the joins, so a key with many rows stays one row.
    n_details = details.groupBy("l_orderkey").agg(F.count("*").alias("n_details"))
    n_trace = trace.groupBy("l_orderkey").agg(F.count("*").alias("n_trace"), F.sum("l_quantity").alias("qty"))
    n_docs = documents.groupBy("event_id").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("parse_status") != "ok").alias("n_rejected"),
        F.sum("k").alias("sum_k"),
    )
    per_job = (
        jobs.join(n_details.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
        .join(n_trace.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
        .join(n_docs.withColumnRenamed("event_id", "o_orderkey"), "o_orderkey", "left")
    )
    sums = ["n_details", "n_trace", "qty", "n_docs", "n_rejected", "sum_k"]
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums]
    moved = per_job.groupBy(F.concat(F.lit("archived "), "o_orderstatus").alias("part"))
    moved = moved.agg(F.count("*").alias("n_jobs"), *totals)
    return shape.union_all([moved, *left])


def manifest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, location = _new_table(spark, "gate")
    orders = load(spark, sf_dir, "orders")
    newest = _expired(spark, sf_dir).agg(F.max("o_orderkey").alias("key")).first()["key"]
    # About half of the batches hold such a day, and one an unreadable document.
    bad_day = (F.month("o_orderdate") <= 6) & (F.dayofmonth("o_orderdate") == 1)
    price = F.when(bad_day, "unknown").otherwise(F.col("o_totalprice").cast("string"))
    prices = orders.select("o_orderkey", price.alias("price"))
    unreadable = F.raise_error(F.lit("unreadable document")).cast("string")
    doc = F.when(F.col("o_orderkey") == newest, unreadable).otherwise(F.to_json(F.struct("o_orderstatus")))

    def table(name: str, rows: DataFrame, json: JsonColumn | None = None) -> ArchiveTable:
        return ArchiveTable(name, rows, "o_orderkey", f"{prefix}_{name}", json, f"{location}/{name}")

    documents = table("documents", orders.withColumn("doc", doc), JsonColumn("doc"))
    tables = [table("jobs", orders), table("prices", prices), documents]
    # The archive holds numbers, so one text makes its batch fail to be written.
    columns = T.StructType().add("o_orderkey", "long").add("price", "double")
    columns = columns.add("run_id", "string").add("batch_no", "integer")
    lake.create_table(spark, tables[1].target, columns, ["run_id", "batch_no"], tables[1].location)
    size = _share_of_expired(spark, sf_dir, 24)
    scope = RunScope(orders, "o_orderkey", "o_orderdate", AS_OF, batch_size=size)
    ledger = Ledger(prefix, location)
    try:
        archive(spark, "run", scope, tables, ledger)
    except ArchiveFailed:
        pass
    return ledger.deletable_keys(spark).select(F.col("key").alias("job_id"))


def archive_sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, location = _new_table(spark, "sql")
    orders, items = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    target, ledger = f"{prefix}_items", Ledger(prefix, location)
    columns = T.StructType([*items.schema.fields]).add("run_id", "string").add("batch_no", "integer")
    lake.create_table(spark, target, columns, ["run_id", "batch_no"], f"{location}/items")
    size = _share_of_expired(spark, sf_dir, 12)
    scope = RunScope(orders, "o_orderkey", "o_orderdate", AS_OF, batch_size=size)
    tax = F.when(F.col("l_orderkey") % 977 == 3, "unknown").otherwise(F.col("l_tax").cast("string"))
    # Some batches of the first run fail; the second takes their keys again.
    for run_id, rows in (("first", items.withColumn("l_tax", tax)), ("second", items)):
        table = ArchiveTable("items", rows, "l_orderkey", target)
        try:
            archive(spark, run_id, scope, [table], ledger)
        except ArchiveFailed:
            pass
    register_archives(spark, {"archived_lineitem": target}, ledger)
    return spark.sql("""SELECT l_returnflag, count(*) AS n, sum(l_orderkey) AS sum_key,
      sum(l_partkey) AS sum_part FROM archived_lineitem GROUP BY l_returnflag""")


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    run.__name__ = query.__name__
    return run


QUERIES: dict[str, Query] = {
    name: _configured(query)
    for name, query in {
        "expired_keys": expired_keys,
        "batch_assign": batch_assign,
        "batch_count": batch_count,
        "children_semi": children_semi,
        "children_in_ranges": children_in_ranges,
        "retained_anti": retained_anti,
        "delete_by_key": delete_by_key,
        "run_summary": summary_per_batch,
        "json_fields": json_fields,
        "json_unescape": json_unescape,
        "xz_json_lines": xz_json_lines,
        "json_parse_status": json_parse_status,
        "sample_failed_rows": sample_failed_rows,
        "json_infer_flatten": json_infer_flatten,
        "json_infer_fallback": json_infer_fallback,
        "blank_json_shape": blank_json_shape,
        "preferred_field": preferred_field,
        "to_json_cells": to_json_cells,
        "fill_empty_strings": fill_empty_strings,
        "flatten_structs": flatten_structs,
        "cast_columns": cast_columns,
        "union_missing_columns": union_missing_columns,
        "reconcile_types": reconcile_types,
        "create_append_roundtrip": create_append_roundtrip,
        "partitioned_write": partitioned_write,
        "evolve_append": evolve_append,
        "nested_growth": nested_growth,
        "next_batch_index": next_batch_index,
        "batch_index_append": batch_index_append,
        "idempotent_append": idempotent_append,
        "compact_batches": compact_batches,
        "archive_end_to_end": archive_end_to_end,
        "manifest_gate": manifest_gate,
        "archive_sql_view": archive_sql_view,
    }.items()
}
