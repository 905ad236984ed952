from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coldhaul import ArchiveFailed, ArchiveTable, JsonColumn, Ledger, RunScope, archive, archived
from coldhaul.operators import restrict
from coldhaul.plans import archive as plan
from coldhaul.session import setting
from coldhaul.sinks.tables import create_table
from tests.conftest import rows

NOW = datetime(2020, 1, 31)
OLD = NOW - timedelta(days=30)


class Source:
    """Three related tables; archived keys are removed from them."""

    def __init__(self, spark, table, n=40):
        self.spark = spark
        when = F.lit(str(OLD)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))
        recent = F.lit(str(NOW)).cast("timestamp_ntz")
        self.jobs = spark.range(n + 5).select(
            F.col("id").alias("job"),
            F.when(F.col("id") < n, when).otherwise(recent).alias("seen"),
            F.when(F.col("id") % 2 == 0, F.lit("x")).alias("note"),
        )
        self.trace = spark.range(3 * n).select((F.col("id") % n).alias("job"), F.col("id").alias("line"))
        doc = F.to_json(F.struct(F.col("id").alias("num"), F.lit("y").alias("LPMPassName")))
        kind = F.col("id") % 4
        doc = F.when(kind == 0, F.lit(None)).when(kind == 1, "broken").otherwise(doc)
        self.docs = spark.range(n).select(F.col("id").alias("job"), doc.alias("doc"))
        self.prefix, self.location = table("archive")
        self.ledger = Ledger(self.prefix, self.location)

    def target(self, name):
        return f"{self.prefix}_{name}"

    def table(self, name, df, json=None):
        return ArchiveTable(name, df, "job", self.target(name), json, f"{self.location}/{name}")

    def run(self, run_id, delete=True, limit=None, **changed):
        parts = {"jobs": self.jobs, "trace": self.trace, "docs": self.docs} | changed
        tables = [self.table(n, d, JsonColumn("doc") if n == "docs" else None) for n, d in parts.items()]
        scope = RunScope(self.jobs, "job", "seen", NOW, limit=limit, batch_size=10)
        return archive(self.spark, run_id, scope, tables, self.ledger, self.delete if delete else None)

    def delete(self, keys):
        gone = [r.key for r in keys.collect()]
        for name in ("jobs", "trace", "docs"):
            df = getattr(self, name)
            setattr(self, name, df.where(~F.col("job").isin(gone)))

    def archived(self, name):
        return archived(self.spark, self.target(name), self.ledger)


@pytest.fixture
def source(spark, table):
    return Source(spark, table)


def keys_of(df, column="job"):
    return sorted(r[0] for r in df.select(column).collect())


def failing_at(df, job, column):
    stop = F.when(F.col("job") == job, F.raise_error(F.lit("cannot read")).cast(df.schema[column].dataType))
    return df.withColumn(column, stop.otherwise(F.col(column)))


def test_a_run_moves_everything_expired(source):
    result = source.run("r1")
    assert (result.n_keys, result.n_batches, result.failed) == (40, 4, {})
    assert keys_of(source.jobs) == [40, 41, 42, 43, 44]
    assert source.trace.isEmpty()
    assert keys_of(source.archived("jobs")) == list(range(40))
    assert keys_of(source.archived("trace"), "line") == list(range(120))
    assert {r.note for r in source.archived("jobs").collect()} == {"x", ""}
    batches = {r.job: r.batch_no for r in source.archived("trace").collect()}
    assert batches == {k: k // 10 for k in range(40)}


def test_documents_become_columns_and_rejects_keep_their_text(source):
    source.run("r1")
    docs = source.archived("docs")
    assert set(docs.columns) == {
        "job", "parse_status", "LPMPassName", "num", "rejected_text", "run_id", "batch_no",
    }
    assert docs.count() == 40
    assert keys_of(docs.where("parse_status = 'null_input'")) == [k for k in range(40) if k % 4 == 0]
    good = docs.where("parse_status = 'ok'")
    assert keys_of(good, "num") == keys_of(good) == [k for k in range(40) if k % 4 > 1]
    assert {r.rejected_text for r in docs.where("parse_status = 'malformed'").collect()} == {"broken"}
    assert good.where("rejected_text IS NOT NULL").isEmpty()


def test_the_cap_takes_the_oldest_and_later_runs_the_rest(source):
    source.run("r1", limit=15)
    assert keys_of(source.archived("jobs")) == list(range(15))
    source.run("r2", limit=15)
    source.run("r3", limit=15)
    assert keys_of(source.archived("jobs")) == list(range(40))
    assert source.run("r4", limit=15).n_keys == 0


def test_a_bad_batch_stays_at_the_source(source):
    with pytest.raises(ArchiveFailed) as failure:
        source.run("r1", trace=failing_at(source.trace, 25, "line"))
    assert list(failure.value.result.failed) == [2]
    assert "cannot read" in failure.value.result.failed[2]
    kept = list(range(20, 30))
    assert keys_of(source.jobs) == kept + [40, 41, 42, 43, 44]
    moved = [k for k in range(40) if k not in kept]
    for name in ("jobs", "docs"):
        assert set(keys_of(source.archived(name))) <= set(moved)
    assert keys_of(source.archived("jobs")) == moved
    assert sorted(set(keys_of(source.archived("trace")))) == moved
    assert source.archived("trace").count() == 90
    manifest = source.spark.read.table(source.ledger.manifest)
    assert rows(manifest.where("status = 'failed'"), "batch_no", "table") == [(2, "docs"), (2, "jobs"), (2, "trace")]
    assert rows(manifest.where("error IS NOT NULL"), "table") == [("trace",)]
    assert manifest.where("table = 'trace' AND status = 'ok'").agg(F.sum("rows")).first()[0] == 90

    source.run("r2")
    assert keys_of(source.archived("jobs")) == list(range(40))
    assert source.archived("trace").count() == 120


def test_a_finished_run_is_not_written_again(source):
    with pytest.raises(ArchiveFailed):
        source.run("r1", trace=failing_at(source.trace, 25, "line"))
    source.run("r2")
    with pytest.raises(ArchiveFailed):
        source.run("r1")
    assert source.archived("trace").count() == 120


def test_a_stopped_run_resumes_without_duplicates(source, monkeypatch):
    def stop(self, *args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "save_manifest", stop)
        with pytest.raises(KeyboardInterrupt):
            source.run("r1")
    assert source.spark.read.table(source.target("jobs")).count() == 40
    assert source.archived("jobs").isEmpty()
    source.run("r1")
    assert keys_of(source.archived("jobs")) == list(range(40))
    assert source.spark.read.table(source.target("trace")).count() == 120


def test_a_later_run_closes_a_stopped_one(source, monkeypatch):
    def stop(self, *args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "save_manifest", stop)
        with pytest.raises(KeyboardInterrupt):
            source.run("r1")
    source.run("r2")
    assert keys_of(source.archived("jobs")) == list(range(40))
    with pytest.raises(ArchiveFailed):
        source.run("r1")
    assert keys_of(source.archived("jobs")) == list(range(40))


def test_a_failed_delete_is_made_up_for(source, monkeypatch):
    def refuse(self, keys):
        raise RuntimeError("database away")

    with monkeypatch.context() as patch:
        patch.setattr(Source, "delete", refuse)
        with pytest.raises(RuntimeError, match="away"):
            source.run("r1")
    assert source.jobs.count() == 45
    assert source.run("r2").n_keys == 0
    assert source.jobs.count() == 5
    assert keys_of(source.archived("jobs")) == list(range(40))


def test_without_deletes_archived_keys_are_left_out(source):
    assert source.run("r1", delete=False, limit=25).n_keys == 25
    assert source.run("r2", delete=False).n_keys == 15
    assert keys_of(source.archived("jobs")) == list(range(40))


def test_drifting_documents(source):
    source.run("r1", limit=20)
    drifted = F.concat(F.lit('{"num":"n'), F.col("job"), F.lit('","LPMPASSNAME":"z","deep":{"a":[1]}}'))
    source.docs = source.docs.withColumn("doc", F.when(F.col("job") % 4 > 1, drifted))
    source.run("r2")
    docs = source.archived("docs")
    assert {"LPMPASSNAME", "LPMPassName", "deep"} <= set(docs.columns)
    assert dict(docs.dtypes)["num"] == "bigint"
    late = docs.where("job >= 20 and parse_status <> 'null_input'").collect()
    assert len(late) == 10
    assert {(r.parse_status, r.LPMPASSNAME, r.LPMPassName) for r in late} == {("lossy", "z", None)}
    assert all(f'"n{r.job}"' in r.rejected_text and r.deep.a == [1] for r in late)


def test_plain_rows_that_do_not_fit_fail_their_batch(source):
    source.run("r1", limit=10)
    wide = source.trace.withColumn("line", F.concat(F.lit("text"), F.col("line")))
    with pytest.raises(ArchiveFailed) as failure:
        source.run("r2", trace=wide)
    assert "does not fit" in failure.value.result.failed[0]
    assert keys_of(source.archived("jobs")) == list(range(10))
    assert source.jobs.count() == 35


@pytest.mark.parametrize("bound", [restrict.BROADCAST_BYTES, 0])
def test_only_rows_of_the_batch_can_fail_it(source, monkeypatch, bound):
    monkeypatch.setattr(restrict, "BROADCAST_BYTES", bound)
    location = f"{source.location}/trace"
    create_table(
        source.spark,
        source.target("trace"),
        source.trace.select("job", "line", F.lit(0).alias("batch_no"), F.lit("").alias("run_id")).schema,
        ["run_id", "batch_no"],
        location,
    )
    outside = source.spark.createDataFrame([(41, "text"), (25, "text")], "job bigint, line string")
    lines = source.trace.withColumn("line", F.col("line").cast("string")).union(outside)
    with setting(source.spark, "spark.sql.autoBroadcastJoinThreshold", "-1" if not bound else "10MB"):
        with pytest.raises(ArchiveFailed) as failure:
            source.run("r1", trace=lines)
    assert list(failure.value.result.failed) == [2]
    assert "batch 2" in failure.value.result.failed[2]
    assert source.archived("trace").count() == 90


def test_casts_kept_columns_and_fixed_targets(source):
    create_table(
        source.spark,
        source.target("docs"),
        source.spark.createDataFrame([], "job bigint, num string, batch_no int, run_id string").schema,
        ["run_id", "batch_no"],
        f"{source.location}/docs",
    )
    spec = JsonColumn("doc", casts={"num": "string", "absent": "int"}, keep=("kind",), evolve=False)
    docs = source.docs.withColumn("kind", F.lit("k"))
    tables = [source.table("docs", docs, spec)]
    archive(source.spark, "r", RunScope(source.jobs, "job", "seen", NOW), tables, source.ledger)
    out = source.archived("docs")
    ours = {"parse_status", "rejected_text", "kind", "run_id", "batch_no"}
    assert set(out.columns) == {"job", "num"} | ours
    assert out.where("num IS NOT NULL").count() == 20
    left_out = out.where("parse_status = 'lossy'")
    assert left_out.where("rejected_text LIKE '%LPMPassName%'").count() == left_out.count() == 20


def test_blank_documents_give_the_fixed_shape(source):
    source.run("r1", docs=source.docs.withColumn("doc", F.lit(" ")))
    docs = source.archived("docs")
    assert rows(docs.select("LPMPASSNAME", "parse_status").distinct()) == [("", "blank")]
    assert docs.count() == 40


def test_fields_named_like_our_columns_are_set_apart(source):
    doc = '{"job":"j","run_id":"r","batch_no":"b","rejected_text":"t","parse_status":"p","doc":"d"}'
    source.run("r1", docs=source.docs.withColumn("doc", F.lit(doc)))
    docs = source.archived("docs")
    names = ["job", "run_id", "batch_no", "rejected_text", "parse_status", "doc"]
    assert rows(docs.select(*[f"document__{n}" for n in names]).distinct()) == [("j", "r", "b", "t", "p", "d")]
    assert keys_of(docs) == list(range(40))


def test_no_documents_at_all(source):
    source.run("r1", docs=source.docs.where("job < 0"))
    assert keys_of(source.archived("jobs")) == list(range(40))


def test_rows_may_come_from_a_function_of_the_keys(source):
    asked = []

    def read(run):
        asked.append(run.n_keys)
        return source.trace

    source.run("r1", trace=read)
    assert asked == [40] and source.archived("trace").count() == 120


def test_reserved_columns_are_refused(source):
    with pytest.raises(ValueError, match="batch_no"):
        source.run("r1", trace=source.trace.withColumn("batch_no", F.lit(1)))


@pytest.mark.parametrize("bad", [set(), {0}, {6}, {2, 3}, set(range(7))])
def test_isolation_tries_few_ranges(bad):
    written, tries = set(), []
    failed = {}

    class Range:
        def __init__(self, low, high):
            self.members = set(range(low, high + 1))

    class Column:
        def between(self, low, high):
            return Range(low, high)

    class Functions:
        @staticmethod
        def col(_):
            return Column()

    def write(r):
        tries.append(r)
        if r.members & bad:
            raise RuntimeError("bad")
        written.update(r.members)

    original, plan.F = plan.F, Functions
    try:
        plan.write_isolated(write, 0, 7, failed)
    finally:
        plan.F = original
    assert set(failed) == bad and written == set(range(7)) - bad
    assert len(tries) <= 1 + 2 * 3 * max(1, len(bad))


def test_all_columns_beside_a_document_are_kept(source):
    source.run("r1", docs=source.docs.withColumn("origin", F.col("job") * 2))
    assert set(rows(source.archived("docs"), "job", "origin")) == {(k, 2 * k) for k in range(40)}


def test_an_unreadable_document_fails_its_batch_alone(source):
    broken = F.when(F.col("job") == 17, F.raise_error(F.lit("unreadable"))).otherwise(F.col("doc"))
    with pytest.raises(ArchiveFailed) as failure:
        source.run("r1", docs=source.docs.withColumn("doc", broken))
    assert list(failure.value.result.failed) == [1]
    for name in ("jobs", "trace", "docs"):
        assert set(keys_of(source.archived(name))) == {k for k in range(40) if k // 10 != 1}
        # Rows of the failed batch are not in the raw table either.
        raw = source.spark.read.table(source.target(name))
        assert raw.where("job div 10 = 1").isEmpty()


def test_many_bad_batches_leave_every_healthy_one(spark, table):
    big = Source(spark, table, n=400)
    bad = {b for b in range(40) if b % 2}
    line = F.when((F.col("job") / 10).cast("int") % 2 == 1, "text").otherwise(F.col("line").cast("string"))
    create_table(
        spark,
        big.target("trace"),
        big.trace.select("job", "line", F.lit(0).alias("batch_no"), F.lit("").alias("run_id")).schema,
        ["run_id", "batch_no"],
        f"{big.location}/trace",
    )
    with pytest.raises(ArchiveFailed) as failure:
        big.run("r1", trace=big.trace.withColumn("line", line))
    assert set(failure.value.result.failed) == bad
    assert keys_of(big.archived("docs")) == [k for k in range(400) if k // 10 not in bad]


def test_errors_that_are_not_about_rows_are_raised():
    def write(_):
        raise ConnectionError("cluster away")

    failed = {}
    with pytest.raises(ConnectionError):
        plan.write_isolated(write, 0, 100, failed)
    assert failed == {}


def test_many_keys_are_broadcast_for_writes_alone(spark, source, monkeypatch):
    """Not to count the rows of the source, nor to find those that lose a value."""
    for module in (restrict, plan):
        monkeypatch.setattr(module, "KEYS_ALONE_BYTES", 0)
    line = F.when(F.col("line") == 25, "unknown").otherwise(F.col("line").cast("string"))
    columns = spark.range(1).selectExpr("id AS job", "id AS line", "'' AS run_id", "0 AS batch_no").schema
    create_table(spark, source.target("trace"), columns, ["run_id", "batch_no"], f"{source.location}/trace")
    broadcast, sent = F.broadcast, []

    def sending(df):
        sent.append(df.columns)
        return broadcast(df)

    monkeypatch.setattr(F, "broadcast", sending)
    with pytest.raises(ArchiveFailed) as failure:
        source.run("r1", delete=False, trace=source.trace.withColumn("line", line))
    assert list(failure.value.result.failed) == [2]
    assert keys_of(source.archived("trace"), "line") == [n for n in range(120) if not 20 <= n % 40 < 30]
    assert keys_of(source.archived("docs")) == [k for k in range(40) if not 20 <= k < 30]
    # Once for jobs, once for trace, and for documents to get their columns and to copy them.
    assert sent == [["job", "batch_no"]] * 4
