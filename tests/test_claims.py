from concurrent.futures import ThreadPoolExecutor

import pytest

from coldhaul import ArchiveTable, Claimed, Ledger, RunScope, archive
from coldhaul.plans.claims import claim
from coldhaul.session import scratch_path
from coldhaul.sinks import folders


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def test_one_of_two_claims_holds_and_ends(spark):
    folder, clock = scratch_path(spark, "claims"), Clock()
    first = claim(spark, folder, "first", 60, clock)
    with pytest.raises(Claimed, match="held by first"):
        claim(spark, folder, "second", 60, clock)
    clock.now += 50
    first.renew()
    clock.now += 50
    first.check()
    with pytest.raises(Claimed):
        claim(spark, folder, "second", 60, clock)
    first.release()
    with claim(spark, folder, "second", 60, clock) as second:
        second.check()
        with pytest.raises(Claimed, match="taken over by second"):
            first.check()
    claim(spark, folder, "third", 60, clock)
    assert len(folders.names(spark, folder)) == 1


def test_an_expired_claim_is_taken_over(spark):
    folder, clock = scratch_path(spark, "claims"), Clock()
    dead = claim(spark, folder, "dead", 60, clock)
    clock.now += 61
    heir = claim(spark, folder, "heir", 60, clock)
    for late in (dead.check, dead.renew):
        with pytest.raises(Claimed, match="heir"):
            late()
    dead.release()
    heir.check()


def test_a_claim_being_written_holds(spark):
    folder = scratch_path(spark, "claims")
    assert folders.create_new(spark, f"{folder}/{7:012d}", "")
    with pytest.raises(Claimed, match="just claiming"):
        claim(spark, folder, "other", 60)


def test_many_claim_at_once_and_one_gets_it(spark):
    folder = scratch_path(spark, "claims")

    def attempt(i):
        try:
            return claim(spark, folder, f"owner {i}", 60).owner
        except Claimed:
            return None

    for _ in range(5):
        with ThreadPoolExecutor(8) as pool:
            winners = [w for w in pool.map(attempt, range(8)) if w]
        assert len(winners) == 1
        folders.remove(spark, folder)


def _setup(spark, table):
    prefix, location = table("claims")
    rows = spark.sql("SELECT id AS k, timestamp'1999-01-01' AS ts FROM range(40)")
    scope = RunScope(rows, "k", "ts", "2000-01-01 00:00:00", batch_size=10)
    return scope, [ArchiveTable("jobs", rows, "k", f"{prefix}_jobs", location=f"{location}/jobs")], Ledger(prefix, location)


def test_two_overlapping_runs(spark, table):
    """The second run starts while the first deletes, and is refused; afterwards it finds nothing to do."""
    scope, tables, ledger = _setup(spark, table)
    refused = []

    def delete(keys):
        with pytest.raises(Claimed, match="held by first"):
            archive(spark, "second", scope, tables, ledger)
        refused.append(keys.count())

    archive(spark, "first", scope, tables, ledger, delete)
    assert refused == [40] and spark.read.table(tables[0].target).count() == 40
    ledger.claim(spark, "third").release()


def test_a_run_that_lost_its_claim_commits_nothing(spark, table, monkeypatch):
    scope, tables, ledger = _setup(spark, table)
    original = Ledger.save_manifest
    ledger.create(spark, scope.source.schema["k"].dataType)
    from coldhaul.plans import archive as plan

    def overtaken(*args):
        heir.append(ledger.claim(spark, "heir"))
        return write(*args)

    heir, write = [], plan.write_isolated
    monkeypatch.setattr(plan, "write_isolated", overtaken)
    with pytest.raises(Claimed, match="heir"):
        archive(spark, "slow", scope, tables, ledger, lease_seconds=0)
    assert Ledger.save_manifest is original and spark.read.table(ledger.manifest).isEmpty()
    heir[0].check()
    heir[0].release()
    monkeypatch.undo()
    assert archive(spark, "slow", scope, tables, ledger).n_keys == 40
