import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from coldhaul.llm import ring
from llm_data import DOC_SCHEMA, clashing, messy, sf_documents


def one_by_one(loads, owners, caps):
    """The same rounds for single documents."""
    used = Counter()
    place = {}
    waiting = [(a, r) for a, n in enumerate(loads) for r in range(n)]
    for step in range(len(owners)):
        still = []
        for arc, rank in sorted(waiting, key=lambda x: ((x[0] + step) % len(owners), x[1])):
            shard = owners[(arc + step) % len(owners)]
            if used[shard] < caps[shard]:
                place[arc, rank] = (shard, used[shard])
                used[shard] += 1
            else:
                still.append((arc, rank))
        waiting = still
    assert not waiting
    return place


@given(st.lists(st.integers(0, 9), min_size=12, max_size=12), st.sampled_from([0.0, 0.25, 1.0]))
def test_segments_place_each_document_as_one_by_one(loads, slack):
    owners = ring.ring(4, 3).owners
    caps = ring.capacities(sum(loads), 4, slack)
    got = {}
    for s in ring.assign(loads, owners, caps):
        for rank in range(s.first, s.last):
            assert (s.arc, rank) not in got
            got[s.arc, rank] = (s.shard, s.slot + rank - s.first)
    assert got == one_by_one(loads, owners, caps)


def check(docs, out, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs
    )
    counts = Counter(r["shard"] for r in out)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_counts_differ_by_one_and_slots_have_no_gaps(spark, shards):
    for docs in (sf_documents(spark), messy(spark), clashing(messy(spark))):
        check(docs.collect(), ring.shard_documents(docs, shards).collect(), shards)


def test_rows_that_are_all_equal_are_spread(spark):
    docs = spark.createDataFrame([(1, "same", None, None)] * 200, DOC_SCHEMA)
    check(docs.collect(), ring.shard_documents(docs, 7).collect(), 7)


def test_arc_lookup_is_the_first_node_at_or_after_the_point(spark):
    circle = ring.ring(3, 5)
    points = [0, ring.SPACE - 1, *circle.ends, *[e + 1 for e in circle.ends], *[e - 1 for e in circle.ends]]
    df = spark.createDataFrame([(p,) for p in points], "at long").selectExpr("at", ring.arc_of("at", circle) + " as arc")
    for r in df.collect():
        later = [i for i, e in enumerate(circle.ends) if e >= r["at"]]
        assert r["arc"] == (later[0] if later else 0)


def test_slack_limits_the_movement_to_a_new_shard(spark):
    docs = sf_documents(spark)
    at = [{r["doc_id"]: r["shard"] for r in ring.shard_documents(docs, n, slack=0.25).collect()} for n in (8, 9)]
    moved = sum(at[0][d] != at[1][d] for d in at[0])
    assert moved < 0.35 * len(at[0])


def test_empty_table(spark):
    assert ring.shard_documents(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
