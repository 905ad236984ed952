import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import clashing, messy, rows_of, sf_documents
from pyspark.sql import functions as F

from coldhaul.llm import earlier_copies as ec


def expected(docs):
    """Every string of 50 bytes with the least id that has it, then each document against it."""
    docs = [(i, (t or "").encode()) for i, t in docs]

    def order(i):
        return (i is not None, i)

    first = {}
    for i, t in docs:
        for a in range(len(t) - 49):
            s = t[a : a + 50]
            if s not in first or order(i) < order(first[s]):
                first[s] = i
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 2, bool)
        for a in range(len(t) - 49):
            if order(first[t[a : a + 50]]) < order(i):
                gone[a + 1 : a + 51] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def agrees(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(ec.earlier_copy_digests(docs)) == expected(texts)


def families(seed, n=60):
    """Documents that share passages of 40 to 300 bytes, cut and joined anywhere, with edits."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéü ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 50))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            passage = rng.choice(passages)
            a = rng.randint(0, len(passage) - 10)
            text = passage[a : a + rng.randint(30, 300)]
            if rng.random() < 0.4:
                at = rng.randint(0, len(text))
                text = text[:at] + rng.choice("xyzé") + text[at + rng.randint(0, 2) :]
            parts += [text, "".join(rng.choice(words) for _ in range(rng.randint(0, 9)))]
        rows.append((rng.randint(-5, n), "".join(parts)))
    return rows


@pytest.fixture
def small(monkeypatch):
    """Many blocks and ranges also for small inputs. Only what the driver sets reaches the tasks as well."""
    monkeypatch.setattr(ec, "RANGE_BYTES", 3000)


@pytest.mark.parametrize("seed", range(3))
def test_passages_that_documents_share(spark, small, seed):
    agrees(spark.createDataFrame(families(seed), "doc_id long, text string").repartition(3))


def test_test_documents(spark):
    agrees(sf_documents(spark))


def test_odd_rows(spark, small):
    agrees(messy(spark))
    plain = rows_of(ec.earlier_copy_digests(messy(spark)))
    assert rows_of(ec.earlier_copy_digests(clashing(messy(spark)))) == plain
    assert ec.earlier_copy_digests(messy(spark).limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 49)], "doc_id int, text string")
    agrees(nothing)


def test_text_ids_repeated_strings_and_lengths_around_fifty(spark, small):
    unit = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"
    rows = [("b", unit), ("a", "zz" + unit), ("c", unit[:-1]), ("d", unit + unit), ("e", "é" * 25), ("f", "x" + "é" * 26)]
    rows += [("g", "=" * 500), ("h", "=" * 49), ("i", "=" * 51), (None, unit[1:] + "."), ("b", unit), ("j", ".=" * 200), ("k", "=." * 200)]
    agrees(spark.createDataFrame(rows, "doc_id string, text string"))


def test_a_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(f"{rng.randint(0, 99999)}" for _ in range(120_000))
    rows = [(2, text), (1, text[300_000:301_000]), (3, text[-2000:] + text[:100])]
    got = {r["doc_id"]: r for r in ec.remove_earlier_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(300_000, 301_000)] and got[1]["n_removed"] == 0
    assert bytes(got[3]["kept"]) == b"" and bytes(got[2]["kept"]).decode() == text[:300_000] + text[301_000:]


def test_spans_give_what_is_kept(spark, small):
    rows = families(9)
    got = ec.remove_earlier_copies(spark.createDataFrame(rows, "doc_id long, text string")).where("n_spans > 0")
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t.encode())
    assert got.count() > 20
    for r in got.collect():
        rests = []
        for t in texts[r["doc_id"]]:
            cuts = [0, *(x for s in r["spans"] for x in s), len(t)]
            rests.append(b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
        assert bytes(r["kept"]) in rests and r["n_removed"] == sum(b - a for a, b in r["spans"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=200), max_size=6), st.integers(1, 90))
def test_runs_hold_every_window_once(texts, scan):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    before, ec.SCAN_BYTES = ec.SCAN_BYTES, scan
    try:
        first, windows, anchor, hashes = ec.runs(data, edges)
    finally:
        ec.SCAN_BYTES = before
    got = [s for a, m in zip(first, windows) for s in range(a, a + m)]
    assert got == [s for a, b in zip(edges, edges[1:]) for s in range(a, b - 49)]
    # Equal windows have equal anchors at equal places.
    where = {}
    for a, m, x, h in zip(first.tolist(), windows.tolist(), anchor.tolist(), hashes.tolist()):
        for s in range(a, a + m):
            assert s <= a + x <= s + ec.LENGTH - ec.ANCHOR
            assert where.setdefault(data[s : s + 50].tobytes(), (a + x - s, h)) == (a + x - s, h)


def test_window_order_is_the_suffix_order():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 80))).encode() for _ in range(40)]
    texts += [t[:50] + b"x" for t in texts[:10]]
    least = np.array([rng.randint(-3, 9) for _ in texts])
    windows = np.array([len(t) - 49 for t in texts])
    got = ec.earlier_windows(texts, windows, least)
    every = [(t[a : a + 50], d) for t, d in zip(texts, least) for a in range(len(t) - 49)]
    first = {}
    for s, d in every:
        first[s] = min(d, first.get(s, d))
    assert got.tolist() == [first[s] for s, _ in every]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=12))
def test_union_of_intervals(pairs):
    a, b = ec.covered(np.array([p[0] for p in pairs], np.int64), np.array([p[0] + p[1] for p in pairs], np.int64))
    inside = {x for s, n in pairs for x in range(s, s + n)}
    assert {x for s, e in zip(a.tolist(), b.tolist()) for x in range(s, e)} == inside
    assert all(e < s for e, s in zip(b.tolist(), a.tolist()[1:]))


def test_packed_numbers():
    for values in (np.arange(1000, dtype="<i8") - 500, np.zeros(0, "<u4"), np.array([255], "<u1")):
        assert np.array_equal(ec.unpacked(ec.packed(values), values.dtype.str), values)


def test_hot_passage_is_sent_once_per_block(spark, monkeypatch):
    """Inner runs of a passage that every document has are sent once a block; hot anchors by window."""
    passage = "".join(hashlib.sha256(b"%d" % i).hexdigest() for i in range(20))
    around = [F.sha2(F.concat(F.lit(c), F.col("id").cast("string")), 512) for c in "ab"]
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(around[0], F.lit(passage), around[1]).alias("text"))

    def sent():
        blocks = ec.stored(ec._blocks(ec._ordered(docs.coalesce(1))), "test-blocks")
        rows = ec._sent_runs(blocks.join(ec._shared_anchors(blocks, 4, 40), "block"), 4, 40).collect()
        assert blocks.count() == 1 and len(rows) <= 4
        return [np.concatenate([ec.unpacked(r[n], k) for r in rows]) for n, k in (("sizes", "<u1"), ("places", "<u4"))]

    sizes, places = sent()
    assert len(places) > 400 * 70 and len(sizes) < 400 * 4 and max(sizes) > 60
    monkeypatch.setattr(ec, "HOT_RUNS", 100)
    sizes, places = sent()
    assert np.median(sizes) == 50 and len(places) > 400 * 1000 and len(sizes) < len(places) // 10
    rows = ec.earlier_copy_digests(docs)
    agrees(docs.where("id < 30"))
    assert rows.where("doc_id > 0").agg(F.min("n_removed")).first()[0] >= len(passage)


def test_hot_anchors_give_the_same_result(spark, small, monkeypatch):
    monkeypatch.setattr(ec, "HOT_RUNS", 3)
    for seed in (11, 12):
        agrees(spark.createDataFrame(families(seed), "doc_id long, text string").repartition(3))
