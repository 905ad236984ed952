import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import clashing, messy, rows_of, sf_documents
from pyspark.sql import functions as F

from coldhaul.llm import fill_middle as fim


def expected(doc_id, text):
    """The contract, with one regular expression over the whole text."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def agrees(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(fim.fill_in_middle(docs)) == sorted((expected(*t) for t in texts), key=repr)
    digests = fim.fill_in_middle_digests(docs)
    want = [
        (*e[:5], hashlib.sha256(e[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for (i, t) in texts
        for e in [expected(i, t)]
    ]
    assert rows_of(digests) == sorted(want, key=repr)


def test_test_documents(spark):
    docs = sf_documents(spark)
    agrees(docs)
    assert {r["form"] for r in fim.fill_in_middle(docs).collect()} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    agrees(messy(spark))
    assert rows_of(fim.fill_in_middle(clashing(messy(spark)))) == rows_of(fim.fill_in_middle(messy(spark)))
    assert fim.fill_in_middle_digests(messy(spark).limit(0)).count() == 0


def test_markers_text_ids_and_long_texts(spark):
    long = ("word " * 300 + "émigré <P " + "x" * 20_000 + "é" * 9_000 + " <<S > ") * 20
    rows = [("a", "has <S> inside"), ("b", "<" * 50), ("c", long), ("d", long), ("e", "P><P <S M>"), (None, "no id here")]
    agrees(spark.createDataFrame(rows, "doc_id string, text string"))


@settings(max_examples=200, deadline=None)
@given(st.text("abZ é中\U0001f600.\n<", max_size=400), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.lists(st.integers(0, 1500)))
def test_any_chunks_give_the_same_cuts(text, h1, h2, places):
    """Chunks may end anywhere, inside characters too."""
    raw = text.encode()
    cuts = sorted({0, len(raw), *(p for p in places if p < len(raw))})
    counted = fim.Counted(raw, cuts, fim.SummaryCache(64))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert counted.tokens[-1] == len(units) and counted.chars[-1] == len(text)
    for tokens in (h1 % (len(units) + 1), h2 % (len(units) + 1), len(units)):
        before = "".join(units[:tokens])
        assert counted.place(tokens) == (len(before.encode()), len(before))


def test_borders_follow_the_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 40_000, np.uint8)
    alone = fim.borders(shared, np.array([0, len(shared)]))
    lead = rng.integers(97, 123, 777, np.uint8)
    shifted = fim.borders(np.concatenate((lead, shared)), np.array([0, len(lead) + len(shared)])) - len(lead)
    common = set(alone) & set(shifted)
    assert len(alone) > 40 and len(common) >= len(alone) - 3
    assert np.diff(fim.borders(np.zeros(50_000, np.uint8), np.array([0, 10, 50_000]))).max() <= fim.LONGEST


def test_cache_is_bounded_and_checks_the_bytes(monkeypatch):
    cache = fim.SummaryCache(1000)
    for i in range(200):
        cache.summary(b"%050d" % i)
    assert cache.size <= 1000 and len(cache.known) == 20
    assert cache.summary(b"%050d" % 199) == fim.summarize(b"%050d" % 199) and cache.hits == 1
    monkeypatch.setattr(fim.xxhash, "xxh3_64_intdigest", lambda chunk: 7)
    cache = fim.SummaryCache()
    assert [cache.summary(c).tokens for c in (b"one two", b"!!!!", b"one two")] == [3, 4, 3]


def test_shared_chunks_come_from_the_cache():
    raw = (b"Some passage that many documents share, word by word and line by line. " * 40)
    data = np.frombuffer(raw * 2, np.uint8)
    edges = np.array([0, len(raw), 2 * len(raw)])
    cuts, cache = fim.borders(data, edges), fim.SummaryCache()
    first = np.searchsorted(cuts, edges)
    for i in range(2):
        fim.Counted(raw, [int(c - edges[i]) for c in cuts[first[i] : first[i + 1] + 1]], cache)
    assert cache.hits >= (len(cuts) - 1) // 2


@pytest.mark.parametrize("form,output", [("psm", "<P>a <<S>c<M>b"), ("spm", "<S>c<P>a <<M>b"), ("plain", "a <bc")])
def test_restored(spark, form, output):
    got = spark.range(1).select(fim.restored(F.lit(output), F.lit(form))).first()[0]
    assert got == "a <bc"
