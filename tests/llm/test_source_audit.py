import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import clashing, messy, rows_of, sf_documents
from pyspark.sql import functions as F

from coldhaul.llm import hashing
from coldhaul.llm import source_audit as audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def expected(rows, min_documents=10, top=10):
    """The contract, with strings and dictionaries."""
    rows = [(r["text"] or "", r["lang"] or "", r["source"] or "") for r in rows]
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(FOLD))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in documents[lang].items() if n >= min_documents]
        sources = sorted({r[2] for r in rows if r[1] == lang})

        def shares(total):
            size = sum(total[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (total[t] + 2) // size for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out, key=repr)


def agrees(docs, **options):
    got = rows_of(audit.source_divergence(docs, **options))
    assert got == expected(docs.select("text", "lang", "source").collect(), **options)
    return got


def random_documents(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéüZ") for _ in range(rng.choice((2, 3, 5, 9, 17, 30)))) for _ in range(60)]
    odd = ["", "!", "'", "1", "中文", " ", "ǅ", "ÉCOLE"]
    rows = []
    for i in range(n):
        own = [rng.choice(words + odd) for _ in range(rng.choice((0, 3, 40)))]
        rows.append((i, rng.choice(" \n-.").join(own) or None, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "É"])))
    return rows


def test_test_documents(spark):
    assert {r[2] for r in agrees(sf_documents(spark))} == {"pair", "term"}


@pytest.mark.parametrize("seed", range(2))
def test_random_documents(spark, seed, monkeypatch):
    """Blocks of a few terms only, so that sums are put together from many."""
    monkeypatch.setattr(audit, "CELLS", 20)
    docs = spark.createDataFrame(random_documents(seed), SCHEMA).repartition(3)
    assert len(agrees(docs)) > 50
    agrees(docs, min_documents=2, top=3)


def test_odd_rows(spark):
    agrees(messy(spark), min_documents=2)
    agrees(messy(spark))
    assert rows_of(audit.source_divergence(clashing(messy(spark)))) == rows_of(audit.source_divergence(messy(spark)))
    assert audit.source_divergence(messy(spark).limit(0)).count() == 0


def test_ties_at_the_last_rank_go_by_the_bytes_of_the_item(spark):
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyzéÿ"]
    rows = [(i, " ".join(words), "en", "x") for i in range(10)] + [(20, "wa", "en", "y")]
    got = agrees(spark.createDataFrame(rows, SCHEMA))
    assert [r[3] for r in got if r[1] == "x" and r[2] == "term"] == [f"w{c}" for c in "bcdefghijk"]


def test_terms_that_share_a_digest_are_split(spark, monkeypatch):
    """Digests of two bits clash within chunks and between them."""
    docs = spark.createDataFrame(random_documents(7, 60), SCHEMA).repartition(4).cache()
    want = rows_of(audit.source_divergence(docs, min_documents=3))
    original = audit._counted

    def weak(docs):
        # The chunks as they are, under digests of two bits; the part names the string in its chunk.
        part = F.col("part") + F.pmod(F.xxhash64("term"), F.lit(65536))
        return original(docs).select(F.pmod("digest", F.lit(4)).alias("digest"), part.alias("part"), "term", "counts")

    monkeypatch.setattr(audit, "_counted", weak)
    assert rows_of(audit.source_divergence(docs, min_documents=3)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abÀZ é.中 ", max_size=60), max_size=8), st.integers(0, 3), st.integers(8, 60))
def test_chunks_with_any_digests(texts, bits, segment):
    raw = [t.encode() for t in texts]
    data = audit.TERM_BYTES[np.frombuffer(b"".join(raw), np.uint8)]
    edges = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    words, size = hashing.words, audit.SEGMENT_BYTES

    def weak(data, edges, lower):
        found = words(data, edges, lower)
        found.hashes &= np.uint64((1 << bits) - 1)
        return found

    audit.hashing.words, audit.SEGMENT_BYTES = weak, segment if len(texts) == 1 else 1 << 20
    try:
        found = audit.chunk_terms(data, edges)
    finally:
        audit.hashing.words, audit.SEGMENT_BYTES = words, size
    got = Counter()
    names = {}
    for d, v, r, n, a, b in zip(*(c.tolist() for c in (found.digest, found.variant, found.row, found.n, found.start, found.end))):
        term = data[a:b].tobytes().decode()
        assert names.setdefault((d, v), term) == term and (r, term) not in got
        got[r, term] = n
    want = Counter((r, t) for r, text in enumerate(texts) for t in TERM.findall(text.translate(FOLD)))
    assert got == want


def test_equal_strings_are_compared_whole():
    strings = [b"a" * 8, b"a" * 9, b"a" * 8 + b"b" * 9, b"a" * 8 + b"c" + b"b" * 8, b"x" * 30, b"x" * 15 + b"y" + b"x" * 14]
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - [len(s) for s in strings]
    for i, s in enumerate(strings):
        same = audit.same_strings(data, starts, ends, np.full(6, starts[i]), np.full(6, ends[i]))
        assert same.tolist() == [s == t for t in strings]


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 9 * 10**18, 9 * 10**18 + 77, 12345
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert row.select(audit.share("n", "total", "terms")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)
