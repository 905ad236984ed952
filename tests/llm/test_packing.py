import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coldhaul.llm import packing
from llm_data import DOC_SCHEMA, clashing, messy, sf_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(sizes, cap):
    """The least number of sequences, by trying all ways."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [cap - sizes[i]])

    go(0, [])
    return best


small = st.lists(st.integers(1, 20), min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(small)
def test_fixed_sets_belong_to_a_best_packing(sizes):
    counts = [0] * 21
    for s in sizes:
        counts[s] += 1
    fixed = packing.reduce_instance(counts, 20)
    rest = [s for s in range(21) for _ in range(counts[s])]
    assert sum(u for _, u in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)


def one_at_a_time(counts, cap):
    """The sets of the reduction, those of three that leave room fixed singly."""
    fixed = Counter()
    for j in range(cap, 0, -1):
        while counts[j]:
            sizes = [s for s in range(1, cap + 1) if counts[s]]
            found = packing.dominant_set(counts, sizes, j, cap)
            if found is None:
                break
            uses = min(counts[s] // found.count(s) for s in found)
            if len(found) == 3 and sum(found) < cap:
                uses = 1
            fixed[found] += uses
            for s in found:
                counts[s] -= uses
    return fixed


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(3, 30), st.integers(1, 40), max_size=6), st.integers(20, 40))
def test_sets_fixed_in_bulk_are_those_fixed_singly(lengths, cap):
    counts = [lengths.get(s, 0) if s <= cap else 0 for s in range(41)]
    singly, bulk = counts[: cap + 1], counts[: cap + 1]
    fixed = one_at_a_time(singly, cap)
    found = Counter()
    for pattern, uses in packing.reduce_instance(bulk, cap):
        found[pattern] += uses
    assert (found, bulk) == (fixed, singly)


def test_many_equal_lengths_give_few_patterns():
    counts = [0] * 2049
    counts[600], counts[610], counts[650] = 100_000, 70_000, 30_001
    patterns = packing.pack(counts, 2048)
    assert len(patterns) < 50
    assert sum(len(p) * u for p, u in patterns) == 200_001
    assert sum(u for _, u in patterns) == 66_667


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 40))
def test_patterns_hold_every_piece_once(sizes, copies):
    counts = [0] * 51
    for s in sizes:
        counts[s] += copies
    patterns = packing.pack(counts, 50)
    held = [0] * 51
    for pattern, uses in patterns:
        assert sum(pattern) <= 50 and uses > 0
        for s in pattern:
            held[s] += uses
    assert held == counts
    places = {}
    for r in packing.runs(patterns):
        for rank in range(r.first, r.last):
            nth, side = divmod(rank - r.first, r.each)
            start = r.offset + side * r.size
            places.setdefault(r.sequence + nth, []).append((start, start + r.size))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(spans)) and spans[-1][1] <= 50
    assert len(places) == sum(u for _, u in patterns)


def check(docs, out, cap):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d in docs:
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % cap or cap
        for i, a in enumerate([0, *range(first, len(ids), cap)]):
            piece = ids[a : first if i == 0 else a + cap]
            want.append((d["doc_id"], i, a, len(piece), zlib.crc32(piece.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(w[3] for w in want)
    assert all(e <= cap for e in ends.values()) and -(-total // cap) <= len(ends) <= -(-total // cap) + 2


def test_documents_are_cut_and_placed_without_gaps(spark):
    for docs, cap in ((sf_documents(spark), 2048), (clashing(messy(spark)), 256)):
        check(docs.collect(), packing.pack_documents(docs, PATH, cap).collect(), cap)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOC_SCHEMA), PATH).collect() == []
