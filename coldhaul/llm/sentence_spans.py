"""Removal of repeated passages by sliding spans of consecutive sentences.

A span is a run of several consecutive sentences: at least ``SENTENCES`` of them with
``WORDS`` words, or fewer when they already hold ``LONG`` words, so that a passage of
a single long sentence is a span as well. From every sentence the shortest
such run forward and the shortest run backward are hashed. Spans with the same words
(case and white space apart) are joined globally; the first, by doc_id and place, is
kept, and the sentences under any other are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldhaul.llm.common import keyed, stored

SENTENCES, WORDS, LONG = 2, 12, 25
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[^\S\n]*\n?|\n|\Z)")


def sentences(text: str) -> list[str]:
    """Consecutive pieces that together are the text; each ends after . ! ? or a line break."""
    return [s for s in SENTENCE.findall(text) if s]


def spans(parts: list[str]) -> list[tuple[int, int, int]]:
    """(hash, first, last + 1) of the runs; pieces without a word are passed over."""
    words = [p.lower().split() for p in parts]
    full = [i for i, w in enumerate(words) if w]
    hashes = b"".join([xxhash.xxh3_64_digest(" ".join(words[i])) for i in full])
    lengths = [len(words[i]) for i in full]
    n = len(full)
    found = set()
    last, count = 0, 0
    for first in range(n):  # the shortest run that starts here
        while last < n and not (count >= LONG or (last - first >= SENTENCES and count >= WORDS)):
            count += lengths[last]
            last += 1
        if not (count >= LONG or (last - first >= SENTENCES and count >= WORDS)):
            break
        found.add((first, last))
        count -= lengths[first]
    first, count = n, 0
    for last in range(n, 0, -1):  # the shortest run that ends here
        while first > 0 and not (count >= LONG or (last - first >= SENTENCES and count >= WORDS)):
            first -= 1
            count += lengths[first]
        if not (count >= LONG or (last - first >= SENTENCES and count >= WORDS)):
            break
        found.add((first, last))
        count -= lengths[last - 1]
    return [
        (xxhash.xxh3_64_intdigest(hashes[8 * a : 8 * b]) - (1 << 63), full[a], full[b - 1] + 1) for a, b in sorted(found)
    ]


def _span_rows(docs: DataFrame) -> DataFrame:
    """(hash, key, at, length, again) of every span; ``again``: the same text has the span before."""

    def hash_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, bool]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = set()
                for h, a, b in spans(sentences(text or "")):
                    rows.append((h, key, a, b - a, h in seen))
                    seen.add(h)
                    if len(rows) > 200_000:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return docs.select("key", F.col("text").cast("string")).mapInArrow(
        hash_spans, "hash long, key long, at int, length int, again boolean"
    )


def _batch(rows: list[tuple[int, int, int, int, bool]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], ["hash", "key", "at", "length", "again"]
    )


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed and the text that is left.

    A null text stays null and has no sentences; texts without a span are left as they
    are; a text may have any number of sentences. Of equal rows the first keeps its text.
    An empty table gives no rows, other columns are ignored. The order of the sentences
    left and their spacing do not change.
    """
    rows = keyed(docs.select("doc_id", "text"))
    every = _span_rows(rows)
    repeated = every.groupBy("hash").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1")
    # Stored, so that the join has a shuffle of its own and a very common span is split.
    repeated = stored(repeated.select("hash", "first"), "repeated-spans")
    later = every.join(repeated, "hash").where("key <> first or again")
    removals = later.groupBy("key").agg(F.collect_set(F.struct(F.col("at").alias("a"), "length")).alias("removed"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, n_sentences, n_removed = [], [], []
            for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = sentences(text or "")
                gone = {i for r in removed or () for i in range(r["a"], r["a"] + r["length"])}
                left.append(text if not gone else "".join(p for i, p in enumerate(parts) if i not in gone))
                n_sentences.append(len(parts))
                n_removed.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "text"],
            )

    joined = rows.join(removals, "key", "left").select("doc_id", F.col("text").cast("string").alias("text"), "removed")
    return joined.mapInArrow(cut, f"doc_id {id_type}, n_sentences long, n_removed long, text string")
