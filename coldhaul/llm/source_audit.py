"""How the sources of each language differ in their words, with late string materialization.

Terms are counted by 64-bit digests: a task counts the terms of a chunk of documents and
stores, for each digest, its string once and its counts by group; what is shuffled to count
over the corpus are digests and numbers. The least and the greatest string of each digest
show whether two terms share it; only such digests are split by their strings, which each
chunk knows. Ranks are cut by value first, and strings are joined to the terms that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldhaul.llm import hashing
from coldhaul.llm.common import stored, whole_text

MIN_DOCUMENTS, TOP = 10, 10
#: Parts of a long text are counted one by one; a matrix of shares has about so many cells.
SEGMENT_BYTES, CELLS = 8 << 20, 1 << 15
#: Fixed values of the measure: the scale of shares, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2

# Bytes of terms in lower case, all others as a space.
TERM_BYTES = np.full(256, 32, np.uint8)
TERM_BYTES[65:91] = np.arange(97, 123)
TERM_BYTES[97:123] = np.arange(97, 123)
TERM_BYTES[128:] = np.arange(128, 256)


def _eight(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return np.ascontiguousarray(windows[at]).view("<u8").reshape(-1)


def same_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, as_starts: np.ndarray, as_ends: np.ndarray) -> np.ndarray:
    """Which strings are equal, byte by byte, to those beside them."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lengths = ends - starts
    same = lengths == as_ends - as_starts
    mask = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(2**64 - 1))
    mask = mask[np.minimum(lengths, 8)]
    same &= (_eight(padded, starts) & mask) == (_eight(padded, as_starts) & mask)
    long = np.flatnonzero(same & (lengths > 8))
    same[long] = _eight(padded, ends[long] - 8) == _eight(padded, as_ends[long] - 8)
    for i in np.flatnonzero(same & (lengths > 16)):
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[as_starts[i] : as_ends[i]])
    return same


class Terms:
    """Distinct terms of rows: digest, row, count and place of a term, sorted by digest, string and row.

    ``variant`` tells strings with one digest apart; it is 0 unless there are several.
    """

    def __init__(self, data: np.ndarray, digest: np.ndarray, row: np.ndarray, n: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        order = np.lexsort((row, digest))
        digest, row, n, start, end = (c[order] for c in (digest, row, n, start, end))
        edge = _edges(digest)
        sizes = np.diff(np.append(edge, len(digest)))
        same = same_strings(data, start, end, np.repeat(start[edge], sizes), np.repeat(end[edge], sizes))
        variant = np.zeros(len(digest), np.int64)
        if not same.all():
            for a, size, whole in zip(edge.tolist(), sizes.tolist(), np.logical_and.reduceat(same, edge).tolist()):
                if not whole:
                    texts = [data[start[i] : end[i]].tobytes() for i in range(a, a + size)]
                    number = {t: i for i, t in enumerate(sorted(set(texts)))}
                    variant[a : a + size] = [number[t] for t in texts]
            order = np.lexsort((row, variant, digest))
            digest, row, n, start, end, variant = (c[order] for c in (digest, row, n, start, end, variant))
        edge = _edges(digest, variant, row)
        self.digest, self.variant, self.row, self.start, self.end = (c[edge] for c in (digest, variant, row, start, end))
        self.n = np.add.reduceat(n, edge) if len(edge) else n


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about SEGMENT_BYTES that end between terms."""
    a = 0
    while a < len(data):
        b = min(a + SEGMENT_BYTES, len(data))
        if b < len(data):
            space = np.flatnonzero(data[a:b] == 32)
            if len(space):
                b = a + int(space[-1]) + 1
            else:  # one term that goes on
                later = np.flatnonzero(data[b:] == 32)
                b = b + int(later[0]) + 1 if len(later) else len(data)
        yield a, b
        a = b


def chunk_terms(data: np.ndarray, edges: np.ndarray) -> Terms:
    """Terms of the rows between ``edges``; ``data`` has only bytes of TERM_BYTES."""
    parts = []
    for a, b in _segments(data):
        inner = edges[(edges > a) & (edges < b)]
        found = hashing.words(data[a:b], np.concatenate(([a], inner, [b])) - a, lower=False)
        row = np.searchsorted(edges, found.starts + a, "right") - 1
        one = Terms(data[a:b], found.hashes, row, np.ones(len(row), np.int64), found.starts, found.ends)
        parts.append((one.digest, one.row, one.n, one.start + a, one.end + a))
    if not parts:
        parts = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)]
    return Terms(data, *(np.concatenate(c) for c in zip(*parts)))


def _counted(docs: DataFrame) -> DataFrame:
    """(digest, part, term, counts): per chunk and term, its string and the counts by group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        entry = pa.struct([("g", pa.int64()), ("n", pa.int64()), ("docs", pa.int64())])
        for batch in batches:
            groups = batch.column("g").to_numpy()
            for first, data, edges in hashing.chunks(batch.column("text")):
                own = groups[first : first + len(edges) - 1]
                data = TERM_BYTES[data]
                found = chunk_terms(data, edges)
                if not len(found.digest):
                    continue
                names, code = np.unique(own, return_inverse=True)
                # Rows of one group side by side within a term.
                code = code[found.row]
                head = _edges(found.digest, found.variant)
                term = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(code))))
                order = np.lexsort((code, term))
                at = _edges(term[order], code[order])
                counts = pa.StructArray.from_arrays(
                    [
                        pa.array(names[code[order][at]]),
                        pa.array(np.add.reduceat(found.n[order], at)),
                        pa.array(np.diff(np.append(at, len(order)))),
                    ],
                    fields=list(entry),
                )
                raw = data.tobytes()
                strings = [raw[a:b].decode() for a, b in zip(found.start[head].tolist(), found.end[head].tolist())]
                offsets = np.searchsorted(term[order][at], np.arange(len(head) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.digest[head].view(np.int64)),
                        pa.array(part + found.variant[head]),
                        pa.array(strings, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), counts),
                    ],
                    ["digest", "part", "term", "counts"],
                )
                part += 1 << 16

    return docs.mapInArrow(count, "digest long, part long, term string, counts array<struct<g:long,n:long,docs:long>>")


def _numbered_groups(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(lang, source, g) of all groups, and the expression for g: a hash that tells them apart, seeds tried in turn."""
    groups = stored(docs.select("lang", "source").distinct(), "groups")
    n, seed = groups.count(), 0
    while True:
        g = F.xxhash64(F.lit(seed), "lang", "source")
        if groups.select(g.alias("g")).distinct().count() == n:
            return groups.withColumn("g", g), g
        seed += 1


def _cells(counted: DataFrame, groups: DataFrame, min_documents: int) -> DataFrame:
    """(lang, g, digest, split, n, in_lang, once): kept terms by group; ``once`` marks one row of each term of a language.

    ``split`` is the string where several terms have one digest, else empty.
    """
    rows = counted.select("digest", "part", F.explode("counts").alias("c")).select("digest", "part", "c.*")
    extremes = counted.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest"))
    clashes = stored(extremes.where("least <> greatest").select("digest"), "clashing-digests")
    if clashes.isEmpty():
        rows = rows.withColumn("split", F.lit(""))
    else:
        known = counted.join(clashes, "digest").select("digest", "part", F.col("term").alias("split"))
        rows = rows.join(known, ["digest", "part"], "left").fillna("", "split")
    counts = rows.groupBy("g", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A language has as many rows of a term as it has sources.
    term = Window.partitionBy("lang", "digest", "split")
    whole = counts.join(groups.select("g", "lang"), "g").select(
        "*",
        F.sum("docs").over(term).alias("in_docs"),
        F.sum("n").over(term).alias("in_lang"),
        (F.min("g").over(term) == F.col("g")).alias("once"),
    )
    return whole.where(F.col("in_docs") >= min_documents).select("lang", "g", "digest", "split", "n", "in_lang", "once")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exact for any counts."""
    return F.expr(
        f"1 + CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {ADDED} AS DECIMAL(20,0)) div CAST({total} + {ADDED} * {terms} AS DECIMAL(20,0))"
    )


def _pair_sums(cells: DataFrame, frame: DataFrame) -> DataFrame:
    """(lang, a, b, value) for sources numbered a < b: the measure summed over all kept terms.

    The terms of a language are cut into blocks, each a matrix of terms by sources with
    about CELLS cells, or as many terms as sources where there are many of them; a source
    that lacks a term has the share of a count of 0 there.
    """
    cells_each = F.greatest(F.lit(CELLS), F.col("sources") * F.col("sources"))
    blocks = F.ceil(F.col("terms") * F.col("sources") / cells_each).cast("int")
    frame = frame.where("terms > 0").withColumn("blocks", blocks)
    shares = (
        cells.join(frame.drop("lang"), "g")
        .withColumn("block", F.pmod(F.hash("digest", "split"), F.col("blocks")))
        .select("lang", "block", "s", "digest", "split", share("n", "total", "terms").alias("p"))
    )
    nothing = [F.lit(None).cast("long").alias("digest"), F.lit(None).cast("string").alias("split")]
    absent = frame.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(
        "lang", "block", "s", *nothing, share("0", "total", "terms").alias("p")
    )

    def sums(key: tuple[str, int], rows: pd.DataFrame) -> pd.DataFrame:
        base = rows[rows["digest"].isna()].sort_values("s")["p"].to_numpy(np.int64)
        rows = rows[rows["digest"].notna()]
        term = rows.groupby(["digest", "split"], sort=False).ngroup().to_numpy()
        matrix = np.tile(base, (int(term.max()) + 1 if len(term) else 0, 1))
        matrix[term, rows["s"].to_numpy(np.int64)] = rows["p"].to_numpy(np.int64)
        found = []
        for a in range(len(base) - 1):
            one, others = matrix[:, a : a + 1], matrix[:, a + 1 :]
            found.append(((one - others) ** 2 // (one + others)).sum(0))
        pairs = np.triu_indices(len(base), 1)
        value = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pd.DataFrame({"lang": key[0], "a": pairs[0], "b": pairs[1], "value": value})

    parts = shares.union(absent).groupBy("lang", "block").applyInPandas(sums, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from others, and by which terms.

    Part ``pair``: every other source of the language, with the measure summed over its kept
    terms, 0 where none is kept. Part ``term``: the ``top`` kept terms that the source uses
    more than the language. Ranks run from 1, by value, then by item.

    Null texts, languages and sources count as empty ones; repeated rows are documents of
    their own; texts may be of any length. An empty table gives no rows; other columns are
    ignored. A digest that several terms share is split; all arithmetic is on whole numbers.
    """
    plain = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], whole_text(docs).alias("text"))
    groups, g = _numbered_groups(plain)
    counted = stored(_counted(plain.select(g.alias("g"), "text")), "counted-terms")
    cells = stored(_cells(counted, groups, min_documents), "term-counts")
    by_lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("once").alias("terms"))
    by_group = cells.groupBy("g").agg(F.sum("n").alias("total"))
    in_lang = Window.partitionBy("lang")
    frame = groups.join(by_lang, "lang", "left").join(by_group, "g", "left").fillna(0, ["lang_total", "terms", "total"])
    frame = frame.withColumn("s", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("sources", F.count("*").over(in_lang))
    frame = stored(frame, "group-totals")

    left, right = (
        frame.select("lang", F.col("source").alias(name), F.col("s").alias(number)) for name, number in (("source", "x"), ("item", "y"))
    )
    both = left.join(right, "lang").where("x <> y").select("*", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = both.join(_pair_sums(cells, frame), ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )

    shares = cells.join(frame.drop("lang"), "g").select(
        "g", "digest", "split", share("n", "total", "terms").alias("p"), share("in_lang", "lang_total", "terms").alias("q")
    )
    value = F.expr("(p - q) * (p - q) div (p + q)").alias("value")
    by_value = Window.partitionBy("g").orderBy(F.desc("value"))
    leading = shares.where("p > q").select("g", "digest", "split", value).withColumn("place", F.rank().over(by_value))
    leading = stored(leading.where(F.col("place") <= top).drop("place"), "leading-terms")
    # Terms that are split have their string already; the others have one string each.
    wanted = leading.where("split = ''").select("digest").distinct()
    strings = counted.select("digest", "term").join(wanted, "digest").groupBy("digest").agg(F.min("term").alias("term"))
    item = F.when(F.col("split") != "", F.col("split")).otherwise(F.col("term")).alias("item")
    terms = (
        leading.join(strings, "digest", "left")
        .join(groups, "g")
        .select("lang", "source", F.lit("term").alias("part"), item, "value")
    )
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.union(terms).withColumn("rank", place)
    return ranked.where(f"part = 'pair' OR rank <= {int(top)}")
