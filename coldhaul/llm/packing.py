"""Best-fit packing of documents into sequences, after a dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a histogram
with at most ``capacity`` counts, whatever the number of documents. The packing of a
histogram is a list of patterns (the lengths in one sequence, longest first) with the
number of sequences that use it. It is worked out from the counts and handed to the
documents as ranges of their rank among the documents of the same length.

Reduction (Martello and Toth): for the longest piece j, a set that contains j is fixed
if it dominates every other set that could contain j, that is if the other members of
any such set can be exchanged for members of the fixed one that are at least as long.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldhaul.llm.common import numbered, ranked
from coldhaul.llm.tokens import encoder

Pattern = tuple[int, ...]
FEW = 4


def dominant_set(counts: list[int], sizes: list[int], j: int, cap: int) -> Pattern | None:
    """The set with j that dominates all others, or None if none is proved to.

    ``sizes`` are the lengths with a count, ascending; one piece j is set aside.
    """
    room = cap - j

    def left(size: int) -> int:
        return counts[size] - (size == j)

    def largest(limit: int, taken: int = 0) -> int:
        for i in range(bisect_right(sizes, limit) - 1, -1, -1):
            if left(sizes[i]) - (sizes[i] == taken) > 0:
                return sizes[i]
        return 0

    k = largest(room)
    if not k:
        return (j,)
    if k == room:
        return (j, k)
    least: list[int] = []
    for size in sizes[:4]:
        least += [size] * min(3, left(size))
    least = least[:3]
    if len(least) < 2 or least[0] + least[1] > room:
        return (j, k)
    if len(least) < 3 or sum(least) > room:
        # At most two more pieces fit: compare with the best pairs.
        best_sum = best_second = 0
        for size in sizes[: bisect_right(sizes, room)]:
            if left(size) > 0 and (other := largest(room - size, size)):
                best_sum = max(best_sum, size + other)
                best_second = max(best_second, min(size, other))
        if best_sum <= k:
            return (j, k)
        second = largest(room - k, k)
        if second and second >= best_second:
            return (j, k, second)
    return None


def reduce_instance(counts: list[int], cap: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets and take their pieces out of ``counts``."""
    fixed: list[tuple[Pattern, int]] = []
    sizes = [s for s in range(1, cap + 1) if counts[s]]
    for j in reversed(list(sizes)):
        while counts[j]:
            found = dominant_set(counts, sizes, j, cap)
            if found is None:
                break
            uses = min(counts[s] // found.count(s) for s in found)
            if len(found) == 3 and sum(found) < cap:
                # The proof rests on which lengths have one to four pieces or more, so it
                # holds again and again until one of its own lengths is down to four.
                uses = max(1, min((counts[s] - FEW) // found.count(s) for s in found))
            fixed.append((found, uses))
            for s in found:
                counts[s] -= uses
            for s in set(found):
                if not counts[s]:
                    sizes.pop(bisect_left(sizes, s))
    return fixed


def best_fit(counts: list[int], cap: int) -> list[tuple[Pattern, int]]:
    """Best fit in decreasing order, on whole groups of equal sequences."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def add(pattern: Pattern, uses: int, room: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append([pattern, uses])

    for size in range(cap, 0, -1):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                # A new sequence takes as many of this length as fit.
                fit = min(cap // size, n)
                uses = n // fit
                add((size,) * fit, uses, cap - size * fit)
                n -= uses * fit
                continue
            room = rooms[i]
            group = open_by_room[room]
            pattern, uses = group[-1]
            fit = min(room // size, n)
            # Best fit fills the same sequence while it stays the tightest; it does
            # for equal lengths, since its room only shrinks.
            take = min(uses, n // fit)
            if take == uses:
                group.pop()
                if not group:
                    del open_by_room[room]
                    rooms.pop(i)
            else:
                group[-1][1] -= take
            add(pattern + (size,) * fit, take, room - size * fit)
            n -= take * fit
    return [(p, u) for groups in open_by_room.values() for p, u in groups]


def pack(counts: list[int], cap: int) -> list[tuple[Pattern, int]]:
    """Patterns with their number of uses that hold exactly ``counts[size]`` pieces of each size."""
    counts = list(counts)
    fixed = reduce_instance(counts, cap)
    return fixed + best_fit(counts, cap)


@dataclass(frozen=True)
class Run:
    """Pieces of ``size`` with a rank in [first, last) start at ``offset`` of consecutive sequences."""

    size: int
    first: int
    last: int
    sequence: int
    offset: int
    each: int


def runs(patterns: list[tuple[Pattern, int]]) -> list[Run]:
    """Ranks in order: ``each`` equal pieces side by side share a sequence."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, uses in patterns:
        offset, i = 0, 0
        while i < len(pattern):
            size = pattern[i]
            each = 1
            while i + each < len(pattern) and pattern[i + each] == size:
                each += 1
            first = taken.get(size, 0)
            taken[size] = first + each * uses
            out.append(Run(size, first, first + each * uses, sequence, offset, each))
            offset += size * each
            i += each
        sequence += uses
    return out


def pieces(docs: DataFrame, tokenizer: str, cap: int, end_id: int) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32."""
    schema = docs.select(
        "doc_id",
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("length"),
        F.lit(0).cast("long").alias("ids_crc32"),
    ).schema
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces_matter=True)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            source, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encode(texts)):
                ids += end
                n = len(ids) // 4
                first = n % cap or cap
                edges = [0, *range(first, n + 1, cap)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    source.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(source, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, cap: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece with the sequence it goes to and its offset there.

    A document is its ids and the end id; only one longer than ``cap`` is cut, into
    pieces of ``cap`` of which the first may be shorter. A null or empty text is the
    end id alone. Null ids, repeated rows and ties keep their own pieces; an empty
    table gives no rows; other columns are ignored.
    """
    rows = numbered(pieces(docs, tokenizer, cap, end_id), "pieces")
    counts = [0] * (cap + 1)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most cap rows
        counts[r["length"]] = r["n"]
    plan = docs.sparkSession.createDataFrame(
        [(r.size, r.first, r.last, r.sequence, r.offset, r.each) for r in runs(pack(counts, cap))],
        "size long, first long, last long, sequence long, at long, each int",
    )
    placed = ranked(rows, ["length"])
    inside = (placed["length"] == plan["size"]) & (placed["rank"] >= plan["first"]) & (placed["rank"] < plan["last"])
    nth = F.col("rank") - F.col("first")
    # Few patterns to a length, so the plan is bounded by the capacity, not by the documents.
    return placed.join(F.broadcast(plan), inside).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
