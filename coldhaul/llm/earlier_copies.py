"""Removal of byte strings that an earlier document has, by longest-previous-factor arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller doc_id, that is, if the longest previous factor (LPF) of a suffix that
starts at most LENGTH - 1 bytes before it reaches LENGTH.

No suffix array of a whole corpus is built in one place. The least hashed string of ``ANCHOR``
bytes among those in a window of LENGTH bytes, its anchor, depends on the window alone, so
equal windows have equal anchors, and suffixes can be sorted anchor by anchor:

1. Texts are stored in blocks. Every block sends short sorted hashes of its anchors to the
   range they fall in, and learns which of them other documents have too.
2. Consecutive windows with one anchor form a run. For shared anchors only, each block sends
   its distinct runs (their bytes, their least document and their places) to the range of
   the anchor. There the suffixes that start in the runs are sorted to a depth of LENGTH,
   equal ones by document. A suffix's previous smaller document in that order is then next
   to it among the equal ones, or there is none with an LPF of LENGTH; its next smaller
   document always belongs to another string. So LPF >= LENGTH where the first of the equal
   suffixes has a smaller document.
   An anchor of very many runs would still fill its range: its runs are cut into single
   windows, which go to the range of their own hash.
3. The pieces found return to their blocks, which cut them out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldhaul.llm import hashing
from coldhaul.llm.common import keyed, stored, whole_text

LENGTH, ANCHOR = 50, 20
GRAMS = LENGTH - ANCHOR + 1
#: Bytes of text in a block, of its windows scanned at a time, and of text per range of anchors.
BLOCK_BYTES, SCAN_BYTES, RANGE_BYTES = 4 << 20, 1 << 18, 4 << 20
#: An anchor with more runs than this is dealt out by windows.
HOT_RUNS = 50_000
#: Bits by which the short hashes of anchors exceed what the number of anchors needs.
SPARE_BITS = 10
#: Places of the 8-byte words that together are the first LENGTH bytes of a suffix.
WORDS = [*range(0, LENGTH - 8, 8), LENGTH - 8]
PLACE = np.uint64((1 << 20) - 1)
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers, their least significant bytes first, then the next, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 3)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each place on."""
    with np.errstate(over="ignore"):
        factor = hashing.BASE | np.uint64(1)
        part, width = hashing.mix(data.astype(np.uint64) + hashing.BASE), 1
        total, length = np.zeros(len(data) + 1, np.uint64), 0
        while n:
            if n & 1:
                places = len(data) - length - width + 1
                total = total[:places] * factor + part[length : length + places]
                length += width
            n >>= 1
            if n:
                part = part[: len(part) - width] * factor + part[width:]
                factor, width = factor * factor, 2 * width
        return hashing.mix(total)


def runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, place of the anchor in the run, its hash.

    ``edges`` are the borders of the texts in ``data``; windows lie within a text.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(data) - LENGTH + 1), SCAN_BYTES):
        part = data[at : at + SCAN_BYTES + LENGTH - 1]
        n = len(part) - LENGTH + 1
        hashes = gram_hashes(part, ANCHOR)
        least, width = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * width <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < GRAMS:
            least = np.minimum(least[: width - GRAMS], least[GRAMS - width :])
        anchor = (least & PLACE).astype(np.int64)
        ends = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, at + n + LENGTH - 1, "left")] - at
        crossed = np.zeros(n + 1, np.int64)
        np.add.at(crossed, np.clip(ends - LENGTH + 1, 0, n), 1)
        np.add.at(crossed, np.clip(ends, 0, n), -1)
        inside = np.cumsum(crossed[:-1]) == 0
        fresh = inside.copy()
        fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        first = np.flatnonzero(fresh)
        counted = np.cumsum(inside)
        before = counted[first] - 1
        windows = np.diff(np.append(before, counted[-1]))
        # Least hashes are small, so they are mixed again to be spread over all ranges.
        found.append((first + at, windows, anchor[first] - first, hashing.mix(hashes[anchor[first]] + hashing.BASE)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))  # type: ignore[return-value]


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def short_hashes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the given bits, sorted, and the index in them of each of ``hashes``."""
    return np.unique(hashes >> np.uint64(64 - bits), return_inverse=True)


def earlier_windows(texts: list[bytes], windows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Least document with the string of each window of the runs ``texts``, whose least documents are given.

    The suffixes are sorted by their first LENGTH bytes, equal ones by document.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    keys = [np.ascontiguousarray(words[at + w]).view(">u8").reshape(-1).astype(np.uint64) for w in WORDS]
    document = np.repeat(least, windows)
    order = np.lexsort((document, *keys[::-1]))
    other = np.zeros(len(order), bool)
    other[:1] = True
    for key in keys:
        key = key[order]
        other[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(other)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(document[order][first], np.diff(np.append(first, len(order))))
    return out


class Range:
    """The runs of one range of anchors, as sent by the blocks."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.anchors: list[bytes] = []
        self.windows: list[int] = []
        self.sent: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, block: int, sizes: bytes, anchors: bytes, texts: bytes, least: bytes, most: bytes, holders: bytes, places: bytes) -> None:
        lengths, within = unpacked(sizes, "<u1"), unpacked(anchors, "<u1")
        raw = zstandard.decompress(texts)
        ends = np.cumsum(lengths, dtype=np.int64)
        ids = np.empty(len(lengths), np.int64)
        for i, (a, b, x) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), within.tolist())):
            text = raw[a:b]
            run = self.index.setdefault(text, len(self.index))
            if run == len(self.anchors):
                self.anchors.append(text[x : x + ANCHOR])
                self.windows.append(b - a - LENGTH + 1)
            ids[i] = run
        self.sent.append((block, ids, unpacked(least, "<i8"), unpacked(most, "<i8"), unpacked(holders, "<u4"), unpacked(places, "<u4")))

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, start, length, earlier document) of strings that have one before some holder of theirs."""
        if not self.sent:
            return
        windows = np.array(self.windows, np.int64)
        least = np.full(len(windows), np.iinfo(np.int64).max)
        for _, ids, first, *_ in self.sent:
            np.minimum.at(least, ids, first)
        groups: dict[bytes, int] = {}
        group = np.array([groups.setdefault(a, len(groups)) for a in self.anchors])
        # Runs that alone have their anchor have no other string in common with other runs.
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        document = np.repeat(least, windows)
        first_window = np.cumsum(windows) - windows
        if len(several):
            texts = list(self.index)
            at = np.repeat(first_window[several] - (np.cumsum(windows[several]) - windows[several]), windows[several])
            at += np.arange(len(at))
            document[at] = earlier_windows([texts[i] for i in several], windows[several], least[several])
        # Neighbouring windows of a run with the same earlier document are one piece.
        run = np.repeat(np.arange(len(windows)), windows)
        edge = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (document[1:] != document[:-1]))))
        piece_run, piece_document = run[edge], document[edge]
        offset = edge - first_window[piece_run]
        length = np.diff(np.append(edge, len(run))) + LENGTH - 1
        per_run = np.bincount(piece_run, minlength=len(windows))
        first_piece = np.cumsum(per_run) - per_run
        for block, ids, _, most, holders, places in self.sent:
            # Every sent run with each of its pieces, then with each of its holders.
            sent = np.repeat(np.arange(len(ids)), per_run[ids])
            piece = first_piece[ids][sent] + np.arange(len(sent)) - np.repeat(np.cumsum(per_run[ids]) - per_run[ids], per_run[ids])
            wanted = piece_document[piece] < most[sent]
            sent, piece = sent[wanted], piece[wanted]
            held = holders[sent].astype(np.int64)
            piece = np.repeat(piece, held)
            holder = np.repeat((np.cumsum(holders, dtype=np.int64) - holders)[sent] - (np.cumsum(held) - held), held) + np.arange(len(piece))
            if len(piece):
                yield block, places[holder] + offset[piece].astype(np.uint32), length[piece].astype(np.uint8), piece_document[piece]


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``place``, a whole number in the order of doc_id, the same for equal ids; null ids come first."""
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    if dict(docs.dtypes)["doc_id"] in INTEGERS:
        return rows.withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    ids = keyed(rows.select("doc_id").distinct()).select(F.col("doc_id").alias("of_id"), F.col("key").alias("place"))
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("of_id"))).drop("of_id")


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, places, sizes, data): texts of consecutive rows, compressed together."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, data, edges in _chunks(batch.column("text")):
                k = len(edges) - 1
                ids, places = batch.column("doc_id").slice(row, k), batch.column("place").slice(row, k)
                one = pa.array([0, k], pa.int32())
                lists = [pa.ListArray.from_arrays(one, _flat(c)) for c in (ids, places, pa.array(np.diff(edges)))]
                blob = pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), *lists, pa.array([len(data)], pa.int64()), blob],
                    ["block", "ids", "places", "sizes", "bytes", "data"],
                )
                block += 1

    schema = f"block long, ids array<{id_type}>, places array<long>, sizes array<long>, bytes long, data binary"
    return docs.mapInArrow(pack, schema)


def _flat(values: pa.Array) -> pa.Array:
    """Without an offset, as list items must be."""
    return pa.concat_arrays([values])


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, edges in hashing.chunks(texts):
        a = 0
        while a < len(edges) - 1:  # blocks are smaller than those chunks
            b = int(np.searchsorted(edges, edges[a] + BLOCK_BYTES, "right")) - 1
            b = min(max(b, a + 1), len(edges) - 1)
            yield row + a, data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
            a = b


def _opened(data: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return raw, np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))


def _split(values: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """(range, its part) of hashes sorted by range."""
    own = range_of(values, ranges)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if b > a:
            yield int(own[a]), slice(a, b)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of each value of ``key``, which come one after the other."""
    rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
    for value, group in groupby(rows, key=lambda row: row[key]):
        yield value, group


def _shared_anchors(blocks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(block, found): per range, bits for the block's sorted anchors: do other documents have them, have very many runs them."""
    hot_runs = HOT_RUNS
    offered = [("range", pa.int64()), ("block", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary()), ("several", pa.binary())]
    answered = [("block", pa.int64()), ("range", pa.int64()), ("n", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())]

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, edges = _opened(row["data"], row["sizes"])
                first, _, _, hashes = runs(data, edges)
                values, index = short_hashes(hashes, bits)
                counts = np.bincount(index, minlength=len(values)).astype("<u4")
                place = np.array(row["places"], np.int64)[np.searchsorted(edges, first, "right") - 1]
                low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
                np.minimum.at(low, index, place)
                np.maximum.at(high, index, place)
                out = []
                for own, part in _split(values << np.uint64(64 - bits), ranges):
                    steps = np.diff(values[part], prepend=np.uint64(0))
                    several = np.packbits(low[part] != high[part]).tobytes()
                    out.append((own, row["block"], packed(steps), packed(counts[part]), several))
                if out:
                    yield _rows(out, offered)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, group in _grouped(batches, "range"):
            sent, parts, counts, several = [], [], [], []
            for row in group:
                values = np.cumsum(unpacked(row["steps"], "<u8"), dtype=np.uint64)
                sent.append(row["block"])
                parts.append(values)
                counts.append(unpacked(row["counts"], "<u4"))
                several.append(np.unpackbits(np.frombuffer(row["several"], np.uint8), count=len(values)).astype(bool))
            _, index, blocks_with = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            known = blocks_with > 1
            known[index[np.concatenate(several)]] = True
            hot = np.bincount(index, np.concatenate(counts)) > hot_runs
            out, at = [], 0
            for block, values in zip(sent, parts):
                mine = index[at : at + len(values)]
                at += len(values)
                out.append((block, own, len(values), np.packbits(known[mine]).tobytes(), np.packbits(hot[mine]).tobytes()))
            yield _rows(out, answered)

    sent = blocks.select("block", "places", "sizes", "data").mapInArrow(offer, _ddl(offered))
    by_range = sent.repartition("range").sortWithinPartitions("range")
    answers = by_range.mapInArrow(match, _ddl(answered))
    return answers.groupBy("block").agg(F.collect_list(F.struct("range", "n", "shared", "hot")).alias("found"))


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {'binary' if t == pa.binary() else 'long'}" for n, t in fields)


def _sent_runs(blocks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """Per block and range, the distinct runs with shared anchors; single windows where the anchor has very many runs."""
    names = ["sizes", "anchors", "texts", "least", "most", "holders", "places"]
    fields = [("range", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in names)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, edges = _opened(row["data"], row["sizes"])
                first, windows, anchor, hashes = runs(data, edges)
                _, index = short_hashes(hashes, bits)
                answers = sorted(row["found"], key=lambda f: f["range"])
                shared, hot = (
                    np.concatenate([np.unpackbits(np.frombuffer(f[n], np.uint8), count=f["n"]).astype(bool) for f in answers])[index]
                    for n in ("shared", "hot")
                )
                raw = data.tobytes()
                plain = shared & ~hot
                single = _single_windows(raw, *(c[shared & hot] for c in (first, windows, anchor)))
                first, windows, anchor, hashes = (
                    np.concatenate((c[plain], own)) for c, own in zip((first, windows, anchor, hashes), single)
                )
                place = np.array(row["places"], np.int64)[np.searchsorted(edges, first, "right") - 1]
                # Equal runs of the block become one, under the first of them; sorted by anchor.
                seen: dict[bytes, int] = {}
                ids = np.fromiter(
                    (seen.setdefault(raw[a:b], len(seen)) for a, b in zip(first.tolist(), (first + windows + LENGTH - 1).tolist())),
                    np.int64,
                    len(first),
                )
                if not len(ids):
                    continue
                texts = list(seen)
                k = len(texts)
                some = np.empty(k, np.int64)
                some[ids[::-1]] = np.arange(len(ids))[::-1]
                low, high = np.full(k, np.iinfo(np.int64).max), np.full(k, np.iinfo(np.int64).min)
                np.minimum.at(low, ids, place)
                np.maximum.at(high, ids, place)
                order = np.argsort(hashes[some], kind="stable")
                position = np.empty(k, np.int64)
                position[order] = np.arange(k)
                by_run = np.argsort(position[ids], kind="stable")
                holders = np.bincount(position[ids], minlength=k)
                ends = np.cumsum(holders)
                out = []
                for own, part in _split(hashes[some][order], ranges):
                    chosen = order[part]
                    mine = by_run[ends[part.start] - holders[part.start] : ends[part.stop - 1]]
                    out.append(
                        (
                            own,
                            row["block"],
                            packed((windows[some][chosen] + LENGTH - 1).astype("<u1")),
                            packed(anchor[some][chosen].astype("<u1")),
                            zstandard.compress(b"".join([texts[i] for i in chosen]), 3),
                            packed(low[chosen].astype("<i8")),
                            packed(high[chosen].astype("<i8")),
                            packed(holders[part].astype("<u4")),
                            packed(first[mine].astype("<u4")),
                        )
                    )
                yield _rows(out, fields)

    return blocks.select("block", "places", "sizes", "data", "found").mapInArrow(send, _ddl(fields))


def _single_windows(raw: bytes, first: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs cut into single windows, each with its own hash."""
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(first, windows) + step
    own = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + LENGTH]) for a in at.tolist()), np.uint64, len(at))
    return at, np.ones(len(at), np.int64), np.repeat(anchor, windows) - step, own


def _pieces(sent: DataFrame) -> DataFrame:
    """(block, starts, lengths, earlier): packed pieces that an earlier document has, a row per block and range."""
    fields = [("block", pa.int64()), *((n, pa.binary()) for n in ("starts", "lengths", "earlier"))]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, "range"):
            own = Range()
            for row in group:
                del row["range"]
                own.add(**row)
            out = [
                (block, packed(starts.astype("<u4")), packed(lengths), packed(earlier.astype("<i8")))
                for block, starts, lengths, earlier in own.pieces()
            ]
            if out:
                yield _rows(out, fields)

    by_range = sent.repartition("range").sortWithinPartitions("range")
    return by_range.mapInArrow(sort, _ddl(fields))


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones in order; those that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((fresh[1:], [True]))
    return starts[fresh], ends[last]


def _cut(blocks: DataFrame) -> DataFrame:
    id_field = blocks.schema["ids"].dataType.elementType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                row = batch.select(["places", "sizes", "data", "pieces"]).slice(i, 1).to_pylist()[0]
                raw, edges = _opened(row["data"], row["sizes"])
                place = np.array(row["places"], np.int64)
                parts = row["pieces"] or []
                none = np.zeros(0, np.int64)
                start, length, earlier = (
                    np.concatenate([none, *(unpacked(p[n], k) for p in parts)]).astype(np.int64)
                    for n, k in (("starts", "<u4"), ("lengths", "<u1"), ("earlier", "<i8"))
                )
                doc = np.searchsorted(edges, start, "right") - 1
                gone = earlier < place[doc]
                # Texts lie one after the other, but no piece reaches into the next text.
                a, b = start[gone] + doc[gone], (start + length)[gone] + doc[gone]
                a, b = covered(a, b)  # shifted by a byte per text, so that pieces of two texts never touch
                doc = np.searchsorted(edges + np.arange(len(edges)), a, "right") - 1
                a, b = a - doc, b - doc
                k = len(ids)
                spans, removed = np.bincount(doc, minlength=k), np.bincount(doc, b - a, minlength=k).astype(np.int64)
                data, kept, at = raw.tobytes(), [], 0
                for j in range(k):
                    end = at + int(spans[j])
                    borders = [int(edges[j]), *(int(x) for pair in zip(a[at:end], b[at:end]) for x in pair), int(edges[j + 1])]
                    kept.append(b"".join(data[x:y] for x, y in zip(borders[::2], borders[1::2])))
                    at = end
                offsets = pa.array(np.concatenate(([0], np.cumsum(spans))).astype(np.int32))
                values = pa.StructArray.from_arrays(
                    [pa.array(a - edges[doc], pa.int64()), pa.array(b - edges[doc], pa.int64())], fields=list(span)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        _flat(ids),
                        pa.array(np.diff(edges), pa.int64()),
                        pa.array(removed),
                        pa.array(spans.astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, values),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    schema = f"doc_id {id_field}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    return blocks.select("ids", "places", "sizes", "data", "pieces").mapInArrow(cut, schema)


def remove_earlier_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, the spans removed and the bytes kept.

    Matches lie within a text; where a text ends within a character, ``kept`` need not be valid
    UTF-8. Rows with the same id, and all rows with a null id, remove nothing from each other;
    null ids come before all others. Null and empty texts have no bytes. Texts may be of any
    length. An empty table gives no rows; other columns are ignored.

    A block holds BLOCK_BYTES of text, or one longer text; a range holds what blocks send
    of anchors that are RANGE_BYTES of the text on average, each distinct run once a block, and
    at most HOT_RUNS runs of an anchor. A window that every block has costs its range some 100
    bytes a block.
    """
    blocks = stored(_blocks(_ordered(docs)), "text-blocks")
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(1, math.ceil(size / RANGE_BYTES))
    bits = min(63, max(32, size.bit_length() + SPARE_BITS, ranges.bit_length() + 24))
    shared = _shared_anchors(blocks, ranges, bits)
    pieces = _pieces(_sent_runs(blocks.join(shared, "block"), ranges, bits))
    by_block = pieces.groupBy("block").agg(F.collect_list(F.struct("starts", "lengths", "earlier")).alias("pieces"))
    return _cut(blocks.join(by_block, "block", "left"))


def earlier_copy_digests(docs: DataFrame) -> DataFrame:
    """:func:`remove_earlier_copies` with the sha256 of the bytes kept in place of them."""
    found = remove_earlier_copies(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
