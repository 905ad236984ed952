"""Fill-in-middle documents, cut at token counts summed over memoized chunks.

A token is a run of ASCII letters or any other single character. A rolling hash of the
last ``WINDOW`` bytes cuts each text into chunks that depend on their content only, so
that copied passages give the same chunks. Per task a bounded cache holds, by fingerprint,
a chunk's bytes and its summary: tokens, characters, and whether it begins and ends
inside a word. A cached summary counts only if the bytes are equal. Summaries add up, a
word that goes on over a border counts once, and only the one chunk that holds a cut is
read letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldhaul.llm import hashing
from coldhaul.llm.common import whole_text

WINDOW = 16
#: A chunk ends where these bits of the rolling hash are 0, after 512 bytes on average.
BORDER_BITS = np.uint64((1 << 9) - 1)
#: Longer chunks are cut, counted from the last border; bytes of chunks a task's cache may hold.
LONGEST, CACHE_BYTES = 4096, 32 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the documents that stay plain, and of the others that have their suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Bytes that continue a UTF-8 character; letters and all other first bytes for translate().
CONTINUED = bytes(range(0x80, 0xC0))
CLASSES = bytes(ord("a") if IS_LETTER[b] else ord(".") for b in range(256))


class Summary(NamedTuple):
    """Tokens that begin in a chunk taken alone, its characters, and words cut at its borders."""

    tokens: int
    chars: int
    opens: bool
    closes: bool


def summarize(chunk: bytes) -> Summary:
    signs = chunk.translate(CLASSES, CONTINUED)
    tokens = signs.count(b".") + signs.count(b".a") + signs.startswith(b"a")
    return Summary(tokens, len(signs), bool(IS_LETTER[chunk[0]]), bool(IS_LETTER[chunk[-1]]))


class SummaryCache:
    """Summaries by fingerprint, valid for equal bytes; the oldest go when it is full."""

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.limit, self.size = limit, 0
        self.known: dict[int, tuple[bytes, Summary]] = {}
        self.hits = 0

    def summary(self, chunk: bytes) -> Summary:
        name = xxhash.xxh3_64_intdigest(chunk)
        found = self.known.get(name)
        if found is not None and found[0] == chunk:
            self.hits += 1
            return found[1]
        made = summarize(chunk)
        if found is None and len(chunk) <= self.limit:
            while self.size + len(chunk) > self.limit:
                self.size -= len(self.known.pop(next(iter(self.known)))[0])
            self.known[name] = (chunk, made)
            self.size += len(chunk)
        return made


def borders(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where chunks begin: at the rows' ``edges``, after hash borders, and every LONGEST bytes without one.

    A border depends on the WINDOW bytes before it, all in its row.
    """
    found = np.zeros(0, np.int64)
    if len(data) >= WINDOW:
        rolling, step = hashing.mix(data.astype(np.uint64) + hashing.BASE), 1
        factor = hashing.BASE | np.uint64(1)
        with np.errstate(over="ignore"):
            while step < WINDOW:  # the hash of 2 * step bytes from two of step bytes
                rolling = rolling[:-step] * factor + rolling[step:]
                factor, step = factor * factor, 2 * step
        ends = np.flatnonzero((hashing.mix(rolling) & BORDER_BITS) == 0) + WINDOW
        row = np.searchsorted(edges, ends, "right") - 1
        found = ends[ends - edges[np.minimum(row, len(edges) - 1)] >= WINDOW]
    cuts = np.unique(np.concatenate((edges, found)))
    parts = -(-np.diff(cuts) // LONGEST)
    if len(parts) and parts.max() > 1:
        at = np.repeat(cuts[:-1], parts)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.concatenate((at + nth * LONGEST, cuts[-1:]))
    return cuts


def token_start(chunk: bytes, nth: int, goes_on: bool) -> int:
    """Place of the nth token that begins in a chunk; ``goes_on``: its first letters belong to a word before it."""
    codes = np.frombuffer(chunk, np.uint8)
    letter = IS_LETTER[codes]
    before = np.concatenate(([goes_on], letter[:-1]))
    starts = np.where(letter, ~before, (codes & 0xC0) != 0x80)
    return int(np.flatnonzero(starts)[nth])


class Counted:
    """A text as chunks with running counts of tokens and characters."""

    def __init__(self, text: bytes, cuts: list[int], cache: SummaryCache) -> None:
        self.text, self.cuts = text, cuts
        self.joined, self.tokens, self.chars = [], [0], [0]
        closes = False
        for a, b in zip(cuts, cuts[1:]):
            s = cache.summary(text[a:b])
            goes_on = closes and s.opens
            self.joined.append(goes_on)
            self.tokens.append(self.tokens[-1] + s.tokens - goes_on)
            self.chars.append(self.chars[-1] + s.chars)
            closes = s.closes

    def place(self, tokens: int) -> tuple[int, int]:
        """(bytes, characters) before the token of that number; at the end after the last one."""
        if tokens >= self.tokens[-1]:
            return len(self.text), self.chars[-1]
        # The last chunk whose tokens begin at or before the one sought.
        i = int(np.searchsorted(self.tokens, tokens, "right")) - 1
        chunk = self.text[self.cuts[i] : self.cuts[i + 1]]
        at = token_start(chunk, tokens - self.tokens[i], self.joined[i])
        return self.cuts[i] + at, self.chars[i] + len(chunk[:at].translate(None, CONTINUED))


def fill_in_middle(docs: DataFrame, seed: str = "1:") -> DataFrame:
    """Per document: doc_id, n tokens, form, prefix_chars, middle_chars and the output text.

    The form is ``plain``, ``psm`` or ``spm``; it and the cuts follow from the sha256 of
    ``seed`` and the id, so that equal ids with equal texts give equal rows. Null and empty
    texts and texts that hold a marker are plain, with null counts of characters; a null id
    counts as an empty one. Texts may be of any length; an empty table gives no rows; other
    columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select("doc_id", whole_text(docs).alias("text"), digest.alias("digest")).select("doc_id", "text", *draws)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SummaryCache()
        for batch in batches:
            for row, data, edges in hashing.chunks(batch.column(1)):
                k = len(edges) - 1
                cuts, raw = borders(data, edges), data.tobytes()
                first = np.searchsorted(cuts, edges)
                drawn = zip(*[batch.column(i).slice(row, k).to_pylist() for i in range(2, 6)])
                out = []
                for i, (h1, h2, h3, h4) in enumerate(drawn):
                    a, b = int(edges[i]), int(edges[i + 1])
                    own = [int(c) - a for c in cuts[first[i] : first[i + 1] + 1]] if b > a else [0]
                    out.append(_formed(raw[a:b], own, cache, h1, h2, h3, h4))
                columns = list(zip(*out))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, k), *(pa.array(c, t) for c, t in zip(columns, types))],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _formed(
    text: bytes, cuts: list[int], cache: SummaryCache, h1: int, h2: int, h3: int, h4: int
) -> tuple[int, str, int | None, int | None, str]:
    counted = Counted(text, cuts, cache)
    n = counted.tokens[-1]
    if not text or h3 % 100 >= PLAIN_FROM or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text.decode()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    (from_byte, from_char), (to_byte, to_char) = counted.place(a), counted.place(b)
    prefix, middle, suffix = (p.decode() for p in (text[:from_byte], text[from_byte:to_byte], text[to_byte:]))
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", from_char, to_char - from_char, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", from_char, to_char - from_char, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Texts that hold a marker are plain, so the markers divide it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """:func:`fill_in_middle` with sha256 digests of the output and of the text restored from it."""
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    digests = [F.sha2(F.encode(c, "UTF-8"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
