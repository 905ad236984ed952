"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

1. One pass over the texts hashes the shingles (48 bits) and sends them, packed by
   hash range, to the tasks that build the inverted index. A shingle that no other
   set has is dropped there; the others come back to their document with their
   frequency. A set that keeps fewer shingles than a partner would have to share has
   no partner and is done.
2. The shingles of a set are ordered by frequency. With a prefix of n - ceil(0.8 n) + l
   shingles any two linked sets share at least l of them, so a longer prefix allows a
   stricter test. Each set takes the l with the least estimated cost: postings to read
   and candidates to verify. Two sets are compared if they share as many prefix
   shingles as the smaller of their l.
3. In a group of many near copies not all pairs are formed. Every set is first verified
   against the most central sets among its posting lists, in a family of copies the
   original; the links give components. Only pairs that lie in different components by
   then are counted and verified, so no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldhaul.llm import hashing
from coldhaul.llm.common import keyed, stored
from coldhaul.llm.components import components

SHINGLE = 5
TOKEN_BITS = 48
RANGE_BITS = 11
MATCHES = (1, 2, 4, 8)
SHARED = np.dtype([("local", "<u2"), ("token", "<u8"), ("freq", "<u4")])
#: Leaders stand for sets of about their own size; a band is this ratio wide.
BAND = 1.15


def _packed(docs: DataFrame) -> DataFrame:
    """kind 0: a document and the local number of its set; kind 1: postings of one hash range of a block."""
    id_field = docs.schema["doc_id"]
    schema = f"kind int, range int, block long, local int, doc_id {id_field.dataType.simpleString()}, set long, n int, high binary, low binary, holders binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        number = 0
        types = None
        for batch in batches:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), batch.schema.field(0).type, pa.int64(), pa.int32()]
            types += [pa.binary()] * 3
            names = ["kind", "range", "block", "local", "doc_id", "set", "n", "high", "low", "holders"]
            for row, data, edges in hashing.chunks(batch.column(1)):
                block, number = task + number, number + 1
                local: dict[tuple[int, int], int] = {}
                sets, sizes, numbers, tokens, holders = [], [], [], [], []
                for one in hashing.shingles(hashing.words(data, edges), SHINGLE):
                    size = len(one)
                    with np.errstate(over="ignore"):
                        name = int(hashing.mix(hashing.mix(one ^ hashing.BASE).sum(keepdims=True))[0].astype(np.int64)) if size else 0
                    if (name, size) not in local:
                        local[name, size] = len(local)
                        if size:
                            short = np.unique(one >> np.uint64(64 - TOKEN_BITS))
                            tokens.append(short)
                            holders.append(np.full(len(short), local[name, size], np.uint16))
                    sets.append(name)
                    sizes.append(size)
                    numbers.append(local[name, size])
                k = len(sets)
                ids = batch.column(0).slice(row, k)
                # Documents travel with the postings; a spread of ranges keeps them even.
                spread = (np.arange(k) + block) % (1 << RANGE_BITS)
                nothing = pa.nulls(k, pa.binary())
                columns = [np.zeros(k), spread, np.full(k, block), numbers, ids, sets, sizes]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(np.asarray(c)).cast(t) for c, t in zip(columns, types)] + [nothing] * 3, names
                )
                if not tokens:
                    continue
                every, holder = np.concatenate(tokens), np.concatenate(holders)
                order = np.argsort(every)
                every, holder = every[order], holder[order]
                ranges = (every >> np.uint64(TOKEN_BITS - RANGE_BITS)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(ranges)) + 1
                cuts = np.concatenate(([0], cuts, [len(every)]))
                high, low = (every >> np.uint64(32)).astype("<u2"), every.astype("<u4")
                k = len(cuts) - 1
                blobs = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (high, low, holder.astype("<u2"))]
                columns = [np.ones(k), ranges[cuts[:-1]], np.full(k, block)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c).cast(t) for c, t in zip(columns, types)]
                    + [pa.nulls(k, types[i]) for i in (3, 4, 5, 6)]
                    + blobs,
                    names,
                )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(pack, schema)


def _indexed(packed: DataFrame) -> DataFrame:
    """kind 0 as it came; kind 1: per block and range, the shingles that more than one set has.

    A row of kind 1 holds parallel arrays: local number of the set, shingle, frequency.
    """
    id_type = packed.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, block long, local int, doc_id {id_type}, set long, n int, shared binary"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, holders = [], []
        names = ["kind", "block", "local", "doc_id", "set", "n", "shared"]
        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            kinds = batch.column("kind")
            docs = batch.filter(pa.array(np.asarray(kinds) == 0))
            if docs.num_rows:
                k = docs.num_rows
                yield pa.RecordBatch.from_arrays(
                    [docs.column(c) for c in ("kind", "block", "local", "doc_id", "set", "n")]
                    + [pa.nulls(k, pa.binary())],
                    names,
                )
            lists = batch.filter(pa.array(np.asarray(kinds) == 1))
            for block, high, low, holder in zip(
                lists.column("block").to_pylist(), *[lists.column(c) for c in ("high", "low", "holders")]
            ):
                part = np.frombuffer(high.as_buffer(), "<u2").astype(np.uint64) << np.uint64(32)
                tokens.append(part | np.frombuffer(low.as_buffer(), "<u4"))
                at = np.frombuffer(holder.as_buffer(), "<u2")
                holders.append((len(tokens) - 1, block, at.copy()))
        if not tokens:
            return
        blocks = np.unique([b for _, b, _ in holders])
        every = np.concatenate(tokens)
        del tokens
        holder = np.concatenate([at.astype(np.int64) + (int(np.searchsorted(blocks, b)) << 16) for _, b, at in holders])
        del holders
        order = np.argsort(every)
        every, holder = every[order], holder[order]
        del order
        edge = np.concatenate(([0], np.flatnonzero(np.diff(every)) + 1, [len(every)]))
        counts = np.diff(edge)
        freq = np.repeat(counts, counts)
        shared = freq > 1
        every, holder, freq = every[shared], holder[shared], freq[shared]
        order = np.argsort(holder, kind="stable")
        every, holder, freq = every[order], holder[order], freq[order]
        if not len(every):
            return
        rows = np.empty(len(every), SHARED)
        rows["local"], rows["token"], rows["freq"] = holder & 0xFFFF, every, freq
        edge = np.searchsorted(holder >> 16, np.arange(len(blocks) + 1))
        for a in range(0, len(blocks), 64):
            some = [i for i in range(a, min(a + 64, len(blocks))) if edge[i] < edge[i + 1]]
            k = len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(k, np.int32)),
                    pa.array(blocks[some].astype(np.int64)),
                    pa.nulls(k, pa.int32()),
                    pa.nulls(k, id_arrow),
                    pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.int32()),
                    pa.array([rows[edge[i] : edge[i + 1]].tobytes() for i in some], pa.binary()),
                ],
                names,
            )

    return packed.repartition("range").mapInArrow(index, schema)


def _lists(indexed: DataFrame) -> DataFrame:
    """One row per set that can have a partner: its shared shingles and their frequencies.

    A set that several blocks hold is taken from the first of them, so that the lists of
    the others are not sent on.
    """
    sets = indexed.where("kind = 0 and n > 0").groupBy("set", "n").agg(F.min(F.struct("block", "local")).alias("first"))
    owners = sets.select("first.block", "first.local", "set", "n")

    def gather(owned: pa.Table, lists: pa.Table) -> pa.Table:
        rows = np.concatenate([np.empty(0, SHARED), *[np.frombuffer(x.as_buffer(), SHARED) for x in lists.column("shared")]])
        rows = rows[np.argsort(rows["local"], kind="stable")]
        local, n = owned.column("local").to_numpy(), owned.column("n").to_numpy().astype(np.int64)
        start, end = (np.searchsorted(rows["local"], local, side) for side in ("left", "right"))
        # A partner shares at least ceil(0.8 n) shingles.
        need = (4 * n + 4) // 5
        able = np.flatnonzero(end - start >= need)
        sizes = (end - start)[able]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(offsets[-1]) + np.repeat(start[able] - offsets[:-1], sizes)
        offsets = pa.array(offsets.astype(np.int32))
        return pa.table(
            {
                "set": owned.column("set").take(pa.array(able)),
                "n": owned.column("n").take(pa.array(able)),
                "need": pa.array(need[able]),
                "tokens": pa.ListArray.from_arrays(offsets, pa.array(rows["token"][at].astype(np.int64))),
                "freqs": pa.ListArray.from_arrays(offsets, pa.array(rows["freq"][at].astype(np.int32))),
            }
        )

    # A block is some MB of text, so its group is small whatever the corpus.
    blocks = indexed.where("kind = 1").select("block", "shared").groupBy("block")
    return owners.groupBy("block").cogroup(blocks).applyInArrow(gather, "set long, n int, need long, tokens array<long>, freqs array<int>")


def _candidates(indexed: DataFrame) -> DataFrame:
    """One row per set that can have a partner: its shared shingles by frequency, its l and prefix length."""
    one = _lists(indexed)
    ordered = one.select("set", "n", "need", F.expr("sort_array(arrays_zip(freqs, tokens))").alias("z")).select(
        "set", "n", "need", F.col("z.tokens").alias("tokens"), F.col("z.freqs").alias("freqs")
    )
    # A partner of the same size shares at least ceil(8/9 n), which leaves this part of
    # the prefix to read; about one in l of what is read there becomes a candidate.
    costs = []
    for i in MATCHES:
        part = f"greatest(0, size(freqs) - cast((8 * n + 8) div 9 as int) + {i})"
        read = f"aggregate(slice(freqs, 1, {part}), 0L, (a, x) -> a + x - 1)"
        costs.append(f"if({i} <= need, struct({read} * (1 + n / {SHINGLE} / {i}) as cost, {i} as matches), null)")
    best = F.expr(f"array_min(filter(array({', '.join(costs)}), x -> x is not null)).matches")
    # How usual the shingles of a set are among all sets: in a family of copies the
    # original is the most central.
    central = F.expr("aggregate(freqs, 0L, (a, x) -> a + x) / n")
    return ordered.withColumn("matches", best).select(
        "set", "n", "matches", "tokens", central.alias("central"), F.expr("slice(tokens, 1, size(tokens) - cast(need as int) + matches)").alias("prefix")
    )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, by their whole sets."""
    left = sets.select(F.col("set").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    right = sets.select(F.col("set").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    both = pairs.join(left, "u").join(right, "v")
    shared = both.select("u", "v", "nu", "nv", F.size(F.array_intersect("tu", "tv")).alias("o"))
    return shared.where("100 * o >= 80 * (nu + nv - o)").select("u", "v")


def _leader_links(rows: DataFrame, sets: DataFrame, shift: float) -> DataFrame:
    """Links between sets and the leaders of their posting lists.

    A leader is the most central set of a list within a band of sizes. Each set is
    compared with two of its leaders at most: the one it meets most often and the most
    central.
    """
    rows = rows.withColumn("band", F.floor(F.log(F.col("n")) / math.log(BAND) + shift))
    leaders = rows.groupBy("token", "band").agg(F.max_by("set", "central").alias("leader"), F.max("central").alias("leading"))
    met = rows.join(leaders, ["token", "band"]).where("set <> leader").groupBy("set", "leader")
    met = met.agg(F.count("*").alias("met"), F.max("leading").alias("leading"))
    chosen = met.groupBy("set").agg(F.max_by("leader", "met").alias("a"), F.max_by("leader", "leading").alias("b"))
    pairs = chosen.select("set", F.explode(F.array_distinct(F.array("a", "b"))).alias("v"))
    pairs = pairs.select(F.least("set", "v").alias("u"), F.greatest("set", "v").alias("v")).distinct()
    return stored(_verified(pairs, sets), "links")


def _placed(postings: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components so far, and the postings of lists that still hold several of them.

    ``main`` is the component of the most central set of a list.
    """
    found = components(links)
    placed = postings.join(found.withColumnRenamed("u", "set"), "set", "left")
    placed = placed.withColumn("component", F.coalesce("component", "set"))
    mixed = placed.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", "central").alias("main")
    )
    return found, stored(placed.join(mixed.where("low < high").select("token", "main"), "token"), "shingle-placed")


def near_copy_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles and the smallest doc_id its links reach.

    Links: 100 * common shingles >= 80 * shingles in either, 5 lower-cased words each. A
    text of fewer words is one shingle; without words, or null, it links with nothing
    and is its own component. Rows with equal texts link, repeated ids included; a null
    id is never the smallest unless its component has no other. An empty table gives no
    rows; other columns are ignored.
    """
    indexed = stored(_indexed(_packed(docs.select("doc_id", "text"))), "shingle-index")
    sets = stored(_candidates(indexed), "shingle-sets")
    # place: where a shingle stands in the order of its set, after those no other set has.
    m = F.size("tokens").alias("m")
    postings = sets.select("set", "n", m, "matches", "central", F.posexplode("prefix").alias("i", "token"))
    postings = stored(postings.withColumn("place", F.expr("n - m + i + 1")).drop("i"), "shingle-postings")
    sets = sets.select("set", "n", "tokens")

    links = _leader_links(postings, sets, 0.0)
    found, placed = _placed(postings, links)
    # Once more with other bands, where a list still holds several components.
    links = links.unionByName(_leader_links(placed, sets, 0.5))
    found, several = _placed(postings, links)

    # Linked sets share o >= 4/9 (n_a + n_b), so both hold that many shared shingles, and
    # their prefixes of n - o + l shingles have l in common.
    sides = ("set", "n", "m", "matches", "component", "place")
    a = several.where("component <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in sides])
    b = several.select("token", "main", *[F.col(c).alias(f"{c}_b") for c in sides])
    across = a.join(b, "token").where(
        "component_a <> component_b and (component_b = main or set_a < set_b) and 9 * least(m_a, m_b) >= 4 * (n_a + n_b)"
        " and place_a <= n_a - (4 * (n_a + n_b) + 8) div 9 + least(matches_a, matches_b)"
        " and place_b <= n_b - (4 * (n_a + n_b) + 8) div 9 + least(matches_a, matches_b)"
    )
    counted = across.groupBy(F.least("set_a", "set_b").alias("u"), F.greatest("set_a", "set_b").alias("v")).agg(
        F.count("*").alias("met"), F.first(F.least("matches_a", "matches_b")).alias("matches")
    )
    more = stored(_verified(counted.where("met >= matches").select("u", "v"), sets), "links")
    if more.take(1):
        found = components(links.unionByName(more))

    rows = indexed.where("kind = 0").select("doc_id", "set", F.col("n").cast("long").alias("n_shingles"))
    rows = rows.join(found.withColumnRenamed("u", "set"), "set", "left")
    # Texts without words stay alone.
    rows = rows.withColumn("group", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set")))
    least = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "group", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies of an earlier one, with the columns they came with.

    Of each component the row with the smallest doc_id stays (of equal ids, one row), and
    all texts without words.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "text")
    rows = keyed(whole)
    found = near_copy_components(rows.select(F.col("key").alias("doc_id"), "text"))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("key"))
    return rows.join(gone, "key", "left_anti").select("whole.*")
