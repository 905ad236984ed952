"""Consistent-hash ring with virtual nodes and bounded loads.

A document is hashed to a point of the ring and belongs to the arc that ends at the
next virtual node clockwise. Its shard is the owner of that node unless the shard is
full; then it goes on clockwise. Every document is offered to its own node first, and
in each further round those left over move one node on. A round only needs the number
of documents on each arc, so the moves are worked out from one count per virtual node
and told to the documents as ranges of their rank on their arc.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldhaul.llm.common import numbered, ranked

SPACE = 1 << 60


@dataclass(frozen=True)
class Ring:
    """Arcs in clockwise order: ``ends`` are node positions, ``owners`` their shards."""

    ends: tuple[int, ...]
    owners: tuple[int, ...]


def ring(shards: int, virtual_nodes: int) -> Ring:
    """Places that depend on the shard and node numbers alone, so a new shard moves no node."""
    nodes = sorted(
        (int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:15], 16), s)
        for s in range(shards)
        for v in range(virtual_nodes)
    )
    return Ring(tuple(p for p, _ in nodes), tuple(s for _, s in nodes))


def arc_of(at: str, circle: Ring) -> str:
    """SQL for the first node at or after a point, the first node beyond the last.

    The circle is cut into cells, about four per node; a cell knows its nodes and how many come
    before it, so a point is compared with the few nodes of its own cell.
    """
    bits = max(1, (4 * len(circle.ends)).bit_length())
    width = SPACE >> bits
    cells: list[list[int]] = [[] for _ in range(1 << bits)]
    for end in circle.ends:
        cells[end // width].append(end)
    before, index = 0, []
    for cell in cells:
        index.append({"n": before, "e": cell})
        before += len(cell)
    cell = f"element_at(from_json('{json.dumps(index, separators=(',', ':'))}', 'array<struct<n:int,e:array<bigint>>>'), cast({at} div {width} as int) + 1)"
    return f"({cell}.n + size(filter({cell}.e, x -> x < {at}))) % {len(circle.ends)}"


@dataclass(frozen=True)
class Segment:
    """Documents of ``arc`` with a rank in [first, last) go to ``shard``, from ``slot`` on."""

    arc: int
    first: int
    last: int
    shard: int
    slot: int


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Places per shard; without slack they sum to ``total`` and differ by one at most."""
    if slack > 0:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def assign(loads: list[int], owners: tuple[int, ...], caps: list[int]) -> list[Segment]:
    """Segments that place all documents, from the count of each arc.

    At most as many rounds as there are nodes are needed, since a document that has
    passed all of them has seen every shard full, which the total capacity forbids.
    """
    nodes = len(owners)
    used = [0] * len(caps)
    segments: list[Segment] = []
    waiting = [[(a, 0, n)] if n else [] for a, n in enumerate(loads)]
    left = sum(loads)
    for step in range(nodes):
        if not left:
            break
        for node in range(nodes):
            home = (node - step) % nodes
            shard = owners[node]
            kept = []
            for arc, first, last in waiting[home]:
                take = min(last - first, caps[shard] - used[shard])
                if take:
                    segments.append(Segment(arc, first, first + take, shard, used[shard]))
                    used[shard] += take
                    left -= take
                if first + take < last:
                    kept.append((arc, first + take, last))
            waiting[home] = kept
    if left:
        raise ValueError("the shards have too few places")
    return segments


def shard_documents(docs: DataFrame, shards: int = 24, virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Each document with its shard and its slot there.

    With ``slack`` 0 the counts of the shards differ by one at most; a larger slack
    allows that share more and lets fewer documents leave their own node. A null id
    or text is hashed as empty, and rows that are equal share an arc but get slots of
    their own. An empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    circle = ring(shards, virtual_nodes)
    text = docs["text"].cast("string")
    # 15 hexadecimal digits: 60 bits, as the node positions.
    at = F.conv(F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        at.alias("at"),
    )
    arc = F.expr(arc_of("at", circle))
    rows = numbered(rows.withColumn("arc", arc), "ring")
    counted = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    loads = [counted.get(a, 0) for a in range(len(circle.ends))]
    placed = assign(loads, circle.owners, capacities(sum(loads), shards, slack))
    plan = spark.createDataFrame(
        [(s.arc, s.first, s.last, s.shard, s.slot) for s in placed],
        "home int, first long, last long, shard int, from_slot long",
    )
    onto = ranked(rows, ["arc"])
    inside = (onto["arc"] == plan["home"]) & (onto["rank"] >= plan["first"]) & (onto["rank"] < plan["last"])
    # The plan has at most one row per node and round that placed something there.
    return onto.join(F.broadcast(plan), inside).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("from_slot") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
