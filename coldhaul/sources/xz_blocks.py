"""xz files as independently decodable blocks, several tasks to a file.

The end of each stream lists its blocks; these lists are read by the driver, and each
block is decoded by one task, in pieces. The whole lines of a block are written as they
are; what stands before its first and after its last line break is put together with
the neighbouring blocks afterwards. A file that was written as one block, as ``xz``
does without ``--block-size`` or threads, is decoded by one task.
"""

from __future__ import annotations

import lzma
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the xz format: sizes of a stream's header and footer, their magic bytes.
HEADER, FOOTER = 12, 12
HEADER_MAGIC, FOOTER_MAGIC = b"\xfd7zXZ\x00", b"YZ"
_READ_BYTES = 1 << 20


class Block(NamedTuple):
    """A block's place in its file, its sizes there (without padding) and decoded, and its stream's header."""

    start: int
    size: int
    decoded: int
    header: bytes


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of 7 bits a byte, least first, and the place after it."""
    value, shift = 0, 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def blocks_of(file: BinaryIO, size: int) -> list[Block]:
    """The blocks of all streams of a file in order; only headers, footers and indexes are read."""

    def read(start: int, length: int) -> bytes:
        if start < 0:
            raise lzma.LZMAError("xz content ends before its end marker")
        file.seek(start)
        return file.read(length)

    found: list[list[Block]] = []
    end = size
    while end > 0:
        while end >= 4 and read(end - 4, 4) == b"\x00" * 4:  # padding between streams
            end -= 4
        footer = read(end - FOOTER, FOOTER)
        if footer[-2:] != FOOTER_MAGIC:
            raise lzma.LZMAError("xz content ends before its end marker")
        index_size = (int.from_bytes(footer[4:8], "little") + 1) * 4
        index_start = end - FOOTER - index_size
        index = read(index_start, index_size)
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            packed, at = _number(index, at)
            decoded, at = _number(index, at)
            sizes.append((packed, decoded))
        start = index_start - sum(-(-packed // 4) * 4 for packed, _ in sizes)
        end = start - HEADER
        header = read(end, HEADER)
        if header[:6] != HEADER_MAGIC:
            raise lzma.LZMAError("an xz stream does not begin where its index says")
        blocks = []
        for packed, decoded in sizes:
            blocks.append(Block(start, packed, decoded, header))
            start += -(-packed // 4) * 4
        found.append(blocks)
    return [b for blocks in reversed(found) for b in blocks]


def decoded(file: BinaryIO, block: Block) -> Iterator[bytes]:
    """The content of a block in pieces; its checksum is verified with the last one."""
    decoder = lzma.LZMADecompressor(format=lzma.FORMAT_XZ)
    decoder.decompress(block.header)
    left, made = block.size, 0
    file.seek(block.start)
    while left or not decoder.needs_input:
        data = b""
        if decoder.needs_input:
            data = file.read(min(left, _READ_BYTES))
            if not data:
                raise lzma.LZMAError("xz content ends before its end marker")
            left -= len(data)
        piece = decoder.decompress(data, max_length=4 * _READ_BYTES)
        made += len(piece)
        if piece:
            yield piece
    if made != block.decoded:
        raise lzma.LZMAError(f"an xz block has {made} bytes, its index says {block.decoded}")


def lines_and_border(pieces: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """``line`` rows with whole lines, then one ``border`` row: what neighbouring blocks must be asked for.

    The border is the text before the first line break, a line break, and the text after
    the last one; or the whole block where it has none.
    """
    head: bytes | None = None
    pending: list[bytes] = []
    for piece in pieces:
        if head is None:
            first = piece.find(b"\n")
            if first < 0:
                pending.append(piece)
                continue
            head = b"".join([*pending, piece[:first]])
            pending, piece = [], piece[first + 1 :]
        last = piece.rfind(b"\n")
        if last < 0:
            pending.append(piece)
        else:
            yield "line", b"".join([*pending, piece[:last]])
            pending = [piece[last + 1 :]]
    tail = b"".join(pending)
    yield "border", tail if head is None else head + b"\n" + tail


def _open(path: str) -> tuple[BinaryIO, int]:
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner), store.get_file_info(inner).size


def reachable(path: str) -> bool:
    """Whether tasks can read ranges of the file; stores that only Spark knows are read whole."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def block_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, number, start, size, decoded, header) of every block of the files."""
    rows = []
    for i, path in enumerate(paths):
        file, size = _open(path)
        try:
            with file:
                rows += [(i, n, path, *block) for n, block in enumerate(blocks_of(file, size))]
        except (lzma.LZMAError, IndexError) as error:
            raise lzma.LZMAError(f"LZMAError in {path}: {error}") from error
    schema = "file int, number int, path string, start long, size long, decoded long, header binary"
    frame = spark.createDataFrame(rows, schema)
    return frame.repartition(max(1, min(len(rows), 10_000)), "file", "number")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file, _ = _open(row["path"])
            with file:
                block = Block(row["start"], row["size"], row["decoded"], row["header"])
                for kind, text in lines_and_border(decoded(file, block)):
                    columns = [[row["file"]], [row["number"]], [kind], [text]]
                    types = [pa.int32(), pa.int32(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types)], ["file", "number", "kind", "content"]
                    )


def land_blocks(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Decode the files into text files below ``folder``; returns the two folders that hold the lines.

    Whole lines are written once, as they come. Borders, a short text per block, are
    written beside them, joined file by file, and cut into lines again.
    """
    pieces = block_rows(spark, paths).mapInArrow(_pieces, "file int, number int, kind string, content binary")
    value = F.when(F.col("kind") == "line", F.col("content").cast("string")).otherwise(
        F.concat_ws(" ", "file", "number", F.hex("content"))
    )
    pieces.select("kind", value.alias("value")).write.partitionBy("kind").text(folder)
    empty = spark.createDataFrame([], "value string")
    for kind in ("line", "border"):  # a folder for each, also where there is none
        empty.write.mode("append").text(f"{folder}/kind={kind}")
    part = F.split("value", " ")
    number = F.struct(part[1].cast("int").alias("number"), F.unhex(part[2]).alias("content"))
    borders = spark.read.option("lineSep", "\n").text(f"{folder}/kind=border").groupBy(part[0].alias("file")).agg(
        F.sort_array(F.collect_list(number)).alias("blocks")
    )
    joined = F.aggregate("blocks", F.lit(b""), lambda text, block: F.concat(text, block["content"]))
    borders.select(joined.cast("string")).write.text(f"{folder}/kind=joined")
    return [f"{folder}/kind=line", f"{folder}/kind=joined"]
