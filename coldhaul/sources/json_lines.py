"""JSON-lines snapshots, plain or compressed."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from coldhaul.functions.json_text import schema_of_json_files
from coldhaul.session import scratch_path
from coldhaul.sinks import folders
from coldhaul.sources import xz_blocks

LINES_PER_CHUNK = 1_000
_READ_BYTES = 1 << 20


def read_json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All files in one read with one inferred schema.

    Handles what the JSON reader decodes itself: plain, gzip, bzip2, zstd.
    """
    return spark.read.schema(schema_of_json_files(spark, paths)).json(paths)


def _lines(content: bytes) -> Iterator[str]:
    """Lines of an xz file, decoded piece by piece; streams may follow each other."""
    rest, pending = content, b""
    while rest:
        stream = lzma.LZMADecompressor(format=lzma.FORMAT_XZ)
        data = rest
        while not stream.eof:
            piece = stream.decompress(data, max_length=_READ_BYTES)
            if not piece and not stream.eof and stream.needs_input:
                raise lzma.LZMAError("xz content ends before its end marker")
            data = b""
            *whole, pending = (pending + piece).split(b"\n")
            for line in whole:
                yield line.decode("utf-8").rstrip("\r")
        rest = stream.unused_data.lstrip(b"\x00")
    if pending:
        yield pending.decode("utf-8").rstrip("\r")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            chunk: list[str] = []
            for line in _lines(content.as_py()):
                if line.strip():
                    chunk.append(line)
                if len(chunk) == LINES_PER_CHUNK:
                    yield pa.record_batch([pa.array(chunk, pa.string())], names=["value"])
                    chunk = []
            yield pa.record_batch([pa.array(chunk, pa.string())], names=["value"])


def decode_xz_lines(files: DataFrame) -> DataFrame:
    """Non-empty lines of xz files given as rows with a ``content`` column.

    One file is decoded by one task; memory holds the compressed file and one chunk
    of lines.
    """
    return files.select("content").mapInArrow(_decode, "value string")


def land_xz_lines(spark: SparkSession, paths: str | list[str], path: str | None = None) -> list[str]:
    """Decode xz files once into splittable text files; returns their folders.

    Each block of a file is decoded by its own task. Files in stores that only Spark can
    read are decoded whole, one task each, and must be below 2 GB.
    """
    path = path or scratch_path(spark, "lines")
    files = [f for p in ([paths] if isinstance(paths, str) else paths) for f in folders.matching(spark, p)]
    ranged = [f for f in files if xz_blocks.reachable(f)]
    landed = xz_blocks.land_blocks(spark, ranged, f"{path}/blocks") if ranged else []
    whole = [f for f in files if f not in set(ranged)]
    if whole:
        lines = decode_xz_lines(spark.read.format("binaryFile").load(whole))
        lines.hint("rebalance").write.text(f"{path}/whole")
        landed.append(f"{path}/whole")
    return landed


def read_xz_json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """xz-compressed JSON lines as one frame with one inferred schema."""
    return read_json_lines(spark, land_xz_lines(spark, paths))
