"""Token-id files: each document compressed by itself with a shared zstandard dictionary.

A file holds, little-endian::

    magic "TKZD" | version u16 | bytes per id u16 | SHA-256 of the dictionary, 32 bytes
    frames, one zstandard frame per document
    index: per document doc_id i64, has_id u8, frame offset u64, ids u64
    documents u64 | index offset u64 | magic "TKZD"

so one short document is read with the index and one frame. The dictionary is a file
beside the others; a reader refuses one whose hash is not the one in the header.

Files are written by the tasks to any store that Arrow reaches by URI, each under a
name of its own. What counts is the manifest that Spark writes when all tasks are
done: a file of a lost or repeated attempt is in no manifest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coldhaul.llm.common import by_id, least_hash_sample, stored
from coldhaul.llm.tokens import encoder
from coldhaul.session import scratch_path

MAGIC, VERSION = b"TKZD", 1
HEADER = struct.Struct("<4sHH32s")
FOOTER = struct.Struct("<QQ4s")
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("ids", "<u8")])
FILE_BYTES = 64 << 20
SAMPLE_BYTES = 4 * 4096


class Writer:
    """Appends documents to one file."""

    def __init__(self, out: BinaryIO, dictionary: bytes, width: int, level: int) -> None:
        self.out, self.width, self.at = out, width, HEADER.size
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.entries: list[tuple[int, int, int, int]] = []
        out.write(HEADER.pack(MAGIC, VERSION, width, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.packer.compress(ids.astype(f"<u{self.width}").tobytes())
        self.entries.append((doc_id or 0, doc_id is not None, self.at, len(ids)))
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> None:
        self.out.write(np.array(self.entries, INDEX).tobytes())
        self.out.write(FOOTER.pack(len(self.entries), self.at, MAGIC))


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, file: pa.NativeFile, dictionary: bytes) -> None:
        self.file, size = file, file.size()
        magic, version, self.width, digest = HEADER.unpack(file.read_at(HEADER.size, 0))
        n, self.end, last = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or last != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.index = np.frombuffer(file.read_at(n * INDEX.itemsize, self.end), INDEX)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        return int(self.index["doc_id"][i]) if self.index["has_id"][i] else None

    def ids(self, i: int) -> np.ndarray:
        start = int(self.index["offset"][i])
        end = int(self.index["offset"][i + 1]) if i + 1 < len(self.index) else self.end
        raw = self.unpacker.decompress(self.file.read_at(end - start, start))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _id_bytes(texts: list[str | None], path: str, end_id: int) -> list[bytes]:
    end = end_id.to_bytes(4, "little")
    return [ids + end for ids in encoder(path, spaces_matter=False)(["" if t is None else t for t in texts])]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample_docs: int, size: int) -> bytes:
    """A dictionary from ``sample_docs`` distinct texts of least hash, if there are as many.

    Their ids are cut into samples of at most 4,096 ids, and the ``sample_docs`` samples
    of least hash are taken, from any place of a text; so the driver gets a bounded
    amount. If there is too little to train on, the samples themselves are the dictionary.
    """
    chosen = least_hash_sample(docs, sample_docs)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _id_bytes(batch.column(0).to_pylist(), tokenizer, end_id)
            pieces = [x[at : at + SAMPLE_BYTES] for x in found for at in range(0, len(x), SAMPLE_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], ["ids"])

    pieces = chosen.mapInArrow(ids, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(sample_docs)
    samples = sorted(bytes(r["ids"]) for r in pieces.collect())
    samples = [np.frombuffer(s, "<u4").astype(f"<u{width}").tobytes() for s in samples]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    width: int = 2,
    sample_docs: int = 1000,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the manifest.

    The manifest has a row per file: number (order), file, documents, ids, and start,
    the ids in all files before it. doc_id must be a whole number or null; nulls come
    first, rows with one id are neighbours. A null or empty text is the end id alone.
    ``width`` is 2 for vocabularies below 65,536 ids, else 4; ids that do not fit are
    refused. An empty table writes no file but the dictionary.
    """
    greatest = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    if greatest >> 8 * width:
        raise ValueError(f"ids up to {greatest} do not fit {width} bytes")
    dictionary = train_dictionary(docs, tokenizer, end_id, width, sample_docs, dictionary_bytes)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        rows: list[tuple[int, str, int, int]] = []
        writer, name = None, ""

        def finish() -> None:
            nonlocal writer
            writer.close()
            writer.out.close()
            rows.append((task << 32 | len(rows), name, len(writer.entries), sum(e[3] for e in writer.entries)))
            writer = None

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                found = _id_bytes(batch.column(1).slice(at, 256).to_pylist(), tokenizer, end_id)
                for doc_id, raw in zip(ids[at : at + 256], found):
                    if writer is None:
                        name = f"part-{task:06d}-{len(rows):04d}-{uuid.uuid4().hex}.tkz"
                        writer = Writer(store.open_output_stream(f"{root}/{name}"), dictionary, width, level)
                    writer.add(doc_id, np.frombuffer(raw, "<u4"))
                    if writer.at >= FILE_BYTES:
                        finish()
        if writer is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["number", "file", "documents", "ids"],
            )

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    manifest = stored(by_id(ordered).mapInArrow(write, "number long, file string, documents long, ids long"), "token-manifest")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file of up to 64 MB, so this window is short.
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read every document back: doc_id, start, n_tokens and the checksum of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/dictionary") as f:
            dictionary = f.read()
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as f:
                    reader = Reader(f, dictionary)
                    counts = reader.index["ids"].astype(np.int64)
                    starts = start + np.cumsum(counts) - counts
                    for a in range(0, len(reader), 10_000):
                        part = range(a, min(a + 10_000, len(reader)))
                        span = slice(a, part.stop)
                        crcs = []
                        for i in part:
                            ids = reader.ids(i)
                            if len(ids) != counts[i]:
                                raise ValueError(f"{name}: document {i} has {len(ids)} ids, the index says {counts[i]}")
                            crcs.append(zlib.crc32(ids.tobytes()))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([reader.doc_id(i) for i in part], pa.int64()),
                                pa.array(starts[span]),
                                pa.array(counts[span]),
                                pa.array(crcs, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    files = manifest.select("file", "start").repartition("file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to new files in the scratch folder and read the files back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
