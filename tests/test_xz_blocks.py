import io
import json
import lzma
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coldhaul.session import scratch_path
from coldhaul.sources import json_lines, xz_blocks


def _packed_number(value):
    out = b""
    while value >= 0x80:
        out, value = out + bytes([value & 0x7F | 0x80]), value >> 7
    return out + bytes([value])


def many_blocks(parts):
    """One xz stream with a block for each of the parts, put together from streams of one block."""
    body, records = b"", []
    for part in parts:
        stream = lzma.compress(part, check=lzma.CHECK_CRC64)
        (block,) = xz_blocks.blocks_of(io.BytesIO(stream), len(stream))
        body += stream[12 : 12 + -(-block.size // 4) * 4]
        records.append((block.size, len(part)))
    index = b"\x00" + _packed_number(len(records)) + b"".join(_packed_number(n) for r in records for n in r)
    index += b"\x00" * (-len(index) % 4)
    index += zlib.crc32(index).to_bytes(4, "little")
    header = lzma.compress(b"x", check=lzma.CHECK_CRC64)[:12]
    footer = (len(index) // 4 - 1).to_bytes(4, "little") + header[6:8]
    return header + body + index + zlib.crc32(footer).to_bytes(4, "little") + footer + b"YZ"


def cut(text, places):
    edges = [0, *sorted(min(p, len(text)) for p in places), len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:]) if a < b]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=300), max_size=5), max_size=3), st.integers(0, 2))
def test_blocks_of_any_file(streams, padding):
    data = b"".join((many_blocks(parts) if parts else lzma.compress(b"")) + b"\x00" * 4 * padding for parts in streams)
    file = io.BytesIO(data)
    blocks = xz_blocks.blocks_of(file, len(data))
    assert [b"".join(xz_blocks.decoded(file, b)) for b in blocks] == [p for parts in streams for p in parts]


@given(st.lists(st.binary(max_size=12).map(lambda b: b.replace(b"\r", b"\n")), max_size=8))
def test_lines_and_borders_hold_everything(pieces):
    """Blocks one after the other give the lines of the whole."""
    rows = [list(xz_blocks.lines_and_border(iter([p]))) for p in pieces]
    assert all([k for k, _ in r] == ["line"] * (len(r) - 1) + ["border"] for r in rows)
    whole = [line for r in rows for k, t in r if k == "line" for line in t.split(b"\n")]
    joined = b"".join(r[-1][1] for r in rows).split(b"\n")
    assert sorted(x for x in whole + joined if x) == sorted(x for x in b"".join(pieces).split(b"\n") if x)


def documents(seed, n):
    rng = random.Random(seed)
    return [json.dumps({"id": i, "t": "é中\U0001f600"[: rng.randint(0, 3)] * rng.randint(0, 30)}, ensure_ascii=False) for i in range(n)]


def test_one_file_is_decoded_by_many_tasks(spark, tmp_path):
    """Blocks cut lines, and characters, anywhere; one line spans several blocks."""
    lines = documents(1, 3000)
    lines.insert(1500, json.dumps({"id": 1500_000, "t": "long " * 10_000}))
    text = "\n".join(lines).encode()
    rng = random.Random(2)
    parts = cut(text, [rng.randrange(len(text)) for _ in range(40)])
    data = many_blocks(parts)
    assert lzma.decompress(data) == text
    path = tmp_path / "many.xz"
    path.write_bytes(data + lzma.compress("\r\n".join(["", *documents(3, 50)]).encode()))
    frame = xz_blocks.block_rows(spark, [str(path)])
    assert frame.count() == len(parts) + 1 and frame.rdd.getNumPartitions() > 10
    df = json_lines.read_xz_json_lines(spark, str(path))
    want = [json.loads(x) for x in lines + documents(3, 50)]
    assert sorted((r["id"], r["t"]) for r in df.collect()) == sorted((w["id"], w["t"]) for w in want)


def test_files_keep_apart(spark, tmp_path):
    """The last line of a file, without a line break, does not run into the next file."""
    for i in range(3):
        text = "\n".join(documents(i, 30)).encode()
        (tmp_path / f"{i}.xz").write_bytes(many_blocks(cut(text, [100, 101, 777])))
    df = json_lines.read_xz_json_lines(spark, [str(tmp_path / "*.xz")])
    assert df.count() == 90 and df.columns == ["id", "t"]


@pytest.mark.parametrize("damage", ["cut", "index", "content"])
def test_damaged_files_are_errors(spark, tmp_path, damage):
    data = many_blocks([b'{"a":1}\n' * 500, b'{"a":2}\n' * 500])
    if damage == "cut":
        data = data[: len(data) // 2]
    elif damage == "index":
        data = data[:12] + data[20:]
    else:
        data = data[:60] + bytes([data[60] ^ 0x55]) + data[61:]
    (tmp_path / "bad.xz").write_bytes(data)
    with pytest.raises(Exception, match="(?i)xz|corrupt|lzma"):
        json_lines.read_xz_json_lines(spark, str(tmp_path / "bad.xz")).count()


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xz").write_bytes(many_blocks([b'{"a":1}\n{"a"', b":2}\n"]))
    monkeypatch.setattr(xz_blocks, "reachable", lambda path: False)
    folders = json_lines.land_xz_lines(spark, str(tmp_path / "a.xz"), scratch_path(spark, "xz"))
    assert len(folders) == 1 and json_lines.read_json_lines(spark, folders).count() == 2
