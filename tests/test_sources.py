import gzip
import json
import lzma

import pytest

from coldhaul.sinks.source_deletes import delete_staged_keys
from coldhaul.sources import jdbc
from coldhaul.sources.json_lines import LINES_PER_CHUNK, read_json_lines, read_xz_json_lines
from tests.conftest import rows


def lines(n, start=0):
    return [json.dumps({"id": i, "v": {"name": f"é {i}"}}, ensure_ascii=False) for i in range(start, start + n)]


def test_xz_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xz").write_bytes(lzma.compress("\n".join(lines(2 * LINES_PER_CHUNK + 5)).encode()))
    two_streams = lzma.compress("\r\n".join(lines(3, 9_000)).encode() + b"\r\n\r\n")
    two_streams += lzma.compress("\n".join(lines(4, 9_500)).encode() + b"\n") + b"\0" * 4
    (folder / "b.xz").write_bytes(two_streams)
    (folder / "empty.xz").write_bytes(lzma.compress(b""))
    df = read_xz_json_lines(spark, str(folder))
    assert df.columns == ["id", "v"]
    assert df.count() == df.select("id").distinct().count() == 2 * LINES_PER_CHUNK + 12
    assert df.where("id = 9501").first().v.name == "é 9501"


def test_a_cut_xz_file_is_an_error(spark, tmp_path):
    path = tmp_path / "cut.xz"
    path.write_bytes(lzma.compress("\n".join(lines(5_000)).encode())[:-200])
    with pytest.raises(Exception, match="LZMAError"):
        read_xz_json_lines(spark, str(path)).count()


def test_plain_and_gzip_in_one_read(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(lines(3)))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b'{"id":"x","more":1}\n'))
    df = read_json_lines(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json.gz")])
    assert df.columns == ["id", "more", "v"]
    assert rows(df.select("id")) == [("0",), ("1",), ("2",), ("x",)]


class Reader:
    """Records what a JDBC read asks for."""

    def __init__(self):
        self.asked = {}

    @property
    def read(self):
        return self

    def format(self, name):
        self.asked["format"] = name
        return self

    def options(self, **options):
        self.asked.update(options)
        return self

    def load(self):
        return self


def test_jdbc_options():
    reader = Reader()
    jdbc.read_jdbc(reader, "jdbc:x", jdbc.as_dbtable("SELECT 1", "one"), {"user": "u"})
    assert reader.asked == {
        "format": "jdbc",
        "url": "jdbc:x",
        "dbtable": "(SELECT 1) AS one",
        "fetchsize": "1000",
        "user": "u",
    }
    jdbc.read_jdbc(reader, "jdbc:x", "t", {}, "k", (5, 90), 4)
    split = {n: reader.asked[n] for n in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    assert list(split.values()) == ["k", "5", "91", "4"]


@pytest.mark.parametrize("cuts", [[], [5], [3, 7, 7]])
@pytest.mark.parametrize("slices", [None, ("s", 3)])
def test_predicates_take_each_row_once(spark, cuts, slices):
    df = spark.range(20).selectExpr("nullif(id, 19) AS k", "nullif(id - 10, 4) AS s")
    parts = [df.where(p) for p in jdbc.key_range_predicates("k", cuts, slices)]
    got = sorted(r.k for part in parts for r in part.collect())
    assert got == list(range(19))


class Connection:
    def __init__(self, fail_on=None):
        self.fail_on, self.log, self.rowcount = fail_on, [], 3

    def cursor(self):
        return self

    def execute(self, statement):
        self.log.append(statement)
        if self.fail_on and self.fail_on in statement:
            raise RuntimeError("refused")

    def commit(self):
        self.log.append("commit")

    def rollback(self):
        self.log.append("rollback")

    def close(self):
        pass


def test_deletes_share_one_transaction():
    connection = Connection()
    removed = delete_staged_keys(connection, {"a": "id", "b": "job"}, "stage", "k")
    assert removed == {"a": 3, "b": 3}
    assert connection.log == [
        "DELETE FROM a WHERE id IN (SELECT k FROM stage)",
        "DELETE FROM b WHERE job IN (SELECT k FROM stage)",
        "commit",
    ]


def test_a_failed_delete_rolls_back():
    connection = Connection(fail_on="FROM b")
    with pytest.raises(RuntimeError):
        delete_staged_keys(connection, {"a": "id", "b": "job"}, "stage", "k")
    assert connection.log[-1] == "rollback" and "commit" not in connection.log
