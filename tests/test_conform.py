from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import same_type
from coldhaul.operators.conform import compare_schemas, conform, lossy_rows
from tests.conftest import rows

TYPES = [
    "bigint",
    "int",
    "double",
    "string",
    "boolean",
    "date",
    "timestamp",
    "decimal(10,2)",
    "array<string>",
    "array<bigint>",
    "struct<a:bigint>",
    "struct<a:string,l:array<int>>",
    "map<string,bigint>",
]
VALUES = {
    "bigint": "5L",
    "int": "5",
    "double": "5.5D",
    "string": "'x'",
    "boolean": "true",
    "date": "DATE '2020-01-02'",
    "timestamp": "TIMESTAMP '2020-01-02 03:04:05'",
    "decimal(10,2)": "5.25BD",
    "array<string>": "array('1', 'x')",
    "array<bigint>": "array(1L, 2L)",
    "struct<a:bigint>": "named_struct('a', 1L)",
    "struct<a:string,l:array<int>>": "named_struct('a', 'x', 'l', array(1))",
    "map<string,bigint>": "map('k', 1L)",
}


def conformed(spark, value, source, target):
    df = spark.sql(f"SELECT CAST({value} AS {source}) AS c UNION ALL SELECT CAST(NULL AS {source})")
    schema = T.StructType.fromDDL(f"c {target}")
    out, _ = conform(df.withColumn("lost", lossy_rows(df.schema, schema)), schema.add("lost", "boolean"))
    return out


@pytest.mark.parametrize("source", TYPES)
def test_every_pair_gives_the_table_type_and_reports_losses(spark, source):
    value = f"CAST({VALUES[source]} AS {source})"
    both = f"SELECT {{}} UNION ALL SELECT {', '.join(['NULL'] * len(TYPES))}"
    df = spark.sql(both.format(", ".join(f"{value} AS c{i}" for i in range(len(TYPES)))))
    schema = T.StructType.fromDDL(", ".join(f"c{i} {t}" for i, t in enumerate(TYPES)))
    flags = [
        lossy_rows(T.StructType([df.schema[f.name]]), T.StructType([f])).alias(f"lost_{f.name}") for f in schema
    ]
    marks = [T.StructField(f"lost_{f.name}", T.BooleanType()) for f in schema]
    out, _ = conform(df.select("*", *flags), T.StructType(schema.fields + marks))
    assert same_type(T.StructType(out.schema.fields[: len(TYPES)]), schema)
    got = out.collect()
    for i, target in enumerate(TYPES):
        # Of two rows, the value and the NULL, only a lost value may add a NULL.
        nulls, lost = sum(r[f"c{i}"] is None for r in got), sum(r[f"lost_c{i}"] for r in got)
        assert nulls - 1 <= lost <= 1, target
        assert nulls >= 1 and (lost == 0 or source != target), target


@pytest.mark.parametrize(
    "source, value, target, expected, lost",
    [
        ("string", "'12'", "bigint", 12, False),
        ("string", "'x'", "bigint", None, True),
        ("double", "1.5D", "bigint", 1, True),
        ("double", "2.0D", "bigint", 2, False),
        ("bigint", "3000000000L", "int", None, True),
        ("string", "'x'", "array<string>", ["x"], False),
        ("bigint", "1L", "array<string>", ["1"], False),
        ("string", "'x'", "array<bigint>", [None], True),
        ("array<bigint>", "array(1L, 2L)", "string", "[1,2]", False),
        ("array<string>", "array('1', 'x')", "array<bigint>", [1, None], True),
        ("array<bigint>", "array(1L)", "bigint", None, True),
        ("struct<a:bigint>", "named_struct('a', 1L)", "string", '{"a":1}', False),
        ("map<string,bigint>", "map('k', 1L)", "string", '{"k":1}', False),
        ("struct<a:bigint,l:array<int>>", "named_struct('a', 1L, 'l', array(1))", "string", '{"a":1,"l":[1]}', False),
        ("struct<a:bigint>", "named_struct('a', 1L)", "struct<b:int,a:string>", (None, "1"), False),
        ("struct<a:bigint,z:int>", "named_struct('a', 1L, 'z', 2)", "struct<a:bigint>", (1,), True),
        ("string", "'x'", "struct<a:bigint>", None, True),
        ("boolean", "true", "bigint", 1, False),
        ("bigint", "5L", "boolean", True, True),
        ("string", "'007'", "bigint", 7, True),
        ("string", "'1.239'", "decimal(10,2)", Decimal("1.24"), True),
        ("string", "'2020-01-01 10:11:12'", "date", date(2020, 1, 1), True),
        ("timestamp_ntz", "TIMESTAMP_NTZ '2020-01-01 10:11:12'", "date", date(2020, 1, 1), True),
        ("timestamp_ntz", "TIMESTAMP_NTZ '2020-01-01 00:00:00'", "date", date(2020, 1, 1), False),
        ("string", "'12345678901234567890123'", "double", 1.2345678901234568e22, True),
        ("binary", "X'6869'", "string", "hi", False),
        ("bigint", "1L", "date", None, True),
    ],
)
def test_values(spark, source, value, target, expected, lost):
    first = conformed(spark, value, source, target).first()
    got = tuple(first.c) if isinstance(first.c, tuple) else first.c
    assert (got, first.lost) == (expected, lost)


def test_bytes_that_are_no_text_are_flagged(spark):
    df = spark.sql("SELECT X'FFFE41' AS c")
    assert df.select(lossy_rows(df.schema, T.StructType.fromDDL("c string"))).first()[0]


def test_missing_extra_and_order(spark):
    df = spark.createDataFrame([(1, "x", None)], "b int, extra string, unused string")
    schema = T.StructType.fromDDL("a double, b bigint")
    out, report = conform(df, schema)
    assert out.schema == schema and rows(out) == [(None, 1)]
    assert (report.missing, report.extra) == (["a"], ["extra", "unused"])
    assert report.mismatched == [("b", "int", "bigint")] and not report.identical
    assert [r[0] for r in df.select(lossy_rows(df.schema, schema)).collect()] == [True]
    assert [r[0] for r in df.select(lossy_rows(df.schema, schema, ("extra",))).collect()] == [False]


def test_names_are_case_sensitive():
    incoming = T.StructType().add("A", "long")
    report = compare_schemas(incoming, T.StructType().add("a", "long"))
    assert (report.missing, report.extra) == (["a"], ["A"])


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1,)], "`a.b` int")
    out, _ = conform(df, T.StructType().add("a.b", "string"))
    assert rows(out) == [("1",)]
