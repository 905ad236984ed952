import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import common_type
from coldhaul.operators.shape import (
    cast_columns,
    expand_struct,
    fill_empty_strings,
    flatten_structs,
    old_columns_first,
    union_all,
)
from tests.conftest import rows

CREW = [
    ("Ada", "", "7", 12),
    ("", "north", "", -4),
    (None, "south", "9", None),
]


def test_literal_rows_keep_empty_strings(spark, table):
    from coldhaul.sinks.tables import append_or_create

    schema = T.StructType.fromDDL("name string, post string, code string, score int")
    name, location = table("crew")
    append_or_create(spark.createDataFrame(CREW, schema), name, location=location)
    assert spark.read.table(name).schema == schema
    assert rows(spark.read.table(name)) == sorted(CREW, key=repr)


def test_fill_touches_strings_only(spark):
    df = spark.createDataFrame([(None, None, None)], "s string, n bigint, t timestamp")
    assert rows(fill_empty_strings(df)) == [("", None, None)]


def test_flatten_depth_order_and_nulls(spark):
    df = spark.sql(
        """SELECT 1 AS id, named_struct('x', 1, 'y', named_struct('z', 'q')) AS a, array(named_struct('k', 1)) AS l
        UNION ALL SELECT 2, NULL, NULL"""
    )
    flat = flatten_structs(df)
    assert flat.columns == ["id", "a__x", "a__y__z", "l"]
    assert rows(flat.drop("l")) == [(1, 1, "q"), (2, None, None)]


def test_flatten_names_with_dots_and_ticks(spark):
    df = spark.createDataFrame([((1, (2,)),)], "`a.b` struct<`c.d`:int, `e``f`:struct<`g h`:int>>")
    assert flatten_structs(df).columns == ["a.b__c.d", "a.b__e`f__g h"]
    assert rows(flatten_structs(df)) == [(1, 2)]


def test_flatten_refuses_clashes(spark):
    df = spark.createDataFrame([((1,), 2)], "a struct<b:int>, a__b int")
    with pytest.raises(ValueError, match="a__b"):
        flatten_structs(df)


def test_cast_ignores_absent_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = cast_columns(df, {"a": "string", "c": "string"})
    assert out.dtypes == [("a", "string"), ("b", "int")]


def test_expand_renames_a_field_named_like_a_kept_column(spark):
    df = spark.createDataFrame([(1, ("x", 2))], "id int, j struct<id:string, n:int>")
    assert expand_struct(df, "j", ["id"]).columns == ["id", "j__id", "n"]


def test_old_columns_come_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "new int, b int, a int")
    assert old_columns_first(df, ["a", "b", "gone"]).columns == ["a", "b", "new"]


def test_union_aligns_drifting_types_and_nested_fields(spark):
    a = spark.createDataFrame([(1, (1,))], "k bigint, s struct<x:int>")
    b = spark.createDataFrame([("z", (2.5, "q"), [1])], "k string, s struct<x:double,y:string>, l array<int>")
    c = spark.createDataFrame([(True,)], "k boolean")
    out = union_all([a, b, c])
    assert [f.name for f in out.schema] == ["k", "s", "l"]
    assert rows(out) == [("1", (1.0, None), None), ("true", None, None), ("z", (2.5, "q"), [1])]


def test_union_of_many_keeps_duplicates(spark):
    frames = [spark.range(3) for _ in range(60)]
    assert union_all(frames).count() == 180


def test_union_of_nothing_is_an_error():
    with pytest.raises(ValueError):
        union_all([])


@pytest.mark.parametrize(
    "a, b, common",
    [
        ("int", "bigint", "bigint"),
        ("bigint", "double", "double"),
        ("float", "int", "double"),
        ("decimal(10,2)", "int", "decimal(12,2)"),
        ("decimal(20,0)", "bigint", "decimal(20,0)"),
        ("decimal(38,10)", "decimal(38,0)", "double"),
        ("bigint", "string", "string"),
        ("boolean", "bigint", "string"),
        ("void", "date", "date"),
        ("struct<a:int>", "string", "string"),
        ("array<int>", "array<string>", "array<string>"),
        ("array<int>", "int", "string"),
        ("struct<a:int>", "struct<b:int,a:bigint>", "struct<a:bigint,b:int>"),
    ],
)
def test_common_type(spark, a, b, common):
    left, right = (T.StructType.fromDDL(f"c {t}").fields[0].dataType for t in (a, b))
    assert common_type(left, right).simpleString() == common
