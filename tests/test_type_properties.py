"""Schema handling for arbitrary nested types; nothing is executed."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from coldhaul.functions.types import common_schema, columns_ddl, merge_repeated, same_type
from coldhaul.operators.conform import compare_schemas, conform, lossy_rows
from coldhaul.operators.shape import flatten_structs, union_all

ATOMS = [
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.FloatType(),
    T.BooleanType(),
    T.DateType(),
    T.TimestampType(),
    T.TimestampNTZType(),
    T.BinaryType(),
    T.DecimalType(12, 3),
]
NAMES = st.sampled_from(["a", "A", "b.c", "d e", "f`g", "h"])


def structs(kinds):
    fields = st.dictionaries(NAMES, kinds, min_size=1, max_size=3)
    return fields.map(lambda d: T.StructType([T.StructField(n, t) for n, t in d.items()]))


kinds = st.recursive(
    st.sampled_from(ATOMS),
    lambda inner: st.one_of(
        inner.map(T.ArrayType), structs(inner), inner.map(lambda t: T.MapType(T.StringType(), t))
    ),
    max_leaves=6,
)
relaxed = settings(
    max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def leaves(t):
    return sum(leaves(f.dataType) for f in t.fields) if isinstance(t, T.StructType) else 1


@relaxed
@given(structs(kinds), structs(kinds))
def test_conform_always_gives_the_table_schema(spark, incoming, table):
    df = spark.createDataFrame([], incoming)
    out, report = conform(df, table)
    assert same_type(out.schema, table)
    assert report == compare_schemas(incoming, table)
    assert df.select(lossy_rows(incoming, table)).dtypes[0][1] == "boolean"


@relaxed
@given(st.lists(structs(kinds), min_size=1, max_size=4))
def test_union_has_the_common_schema(spark, schemas):
    out = union_all([spark.createDataFrame([], s) for s in schemas])
    assert same_type(out.schema, common_schema(schemas))


@relaxed
@given(structs(kinds))
def test_common_schema_with_itself_is_itself(schema):
    assert same_type(common_schema([schema, schema]), schema)
    assert same_type(merge_repeated(schema), schema)


@relaxed
@given(structs(kinds))
def test_flatten_keeps_every_leaf(spark, schema):
    flat = flatten_structs(spark.createDataFrame([], schema))
    assert len(flat.columns) == leaves(schema)
    assert not any(isinstance(f.dataType, T.StructType) for f in flat.schema)


@relaxed
@given(structs(kinds))
def test_ddl_states_the_schema(spark, schema):
    assert same_type(T.StructType.fromDDL(columns_ddl(schema.fields)), schema)
