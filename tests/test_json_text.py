import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.json_text import (
    data_schema,
    infer_json_schema,
    infer_with_fallback,
    is_corrupt_only,
    rejected_rows,
    unescape_json,
    with_parsed,
)
from coldhaul.metrics import observed_parse
from coldhaul.operators.shape import expand_struct, pick_field, prefer_values
from tests.conftest import rows


def unescaped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    out = df.select("i", unescape_json(F.col("v")).alias("u")).orderBy("i").collect()
    return [r.u for r in out]


@pytest.mark.parametrize(
    "text, expected",
    [
        (r'{\"a\": 1, \"b\": \"l1\\nl2\"}', r'{"a": 1, "b": "l1\nl2"}'),
        ('{"a": 1, "b": "ok"}', '{"a": 1, "b": "ok"}'),
        (r'{"a": 2, "b": "say \"hi\""}', r'{"a": 2, "b": "say \"hi\""}'),
        (r'{\"a\": 3, \"b\": \"é\"}', '{"a": 3, "b": "é"}'),
        (r'{\n\"a\": 4}', '{\n"a": 4}'),
        (r'{\"b\": \"\x41\"}', r'{\"b\": \"\x41\"}'),
        ('x","y":"z\\"', 'x","y":"z\\"'),
        ("ends with \\", "ends with \\"),
        ("two \\\\", "two \\"),
        (r"only A", r"only A"),
        ("plain", "plain"),
        ("", None),
        (None, None),
    ],
)
def test_unescape_examples(spark, text, expected):
    assert unescaped(spark, [text]) == [expected]


def test_unescape_takes_long_texts(spark):
    document = json.dumps({"v": 'a"\\\n' * 200_000})
    assert unescaped(spark, [json.dumps(document)[1:-1]]) == [document]


documents = st.dictionaries(
    st.text(st.characters(codec="utf-8"), max_size=6),
    st.one_of(st.integers(), st.booleans(), st.none(), st.text(st.characters(codec="utf-8"), max_size=12)),
    max_size=5,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(documents, min_size=1, max_size=40))
def test_unescape_reverts_one_escaping_and_keeps_json(spark, docs):
    texts = [json.dumps(d, ensure_ascii=False) for d in docs]
    escaped = [json.dumps(t, ensure_ascii=False)[1:-1] for t in texts]
    assert unescaped(spark, escaped) == texts
    quoted = [t for t in texts if '"' in t]
    assert unescaped(spark, quoted) == quoted


SCHEMA = "a bigint, b string"
PARSES = [
    ('{"a":1,"b":"x"}', "ok", 1, "x"),
    ('{"a":1,"c":3}', "ok", 1, None),
    ('{"a":"zz","b":"y"}', "malformed", None, "y"),
    ("not json", "malformed", None, None),
    ('[{"a":1}]', "malformed", None, None),
    ("null", "malformed", None, None),
    ("", "blank", None, None),
    (" \t\n ", "blank", None, None),
    (None, "null_input", None, None),
]


def parsed_examples(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PARSES)], "i int, doc string")
    return with_parsed(df, "doc", spark.createDataFrame([], SCHEMA).schema)


def test_parse_status_and_surviving_fields(spark):
    out = parsed_examples(spark).select("i", "parse_status", "j.a", "j.b").orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [p[1:] for p in PARSES]


def test_counts_ride_on_the_pass(spark):
    df, seen = observed_parse(parsed_examples(spark))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": 9, "null_input": 1, "blank": 2, "malformed": 4, "ok": 2}


def test_rejected_rows_keep_the_whole_text(spark):
    text = "not json " * 100
    df = spark.createDataFrame([(text,)], "doc string")
    schema = T.StructType().add("a", "long")
    row = rejected_rows(with_parsed(df, "doc", schema), "doc").first()
    assert row.doc == text and row.snippet == text[:150]


def test_documents_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    parsed_examples(spark).select("i", "doc").write.parquet(path)
    schema = spark.createDataFrame([], SCHEMA).schema
    df = with_parsed(spark.read.parquet(path), "doc", schema)
    wide = expand_struct(df, "j", ["i", "parse_status"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


class TestInference:
    def infer(self, spark, texts):
        df = spark.createDataFrame([(t,) for t in texts], "doc string")
        return infer_json_schema(df, F.col("doc"))

    def test_all_bad_gives_the_corrupt_column_only(self, spark):
        assert is_corrupt_only(self.infer(spark, ["nope", "{"]))

    def test_bad_line_among_good(self, spark):
        schema = self.infer(spark, ['{"a":1}', "nope"])
        assert set(schema.fieldNames()) == {"_corrupt_record", "a"}
        assert data_schema(schema).fieldNames() == ["a"]

    def test_names_differing_by_case(self, spark):
        schema = self.infer(spark, ['{"B":1,"a":1,"A":[1]}'])
        assert schema.fieldNames() == ["A", "B", "a"]
        df = spark.createDataFrame([('{"B":1,"a":7,"A":[1]}',)], "doc string")
        wide = expand_struct(with_parsed(df, "doc", schema), "j", [], ["_corrupt_record"])
        assert wide.select("a").first()[0] == 7

    def test_conflicting_kinds_become_string(self, spark):
        schema = self.infer(spark, ['{"a":1,"b":{"c":1}}', '{"a":"x","b":"y"}'])
        assert {f.name: f.dataType for f in schema} == {"a": T.StringType(), "b": T.StringType()}

    def test_repeated_keys(self, spark):
        schema = self.infer(spark, ['{"a":1,"a":{"x":1,"x":2.5},"b":1.0}', '{"c":{"d":1,"d":2}}'])
        assert schema.simpleString() == "struct<a:string,b:double,c:struct<d:bigint>>"

    def test_line_breaks_inside_a_document(self, spark):
        assert self.infer(spark, ['{\n"a":1,\r\n"b":"x"\n}']).fieldNames() == ["a", "b"]


def test_rare_fields_are_found_without_a_sample(spark):
    df = spark.range(5_000).select(
        F.when(F.col("id") == 4_999, F.lit('{"rare":1}')).otherwise(F.lit('{"a":1}')).alias("doc")
    )
    assert "rare" in infer_json_schema(df, F.col("doc")).fieldNames()


def test_fallback_to_raw_text(spark):
    df = spark.createDataFrame([(r'{"k": 1, "s": "say \"hi\""}',)], "doc string")
    schema, decode = infer_with_fallback(df, "doc", lambda c: F.replace(c, F.lit("\\"), F.lit("")))
    assert schema.fieldNames() == ["k", "s"]
    assert with_parsed(df, "doc", schema, decode).first().parse_status == "ok"


def test_no_documents_is_an_error(spark):
    with pytest.raises(ValueError, match="doc"):
        infer_with_fallback(spark.createDataFrame([(None,)], "doc string"), "doc")


def test_preferred_field(spark):
    schema = T.StructType().add("LPMPASSNAME", "string").add("other", "string")
    names = ["LPMPassName", "LPMPASSNAME"]
    assert pick_field(schema, names) == "LPMPASSNAME"
    assert pick_field(T.StructType().add("LPMPassName", "string").add("LPMPASSNAME", "string"), names) == names[0]
    assert pick_field(schema, ["lpmpassname"]) is None
    assert prefer_values(schema, ["lpmpassname"]) is None
    df = spark.createDataFrame([(None, "b"), ("a", "c")], "LPMPassName string, LPMPASSNAME string")
    assert rows(df.select(prefer_values(df.schema, names))) == [("a",), ("b",)]
