"""JSON text columns: unescaping, schema inference, parsing, parse outcome."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import merge_repeated

CORRUPT = "_corrupt_record"

# A document holding any of these two-character sequences may
# have been stored with its escapes escaped once more.
ESCAPE_MARKS = ("\\n", '\\"', "\\t", "\\\\")


def unescape_json(text: Column) -> Column:
    """Undo one level of escaping; the empty string becomes NULL.

    Decoding follows JSON rules and applies only when no bare quote is left
    once every backslash pair is taken out. Valid JSON that merely contains
    ``\\"`` inside a string therefore passes through, as does text whose
    escapes are not JSON escapes.
    """
    marked = reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in ESCAPE_MARKS))
    bare_quote = F.contains(F.regexp_replace(text, r"(?s)\\.", ""), F.lit('"'))
    decoded = F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v")
    return (
        F.when(text == "", F.lit(None))
        .when(marked & ~bare_quote, F.coalesce(decoded, text))
        .otherwise(text)
    )


def data_schema(schema: T.StructType) -> T.StructType:
    """The schema without the column Spark adds for malformed documents."""
    return T.StructType([f for f in schema.fields if f.name != CORRUPT])


def is_corrupt_only(schema: T.StructType) -> bool:
    return schema.fieldNames() == [CORRUPT]


def schema_of_json_files(spark: SparkSession, paths: str | list[str], **options: str) -> T.StructType:
    """Inferred schema of JSON-lines files.

    The reader refuses files in which one object repeats a key. They are then
    inferred from their lines, and the repeated fields merged, as parsing takes
    the last of them.
    """
    try:
        return spark.read.options(**options).json(paths).schema
    except AnalysisException as error:
        if error.getCondition() != "COLUMN_ALREADY_EXISTS":
            raise
    return infer_json_schema(spark.read.options(**options).text(paths), F.col("value"))


def infer_json_schema(docs: DataFrame, text: Column) -> T.StructType:
    """Schema of a JSON text column; every document counts.

    The JSON reader takes the texts as a Dataset of strings inside the JVM, so no
    document is copied or passes through Python. Needs a classic session.
    """
    spark = docs.sparkSession
    texts = docs.select(text.cast("string").alias("value")).where("value IS NOT NULL")
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    found = spark._jsparkSession.read().json(strings).schema().json()
    return merge_repeated(T.StructType.fromJson(json.loads(found)))


def infer_with_fallback(
    docs: DataFrame,
    column: str,
    decode: Callable[[Column], Column] = unescape_json,
) -> tuple[T.StructType, Callable[[Column], Column]]:
    """Schema and the decoder to use with it.

    When nothing but malformed documents is seen after decoding, the raw text
    is inferred and later parsed as it is.
    """
    raw = F.col(column)
    schema = infer_json_schema(docs, decode(raw))
    if not schema.fields and docs.where(raw.isNotNull()).isEmpty():
        raise ValueError(f"cannot infer a schema: column {column!r} has no documents")
    if is_corrupt_only(schema):
        return data_schema(infer_json_schema(docs, raw)), lambda c: c
    return data_schema(schema), decode


def parse_json(text: Column, schema: T.StructType) -> Column:
    """Permissive parse that also keeps the text of malformed documents."""
    fields = data_schema(schema).fields + [T.StructField(CORRUPT, T.StringType())]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return F.from_json(text, T.StructType(fields), options)


def parse_status(text: Column, parsed: Column) -> Column:
    """``null_input``, ``blank``, ``malformed`` or ``ok`` for a parsed document."""
    return (
        F.when(text.isNull(), "null_input")
        .when(text.rlike(r"\A\s*\z"), "blank")
        .when(parsed.isNull() | parsed.getField(CORRUPT).isNotNull(), "malformed")
        .otherwise("ok")
    )


def with_parsed(
    df: DataFrame,
    column: str,
    schema: T.StructType,
    decode: Callable[[Column], Column] = unescape_json,
    parsed: str = "j",
    status: str = "parse_status",
) -> DataFrame:
    """Add the parsed struct and the outcome; the document is parsed once."""
    out = df.withColumn(parsed, parse_json(decode(F.col(column)), schema))
    return out.withColumn(status, parse_status(F.col(column), F.col(parsed)))


def rejected_rows(df: DataFrame, column: str, status: str = "parse_status", chars: int = 150) -> DataFrame:
    """Malformed documents with a short preview for logs; the text stays whole."""
    return df.where(F.col(status) == "malformed").withColumn(
        "snippet", F.substring(F.col(column), 1, chars)
    )
