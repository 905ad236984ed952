"""Bring a frame to the schema of an existing table.

Types are decided from schemas alone, before anything is written, so drift is
never discovered through a failed write.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import COMPLEX, common_type, quote, same_type

_NUMERIC_LIKE = (T.NumericType, T.BooleanType)
_INSTANTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class SchemaReport:
    """Differences between incoming data and a table; metadata only."""

    matching: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)
    mismatched: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def identical(self) -> bool:
        return not (self.missing or self.extra or self.mismatched)


def compare_schemas(incoming: T.StructType, table: T.StructType) -> SchemaReport:
    new = {f.name: f.dataType for f in incoming.fields}
    old = {f.name: f.dataType for f in table.fields}
    shared = [n for n in old if n in new]
    return SchemaReport(
        matching=[n for n in shared if same_type(new[n], old[n])],
        missing=[n for n in old if n not in new],
        extra=[n for n in new if n not in old],
        mismatched=[
            (n, new[n].simpleString(), old[n].simpleString())
            for n in shared
            if not same_type(new[n], old[n])
        ],
    )


def _castable(src: T.DataType, dst: T.DataType) -> bool:
    if isinstance(src, (T.StringType, T.NullType)) or isinstance(dst, T.StringType):
        return True
    for family in (_NUMERIC_LIKE, _INSTANTS):
        if isinstance(src, family) and isinstance(dst, family):
            return True
    return isinstance(src, T.NumericType) and isinstance(dst, T.TimestampType)


def _widens(src: T.DataType, dst: T.DataType) -> bool:
    """Whether every number of one type is one of the other."""
    if not (isinstance(src, T.NumericType) and isinstance(dst, T.NumericType)):
        return False
    if isinstance(dst, T.DoubleType) and isinstance(src, (T.LongType, T.DecimalType)):
        return False
    return same_type(common_type(src, dst), dst)


def _cast(c: Column, src: T.DataType, dst: T.DataType) -> Column:
    if isinstance(dst, T.StringType):
        return c.cast(dst)
    if _castable(src, dst):
        return c.try_cast(dst)
    return c.cast("string").try_cast(dst)


def converted(c: Column, src: T.DataType, dst: T.DataType) -> Column:
    """Expression of type ``dst`` holding the value of ``c`` (of type ``src``)."""
    if same_type(src, dst):
        return c
    if isinstance(src, T.ArrayType) and isinstance(dst, T.ArrayType):
        return F.transform(c, lambda x: converted(x, src.elementType, dst.elementType))
    if isinstance(dst, T.ArrayType):
        one = F.array(converted(c, src, dst.elementType))
        return F.when(c.isNotNull(), one).cast(dst)
    if isinstance(src, T.StructType) and isinstance(dst, T.StructType):
        have = {f.name: f.dataType for f in src.fields}
        fields = [
            converted(c.getField(f.name), have[f.name], f.dataType).alias(f.name)
            if f.name in have
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in dst.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(src, T.MapType) and isinstance(dst, T.MapType) and same_type(src.keyType, dst.keyType):
        return F.transform_values(c, lambda _, v: converted(v, src.valueType, dst.valueType))
    if isinstance(src, COMPLEX):
        return F.to_json(c) if isinstance(dst, T.StringType) else F.lit(None).cast(dst)
    if isinstance(dst, COMPLEX):
        return F.lit(None).cast(dst)
    return _cast(c, src, dst)


def _any(conditions: list[Column | None]) -> Column | None:
    found = [c for c in conditions if c is not None]
    return reduce(Column.__or__, found) if found else None


def loses_value(c: Column, src: T.DataType, dst: T.DataType) -> Column | None:
    """Condition under which ``converted`` drops something; None when it cannot."""
    if same_type(src, dst) or isinstance(src, T.NullType):
        return None
    if isinstance(src, T.ArrayType) and isinstance(dst, T.ArrayType):
        if loses_value(F.lit(None), src.elementType, dst.elementType) is None:
            return None
        return F.coalesce(
            F.exists(c, lambda x: loses_value(x, src.elementType, dst.elementType)), F.lit(False)
        )
    if isinstance(dst, T.ArrayType):
        return loses_value(c, src, dst.elementType)
    if isinstance(src, T.StructType) and isinstance(dst, T.StructType):
        kept = {f.name: f.dataType for f in dst.fields}
        return _any(
            [
                loses_value(c.getField(f.name), f.dataType, kept[f.name])
                if f.name in kept
                else c.getField(f.name).isNotNull()
                for f in src.fields
            ]
        )
    if isinstance(src, T.MapType) and isinstance(dst, T.MapType) and same_type(src.keyType, dst.keyType):
        if loses_value(F.lit(None), src.valueType, dst.valueType) is None:
            return None
        return F.coalesce(
            F.exists(F.map_values(c), lambda v: loses_value(v, src.valueType, dst.valueType)), F.lit(False)
        )
    if isinstance(dst, T.StringType):
        return ~F.is_valid_utf8(c.cast("string")) if isinstance(src, T.BinaryType) else None
    if _widens(src, dst):
        return None
    if isinstance(src, COMPLEX) or isinstance(dst, COMPLEX):
        return c.isNotNull()
    # Kept only if the way back gives the same value; for text, the same text.
    out = _cast(c, src, dst)
    return c.isNotNull() & F.coalesce(_cast(out, dst, src) != c, F.lit(True))


def conform_columns(incoming: T.StructType, table: T.StructType) -> list[Column]:
    """One expression per table column, in table order."""
    have = {f.name: f.dataType for f in incoming.fields}
    return [
        (
            converted(F.col(quote(f.name)), have[f.name], f.dataType)
            if f.name in have
            else F.lit(None).cast(f.dataType)
        ).alias(f.name)
        for f in table.fields
    ]


def may_lose(incoming: T.StructType, table: T.StructType) -> bool:
    """Whether any row could lose a value; from the schemas alone."""
    kept = {f.name: f.dataType for f in table.fields}
    return any(
        f.name not in kept or loses_value(F.col(quote(f.name)), f.dataType, kept[f.name]) is not None for f in incoming.fields
    )


def lossy_rows(incoming: T.StructType, table: T.StructType, ignore: tuple[str, ...] = ()) -> Column:
    """True for rows of which conforming drops or changes a value."""
    kept = {f.name: f.dataType for f in table.fields}
    condition = _any(
        [
            loses_value(F.col(quote(f.name)), f.dataType, kept[f.name])
            if f.name in kept
            else F.col(quote(f.name)).isNotNull()
            for f in incoming.fields
            if f.name not in ignore
        ]
    )
    return F.lit(False) if condition is None else condition


def lost_values(incoming: T.StructType, table: T.StructType) -> Column | None:
    """JSON text of a row's values that do not fit their column in the table.

    NULL for rows without such values; None when no row can have any.
    """
    kept = {f.name: f.dataType for f in table.fields}
    lost = {}
    for f in incoming.fields:
        if f.name in kept:
            c = F.col(quote(f.name))
            condition = loses_value(c, f.dataType, kept[f.name])
            if condition is not None:
                lost[f.name] = F.when(condition, converted(c, f.dataType, T.StringType()))
    if not lost:
        return None
    text = F.to_json(F.struct(*[c.alias(n) for n, c in lost.items()]))
    return F.when(F.coalesce(*lost.values()).isNotNull(), text)


def conform(df: DataFrame, table: T.StructType) -> tuple[DataFrame, SchemaReport]:
    """The frame with exactly the table's columns, and what had to change."""
    return df.select(*conform_columns(df.schema, table)), compare_schemas(df.schema, table)
