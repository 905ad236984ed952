"""New fields inside structs, arrays of structs and maps of structs of an existing table.

A session-catalog table can get columns but not new fields in one. What a column's
values have beyond its type goes to a column of its own beside it, ``name+1``, then
``name+2`` and so on, in the same nesting; arrays keep their places and maps their keys.
Readers put the parts together again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import quote, same_type
from coldhaul.operators.conform import converted

_SIDE = re.compile(r"(.+)\+(\d+)", re.DOTALL)


def _nested(a: T.DataType, b: T.DataType) -> bool:
    """Whether both are structs, both arrays, or both maps with keys of one type."""
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return same_type(a.keyType, b.keyType)
    return any(isinstance(a, kind) and isinstance(b, kind) for kind in (T.StructType, T.ArrayType))


def _inside(a: T.DataType, b: T.DataType, of_items) -> T.DataType | None:
    """The array or map type whose items ``of_items`` makes from those of both; None if it makes none."""
    if isinstance(a, T.ArrayType):
        items = of_items(a.elementType, b.elementType)
        return items and T.ArrayType(items)
    items = of_items(a.valueType, b.valueType)
    return items and T.MapType(a.keyType, items)


def grown(incoming: T.DataType, known: T.DataType) -> T.DataType | None:
    """What a type has beyond another inside matching structs; None if nothing."""
    if not _nested(incoming, known):
        return None
    if not isinstance(incoming, T.StructType):
        return _inside(incoming, known, grown)
    have = {f.name: f.dataType for f in known.fields}
    fields = []
    for f in incoming.fields:
        beyond = grown(f.dataType, have[f.name]) if f.name in have else f.dataType
        if beyond is not None:
            fields.append(T.StructField(f.name, T.StringType() if isinstance(beyond, T.NullType) else beyond))
    return T.StructType(fields) if fields else None


def shared(incoming: T.DataType, known: T.DataType) -> T.DataType | None:
    """The part of a type whose fields another has too; None if they share no field."""
    if not _nested(incoming, known):
        return incoming
    if not isinstance(incoming, T.StructType):
        return _inside(incoming, known, shared)
    have = {f.name: f.dataType for f in known.fields}
    parts = [(f.name, shared(f.dataType, have[f.name])) for f in incoming.fields if f.name in have]
    fields = [T.StructField(n, t) for n, t in parts if t is not None]
    return T.StructType(fields) if fields else None


def merged_type(known: T.DataType, more: T.DataType) -> T.DataType:
    """The fields of both; those of both kinds keep the place and type they have in the first."""
    if not _nested(known, more):
        return known
    if not isinstance(known, T.StructType):
        return _inside(known, more, merged_type)
    extra = {f.name: f.dataType for f in more.fields}
    fields = [T.StructField(f.name, merged_type(f.dataType, extra.pop(f.name)) if f.name in extra else f.dataType) for f in known.fields]
    return T.StructType(fields + [T.StructField(n, t) for n, t in extra.items()])


def merged(c: Column, known: T.DataType, side: Column, more: T.DataType) -> Column:
    """Values of :func:`merged_type` from those of a column and of the column beside it."""
    if not _nested(known, more):
        return c
    if isinstance(known, T.StructType):
        extra = {f.name: f.dataType for f in more.fields}
        fields = [
            (merged(c.getField(f.name), f.dataType, side.getField(f.name), extra.pop(f.name)) if f.name in extra else c.getField(f.name)).alias(f.name)
            for f in known.fields
        ]
        fields += [side.getField(n).alias(n) for n in extra]
        return F.when(c.isNotNull() | side.isNotNull(), F.struct(*fields))
    if isinstance(known, T.ArrayType):
        nothing = F.lit(None).cast(more.elementType)
        alone = F.transform(c, lambda x: merged(x, known.elementType, nothing, more.elementType))
        both = F.zip_with(c, side, lambda x, y: merged(x, known.elementType, y, more.elementType))
        return F.when(side.isNull(), alone).otherwise(both)
    nothing = F.lit(None).cast(more)
    sides = F.coalesce(side, nothing)
    return F.transform_values(c, lambda k, v: merged(v, known.valueType, F.try_element_at(sides, k), more.valueType))


def side_columns(schema: T.StructType) -> dict[str, list[T.StructField]]:
    """The columns beside each column, in their order."""
    found: dict[str, list[tuple[int, T.StructField]]] = {}
    for f in schema.fields:
        match = _SIDE.fullmatch(f.name)
        if match and match[1] in schema.fieldNames():
            found.setdefault(match[1], []).append((int(match[2]), f))
    return {name: [f for _, f in sorted(fields, key=lambda x: x[0])] for name, fields in found.items()}


def split_growth(df: DataFrame, table: T.StructType) -> DataFrame:
    """The frame with what its nested columns have beyond those of the table in columns beside them.

    Names like ``name+1`` are reserved for these; data that has such a column is refused.
    Nothing is lost: every field of the data is in one of the columns.
    """
    have = {f.name: f.dataType for f in table.fields}
    every = {*table.fieldNames(), *df.columns}
    reserved = [c for c in df.columns if (m := _SIDE.fullmatch(c)) and m[1] in every]
    if reserved:
        raise ValueError(f"the data has columns named {reserved}, which are kept for new nested fields")
    sides = side_columns(table)
    columns = []
    for f in df.schema.fields:
        c, own = F.col(quote(f.name)), f.dataType
        if f.name not in have or not _nested(own, have[f.name]):
            columns.append(c)
            continue
        known = have[f.name]
        columns.append(converted(c, own, shared(own, known) or known).alias(f.name))
        for side in sides.get(f.name, []):
            columns.append(converted(c, own, shared(own, side.dataType) or side.dataType).alias(side.name))
            known = merged_type(known, side.dataType)
        beyond = grown(own, known)
        if beyond is not None:
            columns.append(converted(c, own, beyond).alias(f"{f.name}+{len(sides.get(f.name, [])) + 1}"))
    return df.select(*columns)


def with_growth(df: DataFrame) -> DataFrame:
    """Nested columns put together with those beside them, which are left out."""
    sides = side_columns(df.schema)
    inner = {f.name for fields in sides.values() for f in fields}
    columns = []
    for f in df.schema.fields:
        if f.name in inner:
            continue
        c, known = F.col(quote(f.name)), f.dataType
        for side in sides.get(f.name, []):
            c = merged(c, known, F.col(quote(side.name)), side.dataType)
            known = merged_type(known, side.dataType)
        columns.append(c.alias(f.name))
    return df.select(*columns) if sides else df
