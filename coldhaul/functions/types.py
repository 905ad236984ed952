"""Data type helpers: equality, DDL text, common type."""

from __future__ import annotations

from pyspark.sql import types as T

_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
COMPLEX = (T.ArrayType, T.StructType, T.MapType)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equal apart from nullability."""
    if type(a) is not type(b):
        return False
    if isinstance(a, T.ArrayType):
        return same_type(a.elementType, b.elementType)
    if isinstance(a, T.MapType):
        return same_type(a.keyType, b.keyType) and same_type(a.valueType, b.valueType)
    if isinstance(a, T.StructType):
        return a.fieldNames() == b.fieldNames() and all(
            same_type(x.dataType, y.dataType) for x, y in zip(a.fields, b.fields)
        )
    return a == b


def type_ddl(data_type: T.DataType) -> str:
    """DDL text with quoted field names; an untyped NULL column becomes a string."""
    if isinstance(data_type, T.NullType):
        return "string"
    if isinstance(data_type, T.ArrayType):
        return f"array<{type_ddl(data_type.elementType)}>"
    if isinstance(data_type, T.MapType):
        return f"map<{type_ddl(data_type.keyType)},{type_ddl(data_type.valueType)}>"
    if isinstance(data_type, T.StructType):
        inner = ",".join(f"{quote(f.name)}:{type_ddl(f.dataType)}" for f in data_type.fields)
        return f"struct<{inner}>"
    return data_type.simpleString()


def columns_ddl(fields: list[T.StructField]) -> str:
    return ", ".join(f"{quote(f.name)} {type_ddl(f.dataType)}" for f in fields)


def _common_numeric(a: T.DataType, b: T.DataType) -> T.DataType:
    if type(a) in _WHOLE and type(b) in _WHOLE:
        return max((a, b), key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, T.FractionalType) and isinstance(b, T.FractionalType):
        if not (isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType)):
            return a if same_type(a, b) else T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        parts = []
        for t in (a, b):
            if isinstance(t, T.DecimalType):
                parts.append((t.precision - t.scale, t.scale))
            elif type(t) in _WHOLE:
                parts.append((_DIGITS[type(t)], 0))
        if len(parts) == 2:
            whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
            if whole + scale <= 38:
                return T.DecimalType(whole + scale, scale)
    return T.DoubleType()


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type that holds both: the wider number, merged structs, else string."""
    if same_type(a, b) or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return _common_numeric(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), True)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema([a, b])
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and same_type(a.keyType, b.keyType):
        return T.MapType(a.keyType, common_type(a.valueType, b.valueType), True)
    return T.StringType()


def common_schema(schemas: list[T.StructType]) -> T.StructType:
    """Fields of all schemas in order of first appearance, with common types."""
    merged: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            merged[f.name] = common_type(merged[f.name], f.dataType) if f.name in merged else f.dataType
    return T.StructType([T.StructField(n, t, True) for n, t in merged.items()])


def merge_repeated(data_type: T.DataType) -> T.DataType:
    """The type with same-named fields of a struct merged into one."""
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(merge_repeated(data_type.elementType), data_type.containsNull)
    if isinstance(data_type, T.StructType):
        fields = [T.StructType([T.StructField(f.name, merge_repeated(f.dataType))]) for f in data_type.fields]
        return common_schema(fields)
    return data_type
