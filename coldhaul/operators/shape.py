"""Column shaping and by-name union."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldhaul.functions.types import common_schema, quote
from coldhaul.operators.conform import conform_columns


def fill_empty_strings(df: DataFrame) -> DataFrame:
    """NULL becomes the empty string in string columns; other columns keep NULL."""
    return df.fillna("")


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Pin the type of the named columns that exist; other names are ignored."""
    present = {n: F.col(quote(n)).cast(t) for n, t in types.items() if n in df.columns}
    return df.withColumns(present) if present else df


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    for f in schema.fields:
        here = path + (f.name,)
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, here)
        else:
            yield here


def flatten_structs(df: DataFrame, separator: str = "__") -> DataFrame:
    """Every non-struct leaf as a column named by its path; arrays stay whole."""
    paths = list(_leaves(df.schema))
    names = [separator.join(p) for p in paths]
    clashes = sorted(n for n, times in Counter(names).items() if times > 1)
    if clashes:
        raise ValueError(f"flattening gives the same name twice: {', '.join(clashes)}")
    return df.select(*[F.col(".".join(map(quote, p))).alias(n) for p, n in zip(paths, names)])


def expand_struct(
    df: DataFrame, struct: str, keep: Sequence[str], drop: Sequence[str] = (), reserved: Sequence[str] = ()
) -> DataFrame:
    """The kept columns plus the first level of one struct column.

    A field with a kept or reserved name gets the struct's name in front.
    """
    fields = [f for f in df.schema[struct].dataType.fieldNames() if f not in drop]
    taken = {*keep, *reserved}
    names = [f"{struct}__{f}" if f in taken else f for f in fields]
    inner = [F.col(quote(struct)).getField(f).alias(n) for f, n in zip(fields, names)]
    return df.select(*[F.col(quote(k)) for k in keep], *inner)


def pick_field(schema: T.StructType, candidates: Sequence[str]) -> str | None:
    """First candidate that the schema has, compared case-sensitively."""
    names = set(schema.fieldNames())
    return next((c for c in candidates if c in names), None)


def prefer_values(schema: T.StructType, candidates: Sequence[str], struct: str | None = None) -> Column | None:
    """First non-NULL value among the candidates that the schema has."""
    names = set(schema.fieldNames())
    present = [c for c in candidates if c in names]
    if not present:
        return None
    if struct is None:
        return F.coalesce(*[F.col(quote(c)) for c in present])
    return F.coalesce(*[F.col(quote(struct)).getField(c) for c in present])


def old_columns_first(df: DataFrame, table_columns: Sequence[str]) -> DataFrame:
    """Shared columns in table order, then new ones in their own order."""
    have, known = set(df.columns), set(table_columns)
    names = [c for c in table_columns if c in have] + [c for c in df.columns if c not in known]
    return df.select(*[F.col(quote(c)) for c in names])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; absent columns are NULL, drifting types are aligned.

    Inputs are first projected to one common schema, then combined pairwise so
    that many inputs do not build a deep plan.
    """
    if not frames:
        raise ValueError("union_all needs at least one frame")
    target = common_schema([f.schema for f in frames])
    level = [f.select(*conform_columns(f.schema, target)) for f in frames]
    while len(level) > 1:
        pairs = [level[i].union(level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]
