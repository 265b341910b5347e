"""Type names of inline fixtures and of reports."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from isotab.errors import SourceError

_SIMPLE = {
    "int": T.LongType(), "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(),
    "float": T.DoubleType(), "double": T.DoubleType(), "float32": T.FloatType(), "str": T.StringType(), "string": T.StringType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
}


def parse_type(name: str) -> T.DataType:
    """The Spark type of a fixture's type name; anything else is read as Spark DDL."""
    text = str(name).strip()
    low = text.lower()
    if low in _SIMPLE:
        return _SIMPLE[low]
    if m := re.fullmatch(r"decimal(?:128)?\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", low):
        return T.DecimalType(int(m[1] or 38), int(m[2] or 0) if m[1] else 10)
    if m := re.fullmatch(r"list\s*<(.*)>", text, re.IGNORECASE | re.DOTALL):
        return T.ArrayType(parse_type(m[1]))
    try:
        return T.StructType.fromDDL(f"`x` {text}")["x"].dataType
    except Exception as e:
        raise SourceError(f"unknown type name {name!r} in an inline schema") from e


def type_name(dtype: T.DataType) -> str:
    return dtype.simpleString()


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equality of types that ignores nullability at every level."""
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return same_type(a.elementType, b.elementType)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return same_type(a.keyType, b.keyType) and same_type(a.valueType, b.valueType)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return [f.name for f in a] == [f.name for f in b] and all(same_type(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
    return a == b
