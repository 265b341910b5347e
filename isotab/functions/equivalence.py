"""Differences that are only another spelling of absence: labels, never a verdict."""

from __future__ import annotations

from pyspark.sql import types as T

from isotab.functions.canon import quote

# The spellings of absence, as a scalar and as a container.
SCALAR_ABSENT = ("\\n", "", "null", "none", "0", "0.0", "false")
CONTAINER_ABSENT = ("\\n", "", "null", "none", "[]", "{}")

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\") + "'" for v in values)


def normal_sql(expr: str, dtype: T.DataType, depth: int = 0) -> str:
    """The text under which a value is looked up among the spellings of absence."""
    v = f"n{depth}"
    if isinstance(dtype, T.ArrayType):
        inner = normal_sql(v, dtype.elementType, depth + 1)
        # A list whose elements are all absent-like (or empty lists of such) is a NULL in another spelling.
        absent = f"forall({expr}, {v} -> coalesce({inner}, 'null') in ('null', '[]'))"
        text = f"case when size({expr}) = 0 then '[]' when {absent} then 'null' else to_json({expr}) end"
    elif isinstance(dtype, T.MapType):
        text = f"case when size({expr}) = 0 then '{{}}' else 'map' end"
    elif isinstance(dtype, T.StructType):
        text = "'struct'"
    elif isinstance(dtype, T.BinaryType):
        text = f"lower(hex({expr}))"
    elif isinstance(dtype, T.VariantType):
        text = f"lower(to_json({expr}))"
    else:
        text = f"lower(trim(cast({expr} as string)))"
    return f"case when {expr} is null then 'null' else {text} end"


def equivalent_sql(left: str, lt: T.DataType, right: str, rt: T.DataType, depth: int = 0) -> str:
    """SQL text that is true where two values are equal or differ only in how they spell absence."""
    a, b = normal_sql(left, lt), normal_sql(right, rt)
    tests = [f"({a} in ({_sql_list(g)}) and {b} in ({_sql_list(g)}))" for g in (SCALAR_ABSENT, CONTAINER_ABSENT)]
    if isinstance(lt, _NUMBERS) and isinstance(rt, _NUMBERS):
        tests.append(f"(cast({left} as double) <=> cast({right} as double))")
    elif isinstance(lt, T.ArrayType) and isinstance(rt, T.ArrayType):
        x, y = f"x{depth}", f"y{depth}"
        each = equivalent_sql(x, lt.elementType, y, rt.elementType, depth + 1)
        tests.append(f"(size({left}) = size({right}) and size({left}) > 0 and forall(zip_with({left}, {right}, ({x}, {y}) -> {each}), z{depth} -> z{depth}))")
    elif lt.simpleString() == rt.simpleString() and not isinstance(lt, (T.MapType, T.VariantType)):
        tests.append(f"({left} <=> {right})")
    return f"coalesce({' or '.join(tests)}, false)"


def column_equivalent_sql(left: str, right: str, column: str, lt: T.DataType, rt: T.DataType) -> str:
    return equivalent_sql(f"{left}.{quote(column)}", lt, f"{right}.{quote(column)}", rt)
