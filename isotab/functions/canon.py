"""The canonical form of a value, as SQL text built from its type.

Each value becomes a string with a tag for its logical type; the parts of a nested value are length-prefixed,
so no content can imitate a separator. NULL is a tag of its own at every level. The text is compiled by Catalyst:
SQL text parses faster than a tree of Column objects, which matters for tables of a thousand columns and more.

Tags: n NULL, b boolean, i integer, d decimal, f floating point, t text, x binary, D date, H time, Tn timestamp without
and Tz with a zone, L list, Lu list as a multiset, S struct, M map, V variant, I interval.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotab.config import CanonOptions
from isotab.errors import UnsupportedTypeError

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Python's str.strip() also removes the separators \x1c to \x1f.
_STRIP = r"(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
FOLD_UDF, VARIANT_UDF = "isotab_casefold", "isotab_variant"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def framed(expr: str) -> str:
    """Length-prefixed, so that concatenation is injective."""
    return f"concat(length({expr}), ':', {expr})"


def _double(expr: str, tol: float) -> str:
    plain = f"concat('f:', cast({expr} as string))"
    if not tol > 0:
        return plain
    grid = f"({expr}) / {tol!r}D"
    return f"case when isnan({expr}) or abs({grid}) > 1e37D then {plain} else concat('f:', cast(cast(rint({grid}) as decimal(38,0)) as string)) end"


def _text(expr: str, o: CanonOptions) -> str:
    if o.trim_strings:
        expr = f"regexp_replace({expr}, '{_STRIP}', '')"
    if o.case_insensitive:
        expr = f"{FOLD_UDF}({expr})" if o.exact_casefold else f"lower({expr})"
    return f"concat('t:', {expr})"


def canon_sql(expr: str, dtype: T.DataType, o: CanonOptions, unordered: bool = False, depth: int = 0) -> str:
    """SQL text of the canonical form of `expr`, never NULL. unordered: a list counts as a multiset (outermost level only)."""
    body = _body(expr, dtype, o, unordered, depth)
    return f"case when {expr} is null then 'n' else {body} end"


def _body(expr: str, dtype: T.DataType, o: CanonOptions, unordered: bool, depth: int) -> str:
    v = f"v{depth}"
    match dtype:
        case T.NullType():
            return "'n'"
        case T.BooleanType():
            return f"concat('b:', cast({expr} as string))"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return _double(f"cast({expr} as double)", o.float_tolerance) if o.coerce_numeric_to_float else f"concat('i:', cast({expr} as string))"
        case T.DecimalType():
            if o.coerce_numeric_to_float:
                return _double(f"cast({expr} as double)", o.float_tolerance)
            text = f"cast({expr} as string)"
            if dtype.scale == 0:
                # An unsigned 64-bit column arrives as decimal(20,0) and counts as an integer.
                return f"concat('{'i' if dtype.precision == 20 else 'd'}:', {text})"
            return rf"concat('d:', regexp_replace(regexp_replace({text}, '(\\.\\d*?)0+$', '$1'), '\\.$', ''))"
        case T.FloatType() | T.DoubleType():
            return _double(f"cast({expr} as double)", o.float_tolerance)
        case T.StringType() | T.CharType() | T.VarcharType():
            return _text(expr, o)
        case T.BinaryType():
            return f"concat('x:', lower(hex({expr})))"
        case T.DateType():
            return f"concat('D:', cast({expr} as string))"
        case T.TimestampNTZType():
            return f"concat('Tn:', cast({expr} as string))"
        case T.TimestampType():
            return f"concat('Tz:', cast(unix_micros({expr}) as string))"
        case T.ArrayType():
            parts = f"transform({expr}, {v} -> {canon_sql(v, dtype.elementType, o, False, depth + 1)})"
            if unordered:
                parts = f"array_sort({parts})"
            return f"concat('{'Lu' if unordered else 'L'}:', {_joined(parts, depth + 1)})"
        case T.StructType():
            bits = [f"'{_escaped(f.name)}=', {framed(canon_sql(f'{expr}.{quote(f.name)}', f.dataType, o, False, depth + 1))}" for f in sorted(dtype, key=lambda f: f.name)]
            return f"concat('S:'{''.join(', ' + b for b in bits)})"
        case T.MapType():
            k, x = (canon_sql(f"{v}.{p}", t, o, False, depth + 1) for p, t in (("key", dtype.keyType), ("value", dtype.valueType)))
            parts = f"array_sort(transform(map_entries({expr}), {v} -> concat({framed(k)}, {framed(x)})))"
            return f"concat('M:', {_joined(parts, depth + 1)})"
        case T.DayTimeIntervalType() | T.YearMonthIntervalType() | T.CalendarIntervalType():
            return f"concat('I:', cast({expr} as string))"
        case T.VariantType():
            if depth or not (o.float_tolerance > 0 or o.coerce_numeric_to_float or o.trim_strings or o.case_insensitive or unordered):
                return f"concat('V:', to_json({expr}))"
            flags = ", ".join(str(bool(x)).lower() for x in (o.coerce_numeric_to_float, o.trim_strings, o.case_insensitive, unordered))
            return f"concat('V:', {VARIANT_UDF}(to_json({expr}), {max(o.float_tolerance, 0.0)!r}D, {flags}))"
    if type(dtype).__name__ == "TimeType":
        return f"concat('H:', cast({expr} as string))"
    raise UnsupportedTypeError(f"no canonical form for type {dtype.simpleString()} of {expr}; cast it in the source query or add it to ignore_columns")


def _escaped(name: str) -> str:
    return literal(f"{len(name)}:{name}")[1:-1]


def _joined(parts: str, depth: int) -> str:
    e = f"e{depth}"
    return f"array_join(transform({parts}, {e} -> {framed(e)}), '')"


def column_sql(name: str, dtype: T.DataType, o: CanonOptions) -> str:
    return canon_sql(quote(name), dtype, o, name in o.unordered_list_columns)


def variant_form(text: str, tolerance: float, coerce: bool, trim: bool, fold: bool, unordered: bool) -> str:
    """The canonical JSON of a variant whose values the options reach into: names of fields in order, numbers on the grid of
    the tolerance (those with a fraction, or all if coerced), strings trimmed and folded, lists of the first level as multisets."""

    def form(x, level: int):
        match x:
            case dict():
                return {k: form(x[k], level + 1) for k in sorted(x)}
            case list():
                parts = [form(v, level + 1) for v in x]
                return sorted(parts, key=json.dumps) if unordered and level <= 1 else parts
            case str():
                x = x.strip() if trim else x
                return x.lower() if fold else x
            case bool() | None:
                return x
        number = float(x) if coerce or isinstance(x, float) else x
        if isinstance(number, float) and tolerance > 0 and abs(number / tolerance) <= 1e37:
            return ["grid", round(number / tolerance)]
        return number

    return json.dumps(form(json.loads(text), 0), ensure_ascii=False)


def register_variant(spark) -> None:
    """What a variant holds is known by its rows alone, so options reach into it by an Arrow UDF. Variants inside lists, maps
    and structs are compared without options."""

    @F.pandas_udf(T.StringType())
    def form(text: pd.Series, tolerance: pd.Series, coerce: pd.Series, trim: pd.Series, fold: pd.Series, unordered: pd.Series) -> pd.Series:
        if not len(text):
            return text
        options = [float(tolerance.iloc[0]), *(bool(x.iloc[0]) for x in (coerce, trim, fold, unordered))]
        return text.map(lambda t: None if t is None else variant_form(t, *options))

    spark.udf.register(VARIANT_UDF, form)


def register_casefold(spark) -> None:
    """The exact folding of case: Spark's lower() keeps 'ß', Python's casefold() gives 'ss'."""

    @F.pandas_udf(T.StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.str.casefold()

    spark.udf.register(FOLD_UDF, fold)
