"""Digests of canonical rows and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotab.config import CanonOptions
from isotab.functions.canon import column_sql, framed, literal

#: Columns in one digest expression; a wider row is a digest of digests, which keeps generated methods small.
CHUNK = 100


def fields_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def row_text_sql(schema: dict[str, T.DataType], columns: list[str], o: CanonOptions) -> str:
    """The canonical text of a row: its columns by name, each framed."""
    parts = [f"{literal(f'{len(c)}:{c}=')}, {framed(column_sql(c, schema[c], o))}" for c in sorted(columns)]
    return f"concat({', '.join(parts)})" if parts else "''"


def digest_sql(schema: dict[str, T.DataType], columns: list[str], o: CanonOptions) -> str:
    """A 128-bit digest of the row, as 16 bytes."""
    names = sorted(columns)
    chunks = [names[i : i + CHUNK] for i in range(0, len(names), CHUNK)] or [[]]
    texts = [row_text_sql(schema, c, o) for c in chunks]
    return f"unhex(md5({texts[0]}))" if len(texts) == 1 else f"unhex(md5(concat({', '.join(f'md5({t})' for t in texts)})))"


def row_digest(df: DataFrame, columns: list[str] | None = None, options: CanonOptions = CanonOptions()) -> Column:
    return F.expr(digest_sql(fields_of(df), columns or df.columns, options))


def canon_value(df: DataFrame, column: str, options: CanonOptions = CanonOptions()) -> Column:
    return F.expr(column_sql(column, fields_of(df)[column], options))


def canon_row(df: DataFrame, columns: list[str] | None = None, options: CanonOptions = CanonOptions()) -> Column:
    return F.expr(row_text_sql(fields_of(df), columns or df.columns, options))


def hash_sample(df: DataFrame, keys: list[str], modulus: int, remainder: int = 0) -> DataFrame:
    """About one row in `modulus`, chosen by the key alone, so both sides of a comparison keep the same keys."""
    if modulus < 1:
        raise ValueError("modulus must be at least 1")
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(modulus)) == remainder)
