"""Source specs: dicts with a `type`, each read as a lazy DataFrame."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotab.cases.params import substitute_text
from isotab.errors import SourceError
from isotab.session import active_session
from isotab.types import parse_type


#: Files that `lenient` reads one by one, and bytes of a result that may pass through the driver.
LENIENT_FILES, DRIVER_BYTES = 1000, 1 << 30


class Context:
    """What a handler may need besides its spec."""

    def __init__(self, spark: SparkSession, base_dir: str, variables: Mapping[str, str] | None):
        self.spark, self.base_dir, self.variables = spark, base_dir, variables

    def path(self, path: str) -> str:
        """Absolute paths and URIs stay; others are relative to the case file."""
        return path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) or os.path.isabs(path) else os.path.join(os.path.abspath(self.base_dir), path)

    def query(self, spec: Mapping[str, Any]) -> str | None:
        """`query`, or the text of `query_file` with its placeholders replaced."""
        if spec.get("query"):
            return str(spec["query"])
        if not spec.get("query_file"):
            return None
        path = self.path(str(spec["query_file"]))
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read().strip()
        except OSError as e:
            raise SourceError(f"can't read query_file {path}: {e}") from e
        return text if self.variables is None else substitute_text(text, self.variables, where=path)


def need(spec: Mapping[str, Any], key: str) -> Any:
    if spec.get(key) in (None, ""):
        raise SourceError(f"source of type {spec.get('type')!r} needs '{key}'")
    return spec[key]


def _selected(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    if spec.get("row_filter"):
        df = df.where(str(spec["row_filter"]))
    for column, op, value in spec.get("filters") or []:
        c = F.col(f"`{column}`")
        tests = {"=": lambda: c == value, "==": lambda: c == value, "!=": lambda: c != value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value, "in": lambda: c.isin(list(value)), "not in": lambda: ~c.isin(list(value))}  # noqa: B023
        if op not in tests:
            raise SourceError(f"unknown filter operator {op!r}; known: {sorted(tests)}")
        df = df.where(tests[op]())
    return df.select(*[f"`{c}`" for c in spec["columns"]]) if spec.get("columns") else df


def inline(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    rows, declared = spec.get("rows"), spec.get("schema")
    rows = [] if rows is None else rows
    if not isinstance(rows, list):
        raise SourceError("inline rows must be a list of mappings")
    if bad := [r for r in rows if not isinstance(r, Mapping)]:
        raise SourceError(f"inline rows must be mappings, got {bad[0]!r}")
    if declared:
        schema = T.StructType([T.StructField(str(n), parse_type(t)) for n, t in declared.items()])
        return cx.spark.createDataFrame([tuple(_fit(r.get(f.name), f.dataType) for f in schema) for r in rows], schema)
    names = list(dict.fromkeys(n for r in rows for n in r))
    if not names:
        return cx.spark.createDataFrame([], T.StructType([]))
    import pyarrow as pa

    # Arrow infers a type from all rows, and widens int to float where a column has both.
    return cx.spark.createDataFrame(pa.table({n: pa.array(_widened([r.get(n) for r in rows])) for n in names}))


def _widened(values: list) -> list:
    kinds = {type(v) for v in values if v is not None}
    return [float(v) if v is not None else None for v in values] if kinds == {int, float} else values


def _fit(value: Any, dtype: T.DataType) -> Any:
    """A YAML value as the Python value that the declared type wants."""
    import datetime as dt
    from decimal import Decimal

    if value is None:
        return None
    match dtype:
        case T.DecimalType():
            return Decimal(str(value)).quantize(Decimal(1).scaleb(-dtype.scale))
        case T.DoubleType() | T.FloatType():
            return float(value)
        case T.LongType() | T.IntegerType() | T.ShortType() | T.ByteType():
            return int(value)
        case T.StringType():
            return str(value)
        case T.DateType() if isinstance(value, str):
            return dt.date.fromisoformat(value)
        case T.TimestampType() | T.TimestampNTZType() if isinstance(value, str):
            return dt.datetime.fromisoformat(value)
        case T.TimestampType() | T.TimestampNTZType() if not isinstance(value, dt.datetime):
            return dt.datetime.combine(value, dt.time())
        case T.ArrayType():
            return [_fit(v, dtype.elementType) for v in value]
        case T.MapType():
            return {_fit(k, dtype.keyType): _fit(v, dtype.valueType) for k, v in value.items()}
        case T.StructType():
            return tuple(_fit(value.get(f.name), f.dataType) for f in dtype)
    return value


def csv(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    """Header and inferred types, from the share sampling_ratio of the rows, unless `schema` is given; integers become bigint."""
    reader = cx.spark.read.option("header", True).options(**{k: str(v) for k, v in (spec.get("options") or {}).items()})
    path = cx.path(str(need(spec, "path")))
    if spec.get("schema"):
        return reader.schema(T.StructType([T.StructField(n, parse_type(t)) for n, t in spec["schema"].items()])).csv(path)
    df = reader.option("inferSchema", True).option("samplingRatio", str(spec.get("sampling_ratio", 1.0))).csv(path)
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def parquet(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    """A file, folder or glob. Files may lack columns (NULL then); lenient: also widen types file by file."""
    path = cx.path(str(need(spec, "path")))
    if spec.get("lenient"):
        from functools import reduce

        files = [r[0] for r in cx.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").limit(LENIENT_FILES + 1).collect()]
        if not files:
            raise SourceError(f"no Parquet file at {path}")
        if len(files) > LENIENT_FILES:
            raise SourceError(f"{path} has more than {LENIENT_FILES} files, too many to be widened one by one; read it without `lenient`, or rewrite it with one schema")
        return _selected(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (cx.spark.read.parquet(f) for f in sorted(files))), spec)
    try:
        return _selected(cx.spark.read.option("mergeSchema", True).parquet(path), spec)
    except Exception as e:
        raise SourceError(f"can't read Parquet at {path}: {str(e).splitlines()[0]}") from e


def arrow(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    """An Arrow IPC or Feather file on the driver's machine, of fixture size."""
    import pyarrow.feather as feather

    path = cx.path(str(need(spec, "path")))
    if os.path.getsize(path) > DRIVER_BYTES:
        raise SourceError(f"{path} has more than {DRIVER_BYTES} bytes, which would pass through the driver; write it as Parquet")
    return cx.spark.createDataFrame(feather.read_table(path))


def sql(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    """Spark SQL: `setup` statements first, then `query`, `query_file` or `table`. With `database` naming a DuckDB file,
    the query runs there and its result, of DRIVER_BYTES at most, comes back through Arrow."""
    if spec.get("database") and spec["database"] != ":memory:":
        import duckdb

        with duckdb.connect(cx.path(str(spec["database"])), read_only=bool(spec.get("read_only", False))) as con:
            for statement in spec.get("setup") or []:
                con.execute(statement)
            text = cx.query(spec) or f'SELECT * FROM {need(spec, "table")}'
            return cx.spark.createDataFrame(_bounded(con.sql(text), str(spec["database"])))
    for statement in spec.get("setup") or []:
        cx.spark.sql(statement)
    if text := cx.query(spec):
        return _selected(cx.spark.sql(text.rstrip().rstrip(";")), spec)
    return _selected(cx.spark.table(str(need(spec, "table"))), spec)


def _bounded(result, name: str):
    import pyarrow as pa

    reader, batches, size = result.to_arrow_reader(1 << 16), [], 0
    for batch in reader:
        batches.append(batch)
        size += batch.nbytes
        if size > DRIVER_BYTES:
            raise SourceError(f"the result from {name} has more than {DRIVER_BYTES} bytes, which would pass through the driver; write it as Parquet")
    return pa.Table.from_batches(batches, reader.schema)


def iceberg(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    name = str(need(spec, "table"))
    return _selected(cx.spark.read.format("iceberg").load(f"{spec['catalog']}.{name}" if isinstance(spec.get("catalog"), str) else name), spec)


def delta(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    reader = cx.spark.read.format("delta").options(**{k: str(v) for k, v in (spec.get("storage_options") or {}).items()})
    if spec.get("version") is not None and spec.get("timestamp") is not None:
        raise SourceError("a delta source takes version or timestamp, not both")
    if spec.get("version") is not None:
        reader = reader.option("versionAsOf", str(spec["version"]))
    if spec.get("timestamp") is not None:
        reader = reader.option("timestampAsOf", str(spec["timestamp"]))
    return _selected(reader.load(cx.path(str(need(spec, "path")))), spec)


def jdbc_options(spec: Mapping[str, Any]) -> dict[str, str]:
    """Options for Spark's JDBC reader. Secrets come from the environment only: `*_env` names the variable."""
    if bad := {"password", "private_key", "token", "jwt"} & set(spec):
        raise SourceError(f"put secrets into the environment and name the variable ({', '.join(f'{b}_env' for b in sorted(bad))}), not into a case file")
    out = {k: str(v) for k, v in (spec.get("options") or {}).items()}
    for key, var in spec.items():
        if key.endswith("_env"):
            if var not in os.environ:
                raise SourceError(f"environment variable {var} for {key[:-4]} is not set")
            out[key[:-4]] = os.environ[var]
    return out


def trino(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    host, port = spec.get("host") or os.environ.get("TRINO_HOST"), spec.get("port") or os.environ.get("TRINO_PORT", "8080")
    if not host:
        raise SourceError("a trino source needs host, or TRINO_HOST in the environment")
    url = f"jdbc:trino://{host}:{port}" + "".join(f"/{spec[k]}" for k in ("catalog", "schema") if spec.get(k))
    options = {"url": url, "driver": "io.trino.jdbc.TrinoDriver", "user": spec.get("user") or os.environ.get("TRINO_USER", "isotab")} | jdbc_options(spec)
    if token := os.environ.get("TRINO_JWT_TOKEN"):
        options["accessToken"] = token
    return _queried(cx.spark.read.format("jdbc").options(**options), spec, cx)


def snowflake(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    names = {"sfURL": "account", "sfUser": "user", "sfDatabase": "database", "sfSchema": "schema", "sfWarehouse": "warehouse", "sfRole": "role"}
    options = {k: str(v) for k, name in names.items() if (v := spec.get(name) or os.environ.get(f"SNOWFLAKE_{name.upper()}"))}
    if "sfURL" not in options:
        raise SourceError("a snowflake source needs account, or SNOWFLAKE_ACCOUNT in the environment")
    if key := os.environ.get("SNOWFLAKE_PRIVATE_KEY"):
        options["pem_private_key"] = key
    return _queried(cx.spark.read.format("snowflake").options(**options | jdbc_options(spec)), spec, cx)


def jdbc(spec: Mapping[str, Any], cx: Context) -> DataFrame:
    return _queried(cx.spark.read.format("jdbc").options(url=str(need(spec, "url")), **jdbc_options(spec)), spec, cx)


def _queried(reader, spec: Mapping[str, Any], cx: Context) -> DataFrame:
    text = cx.query(spec)
    return _selected((reader.option("query", text) if text else reader.option("dbtable", str(need(spec, "table")))).load(), spec)


HANDLERS: dict[str, Callable[[Mapping[str, Any], Context], DataFrame]] = {
    "inline": inline, "csv": csv, "parquet": parquet, "arrow": arrow, "feather": arrow, "duckdb": sql, "sql": sql, "spark": sql,
    "iceberg": iceberg, "delta": delta, "trino": trino, "snowflake": snowflake, "jdbc": jdbc,
}


def load_source(spec: Any, base_dir: str = ".", variables: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    if not isinstance(spec, Mapping):
        raise SourceError(f"a source spec must be a mapping, got {type(spec).__name__}")
    if "type" not in spec:
        raise SourceError(f"a source spec needs 'type'; known: {sorted(HANDLERS)}")
    handler = HANDLERS.get(str(spec["type"]).lower())
    if handler is None:
        raise SourceError(f"unknown source type {spec['type']!r}; known: {sorted(HANDLERS)}")
    return handler(spec, Context(spark or active_session(), base_dir, variables))


def describe_source(spec: Any, base_dir: str = ".", variables: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    """Column names and types. Reads metadata only; a CSV file without a schema is read for its types, in part if the
    spec has a sampling_ratio."""
    return {f.name: f.dataType.simpleString() for f in load_source(spec, base_dir, variables, spark).schema.fields}
