"""Where results of runs are kept: two append-only tables, a row per case and a row per example."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotab.config import CompareConfig
from isotab.errors import SourceError
from isotab.functions.fingerprint import row_digest
from isotab.result import Outcome
from isotab.session import active_session

_S, _L = T.StringType(), T.LongType()
SUMMARY_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("run_id", _S), ("run_ts", T.TimestampType()), ("case_name", _S), ("tags", _S), ("equivalent", T.BooleanType()), ("expected_rows", _L), ("actual_rows", _L), ("missing_count", _L),
    ("added_count", _L), ("changed_count", _L), ("compared_columns", _S), ("keys", _S), ("type_mismatches", _S), ("columns_only_in_expected", _S), ("columns_only_in_actual", _S))])
DIFFS_SCHEMA = T.StructType([T.StructField(n, _S) for n in ("run_id", "case_name", "diff_kind", "key_json", "expected_row", "actual_row", "column_diffs")])


def summary_row(run_id: str, run_ts: dt.datetime, case: str, tags: list[str], r: Outcome) -> tuple:
    lists = ([*r.schema.compared], [*r.keys] or None, r.schema.retyped_dicts(), [*r.schema.only_expected], [*r.schema.only_actual])
    return (run_id, run_ts, case, json.dumps(tags), r.equivalent, *r.counts[:5], *(None if x is None else json.dumps(x) for x in lists))


def diff_rows(run_id: str, case: str, r: Outcome) -> list[tuple]:
    text = lambda x: None if x is None else json.dumps(x, default=str)
    cells = lambda d: [{"column": c, "expected": str(old), "actual": str(new)} for c, old, new in d.cells()] or None
    return [(run_id, case, d.kind, text(None if d.key is None else [*map(str, d.key)]), text(d.before), text(d.after), text(cells(d))) for d in r.examples]


class ResultSink:
    """backend: parquet, delta or iceberg (target: a folder, or a catalog prefix for iceberg), table (target: a database),
    duckdb (target: a file), snowflake (target: DATABASE.SCHEMA)."""

    def __init__(self, backend: str, target: str, run_id: str | None = None, prefix: str = "isotab", spark: SparkSession | None = None):
        self.backend, self.target, self.prefix = backend, target, prefix
        self.run_id = run_id or uuid.uuid4().hex
        self.spark = spark or active_session()

    def write(self, case: str, tags: list[str], result: Outcome) -> None:
        now = dt.datetime.now(dt.UTC)
        self._append("run_summary", [summary_row(self.run_id, now, case, tags, result)], SUMMARY_SCHEMA)
        if rows := diff_rows(self.run_id, case, result):
            self._append("run_diffs", rows, DIFFS_SCHEMA)

    def _append(self, table: str, rows: list[tuple], schema: T.StructType) -> None:
        name = f"{self.prefix}_{table}"
        if self.backend == "duckdb":
            return self._duckdb(name, rows, schema)
        df = self.spark.createDataFrame(rows, schema)
        if self.backend in ("parquet", "delta"):
            df.coalesce(1).write.format(self.backend).mode("append").option("mergeSchema", True).save(f"{self.target.rstrip('/')}/{name}")
        elif self.backend == "table":
            df.write.mode("append").saveAsTable(f"{self.target}.{name}" if self.target else name)
        elif self.backend == "iceberg":
            full = f"{self.target}.{name}"
            if self.spark.catalog.tableExists(full):
                df.writeTo(full).append()
            else:
                df.writeTo(full).using("iceberg").partitionedBy(F.col("case_name")).create()
        else:
            from isotab.sources.registry import jdbc_options

            database, _, sf_schema = self.target.partition(".")
            df.write.format("snowflake").options(sfDatabase=database, sfSchema=sf_schema, dbtable=name, **jdbc_options({})).mode("append").save()

    def _duckdb(self, name: str, rows: list[tuple], schema: T.StructType) -> None:
        import duckdb

        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMPTZ"}
        columns = [(f.name, kinds[f.dataType.simpleString()]) for f in schema]
        with duckdb.connect(self.target) as con:
            con.execute(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'{c} {k}' for c, k in columns)})")
            for c, k in columns:  # tables of older runs may lack columns
                con.execute(f"ALTER TABLE {name} ADD COLUMN IF NOT EXISTS {c} {k}")
            con.executemany(f"INSERT INTO {name} ({', '.join(c for c, _ in columns)}) VALUES ({', '.join('?' * len(columns))})", rows)

    def read(self, table: str) -> DataFrame:
        """run_summary or run_diffs, with columns that older files lack as NULL."""
        name, schema = f"{self.prefix}_{table}", SUMMARY_SCHEMA if table == "run_summary" else DIFFS_SCHEMA
        if self.backend == "duckdb":
            import duckdb

            with duckdb.connect(self.target, read_only=True) as con:
                if not con.execute("SELECT count(*) FROM information_schema.tables WHERE table_name = ?", [name]).fetchone()[0]:
                    return self.spark.createDataFrame([], schema)
                have = {r[0] for r in con.execute(f"DESCRIBE {name}").fetchall()}
                con.execute("SET TimeZone = 'UTC'")
                rows = con.execute(f"SELECT {', '.join(f.name if f.name in have else f'NULL AS {f.name}' for f in schema)} FROM {name}").fetchall()
            return self.spark.createDataFrame(rows, schema)
        if self.backend in ("parquet", "delta"):
            path = f"{self.target.rstrip('/')}/{name}"
            try:
                return self.spark.read.format(self.backend).schema(schema).load(path) if self.backend == "parquet" else self.spark.read.format("delta").load(path)
            except Exception as e:
                if "PATH_NOT_FOUND" in str(e):
                    return self.spark.createDataFrame([], schema)
                raise
        return self.spark.table(f"{self.target}.{name}" if self.target else name)


BACKENDS = ("parquet", "delta", "iceberg", "table", "duckdb", "snowflake")


def make_result_sink(spec: str, run_id: str | None = None, prefix: str = "isotab") -> ResultSink:
    backend, colon, target = spec.partition(":")
    if not colon or backend.strip().lower() not in BACKENDS:
        raise SourceError(f"a result sink is BACKEND:TARGET with one of {', '.join(BACKENDS)}, got {spec!r}")
    return ResultSink(backend.strip().lower(), target, run_id, prefix)


class FingerprintSink:
    """Keeps (run_id, case_name, side, digest, copies) of the compared rows as Parquet, for audits."""

    def __init__(self, folder: str, run_id: str | None = None):
        self.folder, self.run_id = folder, run_id or uuid.uuid4().hex

    def write(self, case: str, side: str, df: DataFrame, cfg: CompareConfig) -> None:
        names = [c for c in (cfg.select or df.columns) if c in df.columns and c not in cfg.ignore_columns]
        counts = df.select(F.hex(row_digest(df, names, cfg.canon())).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
        counts.select(F.lit(self.run_id).alias("run_id"), F.lit(case).alias("case_name"), F.lit(side).alias("side"), "digest", "copies").write.mode("append").parquet(self.folder)
