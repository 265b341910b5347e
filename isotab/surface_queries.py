"""Queries through the outer surface: sources, sinks, reports, case files, command lines. Each plants differences whose
number SQL can tell from the same tables. Files that a query needs are small fixtures, made when it runs."""

from __future__ import annotations

import contextlib
import csv
import datetime as dt
import io
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotab.config import CompareConfig
from isotab.errors import ParityError
from isotab.functions.equivalence import equivalent_sql
from isotab.functions.fingerprint import fields_of, hash_sample
from isotab.operators.compare import compare_tables
from isotab.queries import _PAIR, _summary, derived, query, table
from isotab.report.render import Reports, console_lines, render_markdown
from isotab.sources.registry import describe_source, jdbc_options, load_source
from isotab.sources.sinks import DIFFS_SCHEMA, SUMMARY_SCHEMA, FingerprintSink, ResultSink
from isotab.types import parse_type, type_name


def shared_folder(spark) -> str:
    """A new folder that executors can write to."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="isotab-")
    return f"{base.rstrip('/')}/isotab-{uuid.uuid4().hex}"


def local_folder(**files: str) -> str:
    """A folder on the driver's machine with these text files (`__` in a name stands for a dot)."""
    at = tempfile.mkdtemp(prefix="isotab-")
    for name, text in files.items():
        with open(os.path.join(at, name.replace("__", ".")), "w", encoding="utf-8") as f:
            f.write(text)
    return at


def told(spark, schema: str, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def values(columns: str, *rows: str) -> str:
    """SQL of a fixed result."""
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


# ---------------------------------------------------------------- sources


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_source(spark, d):
    at = shared_folder(spark)
    table(spark, d, "customer").write.option("header", True).csv(at)
    return load_source({"type": "csv", "path": at}, spark=spark)


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS VARCHAR) AS note FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name, p_size + 3000000000, 'new' FROM part WHERE p_partkey % 2 = 1")
def parquet_promotion(spark, d):
    """Two generations of files: the newer has a wider type and one more column."""
    at = shared_folder(spark)
    derived(spark, d, "SELECT p_partkey, p_name, p_size FROM {part} WHERE p_partkey % 2 = 0", "part").write.parquet(f"{at}/g=1")
    derived(spark, d, "SELECT p_partkey, p_name, p_size + 3000000000L AS p_size, 'new' AS note FROM {part} WHERE p_partkey % 2 = 1", "part").write.parquet(f"{at}/g=2")
    return load_source({"type": "parquet", "path": f"{at}/g=*", "lenient": True}, spark=spark).select("p_partkey", "p_name", "p_size", "note")


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS remark FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name, 'later' FROM nation WHERE n_nationkey >= 10")
def parquet_glob(spark, d):
    at = shared_folder(spark)
    table(spark, d, "nation").where("n_nationkey < 10").select("n_nationkey", "n_name").write.parquet(f"{at}/a.parquet")
    table(spark, d, "nation").where("n_nationkey >= 10").select("n_nationkey", "n_name", F.lit("later").alias("remark")).write.parquet(f"{at}/b.parquet")
    return load_source({"type": "parquet", "path": f"{at}/*.parquet"}, spark=spark)


@query("SELECT * FROM nation")
def arrow_source(spark, d):
    import pyarrow.feather as feather

    feather.write_feather(table(spark, d, "nation").toArrow(), os.path.join(at := local_folder(), "nation.feather"))
    return load_source({"type": "feather", "path": "nation.feather"}, at, spark=spark)


@query("SELECT n_regionkey, count(*) AS nations, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation WHERE n_nationkey > 2 GROUP BY 1")
def duckdb_source(spark, d):
    """Setup statements and a query that run in DuckDB."""
    import duckdb

    nation = table(spark, d, "nation").toArrow()  # noqa: F841  read by name below
    with duckdb.connect(os.path.join(at := local_folder(), "n.db")) as con:
        con.execute("CREATE TABLE n AS SELECT * FROM nation")
    spec = {"type": "duckdb", "database": "n.db", "setup": ["DELETE FROM n WHERE n_nationkey <= 2"], "query": "SELECT n_regionkey, count(*) AS nations, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM n GROUP BY 1"}
    return load_source(spec, at, spark=spark)


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sql_source(spark, d):
    name = f"isotab_{uuid.uuid4().hex}"
    spec = {"type": "sql", "setup": [f"CREATE TEMPORARY VIEW {name} AS SELECT * FROM parquet.`{d}/orders.parquet`"], "query": f"SELECT o_orderpriority, count(*) AS n FROM {name} WHERE o_orderstatus = 'F' GROUP BY 1;"}
    out = load_source(spec, spark=spark)
    spark.catalog.dropTempView(name)  # the plan is resolved
    return out


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 = 1")
def query_file_source(spark, d):
    at = local_folder(q__sql=f"SELECT s_suppkey, s_name FROM parquet.`{d}/supplier.parquet` WHERE s_suppkey % ${{Modulus}} = 1\n")
    return load_source({"type": "spark", "query_file": "q.sql"}, at, {"modulus": "4"}, spark)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey <> 3 AND n_name < 'NATION_20'")
def source_filters(spark, d):
    spec = {"type": "parquet", "path": f"{d}/nation.parquet", "row_filter": "n_name < 'NATION_20'", "filters": [["n_regionkey", "in", [1, 3]], ["n_nationkey", "!=", 3]], "columns": ["n_nationkey", "n_name"]}
    return load_source(spec, spark=spark)


@query(values("name, kind", "'int', 'bigint'", "'int32', 'int'", "'INT8', 'tinyint'", "'float', 'double'", "'float32', 'float'", "'str', 'string'", "'bool', 'boolean'", "'timestamp', 'timestamp_ntz'", "'timestamptz', 'timestamp'", "'decimal(12, 3)', 'decimal(12,3)'", "'decimal128(5)', 'decimal(5,0)'", "'list<list<int>>', 'array<array<bigint>>'", "'struct<a:int,b:string>', 'struct<a:int,b:string>'", "'what?', 'SourceError'"))
def type_names(spark, d):
    def kind(name):
        try:
            return type_name(parse_type(name))
        except ParityError as e:
            return type(e).__name__

    names = ["int", "int32", "INT8", "float", "float32", "str", "bool", "timestamp", "timestamptz", "decimal(12, 3)", "decimal128(5)", "list<list<int>>", "struct<a:int,b:string>", "what?"]
    return told(spark, "name string, kind string", [(n, kind(n)) for n in names])


@query(values("source, \"column\", kind", "'parquet', 'n_nationkey', 'int'", "'parquet', 'n_name', 'string'", "'parquet', 'n_regionkey', 'int'", "'csv', 'n_nationkey', 'bigint'", "'csv', 'n_name', 'string'", "'csv', 'n_regionkey', 'bigint'", "'declared', 'a', 'decimal(9,2)'", "'inline', 'b', 'array<bigint>'", "'sql', 'n', 'bigint'"))
def describe_sources(spark, d):
    at = shared_folder(spark)
    table(spark, d, "nation").write.option("header", True).csv(at)
    specs = {"parquet": {"type": "parquet", "path": f"{d}/nation.parquet"}, "csv": {"type": "csv", "path": at}, "declared": {"type": "csv", "path": at, "schema": {"a": "decimal(9,2)"}}, "inline": {"type": "inline", "schema": {"b": "list<int>"}, "rows": []}, "sql": {"type": "sql", "query": f"SELECT count(*) AS n FROM parquet.`{d}/nation.parquet`"}}
    return told(spark, "source string, column string, kind string", [(n, c, k) for n, s in specs.items() for c, k in describe_source(s, spark=spark).items()])


class Recorder:
    """Stands where Spark's reader does, and keeps what a connector asks it for."""

    def __init__(self):
        self.asked: list[tuple[str, str]] = []

    def __getattr__(self, name):
        def call(*args, **options):
            self.asked += [(name, " ".join(map(str, args)))] if args or name == "load" else [(k, str(v)) for k, v in options.items()]
            return self

        return self if name == "read" else call


@query(values("source, setting, value", "'iceberg', 'format', 'iceberg'", "'iceberg', 'load', 'lake.db.t'", "'delta', 'format', 'delta'", "'delta', 'option', 'versionAsOf 3'", "'delta', 'load', '/d'", "'delta_at', 'format', 'delta'", "'delta_at', 'endpoint', 'e'", "'delta_at', 'option', 'timestampAsOf 2024-01-01'", "'delta_at', 'load', '/d'",
              "'trino', 'format', 'jdbc'", "'trino', 'url', 'jdbc:trino://h:81/c/s'", "'trino', 'driver', 'io.trino.jdbc.TrinoDriver'", "'trino', 'user', 'u'", "'trino', 'option', 'query SELECT 1'", "'trino', 'load', ''",
              "'snowflake', 'format', 'snowflake'", "'snowflake', 'sfURL', 'acc'", "'snowflake', 'sfUser', 'u'", "'snowflake', 'sfDatabase', 'DB'", "'snowflake', 'sfSchema', 'S'", "'snowflake', 'option', 'dbtable T'", "'snowflake', 'load', ''", "'jdbc', 'format', 'jdbc'", "'jdbc', 'url', 'jdbc:x'", "'jdbc', 'password', 'not in the file'", "'jdbc', 'option', 'dbtable t'", "'jdbc', 'load', ''"))
def connector_requests(spark, d):
    """What the sources of other systems ask their connector for (none is installed here)."""
    os.environ["ISOTAB_TEST_SECRET"] = "not in the file"
    specs = {
        "iceberg": {"type": "iceberg", "catalog": "lake", "table": "db.t"}, "delta": {"type": "delta", "path": "/d", "version": 3}, "delta_at": {"type": "delta", "path": "/d", "timestamp": "2024-01-01", "storage_options": {"endpoint": "e"}},
        "trino": {"type": "trino", "host": "h", "port": 81, "catalog": "c", "schema": "s", "user": "u", "query": "SELECT 1"}, "snowflake": {"type": "snowflake", "account": "acc", "user": "u", "database": "DB", "schema": "S", "table": "T"}, "jdbc": {"type": "jdbc", "url": "jdbc:x", "table": "t", "password_env": "ISOTAB_TEST_SECRET"},
    }
    out = []
    for name, spec in specs.items():
        load_source(spec, spark=(asked := Recorder()))
        out += [(name, *x) for x in asked.asked]
    return told(spark, "source string, setting string, value string", out)


@query(values("\"case\", outcome", "'set', 'token=t0'", "'unset', 'SourceError'", "'in the file', 'SourceError'"))
def secret_options(spark, d):
    os.environ["ISOTAB_TEST_TOKEN"] = "t0"
    out = []
    for name, spec in (("set", {"token_env": "ISOTAB_TEST_TOKEN"}), ("unset", {"token_env": "ISOTAB_TEST_NO_SUCH"}), ("in the file", {"password": "x"})):
        try:
            out.append((name, ",".join(f"{k}={v}" for k, v in jdbc_options(spec).items())))
        except ParityError as e:
            out.append((name, type(e).__name__))
    return told(spark, "case string, outcome string", out)


@query("SELECT CAST(count(*) AS BIGINT) AS sampled, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS keys, true AS both_sides_alike FROM orders")
def hash_sample_partition(spark, d):
    """The remainders of a keyed sample part the table, and a table in another order gives the same keys."""
    from functools import reduce

    orders = table(spark, d, "orders")
    parts = reduce(DataFrame.unionAll, [hash_sample(orders, ["o_orderkey"], 5, r).select("o_orderkey") for r in range(5)])
    left, right = (hash_sample(x, ["o_orderkey"], 7, 3).select("o_orderkey") for x in (orders, orders.orderBy(F.desc("o_totalprice"))))
    alike = left.exceptAll(right).union(right.exceptAll(left)).agg((F.count(F.lit(1)) == 0).alias("both_sides_alike"))
    return parts.agg(F.count(F.lit(1)).alias("sampled"), F.countDistinct("o_orderkey").alias("keys")).join(alike, how="cross")


# ---------------------------------------------------------------- sinks and reports, of one comparison of nations

NATIONS = "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN concat(n_name, '!') ELSE n_name END AS n_name, n_regionkey FROM {nation} WHERE n_nationkey <> 7 UNION ALL SELECT 100 AS n_nationkey, 'NEW' AS n_name, 0 AS n_regionkey"
_CHANGED = "count(*) FILTER (n_nationkey % 5 = 0 AND n_nationkey <> 7)"
_COUNTS = f"count(*) AS expected_rows, count(*) FILTER (n_nationkey <> 7) + 1 AS actual_rows, count(*) FILTER (n_nationkey = 7) AS missing_count, CAST(1 AS BIGINT) AS added_count, {_CHANGED} AS changed_count"


def nations(spark, d, **options):
    return compare_tables(table(spark, d, "nation"), derived(spark, d, NATIONS, "nation"), CompareConfig(**{"keys": ["n_nationkey"], **options}))


def _kept(spark, d, backend: str, target: str, which: str) -> DataFrame:
    sink = ResultSink(backend, target, spark=spark)
    sink.write("nations", ["daily"], nations(spark, d))
    sink.write("same", [], compare_tables(table(spark, d, "nation"), table(spark, d, "nation")))
    return sink.read(which)


_KEPT = f"SELECT 'nations' AS case_name, '[\"daily\"]' AS tags, false AS equivalent, {_COUNTS}, '[\"n_nationkey\"]' AS keys FROM nation UNION ALL SELECT 'same', '[]', true, count(*), count(*), 0, 0, 0, NULL FROM nation"


def _summary_columns(df: DataFrame) -> DataFrame:
    return df.select("case_name", "tags", "equivalent", "expected_rows", "actual_rows", "missing_count", "added_count", "changed_count", "keys")


@query(_KEPT)
def result_sink_summary(spark, d):
    return _summary_columns(_kept(spark, d, "parquet", shared_folder(spark), "run_summary"))


@query(_KEPT)
def result_sink_duckdb(spark, d):
    return _summary_columns(_kept(spark, d, "duckdb", f"{local_folder()}/runs.db", "run_summary"))


@query("""SELECT 'missing' AS diff_kind, '["7"]' AS key_json, CAST(NULL AS VARCHAR) AS old_name, CAST(NULL AS VARCHAR) AS new_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'added', '["100"]', NULL, NULL
UNION ALL SELECT 'changed', '["' || n_nationkey || '"]', n_name, n_name || '!' FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey <> 7""")
def result_sink_diffs(spark, d):
    cell = F.from_json("column_diffs", "array<struct<column string, expected string, actual string>>")[0]
    return _kept(spark, d, "parquet", shared_folder(spark), "run_diffs").select("diff_kind", "key_json", cell["expected"].alias("old_name"), cell["actual"].alias("new_name"))


@query("SELECT 'expected' AS side, count(*) AS digests, CAST(sum(n) AS BIGINT) AS copies FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) UNION ALL SELECT 'actual', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_nationkey, c_mktsegment)")
def fingerprint_sink(spark, d):
    sink = FingerprintSink(at := shared_folder(spark), "r")
    cfg = CompareConfig(select=["c_nationkey", "c_mktsegment"])
    sink.write("c", "expected", table(spark, d, "customer"), cfg)
    sink.write("c", "actual", table(spark, d, "customer").where("c_custkey % 3 = 0"), cfg)
    return spark.read.parquet(at).groupBy("side").agg(F.countDistinct("digest").alias("digests"), F.sum("copies").alias("copies"))


@query(f"""WITH c AS (SELECT {_COUNTS} FROM nation) SELECT 1 AS line, '[DIFFERENT] keyed on [''n_nationkey''] | expected=' || expected_rows || ' actual=' || actual_rows || ' | missing=' || missing_count || ' added=1 changed=' || changed_count AS text FROM c
UNION ALL SELECT 2, '  changed columns:' UNION ALL SELECT 3, '    ' || changed_count || 'x  {{{{n_name}}}} e.g. key=(0): n_name: ''NATION_0'' -> ''NATION_0!''' FROM c UNION ALL SELECT 4, '  - MISSING (only in expected): key=(7)' UNION ALL SELECT 5, '  + ADDED (only in actual): key=(100)'
UNION ALL SELECT 6, '  … and ' || (missing_count + added_count + changed_count - 2) || ' more' FROM c""".replace("{{", "' || chr(123) || '").replace("}}", "' || chr(125) || '"))
def console_report(spark, d):
    return told(spark, "line int, text string", enumerate(console_lines(nations(spark, d, max_examples=2)), 1))


@query("""SELECT 'key' AS field, 30 AS n, true AS cut UNION ALL SELECT 'shown', 20, false""")
def console_caps(spark, d):
    """A list of 30 names is cut after 20."""
    wide = table(spark, d, "region").select("r_regionkey", *[F.lit(k).alias(f"c{k:02}") for k in range(30)])
    line = next(x for x in console_lines(compare_tables(wide, table(spark, d, "region").select("r_regionkey"))) if "only in expected" in x)
    return told(spark, "field string, n int, cut boolean", [("key", int(line.split("(")[1].split(")")[0]), "and 10 more" in line), ("shown", line.count("c") - line.count("columns") - line.count("expected"), False)])


@query(f"SELECT key, CASE key WHEN 'missing' THEN missing_count WHEN 'added' THEN added_count WHEN 'changed' THEN changed_count WHEN 'expected_rows' THEN expected_rows ELSE changed_count END AS value FROM (SELECT {_COUNTS} FROM nation), (SELECT unnest(['missing', 'added', 'changed', 'expected_rows', 'change_signatures']) AS key)")
def json_report(spark, d):
    (files := Reports(json_path=f"{local_folder()}/r.json")).add("nations", nations(spark, d))
    files.close()
    with open(files.json_path, encoding="utf-8") as f:
        got = json.load(f)[0]
    got["change_signatures"] = sum(s["count"] for s in got["change_signatures"])
    return told(spark, "key string, value long", [(k, got[k]) for k in ("missing", "added", "changed", "expected_rows", "change_signatures")])


@query(f"SELECT '**1/2 cases equivalent**' AS line UNION ALL SELECT '| nations | ❌ different | ' || concat_ws(' | ', expected_rows, actual_rows, missing_count, added_count, changed_count) || ' |' FROM (SELECT {_COUNTS} FROM nation) UNION ALL SELECT '| same | ✅ equivalent | ' || concat_ws(' | ', count(*), count(*), 0, 0, 0) || ' |' FROM nation")
def markdown_report(spark, d):
    same = compare_tables(table(spark, d, "nation"), table(spark, d, "nation"))
    text = render_markdown([("nations", nations(spark, d)), ("same", same)]).split("\n")
    return told(spark, "line string", [(x,) for x in text if x.startswith(("**", "| nations", "| same"))])


@query(f"SELECT * FROM (VALUES ('MATCHED', 'n_nationkey', '') , ('MATCHED - TYPE DIFF', 'n_regionkey', '') , ('DIFF', 'only_left', ''), ('DIFF', 'only_right', '')) AS t(status, \"column\", diff_rows) UNION ALL SELECT 'MATCHED - VALUE DIFF', 'n_name', CAST({_CHANGED} AS VARCHAR) FROM nation UNION ALL SELECT 'MATCHED - EQUIVALENT', 'gone', CAST(count(*) FILTER (n_nationkey <> 7) AS VARCHAR) FROM nation")
def column_report_file(spark, d):
    """The CSV file by column, with every status."""
    e = derived(spark, d, "SELECT *, 1 AS only_left, CAST(NULL AS STRING) AS gone FROM {nation}", "nation")
    a = derived(spark, d, NATIONS, "nation").selectExpr("n_nationkey", "n_name", "cast(n_regionkey as bigint) as n_regionkey", "1 as only_right", "'' as gone")
    (files := Reports(folder=local_folder())).add("a case/1", compare_tables(e, a, CompareConfig(keys=["n_nationkey"], null_equivalence=True)))
    (name,) = os.listdir(files.folder)
    with open(os.path.join(files.folder, name), encoding="utf-8", newline="") as f:
        return told(spark, "status string, column string, diff_rows string", [(r["status"], r["column"], r["diff_rows"]) for r in csv.DictReader(f)])


_DAYS = "SELECT event_type AS case_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(user_id % 3 = 0, (ts, CAST(event_id AS VARCHAR))) AS equivalent FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1, 2"


@query(_DAYS)
def html_history(spark, d):
    """The data in the page of the run history."""
    from isotab.report.html import history_tables, render_html

    runs = derived(spark, d, "SELECT CAST(event_id AS STRING) AS run_id, CAST(ts AS TIMESTAMP) AS run_ts, event_type AS case_name, user_id % 3 = 0 AS equivalent FROM {events}", "events")
    runs = runs.select(*[F.col(f.name) if f.name in runs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SUMMARY_SCHEMA])
    page = render_html(history_tables(runs, spark.createDataFrame([], DIFFS_SCHEMA), 5, dt.datetime(2024, 1, 30, tzinfo=dt.UTC)))
    data = json.loads(page.split("const DATA=")[1].split(";\nconst root")[0])
    return told(spark, "case_name string, day string, equivalent boolean", [(case, r[0], r[1]) for case, tables in data.items() for r in tables[0]["rows"]])


@query("SELECT event_type AS case_name, 'c' || (user_id % 3) AS columns, count(*) AS n FROM events e JOIN (SELECT event_type, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1) USING (event_type) WHERE CAST(ts AS DATE) = last AND event_id % 2 = 1 GROUP BY 1, 2")
def latest_signatures(spark, d):
    """Sets of columns that changed in the last run of each case; a run is a day of events here."""
    from isotab.operators.history import daily_points, latest_changes, signature_counts

    runs = derived(spark, d, "SELECT CAST(CAST(ts AS DATE) AS STRING) AS run_id, max(CAST(ts AS TIMESTAMP)) AS run_ts, event_type AS case_name, false AS equivalent FROM {events} GROUP BY 1, 3", "events")
    runs = runs.select(*[F.col(f.name) if f.name in runs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SUMMARY_SCHEMA])
    cell = F.to_json(F.array(F.struct(F.concat(F.lit("c"), F.col("user_id") % 3).alias("column"), F.lit("1").alias("expected"), F.lit("2").alias("actual"))))
    diffs = table(spark, d, "events").where("event_id % 2 = 1").select(F.to_date("ts").cast("string").alias("run_id"), F.col("event_type").alias("case_name"), F.lit("changed").alias("diff_kind"), F.col("event_id").cast("string").alias("key_json"), cell.alias("column_diffs"))
    points = daily_points(runs, 60, dt.datetime(2024, 1, 31, tzinfo=dt.UTC))
    return signature_counts(latest_changes(points, diffs)).select("case_name", F.array_join("columns", ",").alias("columns"), "n")


@query(f"""{_PAIR}, s AS (SELECT concat_ws(',', CASE WHEN e.o_custkey <> a.o_custkey THEN 'o_custkey' END, CASE WHEN e.o_orderstatus <> a.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN e.o_totalprice <> a.o_totalprice THEN 'o_totalprice' END) AS signature FROM e JOIN a USING (o_orderkey))
SELECT CAST(row_number() OVER (ORDER BY n DESC, signature) AS INTEGER) AS place, signature, n FROM (SELECT signature, count(*) AS n FROM s WHERE signature <> '' GROUP BY 1)""")
def patterns_by_count(spark, d):
    from isotab.queries import ORDERS, ORDERS_NEW

    r = compare_tables(derived(spark, d, ORDERS, "orders"), derived(spark, d, ORDERS_NEW, "orders"), CompareConfig(keys=["o_orderkey"], max_examples=1))
    return told(spark, "place int, signature string, n long", [(i, ",".join(p.columns), p.rows) for i, p in enumerate(r.patterns, 1)])


# ---------------------------------------------------------------- options, columns and errors


@query(values("strict, equivalent", "false, true", "true, false"))
def strict_columns(spark, d):
    e, a = table(spark, d, "region"), derived(spark, d, "SELECT *, 1 AS more FROM {region}", "region")
    return told(spark, "strict boolean, equivalent boolean", [(s, compare_tables(e, a, CompareConfig(strict_columns=s)).equivalent) for s in (False, True)])


@query(values("\"column\"", "'n_nationkey'", "'n_regionkey'"))
def exclusions_file(spark, d):
    """Columns of a CSV file for one table, beside those of the case."""
    from isotab.cases.loader import build_case

    at = local_folder(skip__csv="﻿Table , COLUMN\nNation,n_name\nother,n_nationkey\nnation,n_name\nnation,no_such\n")
    case = build_case({"name": "x", "expected": {"type": "parquet", "path": f"{d}/nation.parquet"}, "actual": {"type": "sql", "query": f"SELECT n_nationkey, 'x' AS n_name, n_regionkey, 1 AS more FROM parquet.`{d}/nation.parquet`"}, "compare": {"ignore_columns": ["more"], "ignore_columns_file": "skip.csv", "ignore_columns_table": "NATION"}})
    r = case.run(at)
    return told(spark, "column string", [(c,) for c in r.schema.compared] if r.equivalent else [])


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (n_nationkey % 4 = 0) AS changed FROM nation")
def quoted_names(spark, d):
    left = "SELECT n_nationkey AS `the key`, n_name AS `a``b.c` , n_regionkey AS `select` FROM {nation}"
    right = "SELECT n_nationkey AS `the key`, CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE n_name END AS `a``b.c`, n_regionkey AS `select` FROM {nation}"
    return _summary(spark, d, left, right, ("nation",), keys=["the key"])


@query(values("what, error", "'key', 'MissingKeyError'", "'option', 'CaseError'", "'engine', 'CaseError'", "'name', 'CaseError'", "'schema field', 'SchemaCheckError'", "'concept', 'ConceptCheckError'", "'coverage', 'CoverageError'", "'parameter', 'ParamError'", "'exclusion', 'ExclusionError'", "'source', 'SourceError'"))
def errors_by_cause(spark, d):
    from isotab.cases.exclusions import load_exclusions
    from isotab.cases.loader import build_case
    from isotab.operators.schema import check_concepts, load_usage

    nation = table(spark, d, "nation")
    inline = {"type": "inline", "rows": []}
    skip = local_folder(skip__csv="table,column\na,b\n") + "/skip.csv"
    causes = {
        "key": lambda: compare_tables(nation, nation, CompareConfig(keys=["none"])), "option": lambda: build_case({"name": "n", "expected": inline, "actual": inline, "compare": {"typo": 1}}).config(), "engine": lambda: build_case({"name": "n", "expected": inline, "actual": inline, "engine": "abacus"}),
        "name": lambda: build_case({"expected": inline}), "schema field": lambda: build_case({"name": "n", "schema_check": {"expected": inline, "actual": inline, "keys": []}}), "concept": lambda: check_concepts({"a": {"x": "int"}}, {}, [{"source": "b", "column": "x", "target": "y"}]), "coverage": lambda: load_usage({}, "."),
        "parameter": lambda: build_case({"name": "${no}", "expected": inline, "actual": inline}), "exclusion": lambda: load_exclusions(skip, "b"), "source": lambda: load_source({"type": "none"}),
    }
    out = []
    for what, f in causes.items():
        try:
            f()
            out.append((what, "none"))
        except ParityError as e:
            out.append((what, type(e).__name__))
    return told(spark, "what string, error string", out)


@query("SELECT vectorized, count(*) FILTER (n_nationkey = 7) AS missing, CAST(1 AS BIGINT) AS added FROM nation, (SELECT unnest([true, false]) AS vectorized) GROUP BY 1")
def vectorized_flag(spark, d):
    right = NATIONS.replace("n_nationkey % 5 = 0", "false")
    out = [_summary(spark, d, "SELECT * FROM {nation}", right, ("nation",), vectorized=v).withColumn("vectorized", F.lit(v)) for v in (True, False)]
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- values of other types, with planted differences


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (event_id % 9 = 0) AS changed FROM events")
def bool_values(spark, d):
    return _summary(spark, d, "SELECT event_id, user_id % 2 = 0 AS b FROM {events}", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN user_id % 2 <> 0 ELSE user_id % 2 = 0 END AS b FROM {events}", ("events",), keys=["event_id"])


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (event_id % 8 = 3) AS changed FROM events")
def binary_values(spark, d):
    return _summary(spark, d, "SELECT event_id, unhex(lower(hex(event_type))) AS x FROM {events}", "SELECT event_id, CASE WHEN event_id % 8 = 3 THEN unhex(concat(hex(event_type), '00')) ELSE unhex(hex(event_type)) END AS x FROM {events}", ("events",), keys=["event_id"])


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (event_id % 10 = 4) AS changed FROM events")
def time_values(spark, d):
    spark.conf.set("spark.sql.timeType.enabled", "true")  # as isotab.session does
    left = "SELECT event_id, to_time(date_format(ts, 'HH:mm:ss')) AS t FROM {events}"
    right = "SELECT event_id, CASE WHEN event_id % 10 = 4 THEN CAST(NULL AS TIME) ELSE to_time(date_format(ts, 'HH:mm:ss')) END AS t FROM {events}"
    return _summary(spark, d, left, right, ("events",), keys=["event_id"])


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (event_id % 6 = 1) AS changed FROM events")
def interval_values(spark, d):
    return _summary(spark, d, "SELECT event_id, make_dt_interval(0, cast(user_id % 24 as int)) AS i FROM {events}", "SELECT event_id, make_dt_interval(0, cast(user_id % 24 as int), if(event_id % 6 = 1, 1, 0)) AS i FROM {events}", ("events",), keys=["event_id"])


@query("SELECT options, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, CASE options WHEN 'none' THEN count(*) FILTER (event_id % 6 < 5) WHEN 'tolerance' THEN count(*) FILTER (event_id % 6 IN (0, 2, 3, 4)) WHEN 'text' THEN count(*) FILTER (event_id % 6 IN (0, 1, 4)) ELSE count(*) FILTER (event_id % 6 < 4) END AS changed FROM events, (SELECT unnest(['none', 'tolerance', 'text', 'unordered']) AS options) GROUP BY options")
def variant_values(spark, d):
    """Options reach into a variant; the order of its fields never counts."""
    left = """SELECT event_id, parse_json('{{"n": 1.25, "s": "Ab", "l": [1, 2], "z": null}}') AS v FROM {events}"""
    made = {0: '{{"l": [1, 2], "n": 7, "s": "Ab", "z": null}}', 1: '{{"l": [1, 2], "n": 1.2500001, "s": "Ab", "z": null}}', 2: '{{"l": [1, 2], "n": 1.25, "s": "aB", "z": null}}', 3: '{{"l": [1, 2], "n": 1.25, "s": " Ab", "z": null}}', 4: '{{"l": [2, 1], "n": 1.25, "s": "Ab", "z": null}}', 5: '{{"z": null, "l": [1, 2], "s": "Ab", "n": 1.25}}'}
    right = f"SELECT event_id, parse_json(CASE event_id % 6 {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in made.items())} END) AS v FROM {{events}}"
    options = {"none": {}, "tolerance": {"float_tolerance": 0.001}, "text": {"trim_strings": True, "case_insensitive": True}, "unordered": {"unordered_list_columns": ["v"]}}
    out = [_summary(spark, d, left, right, ("events",), keys=["event_id"], **o).withColumn("options", F.lit(n)) for n, o in options.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT exact, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, CASE WHEN exact THEN count(*) FILTER (c_custkey % 11 = 0) ELSE count(*) END AS changed FROM customer, (SELECT unnest([true, false]) AS exact) GROUP BY exact")
def casefold_exact(spark, d):
    left, right = "SELECT c_custkey, concat(c_name, ' STRASSE') AS n FROM {customer}", "SELECT c_custkey, concat(c_name, if(c_custkey % 11 = 0, '!', ''), ' straße') AS n FROM {customer}"
    out = [_summary(spark, d, left, right, ("customer",), keys=["c_custkey"], case_insensitive=True, exact_casefold=x).withColumn("exact", F.lit(x)) for x in (True, False)]
    return out[0].unionByName(out[1])


@query("SELECT event_id, event_id % 5 IN (0, 1, 4) AS equivalent FROM events")
def null_equivalence_lists(spark, d):
    df = derived(spark, d, "SELECT event_id, array(CAST(NULL AS STRING), 'x') AS e, CASE event_id % 5 WHEN 0 THEN array('', 'x') WHEN 1 THEN array('None', 'x') WHEN 2 THEN array('y', 'x') WHEN 3 THEN array('x') ELSE array(CAST(NULL AS STRING), 'x') END AS a FROM {events}", "events")
    kinds = fields_of(df)
    return df.select("event_id", F.expr(equivalent_sql("e", kinds["e"], "a", kinds["a"])).alias("equivalent"))


@query("SELECT event_id, event_id % 4 <> 3 AS equivalent FROM events")
def null_equivalence_numbers(spark, d):
    df = derived(spark, d, "SELECT event_id, CAST(NULL AS BIGINT) AS e, CASE event_id % 4 WHEN 0 THEN 0D WHEN 1 THEN -0.0D WHEN 2 THEN NULL ELSE 0.5D END AS a FROM {events}", "events").withColumn("a", F.when(F.col("event_id") % 4 == 1, F.lit(0.0)).otherwise(F.col("a")))
    kinds = fields_of(df)
    return df.select("event_id", F.expr(equivalent_sql("e", kinds["e"], "a", kinds["a"])).alias("equivalent"))


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (cheap > 0) AS changed FROM (SELECT o_custkey, count(*) FILTER (o_totalprice < 50000) AS cheap FROM orders GROUP BY 1)")
def map_from_rows(spark, d):
    """Maps collected from rows with a filter, in another order, against maps that keep the filtered rows."""
    entries = "map_from_entries(array_sort(collect_list(struct(o_orderkey, o_orderstatus)) FILTER (WHERE o_totalprice >= 50000)))"
    left = f"SELECT o_custkey, {entries} AS m FROM {{orders}} GROUP BY 1"
    right = f"SELECT o_custkey, {entries.replace(' FILTER (WHERE o_totalprice >= 50000)', '').replace('array_sort', 'reverse')} AS m FROM {{orders}} GROUP BY 1"
    return _summary(spark, d, left, right, ("orders",), keys=["o_custkey"])


# ---------------------------------------------------------------- case files and command lines

_FILE = """
vars: {drop: 7}
param_queries:
  top: {type: sql, query: "SELECT max(n_nationkey) FROM parquet.`DIR/nation.parquet` WHERE n_nationkey <> ${drop}"}
defaults:
  tags: [daily]
  compare: {keys: [n_nationkey], max_examples: 3}
cases:
  - name: same
    expected: {type: parquet, path: DIR/nation.parquet}
    actual: {type: sql, query: "SELECT * FROM parquet.`DIR/nation.parquet`"}
  - name: dropped
    tags: [xfail]
    expected: {type: parquet, path: DIR/nation.parquet}
    actual: {type: sql, query: "SELECT * FROM parquet.`DIR/nation.parquet` WHERE n_nationkey NOT IN (${DROP}, ${top})"}
  - name: keyless
    vars: {drop: 9}
    tags: [xfail]
    expected: {type: parquet, path: DIR/nation.parquet}
    actual: {type: parquet, path: DIR/nation.parquet, row_filter: "n_nationkey > ${drop}"}
    compare: {keys: null}
  - name: schema
    schema_check: {expected: {type: parquet, path: DIR/nation.parquet}, actual: {type: inline, schema: {n_nationkey: int32, n_name: string, n_regionkey: int32}, rows: []}}
"""


@query("""SELECT * FROM (SELECT 'same' AS name, true AS equivalent, count(*) AS expected_rows, CAST(0 AS BIGINT) AS missing FROM nation UNION ALL SELECT 'dropped', false, count(*), count(*) FILTER (n_nationkey IN (7, (SELECT max(n_nationkey) FROM nation WHERE n_nationkey <> 7))) FROM nation
UNION ALL SELECT 'keyless', false, count(*), count(*) FILTER (n_nationkey <= 9) FROM nation UNION ALL SELECT 'schema', true, 0, 0)""")
def case_file(spark, d):
    """Defaults, variables, a queried parameter and four kinds of case."""
    from isotab.cases.loader import load_cases_from_file

    at = local_folder(c__yaml=_FILE.replace("DIR", os.path.abspath(d)))
    got = [(c.name, c.run()) for c in load_cases_from_file(f"{at}/c.yaml")]
    return told(spark, "name string, equivalent boolean, expected_rows long, missing long", [(n, r.equivalent, r.counts.expected_rows, r.counts.missing) for n, r in got])


@query("SELECT 'file' AS pinned, count(*) FILTER (n_nationkey IN (7, (SELECT max(n_nationkey) FROM nation WHERE n_nationkey <> 7))) AS missing FROM nation UNION ALL SELECT 'command line', count(*) FILTER (n_nationkey IN (3, 4)) FROM nation UNION ALL SELECT 'environment', count(*) FILTER (n_nationkey IN (5, (SELECT max(n_nationkey) FROM nation WHERE n_nationkey <> 5))) FROM nation")
def case_parameters(spark, d):
    """File variables < environment < command line; a pinned parameter isn't queried."""
    from isotab.cases.loader import load_cases_from_file
    from isotab.cases.params import ENV_PREFIX, parse_cli_params

    at, out = local_folder(c__yaml=_FILE.replace("DIR", os.path.abspath(d))), []
    for pinned, env, cli in (("file", None, []), ("command line", "5", ["drop=3", "top=4"]), ("environment", "5", [])):
        if env:
            os.environ[f"{ENV_PREFIX}DROP"] = env
        try:
            case = next(c for c in load_cases_from_file(f"{at}/c.yaml", parse_cli_params(cli)) if c.name == "dropped")
        finally:
            os.environ.pop(f"{ENV_PREFIX}DROP", None)
        out.append((pinned, case.run().counts.missing))
    return told(spark, "pinned string, missing long", out)


@query(values("place, name", "1, 'a'", "2, 'b'", "3, 'deep'"))
def case_discovery(spark, d):
    """Case files of a folder and those below it, by path; coverage cases have their own command."""
    from isotab.cases.loader import discover_cases

    one = "name: {}\nexpected: {{type: inline, rows: []}}\nactual: {{type: inline, rows: []}}\n"
    at = local_folder(b__yml=one.format("b"), a__yaml=one.format("a"), note__txt="no case", v__yaml="name: v\ncoverage_check: {source: {type: inline, rows: []}, usage_columns: [x]}\n")
    os.makedirs(f"{at}/sub")
    with open(f"{at}/sub/c.yaml", "w", encoding="utf-8") as f:
        f.write(one.format("deep"))
    return told(spark, "place int, name string", [(i, c.name) for i, c in enumerate(discover_cases(at), 1)])


def _quiet(f, *args) -> tuple[int, list[str]]:
    with contextlib.redirect_stdout(io.StringIO()) as out, contextlib.redirect_stderr(io.StringIO()):
        return f(list(args)), out.getvalue().splitlines()


@query(values("command, code, last", "'run', 0, '4/4 as expected'", "'run --select same', 0, '1/1 as expected'", "'run --param drop=-1 --param top=-1', 1, '2/4 as expected'", "'run --select none', 2, ''", "'run /no/such', 2, ''"))
def cli_run(spark, d):
    from isotab.cli import main

    at = local_folder(c__yaml=_FILE.replace("DIR", os.path.abspath(d)))
    out = []
    for options in ("", "--select same", "--param drop=-1 --param top=-1", "--select none", "/no/such"):
        path = [options] if options.startswith("/") else [at, *options.split()]
        code, lines = _quiet(main, "run", *path)
        out.append((f"run {options}".strip(), code, lines[-1] if lines else ""))
    return told(spark, "command string, code int, last string", out)


@query(values("line", "'same  [daily]'", "'dropped  [xfail]'", "'keyless  [xfail]'", "'schema  [daily]'", "'report 0 has data: true'"))
def cli_list_and_report(spark, d):
    from isotab.cli import main

    at = local_folder(c__yaml=_FILE.replace("DIR", os.path.abspath(d)))
    lines = [x.split("  (")[0] for x in _quiet(main, "list", at)[1]]
    sink = f"duckdb:{at}/runs.db"
    _quiet(main, "run", at, "--result-sink", sink)
    code, _ = _quiet(main, "report", "--result-sink", sink, "--html", f"{at}/h.html")
    with open(f"{at}/h.html", encoding="utf-8") as f:
        has = all(f'"{name}"' in (page := f.read() if i == 0 else page) for i, name in enumerate(("same", "dropped", "keyless", "schema")))
    return told(spark, "line string", [(x,) for x in [*lines, f"report {code} has data: {str(has).lower()}"]])


@query(values("name, outcome", "'same', 'passes'", "'dropped', 'shows the difference'", "'keyless', 'shows the difference'", "'schema', 'passes'"))
def pytest_helper(spark, d):
    from isotab import assert_case, load_cases

    out = []
    for case in load_cases(local_folder(c__yaml=_FILE.replace("DIR", os.path.abspath(d)))):
        try:
            assert_case(case)
            out.append((case.name, "passes"))
        except AssertionError as e:
            out.append((case.name, "shows the difference" if "MISSING (only in expected)" in str(e) else str(e)))
    return told(spark, "name string, outcome string", out)


@query(values("code, status, usage_column, source_column, source_type", "1, 'MAPPED', 'P_NAME', 'p_name', 'text'", "1, 'MAPPED', 'p_size', 'p_size', 'int'", "1, 'UNMAPPED', 'p_color', '', ''", *[f"1, 'UNREFERENCED', '', '{c}', ''" for c in ("p_partkey", "p_brand", "p_type", "p_retailprice")]))
def coverage_cli(spark, d):
    from isotab.coverage_cli import main

    at = local_folder(v__yaml=f"name: v\ncoverage_check: {{source: {{type: parquet, path: {os.path.abspath(d)}/part.parquet}}, usage_file: use.txt, schema_file: s.csv}}\n", use__txt="P_NAME  # the name\n\np_size\np_color\n", s__csv="column_name,type,description\np_name,text,a name\n")
    code, _ = _quiet(main, "coverage", at, "--csv", f"{at}/out.csv")
    with open(f"{at}/out.csv", encoding="utf-8", newline="") as f:
        return told(spark, "code int, status string, usage_column string, source_column string, source_type string", [(code, r["status"], r["usage_column"], r["source_column"], r["source_type"]) for r in csv.DictReader(f)])


@query(values("ignored, equivalent, mismatches", "false, false, 'n_regionkey'", "true, true, ''"))
def schema_check_case(spark, d):
    from isotab.cases.loader import build_case

    spec = {"expected": {"type": "parquet", "path": f"{d}/nation.parquet"}, "actual": {"type": "inline", "schema": {"n_nationkey": "int32", "n_name": "string", "n_regionkey": "int"}, "rows": []}}
    out = []
    for ignored in (False, True):
        r = build_case({"name": "s", "schema_check": {**spec, **({"ignore_columns": ["n_regionkey"]} if ignored else {})}}).run()
        out.append((ignored, r.equivalent, ",".join(t[0] for t in r.schema.retyped)))
    return told(spark, "ignored boolean, equivalent boolean, mismatches string", out)

