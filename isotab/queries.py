"""The catalogue of queries over the test tables, and the same results in DuckDB's SQL.

Where a comparison needs a second table, it is a pure function of the first, written in SQL that both engines read.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotab.config import CompareConfig
from isotab.functions.equivalence import equivalent_sql
from isotab.functions.fingerprint import fields_of, hash_sample
from isotab.operators.compare import plan_for
from isotab.operators.history import column_diff_counts, consecutive_failures, failure_counts, latest_per_day, missing_key_counts
from isotab.operators.schema import check_concepts, check_coverage, check_schemas
from isotab.plans.resolve import resolve
from isotab.sources.registry import load_source
from isotab.sources.sinks import DIFFS_SCHEMA, SUMMARY_SCHEMA

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.replace("{", "").replace("}", "").split()) if "{" in sql else sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """SQL over test tables, written {like_this}, without registering views."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


# ---------------------------------------------------------------- keyed comparison of orders

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_O_NEW = "CASE WHEN o_orderkey % 109 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 113 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority"
ORDERS = f"SELECT {_O} FROM {{orders}}"
ORDERS_NEW = f"SELECT o_orderkey, {_O_NEW} FROM {{orders}} WHERE o_orderkey % 97 <> 0 UNION ALL SELECT o_orderkey, {_O_NEW} FROM {{orders}} WHERE o_orderkey % 97 <> 0 AND o_orderkey % 103 = 0 UNION ALL SELECT o_orderkey + 100000000 AS o_orderkey, {_O_NEW} FROM {{orders}} WHERE o_orderkey % 107 = 0"
_E, _A = ORDERS.replace("{", "").replace("}", ""), ORDERS_NEW.replace("{", "").replace("}", "")
_PAIR = f"WITH e AS ({_E}), a0 AS ({_A}), a AS (SELECT DISTINCT * FROM a0)"


def _orders_plan(spark: SparkSession, d: str, **options):
    cfg = CompareConfig(**{"keys": ["o_orderkey"], **options})
    return plan_for(derived(spark, d, ORDERS, "orders"), derived(spark, d, ORDERS_NEW, "orders"), cfg)[0]


@query(f"""{_PAIR} SELECT (SELECT count(*) FROM e) AS expected_rows, (SELECT count(*) FROM a0) AS actual_rows,
(SELECT count(*) FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)) AS missing, (SELECT count(*) FROM a0 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)) AS added,
CAST(0 AS BIGINT) AS duplicate_keys_expected, (SELECT count(*) - count(DISTINCT o_orderkey) FROM a0) AS duplicate_keys_actual,
(SELECT count(*) FROM e JOIN a USING (o_orderkey) WHERE e.o_custkey <> a.o_custkey OR e.o_orderstatus <> a.o_orderstatus OR e.o_totalprice <> a.o_totalprice) AS changed""")
def keyed_summary_orders(spark, d):
    return _orders_plan(spark, d).full_summary().withColumnsRenamed({"repeats_expected": "duplicate_keys_expected", "repeats_actual": "duplicate_keys_actual"})


@query(f"""{_PAIR} SELECT o_orderkey, 'o_custkey' AS "column", CAST(e.o_custkey AS VARCHAR) AS expected, CAST(a.o_custkey AS VARCHAR) AS actual FROM e JOIN a USING (o_orderkey) WHERE e.o_custkey <> a.o_custkey
UNION ALL SELECT o_orderkey, 'o_orderstatus', e.o_orderstatus, a.o_orderstatus FROM e JOIN a USING (o_orderkey) WHERE e.o_orderstatus <> a.o_orderstatus""")
def changed_rows_long(spark, d):
    return _orders_plan(spark, d, select=["o_custkey", "o_orderstatus", "o_orderpriority"]).differences()


_SIG = "concat_ws(',', CASE WHEN e.o_custkey <> a.o_custkey THEN 'o_custkey' END, CASE WHEN e.o_orderstatus <> a.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN e.o_totalprice <> a.o_totalprice THEN 'o_totalprice' END)"


@query(f"{_PAIR}, s AS (SELECT {_SIG} AS signature FROM e JOIN a USING (o_orderkey)) SELECT signature, count(*) AS n FROM s WHERE signature <> '' GROUP BY signature")
def change_signatures(spark, d):
    return _orders_plan(spark, d).signatures().select(F.array_join("sig", ",").alias("signature"), "n")


_COUNTS = f"{_PAIR}, p AS (SELECT e.o_custkey <> a.o_custkey AS c, e.o_orderstatus <> a.o_orderstatus AS s, e.o_totalprice <> a.o_totalprice AS t FROM e JOIN a USING (o_orderkey)), n AS (SELECT 'o_custkey' AS \"column\", count(*) FILTER (c) AS diff_rows FROM p UNION ALL SELECT 'o_orderstatus', count(*) FILTER (s) FROM p UNION ALL SELECT 'o_totalprice', count(*) FILTER (t) FROM p)"


@query(f'{_COUNTS} SELECT "column", diff_rows FROM n WHERE diff_rows > 0')
def column_diff_counts_orders(spark, d):
    return _orders_plan(spark, d).column_counts().select("column", "diff_rows")


@query(f"""{_COUNTS} SELECT "column", CASE WHEN diff_rows > 0 THEN 'MATCHED - VALUE DIFF' ELSE 'MATCHED' END AS status FROM n
UNION ALL SELECT 'o_orderkey', 'MATCHED' UNION ALL SELECT 'o_orderpriority', 'MATCHED'""")
def column_status(spark, d):
    return _orders_plan(spark, d).column_status().select("column", "status")


@query(f"{_PAIR} SELECT * FROM (SELECT 'missing' AS kind, o_orderkey FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY o_orderkey LIMIT 20)")
def examples_topk(spark, d):
    return _orders_plan(spark, d).one_sided(True).select(F.lit("missing").alias("kind"), F.col("row.o_orderkey").alias("o_orderkey")).orderBy("o_orderkey").limit(20)


@query("""WITH e AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders), a AS (SELECT o_custkey, CASE WHEN o_orderkey % 113 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0)
SELECT * FROM e EXCEPT ALL SELECT * FROM a""")
def missing_rows(spark, d):
    return _multiset_plan(spark, d).missing_rows()


@query("""WITH e AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders), a AS (SELECT o_custkey, CASE WHEN o_orderkey % 113 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0)
SELECT * FROM a EXCEPT ALL SELECT * FROM e""")
def added_rows(spark, d):
    return _multiset_plan(spark, d).added_rows()


def _multiset_plan(spark, d):
    e = derived(spark, d, "SELECT o_custkey, o_orderstatus, o_orderpriority FROM {orders}", "orders")
    a = derived(spark, d, "SELECT o_custkey, CASE WHEN o_orderkey % 113 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM {orders} WHERE o_orderkey % 97 <> 0", "orders")
    return plan_for(e, a, CompareConfig())[0]


# ---------------------------------------------------------------- lineitem: multisets and repeated keys

_L_NEW = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM {lineitem} WHERE l_orderkey % 211 <> 0"


@query(f"""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, 1 AS w FROM lineitem UNION ALL SELECT *, -1 FROM ({_L_NEW.replace("{", "").replace("}", "")})),
g AS (SELECT sum(w) AS n, count(*) FILTER (w = 1) AS e, count(*) FILTER (w = -1) AS a FROM u GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
SELECT CAST(sum(e) AS BIGINT) AS expected_rows, CAST(sum(a) AS BIGINT) AS actual_rows, CAST(sum(greatest(n, 0)) AS BIGINT) AS missing, CAST(sum(greatest(-n, 0)) AS BIGINT) AS added FROM g""")
def keyless_summary_lineitem(spark, d):
    return plan_for(table(spark, d, "lineitem"), derived(spark, d, _L_NEW, "lineitem"), CompareConfig())[0].summary()


@query("SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicate_keys FROM lineitem")
def duplicate_keys_lineitem(spark, d):
    e = table(spark, d, "lineitem")
    return plan_for(e, e.limit(0), CompareConfig(keys=["l_orderkey", "l_linenumber"]))[0].summary().select(F.col("repeats_expected").alias("duplicate_keys"))


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber, min(['i:' || l_partkey, 'i:' || l_suppkey]) AS r FROM lineitem GROUP BY ALL),
a AS (SELECT l_orderkey, l_linenumber, min(['i:' || l_partkey, 'i:' || l_suppkey]) AS r FROM ({_L_NEW.replace("{", "").replace("}", "")}) GROUP BY ALL)
SELECT concat_ws(',', CASE WHEN e.r[1] <> a.r[1] THEN 'l_partkey' END, CASE WHEN e.r[2] <> a.r[2] THEN 'l_suppkey' END) AS signature, count(*) AS n FROM e JOIN a USING (l_orderkey, l_linenumber) WHERE e.r <> a.r GROUP BY 1""")
def keyed_dup_lineitem(spark, d):
    cfg = CompareConfig(keys=["l_orderkey", "l_linenumber"], select=["l_partkey", "l_suppkey"])
    return plan_for(table(spark, d, "lineitem"), derived(spark, d, _L_NEW, "lineitem"), cfg)[0].signatures().select(F.array_join("sig", ",").alias("signature"), "n")


# ---------------------------------------------------------------- NULLs, numbers, strings, times


def _summary(spark, d, left: str, right: str, names: tuple[str, ...], **options) -> DataFrame:
    plan, _ = plan_for(derived(spark, d, left, *names), derived(spark, d, right, *names), CompareConfig(**options))
    return plan.full_summary().select("missing", "added", "changed") if options.get("keys") else plan.summary().select("missing", "added")


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, (SELECT count(*) FROM events WHERE event_id % 1000 = 0 AND event_id <> 7) + CAST(EXISTS (SELECT 1 FROM events WHERE event_id = 7) AS BIGINT) * 0 AS changed")
def null_key_match(spark, d):
    # The NULL key of one side meets the NULL key of the other.
    left = "SELECT CASE WHEN event_id = 7 THEN NULL ELSE event_id END AS k, event_type FROM {events}"
    right = "SELECT CASE WHEN event_id = 7 THEN NULL ELSE event_id END AS k, CASE WHEN event_id % 1000 = 0 THEN 'other' ELSE event_type END AS event_type FROM {events}"
    return _summary(spark, d, left, right, ("events",), keys=["k"])


@query("SELECT count(*) FILTER (event_id % 10 = 0) AS missing, count(*) FILTER (event_id % 10 = 0) AS added FROM events")
def null_vs_empty(spark, d):
    left = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS t FROM {events}"
    right = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type END AS t FROM {events}"
    return _summary(spark, d, left, right, ("events",))


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (round_even(o_totalprice / 0.001, 0) <> round_even((o_totalprice + 0.0004) / 0.001, 0)) AS changed FROM orders")
def float_tolerance_grid(spark, d):
    return _summary(spark, d, "SELECT o_orderkey, o_totalprice AS p FROM {orders}", "SELECT o_orderkey, o_totalprice + 0.0004D AS p FROM {orders}", ("orders",), keys=["o_orderkey"], float_tolerance=0.001)


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (p_partkey % 7 = 0) AS changed FROM part")
def coerce_numeric(spark, d):
    right = "SELECT p_partkey, CAST(p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS n FROM {part}"
    return _summary(spark, d, "SELECT p_partkey, p_size AS n FROM {part}", right, ("part",), keys=["p_partkey"], coerce_numeric_to_float=True)


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (p_partkey % 6 = 0) AS changed FROM part")
def decimal_trailing_zeros(spark, d):
    right = "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(15,2)) + CASE WHEN p_partkey % 6 = 0 THEN 0.000001 ELSE 0 END AS DECIMAL(20,6)) AS n FROM {part}"
    return _summary(spark, d, "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(15,2)) AS n FROM {part}", right, ("part",), keys=["p_partkey"])


@query("SELECT count(*) FILTER (p_partkey % 5 = 0) AS missing, count(*) FILTER (p_partkey % 5 = 0) AS added FROM part")
def int_width(spark, d):
    return _summary(spark, d, "SELECT p_partkey, p_size AS n FROM {part}", "SELECT CAST(p_partkey AS DECIMAL(20,0)) AS p_partkey, CAST(p_size AS BIGINT) + CASE WHEN p_partkey % 5 = 0 THEN 4294967296 ELSE 0 END AS n FROM {part}", ("part",))


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (c_custkey % 11 = 0) AS changed FROM customer")
def trim_casefold_strings(spark, d):
    right = "SELECT c_custkey, concat('  ', upper(c_name), CASE WHEN c_custkey % 11 = 0 THEN '!' ELSE '' END, ' ') AS n FROM {customer}"
    return _summary(spark, d, "SELECT c_custkey, c_name AS n FROM {customer}", right, ("customer",), keys=["c_custkey"], trim_strings=True, case_insensitive=True)


@query("SELECT count(*) FILTER (event_id % 50 = 0) AS missing, count(*) FILTER (event_id % 50 = 0) AS added FROM events")
def timestamp_utc_equivalence(spark, d):
    left = "SELECT event_id, CAST(ts AS TIMESTAMP) AS t FROM {events}"
    right = "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL 1 MICROSECOND ELSE CAST(ts AS TIMESTAMP) END AS t FROM {events}"
    return _summary(spark, d, left, right, ("events",))


@query("SELECT count(*) AS missing, count(*) AS added FROM events")
def naive_vs_aware_timestamp(spark, d):
    return _summary(spark, d, "SELECT event_id, ts AS t FROM {events}", "SELECT event_id, CAST(ts AS TIMESTAMP) AS t FROM {events}", ("events",))


@query("SELECT 'o_totalprice' AS \"column\", 'double' AS expected_type, 'decimal(15,2)' AS actual_type")
def type_mismatches(spark, d):
    e = derived(spark, d, "SELECT o_orderkey, o_totalprice FROM {orders}", "orders")
    a = derived(spark, d, "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice, 1 AS more FROM {orders}", "orders")
    return spark.createDataFrame(list(resolve(e, a, CompareConfig()).retyped), "column string, expected_type string, actual_type string")


# ---------------------------------------------------------------- nested values

_ITEMS = "SELECT o.o_orderkey, array_sort(collect_list(struct(l.l_linenumber, l.l_partkey, l.l_suppkey))) AS items FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey"
_MULTI = "(SELECT count(*) FROM (SELECT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey HAVING count(DISTINCT (l_linenumber, l_partkey, l_suppkey)) > 1))"


@query("WITH i AS (SELECT l_orderkey, count(*) FILTER (l_partkey % 100 = 7) AS odd FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) SELECT count(*) FILTER (odd > 0) AS missing, count(*) FILTER (odd > 0) AS added FROM i")
def nested_bcv_list_struct(spark, d):
    right = _ITEMS.replace("struct(l.l_linenumber, l.l_partkey, l.l_suppkey)", "struct(l.l_linenumber AS l_linenumber, l.l_partkey AS l_partkey, CASE WHEN l.l_partkey % 100 = 7 THEN -1L ELSE l.l_suppkey END AS l_suppkey)").replace("FROM {orders} o JOIN {lineitem} l", "FROM {lineitem} l JOIN {orders} o")
    return _summary(spark, d, _ITEMS, right, ("orders", "lineitem"))


@query(f"SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, CAST({_MULTI} AS BIGINT) AS changed")
def nested_bcv_broken(spark, d):
    return _summary(spark, d, _ITEMS, _ITEMS.replace("array_sort(", "reverse(array_sort(").replace("l.l_suppkey))) AS", "l.l_suppkey)))) AS"), ("orders", "lineitem"), keys=["o_orderkey"])


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (c_custkey % 13 = 0) AS changed FROM customer")
def map_unordered(spark, d):
    left = "SELECT c_custkey, map('a', c_nationkey, 'b', 1) AS m FROM {customer}"
    return _summary(spark, d, left, "SELECT c_custkey, map('b', CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 1 END, 'a', c_nationkey) AS m FROM {customer}", ("customer",), keys=["c_custkey"])


_PRIORITIES = "SELECT o_custkey, sort_array(collect_list(o_orderpriority)) AS p FROM {orders} GROUP BY o_custkey"


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(DISTINCT o_custkey) FILTER (o_custkey % 12 = 0) AS changed FROM orders")
def list_unordered(spark, d):
    right = _PRIORITIES.replace("sort_array(collect_list(o_orderpriority))", "reverse(sort_array(concat(collect_list(o_orderpriority), IF(o_custkey % 12 = 0, array('more'), CAST(array() AS array<string>)))))")
    return _summary(spark, d, _PRIORITIES, right, ("orders",), keys=["o_custkey"], unordered_list_columns=["p"])


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (n > 1) AS changed FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey)")
def list_ordered(spark, d):
    return _summary(spark, d, _PRIORITIES, _PRIORITIES.replace("sort_array(collect_list(o_orderpriority))", "reverse(sort_array(collect_list(o_orderpriority)))"), ("orders",), keys=["o_custkey"])


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(*) FILTER (vec_id % 17 = 0) AS changed FROM embeddings")
def embeddings_list_compare(spark, d):
    right = "SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN transform(embedding, x -> x + 1.0F) ELSE embedding END AS embedding FROM {embeddings}"
    return _summary(spark, d, "SELECT vec_id, embedding FROM {embeddings}", right, ("embeddings",), keys=["vec_id"], float_tolerance=0.01)


# ---------------------------------------------------------------- absence labels


@query("SELECT event_id, event_id % 4 <> 3 AS equivalent FROM events")
def null_equivalence_labels(spark, d):
    df = derived(spark, d, "SELECT event_id, CAST(NULL AS STRING) AS e, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'None' ELSE 'x' END AS a FROM {events}", "events")
    kinds = fields_of(df)
    return df.select("event_id", F.expr(equivalent_sql("e", kinds["e"], "a", kinds["a"])).alias("equivalent"))


@query("SELECT count(*) FILTER (event_id % 6 = 0) AS diff_rows, count(*) FILTER (event_id % 12 = 0) AS equivalent_rows FROM events")
def null_equivalence_counts(spark, d):
    left = "SELECT event_id, CASE WHEN event_id % 12 = 0 THEN NULL ELSE event_type END AS t FROM {events}"
    right = "SELECT event_id, CASE WHEN event_id % 12 = 0 THEN '' WHEN event_id % 6 = 0 THEN 'other' ELSE event_type END AS t FROM {events}"
    plan, _ = plan_for(derived(spark, d, left, "events"), derived(spark, d, right, "events"), CompareConfig(keys=["event_id"], null_equivalence=True))
    return plan.column_counts().select("diff_rows", "equivalent_rows")


# ---------------------------------------------------------------- relational idioms of case files


@query("SELECT event_id, user_id FROM events WHERE user_id % 10 = 3")
def modulus_sample(spark, d):
    return load_source({"type": "parquet", "path": f"{d}/events.parquet", "row_filter": "pmod(user_id, 10) = 3", "columns": ["event_id", "user_id"]}, spark=spark)


@query(f"{_PAIR} SELECT (SELECT count(*) FROM e WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)) AS missing, (SELECT count(*) FROM a0 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)) AS added, (SELECT count(*) FROM e JOIN a USING (o_orderkey) WHERE e.o_custkey <> a.o_custkey OR e.o_orderstatus <> a.o_orderstatus OR e.o_totalprice <> a.o_totalprice) AS changed")
def hash_sample_parity(spark, d):
    """Keyed samples of both sides hold the same keys: what the comparisons of all four find adds up to the whole."""
    from functools import reduce

    e, a = derived(spark, d, ORDERS, "orders"), derived(spark, d, ORDERS_NEW, "orders")
    parts = [plan_for(*(hash_sample(x, ["o_orderkey"], 4, r) for x in (e, a)), CompareConfig(keys=["o_orderkey"]))[0].full_summary() for r in range(4)]
    return reduce(DataFrame.unionAll, parts).agg(*[F.sum(c).alias(c) for c in ("missing", "added", "changed")])


_BATCHES = "WITH l AS (SELECT DISTINCT CAST(ts AS DATE) AS b FROM {events} WHERE event_id % 2 = 0), r AS (SELECT DISTINCT CAST(ts AS DATE) AS b FROM {events} WHERE event_id % 2 = 1), c AS (SELECT b FROM l INTERSECT SELECT b FROM r), n AS (SELECT b, row_number() OVER (ORDER BY b DESC) AS i FROM c) SELECT CAST(b AS {text}) AS batch FROM n WHERE i = 2"


@query(_BATCHES.replace("{text}", "VARCHAR"))
def settled_common_batch(spark, d):
    return derived(spark, d, _BATCHES.replace("{text}", "STRING"), "events")


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, count(DISTINCT (CAST(ts AS DATE), event_type)) AS changed FROM events WHERE event_id % 997 = 0")
def hourly_daily_rollup_parity(spark, d):
    left = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM {events} GROUP BY 1, 2"
    right = "WITH h AS (SELECT date_trunc('HOUR', ts) AS hour, event_type, count(*) + sum(CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END) AS n FROM {events} GROUP BY 1, 2) SELECT CAST(hour AS DATE) AS day, event_type, sum(n) AS n FROM h GROUP BY 1, 2"
    return _summary(spark, d, left, right, ("events",), keys=["day", "event_type"])


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_pinned_values(spark, d):
    return derived(spark, d, "SELECT l_orderkey, l_partkey FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P')", "lineitem", "orders")


@query("SELECT o_orderstatus, count(*) AS order_count FROM orders GROUP BY 1")
def order_status_counts(spark, d):
    return derived(spark, d, "SELECT o_orderstatus, count(*) AS order_count FROM {orders} GROUP BY 1", "orders")


@query("SELECT r.r_name, h.h, CAST(r.r_regionkey * 100 + h.h AS BIGINT) AS orders FROM region r CROSS JOIN (SELECT unnest(range(0, 24)) AS h) h")
def hourly_grid(spark, d):
    return derived(spark, d, "SELECT r.r_name, h.h, CAST(r.r_regionkey * 100 + h.h AS BIGINT) AS orders FROM {region} r CROSS JOIN (SELECT explode(sequence(0L, 23L)) AS h) h", "region")


@query("SELECT CAST(max(event_id) AS VARCHAR) AS value FROM events")
def param_scalar(spark, d):
    from isotab.cases.params import resolve_param_queries

    got = resolve_param_queries({"last": {"type": "sql", "query": f"SELECT max(event_id) FROM parquet.`{d}/events.parquet`"}}, {})
    return spark.createDataFrame([(got["last"],)], "value string")


@query("SELECT 'F' AS status, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'O', 2 UNION ALL SELECT NULL, NULL")
def inline_source(spark, d):
    return load_source({"type": "inline", "schema": {"status": "string", "n": "int64"}, "rows": [{"status": "F", "n": 1}, {"status": "O", "n": 2}, {}]}, spark=spark)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2")
def parquet_source(spark, d):
    return load_source({"type": "parquet", "path": f"{d}/nation.parquet", "filters": [["n_regionkey", ">=", 2]], "columns": ["n_nationkey", "n_name"]}, spark=spark)


# ---------------------------------------------------------------- schema operators


@query("SELECT 'orders_new' AS name, 'only_in_expected' AS kind, 'o_orderdate' AS \"column\" UNION ALL SELECT 'orders_new', 'only_in_actual', 'more' UNION ALL SELECT 'orders_new', 'type', 'o_custkey'")
def schema_diff(spark, d):
    e = table(spark, d, "orders")
    a = derived(spark, d, "SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority, 1 AS more FROM {orders}", "orders")
    r = check_schemas(*({f.name: f.dataType.simpleString() for f in x.schema} for x in (e, a)))
    rows = [("orders_new", "only_in_expected", c) for c in r.schema.only_expected] + [("orders_new", "only_in_actual", c) for c in r.schema.only_actual] + [("orders_new", "type", t[0]) for t in r.schema.retyped]
    return spark.createDataFrame(rows, "name string, kind string, column string")


@query("SELECT 'lost' AS kind, 'customer.c_mktsegment' AS concept UNION ALL SELECT 'unaccounted', 'extra'")
def concept_coverage(spark, d):
    wide = derived(spark, d, "SELECT o.*, c.c_custkey, c.c_name AS customer_name, c.c_nationkey, c.c_acctbal, 1 AS extra FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey", "orders", "customer")
    kinds = lambda x: {f.name: f.dataType.simpleString() for f in x.schema}
    r = check_concepts({n: kinds(table(spark, d, n)) for n in ("orders", "customer")}, kinds(wide), [{"source": "customer", "column": "c_name", "target": "customer_name"}])
    return spark.createDataFrame([("lost", c) for c in r.schema.only_expected] + [("unaccounted", c) for c in r.schema.only_actual], "kind string, concept string")


@query("SELECT 'mapped' AS kind, 'P_NAME' AS name UNION ALL SELECT 'unmapped', 'p_color' UNION ALL SELECT 'unreferenced', unnest(['p_partkey', 'p_brand', 'p_type', 'p_size', 'p_retailprice'])")
def usage_coverage(spark, d):
    r = check_coverage(["P_NAME", "p_color"], {f.name: f.dataType.simpleString() for f in table(spark, d, "part").schema})
    return spark.createDataFrame([("mapped", c) for c in r.hits] + [("unmapped", c) for c in r.gaps] + [("unreferenced", c) for c in r.unused], "kind string, name string")


# ---------------------------------------------------------------- run history, made from events


_RUNS = "SELECT CAST(event_id AS VARCHAR) AS run_id, ts AS run_ts, event_type AS case_name, user_id % 3 = 0 AS equivalent FROM events"


def _history(spark, d) -> DataFrame:
    runs = derived(spark, d, "SELECT CAST(event_id AS STRING) AS run_id, CAST(ts AS TIMESTAMP) AS run_ts, event_type AS case_name, user_id % 3 = 0 AS equivalent FROM {events}", "events")
    return runs.select(*[F.col(f.name) if f.name in runs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SUMMARY_SCHEMA])


@query(f"WITH r AS ({_RUNS}), n AS (SELECT *, row_number() OVER (PARTITION BY case_name, CAST(run_ts AS DATE) ORDER BY run_ts DESC, run_id DESC) AS i FROM r) SELECT case_name, CAST(CAST(run_ts AS DATE) AS VARCHAR) AS day, run_id FROM n WHERE i = 1")
def run_history_latest_per_day(spark, d):
    return latest_per_day(_history(spark, d)).select("case_name", F.col("day").cast("string").alias("day"), "run_id")


@query(f"WITH r AS ({_RUNS}), n AS (SELECT *, lag(equivalent, 1) OVER w AS a, lag(equivalent, 2) OVER w AS b FROM r WINDOW w AS (PARTITION BY case_name ORDER BY run_ts, run_id)) SELECT case_name, run_id FROM n WHERE NOT equivalent AND NOT a AND NOT b")
def consecutive_failures_history(spark, d):
    return consecutive_failures(_history(spark, d), 3).select("case_name", "run_id")


@query(f"SELECT case_name, count(*) AS runs, count(*) FILTER (NOT equivalent) AS failures, CAST(max(run_ts) AS VARCHAR) AS last_run FROM ({_RUNS}) GROUP BY 1")
def failure_counts_history(spark, d):
    return failure_counts(_history(spark, d)).withColumn("last_run", F.col("last_run").cast("string"))


def _diffs(spark, d) -> DataFrame:
    text = json.dumps([{"column": "c%", "expected": "1", "actual": "2"}])
    made = derived(spark, d, f"SELECT CAST(event_id AS STRING) AS run_id, event_type AS case_name, CASE WHEN event_id % 2 = 0 THEN 'missing' ELSE 'changed' END AS diff_kind, concat('[\"', user_id % 5, '\"]') AS key_json, CASE WHEN event_id % 2 = 1 THEN replace('{text.replace('{', '{{').replace('}', '}}')}', '%', CAST(user_id % 3 AS STRING)) END AS column_diffs FROM {{events}}", "events")
    return made.select(*[F.col(f.name) if f.name in made.columns else F.lit(None).cast("string").alias(f.name) for f in DIFFS_SCHEMA])


@query("SELECT event_type AS case_name, 'c' || (user_id % 3) AS \"column\", count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2")
def column_diff_history(spark, d):
    return column_diff_counts(_diffs(spark, d))


@query("SELECT event_type AS case_name, '[\"' || (user_id % 5) || '\"]' AS key_json, count(*) AS occurrences FROM events WHERE event_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def missing_key_history(spark, d):
    return missing_key_counts(_history(spark, d), _diffs(spark, d), 10, dt.datetime(2024, 1, 30, tzinfo=dt.UTC))
