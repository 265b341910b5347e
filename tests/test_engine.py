import datetime as dt
import json
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isotab import CompareConfig, compare_tables
from isotab.config import CanonOptions
from isotab.errors import CaseError, ConceptCheckError, ExclusionError, ParamError, SourceError
from isotab.functions.fingerprint import canon_value
from isotab.operators.compare import MissingKeyError
from isotab.operators.schema import check_concepts, check_coverage, check_schemas
from isotab.report.render import by_column, render_console, render_markdown, to_dict


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_row_and_column_order_do_not_matter(spark):
    a = df(spark, "x int, y string", (1, "a"), (2, "b"))
    assert compare_tables(a, df(spark, "y string, x int", ("b", 2), ("a", 1))).equivalent


def test_multiset(spark):
    r = compare_tables(df(spark, "x int", (1,), (1,), (2,)), df(spark, "x int", (1,), (2,), (2,)))
    assert (r.counts.missing, r.counts.added, r.equivalent) == (1, 1, False)
    assert [(e.kind, e.before or e.after) for e in r.examples] == [("missing", {"x": 1}), ("added", {"x": 2})]


def test_keyed(spark):
    e, a = df(spark, "id int, v int", (1, 10), (2, 20), (3, 30)), df(spark, "id int, v int", (2, 20), (3, 999), (4, 40))
    r = compare_tables(e, a, CompareConfig(keys=["id"]))
    assert r.counts[2:5] == (1, 1, 1)
    assert [(x.kind, x.key) for x in r.examples] == [("missing", (1,)), ("added", (4,)), ("changed", (3,))]
    assert [*r.examples[2].cells()] == [("v", 30, 999)]
    assert compare_tables(e, a, CompareConfig(keys=["id"], max_examples=0)).examples == []
    with pytest.raises(MissingKeyError):
        compare_tables(e, a, CompareConfig(keys=["nope"]))


def test_signatures_duplicates_and_null_keys(spark):
    e = df(spark, "k int, m int, r int", (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (None, 5, 5), (9, 1, 1), (9, 2, 2))
    a = df(spark, "k int, m int, r int", (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 2), (None, 5, 6), (9, 2, 2), (9, 1, 1))
    r = compare_tables(e, a, CompareConfig(keys=["k"]))
    assert {p.columns: p.rows for p in r.patterns} == {("m",): 3, ("m", "r"): 1, ("r",): 1}
    assert r.counts[5:] == (1, 1)
    assert r.patterns[0].columns == ("m",) and r.patterns[0].example.key == (1,)
    rows = {c: (s, n) for s, c, _, _, n in by_column(r)}
    assert rows == {"k": ("MATCHED", ""), "m": ("MATCHED - VALUE DIFF", 4), "r": ("MATCHED - VALUE DIFF", 2)}
    dup = compare_tables(df(spark, "x int", (1,), (1,)), df(spark, "x int", (1,)), CompareConfig(keys=["x"]))
    assert dup.equivalent and dup.counts.repeats_expected == 1


@pytest.mark.parametrize(("left", "right", "options", "same"), [
    ("1.0D", "1.0D + 1e-12D", {}, False), ("1.0D", "1.0D + 1e-12D", {"float_tolerance": 1e-9}, True), ("cast(1.1 as decimal(10,3))", "cast(1.1 as decimal(5,1))", {}, True), ("cast(1 as int)", "1L", {}, True), ("1", "1.0D", {}, False),
    ("1", "1.0D", {"coerce_numeric_to_float": True}, True), ("'a'", "' a\\t'", {"trim_strings": True}, True), ("'A'", "'a'", {"case_insensitive": True}, True), ("'STRASSE'", "'straße'", {"case_insensitive": True, "exact_casefold": True}, True),
    ("null", "''", {}, False), ("cast(null as map<string,int>)", "cast(map() as map<string,int>)", {}, False), ("double('NaN')", "double('NaN')", {"float_tolerance": 0.1}, True), ("double('Infinity')", "double('-Infinity')", {"float_tolerance": 0.1}, False), ("-0.0D", "0.0D", {}, False),
    ("array(1,2)", "array(2,1)", {}, False), ("array(1,2)", "array(2,1)", {"unordered_list_columns": ["v"]}, True), ("map('a',1,'b',2)", "map('b',2,'a',1)", {}, True), ("named_struct('a',1,'b',2)", "named_struct('b',2,'a',1)", {}, True), ("named_struct('a',1)", "named_struct('c',1)", {}, False),
    ("array('ab','c')", "array('a','bc')", {}, False), ("array()", "array(cast(null as string))", {}, False), ("array(named_struct('q', array(1)))", "array(named_struct('q', array(2)))", {}, False), ("date'2024-01-01'", "'2024-01-01'", {}, False),
    ("timestamp'2024-01-01 00:00:00'", "timestamp_ntz'2024-01-01 00:00:00'", {}, False), ("x'ff'", "x'FF'", {}, True), ("interval 1 day", "interval 2 day", {}, False), ("parse_json('{\"a\":1,\"b\":2}')", "parse_json('{\"b\":2,\"a\":1}')", {}, True),
])
def test_canonical_values(spark, left, right, options, same):
    e, a = (spark.sql(f"select 1 as id, {x} as v") for x in (left, right))
    cfg = CompareConfig(**options)
    assert compare_tables(e, a, cfg).equivalent == same
    r = compare_tables(e, a, CompareConfig(keys=["id"], **options))
    assert r.equivalent == same and r.counts.changed == (not same)


def test_column_resolution_and_strictness(spark):
    e, a = spark.sql("select 1 as a, 2 as b, 3 as c"), spark.sql("select 1L as a, 2 as b, 4 as d")
    r = compare_tables(e, a, CompareConfig(select=["b", "zzz"]))
    assert r.equivalent and (r.schema.compared, r.schema.only_expected, r.schema.only_actual) == (("b",), ("c",), ("d",))
    r = compare_tables(e, a, CompareConfig(strict_columns=True))
    assert not r.equivalent and r.schema.retyped == (("a", "int", "bigint"),) and not r.counts.differing
    assert compare_tables(e, a, CompareConfig(select=[], ignore_columns=["a", "b"])).equivalent  # nothing compared
    assert compare_tables(e.limit(0), a.limit(0)).equivalent


def test_wide_row(spark):
    cols = [f"c{i}" for i in range(250)]
    e = spark.range(5).select("id", *[F.lit(i).alias(c) for i, c in enumerate(cols)])
    assert compare_tables(e, e.select("*")).equivalent
    r = compare_tables(e, e.withColumn("c217", F.col("id")), CompareConfig(keys=["id"]))
    assert {p.columns for p in r.patterns} == {("c217",)}


values = st.one_of(st.none(), st.integers(-3, 3), st.sampled_from([7, 10**9]))
rows = st.lists(st.tuples(values, st.one_of(st.none(), st.sampled_from(["", "a", "A", " a"])), st.one_of(st.none(), st.lists(values, max_size=3))), max_size=8)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows, rows)
def test_multiset_property(spark, left, right):
    schema = "i long, s string, l array<long>"
    r = compare_tables(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    freeze = lambda xs: Counter((i, s, None if x is None else tuple(x)) for i, s, x in xs)
    e, a = freeze(left), freeze(right)
    assert r.counts[2:4] == ((e - a).total(), (a - e).total())


def test_absence_labels(spark):
    e = spark.sql("select * from values (1, cast(null as int), cast(array() as array<int>)), (2, 0, array(1)), (3, 1, null) as t(id, n, l)")
    a = spark.sql("select * from values (1, 0, cast(null as array<int>)), (2, null, array(1)), (3, null, array()) as t(id, n, l)")
    plain, labelled = (compare_tables(e, a, CompareConfig(keys=["id"], null_equivalence=x)) for x in (False, True))
    assert plain.counts.changed == labelled.counts.changed == 3 and not plain.respelled_by_column
    assert labelled.respelled_by_column == {"n": 2, "l": 2}
    status = {c: s for s, c, *_ in by_column(labelled)}
    assert status["l"] == "MATCHED - EQUIVALENT" and status["n"] == "MATCHED - VALUE DIFF"


def test_decimal_text(spark):
    got = spark.sql("select cast(100 as decimal(10,3)) a, cast(0 as decimal(5,2)) b, cast(-0.5 as decimal(5,3)) c")
    assert [got.select(canon_value(got, c)).first()[0] for c in "abc"] == ["d:100", "d:0", "d:-0.5"]
    big = df(spark, "x decimal(38,10)", (Decimal("1234567890123456789012345678.0000000001"),))
    assert big.select(canon_value(big, "x", CanonOptions())).first()[0].endswith(".0000000001")


def test_schema_operators():
    r = check_schemas({"a": "int", "b": "string", "__m__": "x"}, {"a": "bigint", "c": "string"}, ["__m__"])
    assert (r.schema.only_expected, r.schema.only_actual, r.schema.retyped) == (("b",), ("c",), (("a", "int", "bigint"),)) and not r.equivalent
    assert "schema-only" in r.summary()
    old = {"orders": {"id": "int", "cust": "int"}, "cust": {"id": "int", "region": "string", "email": "string"}}
    wide = {"id": "int", "cust": "int", "mail": "string", "tier": "string"}
    r = check_concepts(old, wide, [{"source": "cust", "column": "email", "target": "mail"}])
    assert (r.schema.only_expected, r.schema.only_actual, *r.counts[:2]) == (("cust.region",), ("tier",), 5, 4)
    full = check_concepts({"o": {"id": "int"}}, {"id": "int", "more": "int"})
    assert full.equivalent and not check_concepts({"o": {"id": "int"}}, {"id": "int", "more": "int"}, strict_unmapped_target=True).equivalent
    with pytest.raises(ConceptCheckError):
        check_concepts(old, wide, [{"source": "cust", "column": "gone", "target": "mail"}])
    c = check_coverage(["ID", "nope"], {"id": "int", "x": "int"}, {"id": {"type": "key", "description": "d"}})
    assert (c.hits, c.gaps, c.unused) == ({"ID": ("id", "key", "d")}, ("nope",), ("x",))


CASES = """
vars: {limit: 3}
param_queries:
  top: {type: sql, query: "select max(id) from range(${limit})"}
defaults:
  compare: {keys: [id], float_tolerance: 0.01}
cases:
  - name: same
    expected: {type: inline, schema: {id: int64, v: float}, rows: [{id: 1, v: 1.0}, {id: 2, v: 2.0}]}
    actual: {type: sql, query_file: q.sql}
    compare: {ignore_columns_file: skip.csv, ignore_columns_table: T}
  - name: differs
    tags: [xfail]
    expected: {type: csv, path: seed.csv}
    actual: {type: parquet, path: data.parquet}
  - name: schema
    schema_check: {expected: {type: csv, path: seed.csv}, actual: {type: parquet, path: data.parquet}}
"""


@pytest.fixture
def folder(tmp_path, spark):
    (tmp_path / "cases").mkdir()
    at = tmp_path / "cases"
    (at / "c.yaml").write_text(CASES)
    (at / "q.sql").write_text("select id, cast(id as double) + 0.0001 as v, ${top} as extra from range(1, ${limit})")
    (at / "skip.csv").write_text("Table,Column\nt,extra\nother,v\n")
    (at / "seed.csv").write_text("id,v\n1,1.5\n2,2.5\n")
    spark.sql("select 1L as id, 1.5D as v union all select 2L, 9.0D").write.parquet(str(at / "data.parquet"))
    return at


def test_cases_cli_sink_and_history(folder, tmp_path, spark, capsys, monkeypatch):
    from isotab import assert_case, load_cases
    from isotab.cli import main

    cases = {c.name: c for c in load_cases(str(folder))}
    assert assert_case(cases["same"]).equivalent
    with pytest.raises(AssertionError, match="CHANGED key=\\(2\\)"):
        assert_case(cases["differs"])
    assert cases["schema"].run().equivalent
    for sink in (f"parquet:{tmp_path}/sink", f"duckdb:{tmp_path}/sink.db"):
        args = ["run", str(folder), "--json", f"{tmp_path}/r.json", "--md", f"{tmp_path}/r.md", "--csv", f"{tmp_path}/csv", "--result-sink", sink]
        assert main(args) == 0
        assert main(["report", "--result-sink", sink, "--html", f"{tmp_path}/h.html"]) == 0
        page = (tmp_path / "h.html").read_text()
        assert '"differs"' in page and '["(2)", "v"' not in page and '["[\\"2\\"]", "v", "2.5", "9.0"]' in page
    assert [c["case"] for c in json.loads((tmp_path / "r.json").read_text())] == ["same", "differs", "schema"]
    assert "MATCHED - VALUE DIFF" in (tmp_path / "csv" / "differs.csv").read_text()
    assert main(["list", str(folder)]) == 0 and "same" in capsys.readouterr().out
    assert main(["run", str(folder), "--select", "none"]) == 2
    assert main(["run", str(folder / "c.yaml"), "--select", "same", "--param", "limit=2"]) == 1
    monkeypatch.setenv("ISOTAB_VAR_LIMIT", "2")
    assert main(["run", str(folder / "c.yaml"), "--select", "same"]) == 1


def test_errors_speak(folder, spark):
    from isotab.cases.exclusions import load_exclusions
    from isotab.cases.loader import build_case
    from isotab.cases.params import parse_cli_params, resolve_param_queries, substitute_spec
    from isotab.sources.registry import load_source

    with pytest.raises(ParamError, match="a.*b"):
        substitute_spec({"x": ["${b}", "${A}"]}, {})
    assert substitute_spec("$x ${A}", {"a": "1"}) == "$x 1" and parse_cli_params(["a=b=c"]) == {"a": "b=c"}
    for q in ("select 1 as a, 2 as b", "select 1 where false", "select * from range(2)", "select null"):
        with pytest.raises(ParamError):
            resolve_param_queries({"p": {"type": "sql", "query": q}}, {})
    assert resolve_param_queries({"P": {"type": "sql", "query": "broken"}}, {"p": "pinned"}) == {}
    with pytest.raises(ExclusionError, match="other"):
        load_exclusions(str(folder / "skip.csv"), "unknown")
    for spec in ("x", {}, {"type": "nope"}, {"type": "inline", "rows": 3}, {"type": "inline", "schema": {"a": "what?"}, "rows": []}, {"type": "parquet", "path": str(folder / "none.parquet")}, {"type": "jdbc", "url": "x", "password": "p"}):
        with pytest.raises(SourceError):
            load_source(spec, spark=spark)
    with pytest.raises(CaseError, match="typo"):
        build_case({"name": "n", "expected": {}, "actual": {}, "compare": {"typo": 1}}).config()
    with pytest.raises(CaseError):
        build_case({"name": "n", "expected": {}, "actual": {}, "engine": "abacus"})


def test_sources(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.feather as feather

    from isotab.sources.registry import describe_source, load_source

    feather.write_feather(pa.table({"a": [1, 2]}), str(tmp_path / "f.arrow"))
    assert load_source({"type": "arrow", "path": "f.arrow"}, str(tmp_path)).count() == 2
    with duckdb.connect(str(tmp_path / "d.db")) as con:
        con.execute("create table t as select 5 as x")
    assert load_source({"type": "duckdb", "database": "d.db", "table": "t", "read_only": True}, str(tmp_path)).first()["x"] == 5
    spark.range(3).write.parquet(str(tmp_path / "p/1.parquet"))
    spark.range(2).selectExpr("id", "'x' as more").write.parquet(str(tmp_path / "p/2.parquet"))
    both = load_source({"type": "parquet", "path": "p/*.parquet"}, str(tmp_path))
    assert both.count() == 5 and both.where("more is null").count() == 3
    assert describe_source({"type": "inline", "schema": {"a": "list<int>", "d": "decimal(10,2)", "t": "timestamptz"}, "rows": []}) == {"a": "array<bigint>", "d": "decimal(10,2)", "t": "timestamp"}
    assert load_source({"type": "inline", "rows": [{"a": 1, "b": None}, {"a": 2.5, "b": "x"}]}).collect()[0]["a"] == 1.0


def test_reports(spark):
    r = compare_tables(spark.sql("select 1 as k, date'2024-01-01' as d"), spark.sql("select 1 as k, date'2024-01-02' as d"), CompareConfig(keys=["k"]))
    assert "CHANGED key=(1)" in render_console(r, "c") and "❌ c" in render_markdown([("c", r)])
    assert set(to_dict(r, "c")) == {"case", "equivalent", "keys", "expected_rows", "actual_rows", "missing", "added", "changed", "columns_only_in_expected", "columns_only_in_actual", "type_mismatches", "duplicate_keys_expected", "duplicate_keys_actual", "compared_columns", "change_signatures"}


def test_streaming(spark, tmp_path):
    from isotab.streaming.micro_batch import compare_batches

    spark.range(4).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    compare_batches(stream, lambda b: spark.range(4), CompareConfig(), lambda n, r: got.append(r.equivalent), str(tmp_path / "cp")).awaitTermination()
    assert got == [True]


def test_history_tables(spark):
    from isotab.report.html import history_tables, render_html
    from isotab.sources.sinks import DIFFS_SCHEMA, SUMMARY_SCHEMA

    now = dt.datetime(2024, 5, 10, 12, tzinfo=dt.UTC)
    run = lambda i, h, ok, case="c", drift="[]": (i, now - dt.timedelta(hours=h), case, "[]", ok, 1, 1, 0, 0, 0, "[]", None, drift, "[]", "[]")
    s = spark.createDataFrame([run("r1", 50, True), run("r2", 3, True), run("r3", 1, False, drift='[{"column": "v"}]'), run("r3", 1, True, "other"), run("r0", 900, True)], SUMMARY_SCHEMA)
    diff = json.dumps([{"column": "v", "expected": "1", "actual": "</script>"}])
    d = spark.createDataFrame([("r3", "c", "changed", '["1"]', None, None, diff)], DIFFS_SCHEMA)
    got = history_tables(s, d, 21, now)
    points, signatures, cells = got["c"]
    assert [(r[0], r[1], r[-1]) for r in points["rows"]] == [("2024-05-08", True, False), ("2024-05-10", False, True)] and points["marks"] == ["ok", "bad drift"]
    assert signatures["rows"] == [[1, "v", '["1"]']] and cells["rows"] == [['["1"]', "v", "1", "</script>"]] and len(got["other"]) == 1
    assert "</script>\"" not in render_html(got)


def test_history_counts_signatures_over_all_diffs(spark):
    from isotab.operators.history import SHOWN_DIFFS
    from isotab.report.html import history_tables
    from isotab.sources.sinks import DIFFS_SCHEMA, SUMMARY_SCHEMA

    now = dt.datetime(2024, 5, 10, 12, tzinfo=dt.UTC)
    s = spark.createDataFrame([("r1", now, "c", "[]", False, 1, 1, 0, 0, 0, "[]", None, "[]", "[]", "[]")], SUMMARY_SCHEMA)
    diff = lambda *columns: json.dumps([{"column": c, "expected": "1", "actual": "2"} for c in columns])
    rows = [("r1", "c", "added", f'["{k}"]', None, None, None) for k in range(600)]
    rows += [("r1", "c", "changed", f'["{k:04}"]', None, None, diff("v") if k % 3 else diff("w", "v")) for k in range(900)]
    rows += [("r0", "c", "changed", '["1"]', None, None, diff("v")), ("r1", "c", "changed", '["1"]', None, None, "[]")]
    _, signatures, cells = history_tables(s, spark.createDataFrame(rows, DIFFS_SCHEMA), 21, now)["c"]
    assert signatures["rows"] == [[600, "v", '["0001"]'], [300, "v, w", '["0000"]']]
    assert len(cells["rows"]) == SHOWN_DIFFS


def test_patterns_are_bounded(spark, monkeypatch):
    from isotab.operators import compare

    monkeypatch.setattr(compare, "MOST_PATTERNS", 2)
    cells = ", ".join(f"case when id % 7 = {k} then -1L else id end as c{k}" for k in range(7))
    e, a = spark.sql(f"select id, {', '.join(f'id as c{k}' for k in range(7))} from range(40)"), spark.sql(f"select id, {cells} from range(40)")
    r = compare_tables(e, a, CompareConfig(keys=["id"]))
    assert len(r.patterns) == 2 and r.counts.changed == 40 and sum(r.changed_by_column.values()) == 40 and len(r.changed_by_column) == 7
