"""Keyed comparison in two stages.

1. Verdict: both sides become (canonical key, two 64-bit hashes), are unioned and grouped by key. All buffers are of
   fixed width, so Spark uses a hash aggregate with a partial step on the map side. One shuffle, no wide data. A key that
   stands once on each side has changed if its hashes differ: that needs no second look to be counted.
2. Explanation: only keys that both sides have and that differ, or that one side has more than once, are looked up
   again, both sides in one pass: the smallest canonical row stands for a key, so the result doesn't depend on row order.
   Rows themselves are fetched only for keys that have changed, and only where rows are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotab.config import CompareConfig
from isotab.functions.canon import column_sql, literal, quote
from isotab.functions.equivalence import column_equivalent_sql
from isotab.functions.fingerprint import CHUNK, fields_of, row_text_sql
from isotab.types import same_type

# The statuses of a column.
MATCHED, TYPE_DIFF, VALUE_DIFF, EQUIVALENT, ONE_SIDED = "MATCHED", "MATCHED - TYPE DIFF", "MATCHED - VALUE DIFF", "MATCHED - EQUIVALENT", "DIFF"


@dataclass
class KeyedPlan:
    expected: DataFrame
    actual: DataFrame
    columns: list[str]
    cfg: CompareConfig

    @property
    def keys(self) -> list[str]:
        return list(self.cfg.keys or [])

    def _key_sql(self, df: DataFrame) -> str:
        return row_text_sql(fields_of(df), self.keys, self.cfg.canon())

    def _hash_sql(self, df: DataFrame, seed: int) -> str:
        schema, names, o = fields_of(df), sorted(self.columns), self.cfg.canon()
        chunks = [", ".join(column_sql(c, schema[c], o) for c in names[i : i + CHUNK]) for i in range(0, len(names), CHUNK)]
        inner = [f"xxhash64({seed}, {c})" for c in chunks] or [f"xxhash64({seed})"]
        return inner[0] if len(inner) == 1 else f"xxhash64({', '.join(inner)})"

    def _side(self, df: DataFrame, expected: bool) -> DataFrame:
        h = [self._hash_sql(df, s) for s in (11, 29)]
        out = df.select(F.expr(self._key_sql(df)).alias("key"), F.expr(h[0]).alias("h1"), F.expr(h[1]).alias("h2"))
        return out.withColumn("side", F.lit(expected))

    @cached_property
    def by_key(self) -> DataFrame:
        """key, e_n and a_n (rows on each side), differs (once on each side, with two hashes), repeated (on both sides, and on
        one of them more than once)."""
        both = self._side(self.expected, True).unionAll(self._side(self.actual, False))
        on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        agg = both.groupBy("key").agg(F.count_if(F.col("side")).alias("e_n"), F.count_if(~F.col("side")).alias("a_n"), on(True, "h1").alias("e1"), on(True, "h2").alias("e2"), on(False, "h1").alias("a1"), on(False, "h2").alias("a2"))
        once = (F.col("e_n") == 1) & (F.col("a_n") == 1)
        odd = (F.col("e1") != F.col("a1")) | (F.col("e2") != F.col("a2"))
        return agg.select("key", "e_n", "a_n", (once & odd).alias("differs"), ((F.col("e_n") > 0) & (F.col("a_n") > 0) & ~once).alias("repeated"))

    def _canonical(self, df: DataFrame) -> str:
        schema, o = fields_of(df), self.cfg.canon()
        return f"array({', '.join(column_sql(c, schema[c], o) for c in self.columns)})" if self.columns else "cast(array() as array<string>)"

    def _smallest(self, wanted: DataFrame) -> DataFrame:
        """key, e_c and a_c: the smallest canonical row of each side, of the wanted keys, where they differ."""
        side = lambda df, e: df.select(F.expr(self._key_sql(df)).alias("key"), F.expr(self._canonical(df)).alias("c"), F.lit(e).alias("side"))
        both = side(self.expected, True).unionAll(side(self.actual, False)).join(wanted, "key", "left_semi")
        least = lambda e: F.min(F.when(F.col("side") == e, F.col("c")))
        return both.groupBy("key").agg(least(True).alias("e_c"), least(False).alias("a_c")).where("e_c != a_c")

    @cached_property
    def pairs(self) -> DataFrame:
        """key and sig (sorted names of the columns that differ) of each key that has changed."""
        order = sorted(range(len(self.columns)), key=lambda i: self.columns[i])
        differ = [f"case when e_c[{i}] != a_c[{i}] then {literal(self.columns[i])} end" for i in order]
        sig = f"array_compact(array({', '.join(differ)}))" if differ else "cast(array() as array<string>)"
        return self._smallest(self.by_key.where("differs or repeated").select("key")).select("key", F.expr(sig).alias("sig"))

    def _representatives(self, df: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
        names = list(dict.fromkeys([*self.keys, *self.columns]))
        rows = df.select(F.expr(self._key_sql(df)).alias("key"), F.expr(self._canonical(df)).alias("c"), F.struct(*[F.col(quote(c)) for c in names]).alias("row"))
        best = rows.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min_by("row", "c").alias(name))
        return best.select("key", name)

    def _with_rows(self, pairs: DataFrame) -> DataFrame:
        """key, e and a (the rows), sig, equiv (those of sig that only spell absence differently)."""
        out = pairs.join(self._representatives(self.expected, pairs, "e"), "key").join(self._representatives(self.actual, pairs, "a"), "key")
        same = []
        if self.cfg.null_equivalence:
            e, a = fields_of(self.expected), fields_of(self.actual)
            same = [f"case when array_contains(sig, {literal(c)}) and {column_equivalent_sql('e', 'a', c, e[c], a[c])} then {literal(c)} end" for c in sorted(self.columns)]
        equiv = f"array_compact(array({', '.join(same)}))" if same else "cast(array() as array<string>)"
        return out.select("key", "e", "a", "sig", F.expr(equiv).alias("equiv"))

    @cached_property
    def changed(self) -> DataFrame:
        return self._with_rows(self.pairs)

    def changed_for(self, keys: list[str]) -> DataFrame:
        """`changed` for some keys alone."""
        return self._with_rows(self.pairs.where(F.col("key").isin(keys)))

    def summary(self) -> DataFrame:
        """One row of counts, without changed."""
        total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
        e, a = F.col("e_n"), F.col("a_n")
        return self.by_key.agg(total(e, "expected_rows"), total(a, "actual_rows"), total(F.when(a == 0, e).otherwise(0), "missing"), total(F.when(e == 0, a).otherwise(0), "added"), total(F.greatest(e - 1, F.lit(0)), "repeats_expected"), total(F.greatest(a - 1, F.lit(0)), "repeats_actual"), total((F.col("differs") | F.col("repeated")).cast("int"), "suspects"))

    def full_summary(self) -> DataFrame:
        """The same with changed, as one lazy plan: repeated keys alone are looked up again."""
        sure = self.by_key.agg(F.count_if("differs").alias("sure"))
        more = self._smallest(self.by_key.where("repeated").select("key")).agg(F.count(F.lit(1)).alias("more"))
        counts = self.summary().drop("suspects").join(sure, how="cross").join(more, how="cross")  # one row each
        return counts.withColumn("changed", F.col("sure") + F.col("more")).drop("sure", "more")

    def signatures(self) -> DataFrame:
        """sig, n, the smallest key."""
        return self.pairs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))

    def diff_counts(self) -> DataFrame:
        """column, diff_rows: explodes signatures, not rows."""
        return self.signatures().select(F.explode("sig").alias("column"), "n").groupBy("column").agg(F.sum("n").alias("diff_rows"))

    def column_counts(self) -> DataFrame:
        """column, diff_rows, equivalent_rows."""
        if not self.cfg.null_equivalence:
            return self.diff_counts().withColumn("equivalent_rows", F.lit(0).cast("long"))
        per = self.changed.groupBy("sig", "equiv").agg(F.count(F.lit(1)).alias("n"))
        one = per.select(F.explode("sig").alias("column"), "n", "equiv")
        return one.groupBy("column").agg(F.sum("n").alias("diff_rows"), F.sum(F.when(F.array_contains("equiv", F.col("column")), F.col("n")).otherwise(0)).alias("equivalent_rows"))

    def column_status(self) -> DataFrame:
        """column, status, diff_rows of every compared column, as in the reports by column."""
        spark = self.expected.sparkSession
        e, a = fields_of(self.expected), fields_of(self.actual)
        all_ = spark.createDataFrame([(c, same_type(e[c], a[c])) for c in self.columns], "column string, same boolean")
        n = F.coalesce("diff_rows", F.lit(0))
        status = F.when(~F.col("same"), TYPE_DIFF).when(n == 0, MATCHED).when(n <= F.col("equivalent_rows"), EQUIVALENT).otherwise(VALUE_DIFF)
        return all_.join(self.column_counts(), "column", "left").select("column", status.alias("status"), n.alias("diff_rows"))

    def one_sided(self, expected: bool) -> DataFrame:
        """key, row: every row whose key the other side lacks."""
        df, col = (self.expected, "a_n") if expected else (self.actual, "e_n")
        rows = df.select(F.expr(self._key_sql(df)).alias("key"), F.struct(*[F.col(quote(c)) for c in df.columns]).alias("row"))
        return rows.join(self.by_key.where(F.col(col) == 0).select("key"), "key", "left_semi")

    def differences(self) -> DataFrame:
        """Long form of changed: key, row structs exploded to (column, expected, actual) as text."""
        triples = [F.struct(F.lit(c).alias("column"), F.col(f"e.{quote(c)}").cast("string").alias("expected"), F.col(f"a.{quote(c)}").cast("string").alias("actual")) for c in self.columns]
        keys = [F.col(f"e.{quote(k)}").alias(k) for k in self.keys]
        long = self.changed.select(*keys, "sig", F.explode(F.array(*triples)).alias("d"))
        return long.where(F.array_contains("sig", F.col("d.column"))).select(*self.keys, "d.column", "d.expected", "d.actual")
