"""Multiset comparison: one shuffle of 16-byte digests, combined on the map side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotab.config import CompareConfig
from isotab.functions.canon import quote
from isotab.functions.fingerprint import digest_sql, fields_of, row_text_sql


@dataclass
class KeylessPlan:
    expected: DataFrame
    actual: DataFrame
    columns: list[str]
    cfg: CompareConfig

    def _side(self, df: DataFrame, e: int, a: int) -> DataFrame:
        digest = digest_sql(fields_of(df), self.columns, self.cfg.canon())
        return df.select(F.expr(digest).alias("fp"), F.lit(e).cast("long").alias("e"), F.lit(a).cast("long").alias("a"))

    def counts(self) -> DataFrame:
        """fp, copies on each side."""
        both = self._side(self.expected, 1, 0).unionAll(self._side(self.actual, 0, 1))
        return both.groupBy("fp").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))

    def summary(self) -> DataFrame:
        zero = F.lit(0).cast("long")
        total = lambda c, name: F.coalesce(F.sum(c), zero).alias(name)
        return self.counts().agg(total(F.col("e"), "expected_rows"), total(F.col("a"), "actual_rows"), total(F.greatest(F.col("e") - F.col("a"), zero), "missing"), total(F.greatest(F.col("a") - F.col("e"), zero), "added"))

    def _surplus(self, df: DataFrame, more: str, less: str) -> DataFrame:
        """Rows of one side, each as often as that side has surplus copies. The digests that differ are joined in:
        Spark broadcasts them where their measured size allows, and shuffles both sides by digest otherwise."""
        names, schema = self.columns, fields_of(df)
        surplus = self.counts().where(F.col(more) > F.col(less)).select("fp", (F.col(more) - F.col(less)).alias("n"))
        rows = df.select(F.expr(digest_sql(schema, names, self.cfg.canon())).alias("fp"), F.struct(*[F.col(quote(c)) for c in names]).alias("row") if names else F.struct(F.lit(1).alias("_")).alias("row"), F.expr(row_text_sql(schema, names, self.cfg.canon())).alias("text"))
        # One spelling stands for the digest: equal digests have equal canonical text.
        rep = rows.join(surplus, "fp").groupBy("fp").agg(F.first("row").alias("row"), F.first("text").alias("text"), F.max("n").alias("n"))
        return rep.select("fp", "row", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))

    def missing(self) -> DataFrame:
        return self._surplus(self.expected, "e", "a")

    def added(self) -> DataFrame:
        return self._surplus(self.actual, "a", "e")

    def missing_rows(self) -> DataFrame:
        return self.missing().select("row.*")

    def added_rows(self) -> DataFrame:
        return self.added().select("row.*")

    def examples(self, n: int) -> list:
        """At most n rows (kind, text, row as a Row), in the order of kind and canonical text."""
        out = []
        for kind, df in (("missing", self.missing()), ("added", self.added())):
            if len(out) < n:
                out += [(kind, r["text"], r["row"]) for r in df.orderBy("text", "copy").limit(n - len(out)).collect()]
        return out
