"""Run history as DataFrames over the tables of a result sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Changed cells per case that a report shows of its latest run; signatures are counted over all.
SHOWN_DIFFS = 500
_CELLS = "array<struct<column string, expected string, actual string>>"


def recent(summary: DataFrame, days: int, now: dt.datetime | None = None) -> DataFrame:
    at = now or dt.datetime.now(dt.UTC)
    return summary.where(F.col("run_ts") >= F.lit(at - dt.timedelta(days=days)))


def latest_per_day(summary: DataFrame) -> DataFrame:
    """The last run of each case on each UTC day, with `day`; a tie of times goes to the larger run_id."""
    day = F.to_date("run_ts")
    w = Window.partitionBy("case_name", "day").orderBy(F.desc("run_ts"), F.desc("run_id"))
    return summary.withColumn("day", day).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def consecutive_failures(summary: DataFrame, n: int = 3) -> DataFrame:
    """Runs that end a series of n failures of one case."""
    w = Window.partitionBy("case_name").orderBy("run_ts", "run_id")
    failed = F.lit(True)
    for k in range(n):
        failed = failed & ~F.coalesce(F.lag("equivalent", k).over(w) if k else F.col("equivalent"), F.lit(True))
    return summary.withColumn("_f", failed).where("_f").select("case_name", "run_id", "run_ts")


def failure_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("case_name").agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("equivalent")).alias("failures"), F.max("run_ts").alias("last_run"))


def missing_key_counts(summary: DataFrame, diffs: DataFrame, days: int = 21, now: dt.datetime | None = None) -> DataFrame:
    """How often each key was missing lately; the time stands in the summary, so the tables are joined."""
    runs = recent(summary, days, now).select("run_id", "case_name")
    return diffs.where("diff_kind = 'missing'").join(runs, ["run_id", "case_name"]).groupBy("case_name", "key_json").agg(F.count(F.lit(1)).alias("occurrences"))


def column_diff_counts(diffs: DataFrame) -> DataFrame:
    cells = diffs.where("column_diffs is not null").select("case_name", F.explode(F.from_json("column_diffs", _CELLS)).alias("d"))
    return cells.groupBy("case_name", F.col("d.column").alias("column")).agg(F.count(F.lit(1)).alias("n"))


def daily_points(summary: DataFrame, days: int = 21, now: dt.datetime | None = None) -> DataFrame:
    """One row per case and day of what its last run found, with whether the schemas had drifted."""
    drift = F.lit(False)
    for c in ("columns_only_in_expected", "columns_only_in_actual", "type_mismatches"):
        drift = drift | (F.coalesce(F.col(c), F.lit("[]")) != "[]")
    last = latest_per_day(recent(summary, days, now))
    return last.select("case_name", "day", "run_id", "tags", "equivalent", "expected_rows", "actual_rows", "missing_count", "added_count", "changed_count", drift.alias("drifted"))


def latest_changes(points: DataFrame, diffs: DataFrame) -> DataFrame:
    """case_name, key_json, cells: the changed rows that the last run of each case has stored."""
    last = points.groupBy("case_name").agg(F.max_by("run_id", "day").alias("run_id"))
    rows = diffs.where("diff_kind = 'changed'").join(last, ["case_name", "run_id"])
    return rows.select("case_name", "key_json", F.from_json("column_diffs", _CELLS).alias("cells")).where(F.size("cells") > 0)


def signature_counts(changes: DataFrame) -> DataFrame:
    """case_name, columns, n and the row of the smallest key, for each set of columns that changed together."""
    columns = F.array_sort(F.transform("cells", lambda c: c["column"]))
    return changes.groupBy("case_name", columns.alias("columns")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key_json", "cells")).alias("example"))


def shown_cells(changes: DataFrame, most: int = SHOWN_DIFFS) -> DataFrame:
    """case_name, key_json, column, expected, actual: the first changed cells of each case by key."""
    w = Window.partitionBy("case_name").orderBy("key_json", "place", "cell")
    cells = changes.select("case_name", "key_json", F.posexplode("cells").alias("place", "cell"))
    return cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("case_name", "key_json", "cell.*")
