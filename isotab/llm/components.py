"""Connected components by labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotab.llm.common import checkpointed, parallelism, parts_for


def settled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpoint without any known partitioning: a join with it shuffles both sides, so that Spark can split
    the partition of a hot key. rows: a bound on its rows; few rows take few files."""
    spark = df.sparkSession
    return checkpointed(df.repartition(parallelism(spark) if rows is None else parts_for(spark, rows)))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label), with a bound on the rows of `edges` if known: label is the least node of the component. Edges are (a, b), in either direction, of any type
    with an order; nodes without edges don't appear. Each round spreads labels over all edges and then jumps to the
    label's own label, so the rounds grow with the logarithm of the longest path."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = settled(both, None if rows is None else 2 * rows)
    found = both.count()
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), found)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("at"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        new = settled(spread.join(up, "at").select("node", F.least("at", "above").alias("label"), (F.least("at", "above") != F.col("old")).alias("moved")), found)
        if not new.agg(F.coalesce(F.max("moved"), F.lit(False)).alias("m")).collect()[0]["m"]:
            return new.select("node", "label")
        labels = new.select("node", "label")
