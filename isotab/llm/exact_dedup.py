"""Exact deduplication by sorting content.

Sampled splitters (Spark's range partitioner, over a bounded prefix and a hash of the normalised text, so that the
sample stays small) deal the texts out by range; Spark's external sort then puts equal texts side by side, and the
window operator compares neighbours byte by byte. The text is read three times (counts of hashes, splitters, sort) and
crosses the network once; what comes of it is checkpointed without the text.

A text that many rows share would land in one task. Counts by hash, combined before their shuffle, tell which hashes
exceed 1/8 of a partition's share; there are at most 8 per partition, so the list has a proven bound and is broadcast.
Their rows are dealt over salts by their place in the table, so that rows alike in all columns part too; every salt finds its
local keeper, and the keepers of all salts are compared in turn. Only salted rows are joined with what comes of that, by the
join that Spark chooses for the measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotab.llm.common import checkpointed, parallelism

# Fixed value: the characters that don't count in a comparison, [\x20\x09-\x0D].
IGNORED = " \t\n\x0b\x0c\r"
#: Characters of a text in the range key; a hash follows, so equal prefixes can still be split.
PREFIX = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks, tabs and line ends; NULL is an empty text. The row with the most
    code points in its original text stays, of those the one with the smallest id (NULL ids last). Of rows that agree
    in id and text one is kept. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    parts, rows = parallelism(spark), docs.count()
    hot_at = max(2, rows // (8 * parts))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    norm = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.char_length(text).alias("n"), norm.alias("norm")).withColumn("h", F.xxhash64("norm")).withColumn("at", F.monotonically_increasing_id())
    hot = base.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > hot_at)
    hot = hot.select("h", F.ceil(F.col("copies") / hot_at).alias("salts"))
    salted = base.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("salts").isNull(), -1).otherwise(F.pmod(F.xxhash64("at"), F.col("salts")))).drop("salts")
    dealt = salted.withColumn("prefix", F.substring("norm", 1, PREFIX)).repartitionByRange("prefix", "h", "salt")
    group = Window.partitionBy("prefix", "h", "salt", "norm")
    ordered = group.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = dealt.select("doc_id", "norm", "salt", F.first("doc_id").over(every).alias("keep_id"), F.first("n").over(every).alias("keep_n"), F.count(F.lit(1)).over(every).alias("group_size"), F.row_number().over(ordered).alias("place"))
    # Kept without the text, but for one row of each salt of a hot text: at most 16 per partition.
    keeper = F.when((F.col("salt") >= 0) & (F.col("place") == 1), F.col("norm"))
    local = checkpointed(local.select("doc_id", "salt", "keep_id", "keep_n", "group_size", "place", F.sha2("norm", 256).alias("text_sha256"), keeper.alias("norm")))
    keepers = local.where("salt >= 0 and place = 1").select("norm", "text_sha256", "salt", "keep_id", "keep_n", "group_size")
    same = Window.partitionBy("norm")
    best = same.orderBy(F.desc("keep_n"), F.asc_nulls_last("keep_id"), "salt")
    merged = keepers.select("text_sha256", "salt", F.first("keep_id").over(best).alias("all_id"), F.first("salt").over(best).alias("all_salt"), F.sum("group_size").over(same).alias("all_size"))
    cold = local.where("salt < 0").select("doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "text_sha256")
    hot_rows = local.where("salt >= 0").select("doc_id", "salt", "place", "text_sha256").join(merged, ["text_sha256", "salt"])
    kept = (F.col("place") == 1) & (F.col("salt") == F.col("all_salt"))
    return cold.unionByName(hot_rows.select("doc_id", F.col("all_id").alias("keep_id"), F.col("all_size").alias("group_size"), kept.alias("kept"), "text_sha256"))
