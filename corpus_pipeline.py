"""From documents to packed training sequences: quality, line dedup, near duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotab.llm.common import bounded_batches, checkpointed
from isotab.llm.components import settled
from isotab.llm.line_dedup import without_copies
from isotab.llm.near_join import near_join
from isotab.llm.packing import pack_documents
from isotab.llm.quality import train, with_score

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, in their own columns. A text that is NULL is scored as an empty one; equal
    texts have equal scores; an empty table gives an empty one."""
    bounded_batches(spark)
    rated, score = with_score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rated.where(F.col(score) >= 0.5).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated lines. One that is left without words goes: all of it stands elsewhere.
    A NULL text is an empty one; NULL ids come first, so their lines stay; rows that repeat an id and a text are alike."""
    bounded_batches(spark)
    kept = without_copies(docs).where("n_removed = 0 or n_removed < n_lines")
    columns = ["text" if c == "text" else F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return kept.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id (then text hash; those without an id come last).
    Rows that repeat an id (or NULL) and a text are one document; other rows that share an id are decided on their own."""
    bounded_batches(spark)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        found = near_join(docs)
        gone = settled(found.where("doc_id != class_id").select(F.col("doc_id").alias("_id")))
        return docs.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    # A document's key has the order in which one of a group is kept.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("hash"))
    keyed = checkpointed(docs.withColumn("_key", key).dropDuplicates(["_key"]))
    found = near_join(keyed, id_col="_key")
    gone = settled(found.where("doc_id != class_id").select(F.col("doc_id").alias("_gone")))
    return keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti").drop("_key")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed: a NULL text is the end mark alone, repeated rows are packed as often as they stand."""
    import public_tokenizers

    bounded_batches(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


#: In order: each is (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]
#: The classifier, the tokenizer and the packing are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
