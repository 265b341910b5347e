"""The queries of this subpackage, with production parameters over whole tables, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotab.llm.bpe import encode_decode
from isotab.llm.common import bounded_batches
from isotab.llm.exact_dedup import exact_dedup
from isotab.llm.html_text import extract
from isotab.llm.licences import scan
from isotab.llm.line_dedup import dedup_lines
from isotab.llm.near_join import near_join
from isotab.llm.packing import pack_documents
from isotab.llm.quality import classify
from isotab.llm.sharding import shard_by_bytes
from isotab.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_NORM} AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""")
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op10_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_bpe(spark, sf_dir):
    coded = encode_decode(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op2_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


@query()
def op3_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20""")
def op5_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op6_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query()
def op4_near_join(spark, sf_dir):
    return near_join(table(spark, sf_dir, "documents"))


@query()
def op7_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


@query()
def op8_licences(spark, sf_dir):
    """Documents stand as files, each in the directory of its source."""
    return scan(table(spark, sf_dir, "documents"), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.col("doc_id").cast("string")))
