"""What the operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python operator handles at a time, in bytes.
SLICE_BYTES = 4 << 20
#: Rows of a few bytes each in a partition of a checkpoint.
ROWS_PER_PART = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Write to the folder that all executors share and cut the lineage there. A session without a checkpoint
    folder gets a temporary one where driver and executors are one process (a test), and an error otherwise."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} share")
            folder = tempfile.mkdtemp(prefix="isotab-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a small table of so many rows: few files for little, at most what the session has for a shuffle."""
    return max(1, min(parallelism(spark), -(-rows // ROWS_PER_PART)))


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of SLICE_BYTES, where the session has a larger number of bytes (or -1,
    no limit): a batch is held several times at once, in the JVM's direct memory and in the worker. This changes the
    session, so queries and the pipeline call it, not operators; they are right with any size of batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).removesuffix("b")
    if held == "-1" or held.isdigit() and int(held) > SLICE_BYTES:
        spark.conf.set(key, SLICE_BYTES)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, under these names, so that no other column can clash. A NULL text is an empty one."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `most` bytes (one row at least)."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to
