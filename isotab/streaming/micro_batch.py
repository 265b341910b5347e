"""Parity of streams (an extension of this engine): compare each micro-batch, or keep a windowed balance of digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isotab.config import CompareConfig
from isotab.functions.fingerprint import row_digest
from isotab.operators.compare import compare_tables
from isotab.result import Outcome


def compare_batches(actual: DataFrame, expected_for: Callable[[DataFrame], DataFrame], cfg: CompareConfig, handle: Callable[[int, Outcome], None], checkpoint: str) -> StreamingQuery:
    """For each micro-batch of `actual`, compare it with expected_for(batch)."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            handle(epoch, compare_tables(expected_for(batch), batch, cfg))
        finally:
            batch.unpersist()

    return actual.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_balance(expected: DataFrame, actual: DataFrame, ts: str, window: str = "1 hour", watermark: str = "1 hour", cfg: CompareConfig | None = None) -> DataFrame:
    """Per window and digest: copies in expected less copies in actual. A window is final once the watermark passes it."""
    cfg = cfg or CompareConfig()
    names = [c for c in expected.columns if c in actual.columns and c not in cfg.ignore_columns]
    side = lambda df, w: df.select(F.col(ts).alias("ts"), row_digest(df, names, cfg.canon()).alias("fp"), F.lit(w).alias("w"))
    both = side(expected, 1).unionAll(side(actual, -1)).withWatermark("ts", watermark)
    return both.groupBy(F.window("ts", window), "fp").agg(F.sum("w").alias("balance"))
