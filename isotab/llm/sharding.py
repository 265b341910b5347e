"""Shards of near-equal bytes by sampled splitters.

A record's key is a hash of its text followed by bits of a hash of its id: equal texts are neighbours, and even a text
that a third of all rows share can be cut. Rows are drawn for a sample with a chance proportional to their size, the
sample's quantiles become range boundaries, and a range that turns out overfull is subdivided at quantiles of its own keys,
again and again, until it is small enough or holds one key; rows of one key are parted by their place. Sums of
bytes and rows per range (a bounded table) give every range its exact place, running sums within a range give every
record its place, and the shard follows from that place: sizes differ by about one record.

The text is read once: what the later steps need (id, size, checksum, key) is kept in a checkpoint of a few bytes a row.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotab.llm.common import checkpointed

SHARDS, RANGES_PER_SHARD, SAMPLES_PER_RANGE = 24, 32, 64
#: Rows of one range that one task sorts; a range with more is subdivided.
ROWS_PER_RANGE = 1_000_000
_LOW = (1 << 24) - 1


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes plus 8), text_crc32, law ('bytes'), shard, slot, grown_shard (NULL).

    A NULL text has no bytes. Slots count from 0 in each shard in key order; rows alike in all columns are
    interchangeable. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.xxhash64(text).bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.xxhash64(F.col(f"`{id_col}`")).bitwiseAND(F.lit(_LOW)))
    rows = checkpointed(docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))).withColumn("at", F.monotonically_increasing_id())
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).collect()[0]["t"] or 1
    ranges = shards * RANGES_PER_SHARD
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(99)), F.lit(1 << 50)) / float(1 << 50)
    sample = rows.where(draw < F.col("size") * (ranges * SAMPLES_PER_RANGE / total))
    cuts = sample.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).collect()[0]["c"] or []
    cuts = sorted(set(cuts))
    spread = rows.withColumn("range", _at_or_below("key", cuts))
    # At most `ranges` rows, then at most that plus twice rows/limit: bounded by parameters and by the number of tasks.
    while True:
        seen = spread.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        over = {r["range"]: -(-r["n"] // rows_per_range) for r in seen if r["n"] > rows_per_range}
        wide = [r["range"] for r in seen if r["range"] in over and r["hi"] > r["lo"]]
        if not wide:
            break
        most = max(over[k] for k in wide)
        finer = spread.where(F.col("range").isin(wide)).groupBy("range").agg(F.percentile_approx("key", [i / most for i in range(1, most)], 20 * most).alias("c"), F.max("key").alias("hi"), F.min("key").alias("lo")).collect()
        # Keys beside a hot one are cut off it: a cut begins a range, and the next key after it another.
        new = {x for r in finer for c in r["c"] for x in (c, c + 1) if r["lo"] < x <= r["hi"]} - set(cuts)
        if not new:
            new = {r["hi"] for r in finer} - set(cuts)
        if not new:
            break
        cuts = sorted({*cuts, *new})
        spread = rows.withColumn("range", _at_or_below("key", cuts))
    part = F.lit(0)
    if over:
        parts = F.create_map(*[x for k, v in over.items() for x in (F.lit(k), F.lit(v))])[F.col("range")]
        part = F.coalesce(F.pmod(F.xxhash64("at"), parts).cast("int"), F.lit(0))
    spread = spread.withColumn("part", part)
    cells = {(r["range"], r["part"]): (r["n"], r["b"]) for r in spread.groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()}
    parts = [over.get(k, 1) for k in range(len(cuts) + 1)]
    filled = [cells.get((k, j), (0, 0)) for k in range(len(cuts) + 1) for j in range(parts[k])]
    n0, b0 = (_longs(list(accumulate((c[i] for c in filled), initial=0))) for i in (0, 1))
    spread = spread.select("*", (F.get(_longs(list(accumulate(parts, initial=0))), F.col("range")) + F.col("part")).cast("int").alias("cell"))
    w = Window.partitionBy("cell").orderBy("key", "doc_id", "size", "text_crc32", "at").rowsBetween(Window.unboundedPreceding, 0)
    put = spread.select("doc_id", "size", "text_crc32", "cell", F.count(F.lit(1)).over(w).alias("nth"), F.sum("size").over(w).alias("end"))
    put = put.select("doc_id", "size", "text_crc32", (F.get(n0, F.col("cell")) + F.col("nth") - 1).alias("nth"), (F.get(b0, F.col("cell")) + F.col("end")).alias("end"))
    middle = F.col("end").cast("decimal(30,0)") * 2 - F.col("size")
    put = put.withColumn("shard", F.least(F.floor(middle * shards / (2 * total)), F.lit(shards - 1)).cast("int"))
    first = put.groupBy("shard").agg(F.min("nth").alias("first"))
    out = put.join(F.broadcast(first), "shard")  # a row per shard
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _at_or_below(column: str, cuts: list[int]):
    """How many of the sorted cuts are at most the column's value, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    table = _longs(cuts)
    go = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) <= F.col(column)), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), go)


def _longs(values: list[int]):
    return F.lit(np.array(values, dtype=np.int64))
