"""Removal of repeated runs of lines, by a suffix array over line ids.

A document is the sequence of ids of its lines that have words. Documents with equal sequences are one class: of them the
first stays, and all lines of the others lie in one repeated run, if that has enough words. The first of each class goes
into the suffix array.

Prefix doubling ranks suffixes by their first 1, 2, 4, ... lines: the rank of twice the length is that of the pair of ranks
half a prefix apart, and ranks keep the order of a global sort (a range-partitioned sort numbers each distinct pair). A
rank is an interval of the suffix array: the suffixes whose longest common prefix has 2**k lines or more. Only intervals
with several suffixes live on, and doubling goes on until none is left, so that the longest repeated run is found, however
long, in as many rounds as its length has bits; each works on fewer rows. Counts are combined before every shuffle.

A maximal repeated run of m lines, 2**k <= m, starts with one interval of level k and ends with another, and both cover it:
wherever a suffix isn't the first of its interval and the interval's prefix has at least MIN_WORDS words, that prefix is
(part of) a later copy, and all of its lines go. Runs of which neither part has so many words are few and short (MIN_WORDS
lines at most): their shortest forms, which begin or end at each line, are looked up by the ranks of their first and last
2**k lines. First copies stay, so no line disappears from the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotab.llm.common import checkpointed, parts_for, slices
from isotab.llm.components import settled

#: Words of the shortest run that counts as a copy.
MIN_WORDS = 5


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """text and the key (d, th): repeated rows of one id and text are one document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def split_lines(text: str) -> list[tuple[int, list[str]]]:
    """(place, words) of the lines that have words."""
    return [(i, w) for i, line in enumerate(text.split("\n")) if (w := line.split())]


def shortest_runs(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the lines of the shortest run of `least` words that starts with it and that ends with it; 0: none."""
    total = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    end = np.searchsorted(total, total[:-1] + least)  # first end whose sum reaches
    ahead = np.where(end <= n, end - np.arange(n), 0)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    back = np.where(total[1:] >= least, np.arange(n) - begin + 1, 0)
    return ahead, back


def between_levels(least: int) -> list[int]:
    """Lengths of shortest runs that are no power of two: a run of `least` words has at most so many lines."""
    return [m for m in range(3, least + 1) if m & (m - 1)]


def short_runs(counts: np.ndarray, least: int) -> np.ndarray:
    """For each line, one bit for each of between_levels(least): whether a shortest run of that length starts there."""
    ahead, back = shortest_runs(counts, least)
    out = np.zeros(len(counts), np.int64)
    for bit, m in enumerate(between_levels(least)):
        out[ahead == m] |= 1 << bit
        out[np.flatnonzero(back == m) - m + 1] |= 1 << bit
    return out


def sequences(keyed: DataFrame, least: int) -> DataFrame:
    """(d, th, s1, s2, words, lines) of each document: 128 bits of its sequence, and per line 128 bits of its text with blanks
    evened out, its words and the short runs that start with it."""
    kind = keyed.schema["d"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                whole, total, ends, ids, sizes, needs = [], [], [0], [], [], []
                for text in part.column("text").to_pylist():
                    lines = split_lines(text)
                    raw = b"".join(hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=16).digest() for _, w in lines)
                    size = np.array([len(w) for _, w in lines], np.int64)
                    whole.append(hashlib.blake2b(raw, digest_size=16).digest())
                    total.append(int(size.sum()))
                    ends.append(ends[-1] + len(lines))
                    ids.append(raw)
                    sizes.append(size)
                    needs.append(short_runs(size, least))
                pair, own = np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2), np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
                items = pa.StructArray.from_arrays([pa.array(x) for x in (pair[:, 0], pair[:, 1], np.concatenate(sizes), np.concatenate(needs))], names=["a", "b", "w", "need"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("th"), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(total, pa.int64()), lists], names=["d", "th", "s1", "s2", "words", "lines"])

    return keyed.select("d", "th", "text").mapInArrow(run, f"d {kind}, th long, s1 long, s2 long, words long, lines array<struct<a:long,b:long,w:long,need:long>>")


def ranked(rows: DataFrame, pair: list[str], most: int) -> DataFrame:
    """`pair`, the number n of its rows, the first of them, and its rank, for pairs that occur more than once: numbers in
    the order of a global sort, with gaps. `most` bounds the rows."""
    repeated = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "seq")).alias("first")).where("n > 1")
    return checkpointed(repeated.orderBy(*pair).withColumn("r", F.monotonically_increasing_id()).coalesce(parts_for(rows.sparkSession, most)))


def _later(rows: DataFrame, intervals: DataFrame, pair: list[str]) -> DataFrame:
    """The rows of these intervals, with r and whether each is a later copy."""
    return rows.join(intervals, pair).withColumn("later", F.struct("doc", "seq") != F.col("first"))


def later_runs(lines: DataFrame, least: int) -> DataFrame:
    """(doc, seq, n): n lines from seq on are a later copy. lines: (doc, seq, a, b, w, need), documents numbered in order."""
    spark = lines.sparkSession
    total = lines.count()
    ranks = ranked(lines, ["a", "b"], total)
    level, out, span = _later(lines, ranks, ["a", "b"]), [], 1
    while True:
        live = ranks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
        if not live:
            break
        level = settled(level.select("doc", "seq", "need", "w", "r", "later"), live)
        out.append(level.where(F.col("later") & (F.col("w") >= least)).select("doc", "seq", F.lit(span).cast("long").alias("n")))
        ahead = lambda c, by: F.first(c).over(Window.partitionBy("doc").orderBy("seq").rangeBetween(by, by))
        for bit, m in enumerate(between_levels(least)):
            if span < m < 2 * span:
                runs = level.select("doc", "seq", "need", "r", ahead("r", m - span).alias("q")).where(F.col("q").isNotNull() & (F.col("need").bitwiseAND(F.lit(1 << bit)) != 0))
                named = runs.groupBy("r", "q").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "seq")).alias("first")).where("n > 1").drop("n")
                out.append(_later(runs, named, ["r", "q"]).where("later").select("doc", "seq", F.lit(m).cast("long").alias("n")))
        pairs = level.select("doc", "seq", "need", "w", F.col("r").alias("r1"), ahead(F.struct("r", "w"), span).alias("next")).where("next is not null")
        pairs = pairs.select("doc", "seq", "need", (F.col("w") + F.col("next.w")).alias("w"), "r1", F.col("next.r").alias("r2"))
        ranks = ranked(pairs, ["r1", "r2"], live)
        level, span = _later(pairs, ranks, ["r1", "r2"]), 2 * span
    if not out:
        return spark.createDataFrame([], "doc long, seq long, n long")
    from functools import reduce

    return reduce(DataFrame.unionByName, out)


def later_copies(keyed: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(d, th, gone): the runs of lines (seq, n) of a document that are later copies; every document once."""
    base = checkpointed(sequences(keyed, least)).withColumn("row", F.monotonically_increasing_id())
    some = base.where(F.size("lines") > 0)
    firsts = some.groupBy("s1", "s2").agg(F.min(F.struct("d", "th", "row")).alias("first"))
    firsts = checkpointed(firsts.orderBy("first").withColumn("doc", F.monotonically_increasing_id()).coalesce(parts_for(keyed.sparkSession, base.count())))
    # A table whose partitioning Spark doesn't know: the join shuffles both sides and can split a hot class.
    known = some.select("d", "th", "s1", "s2", "words").join(firsts, ["s1", "s2"])
    same = F.col("d").eqNullSafe(F.col("first.d")) & (F.col("th") == F.col("first.th"))
    whole = known.where(~same & (F.col("words") >= least)).select("d", "th", F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit(2**62).alias("n"))).alias("gone"))
    lines = some.select("row", "lines").join(firsts.select(F.col("first.row").alias("row"), "doc"), "row").select("doc", F.posexplode("lines").alias("seq", "line"))
    lines = checkpointed(lines.select("doc", F.col("seq").cast("long").alias("seq"), "line.*"))
    runs = later_runs(lines, least).groupBy("doc").agg(F.collect_list(F.struct("seq", "n")).alias("gone"))
    part = runs.join(firsts, "doc").select("first.d", "first.th", "gone")
    return part.unionByName(whole.dropDuplicates(["d", "th"]))


def _without(text: str, gone: list[int]) -> str:
    """The text less the given lines (counted among those with words) and blank lines that follow them."""
    drop, keep, seq, after = set(gone), [], -1, False
    for line in text.split("\n"):
        if line.split():
            seq += 1
            after = seq in drop
            if after:
                continue
        elif after:
            continue
        keep.append(line)
    return "\n".join(keep)


def covered(runs: list[dict], lines: int) -> list[int]:
    """The lines of the maximal runs that these runs add up to."""
    out, to = [], 0
    for seq, n in sorted((r["seq"], r["n"]) for r in runs):
        end = min(lines, seq + n)
        out += range(max(seq, to), end)
        to = max(to, end)
    return out


def without_copies(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed) for each row: `row` holds its columns but the text, `text` what stays of it.

    Of a run of lines that repeats, in one document or across documents, and has at least `least` words, the copy in
    the document of the smallest id (of any type; then hash of the text, then the earliest line) stays; a NULL id counts as the
    smallest. Lines are equal if their words are. Copies may overlap: of a line repeated in a row the first stays.
    Lines without words are never copies; they go only where they follow a removed line. A NULL text is an empty one.
    Rows that repeat an id and a text are one document and are treated alike. n_lines counts lines with words.
    """
    gone = later_copies(_keyed(docs, id_col, text_col), least)
    gone = settled(gone.select(F.col("d").alias("gd"), F.col("th").alias("gth"), "gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    keyed = _keyed(docs, id_col, text_col, row)
    rows = keyed.join(gone, keyed["d"].eqNullSafe(gone["gd"]) & (keyed["th"] == gone["gth"]), "left").select("row", "text", "gone")
    schema = T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                lines = [sum(1 for x in t.split("\n") if x and not x.isspace()) for t in texts]
                gones = [covered(g, n) if g else () for g, n in zip(part.column("gone").to_pylist(), lines, strict=True)]
                kept = [t if not g else _without(t, g) for t, g in zip(texts, gones, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(list(map(len, gones)), pa.int64())], names=["row", "text", "n_lines", "n_removed"])

    return rows.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, n_lines, n_removed, as in without_copies(). An empty table gives an empty
    result; other columns are ignored."""
    lean = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return without_copies(lean, least).select("row.doc_id", "text", "n_lines", "n_removed")
