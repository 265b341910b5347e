"""Similarity join of documents on the Jaccard similarity of their word n-grams.

1. Documents with equal n-gram sets form a class; everything below is about classes, so copies cost nothing.
2. A class has SIZE MinHash values. BANDS keys of ROWS values each make candidates: two classes that agree in a key.
   All keys miss a pair with a chance of 8e-5 at similarity 0.8, 1e-6 at 0.85 and 2e-9 at 0.9.
3. Candidates form groups (connected components). All pairs of a group are compared in numpy, a block of the group
   against another in each task, so a large group is shared out, and no pair becomes a row. A group of more than GIANT
   classes may be a chain of candidates that have little in common: there the classes of each key are compared instead, and
   each pair under the first key that it shares alone.
4. Values are compared incrementally. After each step, pairs leave whose posterior chance of reaching the threshold
   (uniform prior, binomial evidence) is below TOLERANCE. The rest is verified exactly on the n-gram sets.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotab.llm.common import checkpointed, id_text, slices
from isotab.llm.components import components, settled

N, THRESHOLD = 5, 0.8
SIZE, BANDS, ROWS, STEP, TOLERANCE = 128, 48, 6, 16, 1e-7
#: Members of one block of a large group; the most blocks of the small kind; members of a larger block.
BLOCK, SMALL_BLOCKS, LARGE_BLOCK = 128, 32, 1024
#: Classes of a group that is compared as a whole.
GIANT = 16_384
#: Candidate pairs that are compared at a time.
SLAB = 1 << 17
#: Members of small groups that one task checks together, on average.
TOGETHER = 1000

_RANDOM = np.random.default_rng(20_201)
_LETTER = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.stack([_RANDOM.choice(SIZE, ROWS, replace=False) for _ in range(BANDS)])
_BASE = 0x9E3779B97F4A7C15
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 2**64)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, inverse))
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, words being what str.split() gives."""
    raw = (" ".join(text.split()) if _ODD_SPACE.search(text) else text).encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * up[: len(b)], dtype=np.uint64)])
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str, n: int = N) -> np.ndarray:
    """The set of n-grams of words as sorted hashes; a shorter text is one n-gram of all its words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    s = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        s += w[j : len(w) - k + 1 + j] * _PLACE[j]
    return np.unique(_mixed(s + np.uint64(k)))


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(out, (_MIX[:, None] * s[None, at : at + 1024]).min(1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, BANDS) of int64."""
    out = np.empty((len(signatures), BANDS), np.uint64)
    for k, places in enumerate(_BAND):
        h = np.full(len(signatures), k + 1, np.uint64)
        for p in places:
            h = _mixed(h * np.uint64(_BASE) + signatures[:, p])
        out[:, k] = h
    return out.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, size: int = SIZE, step: int = STEP) -> dict[int, int]:
    """After n compared values, the fewest matches with which a pair stays: its posterior chance, under a uniform prior
    Beta(m + 1, n - m + 1), of a similarity of the threshold or more is at least the tolerance."""
    out = {}
    for n in range(step, size + 1, step):
        # P(S >= t | m of n) = P(Binomial(n + 1, t) <= m)
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def similar_pairs(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray, threshold: float = THRESHOLD, least: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate pairs (left[i], right[i]), those with a Jaccard similarity of at least the threshold."""
    size, least = np.array([len(s) for s in sets]), least or least_matches(threshold)
    found = [_unpruned(left[at : at + SLAB], right[at : at + SLAB], size, signatures, threshold, least) for at in range(0, len(left), SLAB)]
    if not found:
        return left, right
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(left):
        return left, right
    common = _intersections(left, right, sets)
    keep = common >= threshold * (size[left] + size[right] - common) - 1e-9
    return left[keep], right[keep]


def _unpruned(left: np.ndarray, right: np.ndarray, size: np.ndarray, signatures: np.ndarray, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    keep = small >= threshold * large - 1e-9
    left, right = left[keep], right[keep]
    matches = np.zeros(len(left), np.int32)
    for n, m in least.items():
        if not len(left):
            break
        at = slice(n - STEP, n)
        matches += (signatures[left, at] == signatures[right, at]).sum(1, dtype=np.int32)
        keep = matches >= m
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def _intersections(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    used, pos = np.unique(np.concatenate([left, right]), return_inverse=True)
    if len(left) <= 4 * len(used):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    # Many pairs among few sets: products of incidence matrices, some thousand n-grams at a time.
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    grams, which, df = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = df[which] > 1
    owner, which = owner[shared], which[shared]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    which = np.cumsum(np.diff(which, prepend=which[:1]) > 0) if len(which) else which
    total = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, int(which[-1]) + 1 if len(which) else 0, 4096):
        a, b = np.searchsorted(which, [at, at + 4096])
        m = np.zeros((len(used), 4096), np.float32)
        m[owner[a:b], which[a:b] - at] = 1
        total += m @ m.T
    p, q = pos[: len(left)], pos[len(left) :]
    return np.rint(total[p, q]).astype(np.int64)


def described(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, lo, hi, grams, signature) of each document: a hash of its text, and digest, size and MinHash values of its n-gram set."""
    source = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, n) for t in part.column("text").to_pylist()]
                ids = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([minhash(s).tobytes() for s in sets], pa.binary())], names=["id", "th", "lo", "hi", "grams", "signature"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, th long, lo long, hi long, grams long, signature binary")


def keyed(classes: DataFrame) -> DataFrame:
    """(key, band, node): the BANDS keys of each class (node, signature)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = band_keys(np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(-1, SIZE))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(np.repeat(part.column("node").to_numpy(), BANDS))], names=["key", "band", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, band int, node long")


def candidate_groups(classes: DataFrame, count: int) -> DataFrame:
    """(node, label) of the classes (node, signature) that share a key with another; count: the number of classes.

    A key's rows are combined before their shuffle to its least node; the rows of keys with several nodes are then
    joined with that. Of the least nodes of its keys, a node gets an edge to the least one, and so do the others: in a
    large group of copies, whose keys have few different least nodes, that is about one edge per node.
    """
    rows = keyed(classes).select("key", "node")
    buckets = settled(rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("key", "least"), BANDS * count // 2)
    hits = rows.join(buckets, "key").where("node != least").select("node", "least")
    hits = settled(hits.withColumn("first", F.min("least").over(Window.partitionBy("node"))), BANDS * count)  # at most BANDS rows a node
    return components(hits.select(F.col("node").alias("a"), F.col("first").alias("b")).union(hits.select("least", "first")), 2 * hits.count())


def _sized(units: DataFrame) -> DataFrame:
    """(unit, size) with the blocks into which its members are dealt."""
    few = F.ceil(F.col("size") / BLOCK)
    return units.withColumn("blocks", F.when(F.col("size") <= BLOCK * SMALL_BLOCKS, few).otherwise(F.greatest(F.lit(SMALL_BLOCKS), F.ceil(F.col("size") / LARGE_BLOCK))).cast("int"))


def compared(classes: DataFrame, group: DataFrame, count: int, giant: int = GIANT) -> DataFrame:
    """(node, unit, band, blocks): what each class is compared within. A unit is a group (band -1), or a key of a giant one."""
    sizes = group.groupBy(F.col("label").alias("unit")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    large = settled(_sized(sizes), count // BLOCK)
    member = group.withColumnRenamed("label", "unit").join(large, "unit", "left")
    whole = member.where(F.col("size").isNull() | (F.col("size") <= giant)).select("node", "unit", F.lit(-1).alias("band"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    if large.where(F.col("size") > giant).isEmpty():
        return whole
    rows = keyed(classes.join(member.where(F.col("size") > giant).select("node"), "node")).withColumnRenamed("key", "unit")
    shared = settled(_sized(rows.groupBy("unit", "band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")), BANDS * count)
    return whole.union(rows.join(shared, ["unit", "band"]).select("node", "unit", "band", "blocks"))


def _checked(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): per class and task, documents linked to it and the least class it is joined with."""
    least = least_matches(threshold)

    def one(node: np.ndarray, block: np.ndarray, i: int, j: int, band: int, copies: np.ndarray, sets: list, signatures: np.ndarray):
        if i == j:
            left, right = np.triu_indices(len(node), 1)
        else:
            a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
            left, right = np.repeat(a, len(b)), np.tile(b, len(a))
        keys = band_keys(signatures) if band > 0 else None
        for k in range(max(0, band)):  # a pair belongs to the first key that it shares
            apart = keys[left, k] != keys[right, k]
            left, right = left[apart], right[apart]
        left, right = similar_pairs(left, right, sets, signatures, threshold, least)
        links = np.bincount(left, copies[right], len(node)) + np.bincount(right, copies[left], len(node))
        root = np.arange(len(node))
        while True:  # least labels over all links at once, then jumps
            new = root.copy()
            np.minimum.at(new, left, root[right])
            np.minimum.at(new, right, root[left])
            new = new[new]
            if (new == root).all():
                return links.astype(np.int64), node[root]
            root = new

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, band), g in pdf.sort_values(["unit", "band", "node"]).groupby(["unit", "band"]):
            sets = [np.frombuffer(x, "<u8") for x in g["grams"]]
            signatures = np.frombuffer(b"".join(g["signature"]), "<u4").reshape(-1, SIZE)
            links, root = one(g["node"].to_numpy(), g["block"].to_numpy(), int(g["i"].iloc[0]), int(g["j"].iloc[0]), int(band), g["copies"].to_numpy().astype(float), sets, signatures)
            out.append(pd.DataFrame({"node": g["node"].to_numpy(), "links": links, "root": root}))
        return pd.concat(out)

    return members.groupBy("task", "i", "j").applyInPandas(run, "node long, links long, root long")


def near_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_id, n_links.

    n_links counts the other documents of similarity `threshold` or more, copies included; copy_id is the least id
    with an equal n-gram set; class_id is the least id that links lead to, directly or through others. Ids are of any type with
    an order. Words are what white space separates; a text of fewer than n words is one n-gram. A text without words, or NULL, links to none and
    is its own class. Rows that repeat an id and a text count as copies of each other. An empty table gives an empty
    result; other columns are ignored.
    """
    base = checkpointed(described(docs, n, id_col, text_col))
    # A class is what agrees in all 128 bits; it is numbered, and a row that stands for it named by id and text.
    named = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    whole = base.where("grams > 0").groupBy("lo", "hi").agg(F.min(named).alias("of"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    classes = settled(whole.select("lo", "hi", F.col("of.id").alias("rep"), F.col("of.th").alias("rep_th"), "copies", "signature")).withColumn("node", F.monotonically_increasing_id())
    count = classes.count()
    group = candidate_groups(classes, count)
    units = compared(classes, group, count, giant)
    member = settled(classes.join(group, "node").select("node", "rep", "rep_th", "copies"), count)
    tasks = max(1, -(-member.count() // TOGETHER))

    texts = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    wanted = texts.join(member, texts["id"].eqNullSafe(member["rep"]) & (texts["th"] == member["rep_th"]))
    wanted = wanted.groupBy("node").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))  # repeated rows

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, n) for t in part.column("text").to_pylist()]
                columns = [part.column("node"), part.column("copies"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([minhash(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "copies", "grams", "signature"])

    full = wanted.mapInArrow(grams, "node long, copies long, grams binary, signature binary").join(units, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    shared = full.withColumn("block", block).select("*", other.alias("other"))
    shared = shared.select("node", "copies", "unit", "band", "grams", "signature", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("unit"), F.lit(tasks))).otherwise(F.col("unit")).alias("task"))
    found = checkpointed(_checked(shared, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    cluster = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")), found.count())
    joined = classes.select("node", "lo", "hi", "rep", "copies").join(cluster, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = settled(joined.groupBy("label").agg(F.min("rep").alias("class_id")), count)
    info = joined.join(first, "label").join(links, "node", "left").select("lo", "hi", "rep", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = base.select("id", "lo", "hi", "grams").join(settled(info, count), ["lo", "hi"], "left")
    alone = F.col("grams") == 0
    return out.select(F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("copy_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))
