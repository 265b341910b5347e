"""A byte-level convolutional network for document quality, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded, learned filters run over
each chunk, and each filter's largest response in the chunk is kept. A document is the mean and the maximum of its chunks'
responses; a small dense layer makes one probability of them. Only the winning window of each filter gets a gradient,
so training costs little more than scoring.

The network is trained on the driver from a bounded sample of labelled rows: at most TRAIN_ROWS rows of at most TRAIN_BYTES
bytes together, each with all of its chunks. Scoring reads every chunk of every document on the executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotab.llm.common import id_text, slices

CHUNK, OVERLAP = 1024, 64
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 8, 8, 2, 32, 16
#: Bounds on the sample that training reads.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
EPOCHS, BATCH, RATE = 12, 64, 0.01
#: Chunks that are scored at a time.
BLOCK = 16


def chunk_bytes(raw: bytes) -> np.ndarray:
    """(chunks, CHUNK) of uint8, padded with zeros; one chunk for an empty text."""
    n = max(1, -(-max(0, len(raw) - OVERLAP) // (CHUNK - OVERLAP)))
    flat = np.zeros((n - 1) * (CHUNK - OVERLAP) + CHUNK, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (CHUNK - OVERLAP, 1))


@dataclass
class ByteCnn:
    embed: np.ndarray  # 256, EMBED
    conv: np.ndarray  # WIDTH * EMBED, FILTERS
    conv_b: np.ndarray
    dense: np.ndarray  # 2 * FILTERS, HIDDEN
    dense_b: np.ndarray
    out: np.ndarray  # HIDDEN
    out_b: np.ndarray  # 1

    @classmethod
    def new(cls, seed: int = 7) -> ByteCnn:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.normal(size=s) / np.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
        return cls(f(256, EMBED) * 4, f(WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32), f(2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), f(HIDDEN) * 0.1, np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_b, self.dense, self.dense_b, self.out, self.out_b]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * EMBED)"""
        x = self.embed[chunks]
        n, s = len(chunks), x.strides
        return np.lib.stride_tricks.as_strided(x, (n, (CHUNK - WIDTH) // STEP + 1, WIDTH * EMBED), (s[0], s[1] * STEP, s[2]))

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """The largest response of each filter in each chunk, and its place."""
        tops, places = [], []
        for at in range(0, len(chunks), BLOCK):
            w = self.windows(chunks[at : at + BLOCK])
            r = (w.reshape(-1, WIDTH * EMBED) @ self.conv).reshape(*w.shape[:2], FILTERS)
            if where:
                places.append(p := r.argmax(1))
                tops.append(np.take_along_axis(r, p[:, None], 1)[:, 0])
            else:
                tops.append(r.max(1))
        top = np.maximum(np.concatenate(tops) + self.conv_b, 0)
        return (top, np.concatenate(places)) if where else top

    def head(self, top: np.ndarray, starts: np.ndarray):
        """Documents' features, hidden layer and logits, from chunk responses; starts: each document's first chunk."""
        n = np.diff([*starts, len(top)])[:, None]
        x = np.concatenate([np.add.reduceat(top, starts) / n, np.maximum.reduceat(top, starts)], 1)
        h = np.maximum(x @ self.dense + self.dense_b, 0)
        return x, h, h @ self.out + self.out_b[0]

    def score(self, chunks: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, chunks[:-1])])
        z = self.head(self.pooled(np.concatenate(chunks)), starts)[2]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradients(self, chunks: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        top, place = self.pooled(chunks, where=True)
        x, h, z = self.head(top, starts)
        n = np.diff([*starts, len(top)])
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)
        dh = np.outer(dz, self.out) * (h > 0)
        dx = dh @ self.dense.T
        doc = np.repeat(np.arange(len(y)), n)
        peak = top == x[doc, FILTERS:]
        ties = np.add.reduceat(peak.astype(np.float32), starts)[doc]  # a window may stand in the overlap of two chunks
        dtop = (dx[doc, :FILTERS] / n[doc, None] + dx[doc, FILTERS:] * peak / ties) * (top > 0)
        at = place * STEP
        rows = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        seen = self.embed[rows].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        dconv = np.einsum("cf,cfk->kf", dtop, seen)
        dseen = dtop[:, :, None] * self.conv.T[None]
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, rows.ravel(), dseen.reshape(-1, EMBED))
        return [dembed, dconv, dtop.sum(0), x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()], np.float32)]


def fit(chunks: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> ByteCnn:
    """Adam with a falling rate. Both classes weigh the same in sum, up to a factor of 3."""
    net, r = ByteCnn.new(seed), np.random.default_rng(seed)
    m, v, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    y = labels.astype(np.float32)
    rare = min(3.0, max(1.0, max(y.sum(), len(y) - y.sum()) / max(1.0, min(y.sum(), len(y) - y.sum()))))
    weight = np.where(y == (y.mean() < 0.5), rare, 1.0).astype(np.float32)
    steps = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(y), BATCH):
            take = order[at : at + BATCH]
            part = [chunks[i] for i in take]
            g = net.gradients(np.concatenate(part), np.cumsum([0, *map(len, part[:-1])]), y[take], weight[take])
            t += 1
            rate = RATE * (1 - 0.95 * t / steps)
            for p, d, a, b in zip(net.params(), g, m, v, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def held_out(id_col: str) -> Column:
    """True for rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> ByteCnn | float:
    """A network, or where the sample has fewer than two classes the share of ones in it (0.5 without any row).

    The sample is the `rows` labelled ids, held-out ones aside, with the smallest hashes, as far as their texts have
    TRAIN_BYTES bytes together; a text beyond that is passed over, never cut. Ids are of any type; ids or labels
    that are NULL and labels other than 0 and 1 are passed over; an id with several labels takes the smallest, one
    with several texts the one with the smallest hash.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    chosen = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "id")  # at most `rows` rows
    one = F.min(F.struct(F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"))).alias("of")
    sizes = texts.groupBy("id").agg(one).orderBy(F.xxhash64("id"), "id").select("id", "of.th", "of.size").collect()
    taken, held = [], 0
    for r in sizes:
        if held + r["size"] <= TRAIN_BYTES:
            taken.append((r["id"], r["th"]))
            held += r["size"]
    if not taken:
        return 0.5
    kind = chosen.schema["id"].dataType
    named = docs.sparkSession.createDataFrame(taken, T.StructType([T.StructField("id", kind), T.StructField("th", T.LongType())]))
    texts = texts.withColumn("th", F.xxhash64("text")).join(F.broadcast(named), ["id", "th"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in part.column("text").to_pylist():
                    out.append(chunk_bytes(text.encode("utf-8", "replace")).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(out, pa.binary())], names=["id", "y", "chunks"])

    got = texts.mapInArrow(cut, f"id {kind.simpleString()}, y int, chunks binary").dropDuplicates(["id"]).toPandas().sort_values("id")
    y = got["y"].to_numpy()
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit([np.frombuffer(b, np.uint8).reshape(-1, CHUNK) for b in got["chunks"]], y)


def with_score(docs: DataFrame, model: ByteCnn | float, text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows with all their columns and a score, and the name of the score's column. NULL is an empty text."""
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 19):
                if isinstance(model, float):
                    p = np.full(part.num_rows, model)
                else:
                    p = model.score([chunk_bytes((t or "").encode("utf-8", "replace")) for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema), name


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. A text's score depends on the text alone (to rounding).
    A NULL id counts as learned from (false). An empty table gives an empty result; other columns are ignored."""
    model = train(docs, labels, id_col, text_col, label_col)
    out, _ = with_score(id_text(docs, id_col, text_col), model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
