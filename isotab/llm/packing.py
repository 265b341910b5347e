"""Packing of documents into sequences of a fixed number of tokens.

Every document is its ids and an end mark. A longer one is cut from its end into whole sequences; what is left is its
first piece. Pieces, a few bytes each, are dealt into groups of a bounded number by a hash, and each group is packed in
one task: best fit over descending lengths, then a local search. The search takes the emptiest bins one by one and
moves its pieces into the room of others, or swaps one of its pieces for one or two smaller ones of an underfull bin, so
that each step increases the sum of squared fills; a bin that runs empty is saved. It goes over all underfull bins until
no step is left or no fewer bins are possible. Pieces of one length are
interchangeable, so a group is searched by lengths, not by pieces. Of several groups, each hands on its emptiest bins
(OPEN_BINS at most): their pieces are dealt into groups anew and packed together, so what each group leaves open is
filled by others. Groups grow in number with the input, not in size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotab.llm.bpe import load_fast
from isotab.llm.common import checkpointed, id_text, slices

CAPACITY, END_ID = 1024, 2
#: Pieces in a group, on average.
GROUP = 20_000
#: Bins that a group hands on: the emptiest, where they have room.
OPEN_BINS = 64


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and end mark."""
    source = id_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_fast(path)
        for batch in batches:
            for part in slices(batch):
                rows, which, numbers, starts, lengths, sums = part.column("id"), [], [], [], [], []
                for row, ids in enumerate(bpe.encode(part.column("text").to_pylist())):
                    raw = memoryview(ids.tobytes() + np.int32(end_id).tobytes())
                    n = len(raw) // 4
                    at, to, k = 0, n % capacity or capacity, 0
                    while at < n:
                        which.append(row)
                        numbers.append(k)
                        starts.append(at)
                        lengths.append(to - at)
                        sums.append(zlib.crc32(raw[4 * at : 4 * to]))
                        at, to, k = to, to + capacity, k + 1
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(which, pa.int32())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=names)

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_lengths(lengths: Iterable[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of lengths, each at most `capacity` in sum, as few as the search finds."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)  # free space -> bins
    frees: list[int] = []
    for x in sorted(lengths, reverse=True):
        i = bisect_left(frees, x)
        if i < len(frees):
            free = frees[i]
            b = room[free].pop()
            if not room[free]:
                del room[free], frees[i]
        else:
            b, free = len(bins), capacity
            bins.append([])
        bins[b].append(x)
        if free - x > 0:
            if free - x not in room:
                insort(frees, free - x)
            room[free - x].append(b)
    return improve(bins, capacity)


class Open:
    """Bins by their room, and by what one or two of their pieces (or none) add up to: `held[room][sum]` are the bins, bit
    `sum` of `sums[room]` tells whether there are any."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.room = [capacity - sum(b) for b in bins]
        self.held: dict[int, dict[int, set[int]]] = {}
        self.sums: dict[int, int] = {}
        self.rooms: list[int] = []
        self.steps = 0
        for j, b in enumerate(bins):
            if b:
                self.put(j)

    def _sums(self, j: int) -> set[int]:
        b = sorted(self.bins[j])
        kinds = sorted(set(b))
        two = {x + y for i, x in enumerate(kinds) for y in kinds[:i]} | {2 * x for x, y in zip(b, b[1:], strict=False) if x == y}
        return {0, *kinds} | two

    def put(self, j: int) -> None:
        r = self.room[j]
        if not r:
            return
        if r not in self.held:
            self.held[r], self.sums[r] = {}, 0
            insort(self.rooms, r)
        held, bits = self.held[r], self.sums[r]
        for y in self._sums(j):
            if y in held:
                held[y].add(j)
            else:
                held[y] = {j}
                bits |= 1 << y
        self.sums[r] = bits

    def take(self, j: int) -> None:
        r = self.room[j]
        if not r:
            return
        held, bits = self.held[r], self.sums[r]
        for y in self._sums(j):
            held[y].discard(j)
            if not held[y]:
                del held[y]
                bits ^= 1 << y
        self.sums[r] = bits
        if not bits:
            del self.held[r], self.sums[r]
            del self.rooms[bisect_left(self.rooms, r)]

    def place(self, x: int, own: int) -> tuple[int, int] | None:
        """The bin, and the sum of its pieces, for which to give x out of a bin with the room `own`: the fullest that takes x
        whole, or else where the bin gains most. The squared fills rise if it gains more than it has room beyond `own`."""
        i = bisect_left(self.rooms, x)
        if i < len(self.rooms) and x > self.rooms[i] - own:
            return min(self.held[self.rooms[i]][0]), 0
        best, at = 0, None
        for r in reversed(self.rooms):
            if r <= best:
                break
            low = max(x - r, 0)
            bits = self.sums[r] >> low
            y = low + (bits & -bits).bit_length() - 1
            if bits and x - y > max(best, r - own):
                best, at = x - y, (r, y)
        return (min(self.held[at[0]][at[1]]), at[1]) if at else None

    def empty(self, k: int) -> bool:
        """Try to give all of bin k to others, which change for the better even where that fails."""
        self.take(k)
        target, steps = self.bins[k], True
        while target and steps:
            steps = False
            for x in sorted(target, reverse=True):
                if x not in target or (found := self.place(x, self.room[k])) is None:
                    continue
                j, y = found
                self.take(j)
                b = self.bins[j]
                out = [] if not y else [y] if y in b else next([z, y - z] for i, z in enumerate(b) if y - z in b[:i])
                for z in out:
                    b.remove(z)
                b.append(x)
                target.remove(x)
                target += out
                self.room[j] -= x - y
                self.room[k] += x - y
                self.put(j)
                self.steps, steps = self.steps + 1, True
        if target:
            self.put(k)
        return not target


def improve(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The local search: passes over all open bins until one finds no step. Every step raises the sum of squared fills, so it ends."""
    bins = [b for b in bins if b]
    left, least = len(bins), -(-sum(map(sum, bins)) // capacity)
    if left > least:
        search, before = Open(bins, capacity), -1
        while left > least and before < search.steps:
            before = search.steps
            for k in sorted((k for k, b in enumerate(bins) if b and search.room[k]), key=search.room.__getitem__, reverse=True):
                if bins[k] and search.room[k] and search.empty(k):
                    left -= 1
                    if left == least:
                        break
    return [b for b in bins if b]


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. `parts` is read twice: give a table or a checkpoint, whose rows keep their
    places. The place of a row takes part in the hash, so that even rows alike in all columns are dealt over groups."""
    kind, names = parts.schema["doc_id"].dataType.simpleString(), ["doc_id", "piece", "start", "length", "ids_crc32"]
    groups = max(1, -(-parts.count() // group))
    if groups == 1:
        return _packed(parts, capacity, 1, 0, kind).drop("open")
    first = checkpointed(_packed(parts, capacity, groups, 0, kind))
    rest = first.where("open").select(*names)
    again = max(1, -(-rest.count() // group))
    return first.where("not open").unionByName(_packed(rest, capacity, again, groups, kind)).drop("open")


def _packed(parts: DataFrame, capacity: int, groups: int, offset: int, kind: str) -> DataFrame:
    """The pieces packed in so many groups, with `open` for those of bins to hand on; numbers of groups start at `offset`."""
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("int") + offset)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number, length = int(pdf["part"].iloc[0]), pdf["length"].to_numpy()
        order = np.argsort(length, kind="stable")
        rows = {int(x): list(r) for x, r in zip(*_runs(length[order], order), strict=True)}
        sequence, place, open_ = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64), np.zeros(len(pdf), bool)
        k = 0
        for r in rows.pop(capacity, []):
            sequence[r], place[r] = k, 0
            k += 1
        bins = sorted(pack_lengths([x for x, r in rows.items() for _ in r], capacity), key=sum)
        for i, b in enumerate(bins):
            at, hand_on = 0, i < OPEN_BINS and sum(b) < capacity
            for x in sorted(b, reverse=True):
                r = rows[x].pop()
                sequence[r], place[r], open_[r] = k, at, hand_on
                at += x
            k += 1
        return pdf.drop(columns="part").assign(sequence_id=(number << 32) + sequence, offset=place, open=open_)

    return dealt.groupBy("part").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean")


def _runs(values: np.ndarray, order: np.ndarray):
    at = np.flatnonzero(np.diff(values, prepend=-1))
    return values[at], np.split(order, at[1:])


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL text is an empty one, whose only token is the end mark. Offsets in a sequence have no gaps; the numbers of
    sequences do. Repeated rows are packed as often as they stand in the table; other columns are ignored; an empty
    table gives an empty result. The pieces are checkpointed, so a lost executor doesn't cost the tokenization.
    """
    return pack(checkpointed(pieces(docs, path, capacity, end_id, id_col, text_col)), capacity)
