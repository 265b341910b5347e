"""BPE encoding and decoding with a pair occurrence index.

The pieces of text that a batch holds and that the worker hasn't met before are laid out as one run of symbols. An index
maps every mergeable pair to all its positions in that run. Ranks that occur are taken in ascending order; a rank's
positions are merged from left to right, and the pairs that a merge makes with its neighbours are entered under their
own ranks. A merge can only make pairs of a higher rank, since a token is made before it is part of another, so every
piece sees the same merges as if it were encoded alone. Pieces recur, so their ids are kept, in a bounded table.

Normalisation and the cut into pieces follow the tokenizer's file. Texts of common characters take a short way that
gives the same pieces; all others go through the tokenizer's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isotab.llm.common import id_text, slices

#: Pieces whose ids a worker keeps (fewer where they are cheap to find again), and characters of the longest kept piece.
CACHE_ITEMS, FAST_ITEMS, CACHE_CHARS = 800_000, 600_000, 64
#: Symbols in one index.
INDEX_SYMBOLS = 200_000
#: Characters for which Python and the tokenizer agree on space, case and composition.
_COMMON = re.compile("[^\t-\r -~\xa1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(spare)}


class Bpe:
    """A tokenizer file's BPE model."""

    items = CACHE_ITEMS

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: only plain byte-level BPE models are supported")
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.words = bool(end)  # word pieces end with a mark, and white space is dropped
        letters = byte_letters()
        self.first = [vocab.get(letters[b], -1) for b in range(256)]
        self.last = [vocab.get(letters[b] + end, -1) for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank.setdefault(vocab[a] << 20 | vocab[b], r)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._first, self._last = np.array(self.first, np.int64), np.array(self.last, np.int64)
        self._pair_keys = np.array(sorted(self.rank), np.int64)
        self._pair_ranks = np.array([self.rank[k] for k in self._pair_keys.tolist()], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        back = {v: k for k, v in letters.items()}
        special = set(self.special.values())
        self.token_bytes = [t.encode() if i in special else bytes(back[c] for c in t if c in back) for i, t in enumerate(self.tokens)] if self.byte_decoder else []
        own = Tokenizer.from_file(path)
        self._normal, self._cut = own.normalizer, own.pre_tokenizer
        self._letter_bytes = {ord(v): k for k, v in letters.items()}
        self._piece = regex.compile(_SPLIT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if self.words else _SPLIT + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed, through one pair occurrence index over all of them."""
        text = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(text)
        if not n:
            return [b""] * len(pieces)
        stops = np.cumsum([len(p) for p in pieces])
        ends = np.unique(stops[stops > 0]) - 1
        laid = self._first[text]
        laid[ends] = self._last[text[ends]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends], before[ends[:-1] + 1] = -1, -1
        # All positions of each mergeable pair, in order, under the pair's rank.
        keys = laid[:-1] << 20 | laid[1:]
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        found = np.flatnonzero((self._pair_keys[at] == keys) & (after[:-1] >= 0)) if len(self._pair_keys) else np.empty(0, np.int64)
        ranks = self._pair_ranks[at[found]]
        order = np.argsort(ranks, kind="stable")
        kinds, begins = np.unique(ranks[order], return_index=True)
        index = {r: p.tolist() for r, p in zip(kinds.tolist(), np.split(found[order], begins[1:]), strict=True)} if len(kinds) else {}
        symbols, after, before, rank, merges = laid.tolist(), after.tolist(), before.tolist(), self.rank.get, self.merges
        active = list(index)  # ascending, so a heap
        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            a, b, made = merges[r]
            if a == b:
                places.sort()
            for p in places:
                if symbols[p] != a or (q := after[p]) < 0 or symbols[q] != b:
                    continue  # an earlier merge took one of the two
                symbols[p], symbols[q] = made, -1
                after[p] = nxt = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    if (k := rank(made << 20 | symbols[nxt])) is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heapq.heappush(active, k)
                if (prev := before[p]) >= 0 and (k := rank(symbols[prev] << 20 | made)) is not None:
                    if k in index:
                        index[k].append(prev)
                    else:
                        index[k] = [prev]
                        heapq.heappush(active, k)
        laid = np.array(symbols, np.int64)
        packed = laid[laid >= 0].astype("<i4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(laid >= 0)])[np.concatenate([[0], stops])]).tolist()
        return [packed[x:y] for x, y in zip(cuts, cuts[1:])]

    def _chunks(self, text: str) -> list[str]:
        """Parts of a text of common characters, none of which a piece crosses."""
        return unicodedata.normalize("NFC", text).lower().split() if self.words else _SPACED.findall(text)

    def _rare(self, text: str) -> list[bytes]:
        """Pieces of any text, by the tokenizer's own normaliser and pre-tokenizer."""
        if self._normal is not None:
            text = self._normal.normalize_str(text)
        letters = self._letter_bytes
        return [bytes(letters[ord(c)] for c in p) for p, _ in self._cut.pre_tokenize_str(text)]

    def _parts(self, text: str) -> Iterator[tuple[str, str]]:
        for i, part in enumerate(self._marks.split(text) if self._marks and "<" in text else (text,)):
            if part:
                yield ("special" if i % 2 else "rare" if not part.isascii() and _COMMON.search(part) or _CONTROL.search(part) else "common"), part

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as arrays of int32."""
        known = self.cache
        if len(known) > self.items:
            known.clear()
        plans, new, long = [], dict.fromkeys(()), {}
        for text in texts:
            plan = []
            for kind, part in self._parts(text):
                got = self._chunks(part) if kind == "common" else self._rare(part) if kind == "rare" else part
                plan.append((kind, got))
                if kind != "special":
                    new.update(dict.fromkeys(x for x in got if x not in known))
            plans.append(plan)
        self._learn(list(new), known, long)
        out = []
        for plan in plans:
            bits = []
            for kind, got in plan:
                if kind == "special":
                    bits.append(np.int32(self.special[got]).tobytes())
                elif long:
                    bits += [known[x] if x in known else long[x] for x in got]
                else:
                    bits += map(known.__getitem__, got)
            out.append(np.frombuffer(b"".join(bits), dtype="<i4"))
        return out

    def _learn(self, chunks: list, known: dict, long: dict) -> None:
        """Ids of new chunks of text (or, of rare texts, pieces), packed. A piece is a chunk of its own, so those of it that
        are known, from other chunks too, don't enter the index again."""
        at = 0
        while at < len(chunks):
            todo, fresh, total = [], {}, 0
            while at < len(chunks) and total < INDEX_SYMBOLS:
                chunk = chunks[at]
                parts = self._piece.findall(chunk) if isinstance(chunk, str) else [chunk]
                for p in parts:
                    if p not in known and p not in fresh and p not in long:
                        fresh[p] = raw = p.encode() if isinstance(p, str) else p
                        total += len(raw)
                if len(parts) != 1 or parts[0] != chunk:
                    todo.append((chunk, parts))
                at += 1
            for p, packed in zip(fresh, self.encode_pieces(list(fresh.values())), strict=True):
                (known if len(p) <= CACHE_CHARS else long)[p] = packed
            for chunk, parts in todo:
                (known if len(chunk) <= CACHE_CHARS else long)[chunk] = b"".join([known[p] if p in known else long[p] for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        """The text that the tokenizer's decoder makes of the ids; without a decoder, its tokens joined by blanks."""
        if self.byte_decoder:
            return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0]")


class FastBpe(Bpe):
    """The same ids, with new chunks encoded by tiktoken, where only the ids matter and not how they are found.
    For byte-level vocabularies whose ids are in the order of their merges."""

    items = FAST_ITEMS

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        ids = [m[2] for m in self.merges]
        if self.words or not self.byte_decoder or ids != sorted(ids) or sorted([*self.first, *ids]) != list(range(256 + len(ids))):
            raise ValueError(f"{path}: ids are not in the order of merges")
        special = set(self.special.values())
        self._fast = tiktoken.Encoding("own", pat_str=self._piece.pattern, mergeable_ranks={b: i for i, b in enumerate(self.token_bytes) if i not in special}, special_tokens={})

    def _learn(self, chunks: list, known: dict, long: dict) -> None:
        fast, rare = self._fast.encode_ordinary, []
        for chunk in chunks:
            if isinstance(chunk, str):
                (known if len(chunk) <= CACHE_CHARS else long)[chunk] = np.array(fast(chunk), dtype="<i4").tobytes()
            else:
                rare.append(chunk)
        super()._learn(rare, known, long)


@lru_cache(maxsize=4)
def load_fast(path: str) -> FastBpe:
    return FastBpe(path)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One model, and one table of pieces, per worker."""
    return Bpe(path)


def ids_array(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, "<i4")])))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): whole texts, without special tokens added; a special token's own text becomes its id.
    NULL is an empty text, which has no ids. Rows are independent: repeated ids and other columns don't matter. A text of
    any length is encoded whole, its new pieces in indexes of about INDEX_SYMBOLS. An empty table gives an empty result."""
    return _mapped(docs, path, id_col, text_col, False)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): encode(), and decode() of the same ids, in one pass."""
    return _mapped(docs, path, id_col, text_col, True)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    source = id_text(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode(part.column("text").to_pylist())
                columns = [part.column("id"), ids_array(ids)]
                names = ["id", "ids"]
                if back:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>" + (", decoded string" if back else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, decoded) of (id, ids); NULL ids are none."""
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, decoded string")
