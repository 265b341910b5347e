"""Licences of files, by sparse TF-IDF cosines to templates and inheritance from directories.

Weights are term frequency times inverse document frequency, the latter counted over all files and for all words. Those
of the templates' words are at hand everywhere; those of others are joined to the texts that need them: where a passage
that may be the best of its text holds such words. For each template, the heaviest words are its anchors: so many that a passage without any of them can't reach the threshold. All passages of
the template's length that hold an anchor (and its line, where that is shorter) are compared with the template, so
headers are found wherever they stand and the other text isn't weighed.

A file without a licence of its own gets that of the nearest directory above it that has a licence file: a path join of
the distinct directories and their ancestors with the directories of licence files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotab.llm.common import checkpointed, slices
from isotab.llm.components import settled

# Common wordings of licence notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
)
THRESHOLD = 0.8
#: Distinct words, or slices of text, that a task counts before it hands the counts on.
WORDS, SLICES = 1 << 18, 8
#: File names that speak for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)(\..*)?$"
_TOKEN = re.compile(r"[^\W_]+(?:\.\d+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


VOCABULARY = frozenset(t for _, text in TEMPLATES for t in tokens(text))


@dataclass
class Template:
    name: str
    words: list[str]
    weights: dict[str, float]
    norm: float
    anchors: set[str]


class Matcher:
    """Templates weighted by document frequencies, and the number of documents. `df` holds the vocabulary's words at least;
    a word that it doesn't hold is in no document."""

    def __init__(self, df: dict[str, int], documents: int, threshold: float = THRESHOLD):
        self.threshold, self.df, self.documents = threshold, df, documents
        self.idf = {t: self.weight(df.get(t, 0)) for t in VOCABULARY}
        self.most = self.weight(0)
        self.templates = []
        for name, text in TEMPLATES:
            words = tokens(text)
            weights = {t: n * self.idf[t] for t, n in Counter(words).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            left, anchors = norm * norm, set()
            for t in sorted(weights, key=lambda t: (-weights[t], t)):
                if left < (threshold * norm) ** 2 * 0.999:
                    break
                anchors.add(t)
                left -= weights[t] ** 2
            self.templates.append(Template(name, words, weights, norm, anchors))
        self.by_anchor: dict[str, list[Template]] = {}
        for t in self.templates:
            for a in t.anchors:
                self.by_anchor.setdefault(a, []).append(t)

    def weight(self, holders: int) -> float:
        return math.log((1 + self.documents) / (1 + holders)) + 1

    def cosine(self, passage: list[str], t: Template) -> float:
        dot, own, _ = self._parts(Counter(passage), t)
        return self._value(dot / t.norm, own, {w: n for w, n in Counter(passage).items() if w not in self.idf}, self.df) if dot else 0.0

    def _parts(self, counts: Counter, t: Template) -> tuple[float, float, int]:
        """Product with the template, squared norm of the vocabulary's words, squared counts of all others."""
        dot, own, others = 0.0, 0.0, 0
        for w, n in counts.items():
            if (idf := self.idf.get(w)) is None:
                others += n * n
            else:
                own += (n * idf) ** 2
                if w in t.weights:
                    dot += n * idf * t.weights[w]
        return dot, own, others

    def _value(self, share: float, own: float, others: dict[str, int], df: dict[str, int]) -> float:
        return share / math.sqrt(own + sum((n * self.weight(df.get(w, 0))) ** 2 for w, n in others.items()))

    def best(self, text: str, df: dict[str, int] | None = None) -> tuple[str | None, float]:
        """The template with the largest cosine to a passage, if that reaches the threshold. `df` is of words beside the vocabulary."""
        return self._choose(self.passages(text), self.df if df is None else df)

    def _choose(self, passages: list[tuple[float, float, dict[str, int], str]], df: dict[str, int]) -> tuple[str | None, float]:
        found: tuple[float, str | None] = (0.0, None)
        for share, own, others, name in passages:
            c = self._value(share, own, others, df)
            if c > found[0] + 1e-12:
                found = (c, name)
        return (found[1], found[0]) if found[0] >= self.threshold else (None, found[0])

    def passages(self, text: str) -> list[tuple[float, float, dict[str, int], str]]:
        """The passages of which one has the largest cosine, whatever the frequencies of words beside the vocabulary (a weight
        is 1 at least, that of an unseen word at most): product over the template's norm, squared norm of the vocabulary's
        words, counts of the others, and the template's identifier."""
        low = text.lower()
        words, starts = [], []
        for m in _TOKEN.finditer(low):
            words.append(m[0])
            starts.append(m.start())
        hits = [i for i, w in enumerate(words) if w in self.by_anchor]
        found: list[tuple[float, float, float, int, int, str]] = []
        least = 0.0
        tried: set[tuple[int, int, int]] = set()
        for i in hits:
            a = b = None
            for t in self.by_anchor[words[i]]:
                n = len(t.words)
                spans = [(s, min(len(words), s + n)) for s in range(max(0, i - n + 1), max(0, min(i, len(words) - n)) + 1)]
                if a is None:  # the line of the anchor, as words
                    begin, end = low.rfind("\n", 0, starts[i]) + 1, low.find("\n", starts[i])
                    a, b = i, i + 1
                    while a > 0 and starts[a - 1] >= begin and i - a < 64:
                        a -= 1
                    while b < len(words) and (end < 0 or starts[b] < end) and b - i < 64:
                        b += 1
                for span in [*spans, (a, b)]:
                    key = (id(t), *span)
                    if key in tried:
                        continue
                    tried.add(key)
                    dot, own, others = self._parts(Counter(words[span[0] : span[1]]), t)
                    share = dot / t.norm
                    if share and (upper := share / math.sqrt(own + others)) >= least - 1e-9:
                        least = max(least, share / math.sqrt(own + others * self.most**2))
                        found.append((upper, share, own, *span, t.name))
        out = {}
        for upper, share, own, a, b, name in found:
            if upper >= least - 1e-9:
                others = Counter(w for w in words[a:b] if w not in self.idf)
                out.setdefault((share, own, name, frozenset(others.items())), (share, own, dict(others), name))
        return list(out.values())


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(word, n) of all words over all rows of `text`, checkpointed; n of the word "" is the number of rows. A task adds up
    what it has read before it hands that on, every few slices, so that it holds no more than their words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        read = 0
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    seen[""] += 1
                    seen.update(set(tokens(text)))
                read += 1
                if len(seen) >= WORDS or read == SLICES:
                    yield from _counted(seen)
                    read = 0
        yield from _counted(seen)

    return settled(texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    if seen:
        words = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        for at in range(0, words.num_rows, 1 << 16):
            yield words.slice(at, 1 << 16)


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, path, licence, score, origin ('own', 'inherited' or NULL), licence_path.

    score is the best cosine of any passage to any template, licence the template's identifier if it reaches the
    threshold; licence_path is the file that the licence comes from. A directory with several licence files takes the best score, then the
    smallest path. NULL texts are empty and have no licence; a file with a NULL path inherits none. Empty tables give an
    empty result; other columns are ignored; repeated rows are treated alike.
    """
    source = files.select(F.col(f"`{id_col}`").alias("doc_id"), path.cast("string").alias("path"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    counts = document_frequencies(source)
    df = {r["word"]: r["n"] for r in counts.where(F.col("word").isin("", *sorted(VOCABULARY))).collect()}
    documents = df.pop("", 0)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The result of a text, or what is needed for it: the text and the words whose frequencies count."""
        matcher = Matcher(df, documents, threshold)
        for batch in batches:
            for part in slices(batch):
                got, needs, open_ = [], [], []
                for text in part.column("text").to_pylist():
                    passages = matcher.passages(text)
                    needs.append(sorted({w for p in passages for w in p[2]}) or None)
                    got.append(matcher._choose(passages, {}) if needs[-1] is None else (None, None))
                    open_.append(text if needs[-1] else None)
                columns = [part.column("doc_id"), part.column("path"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(open_, pa.string()), pa.array(needs, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "path", "licence", "score", "text", "needs"])

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(df, documents, threshold)
        for batch in batches:
            for part in slices(batch):
                rows = zip(part.column("text").to_pylist(), part.column("counts").to_pylist(), strict=True)
                got = [matcher.best(text, {c["word"]: c["n"] for c in found}) for text, found in rows]
                yield pa.RecordBatch.from_arrays([part.column("hash"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["hash", "licence", "score"])

    first = checkpointed(source.mapInArrow(run, f"doc_id {kind}, path string, licence string, score double, text string, needs array<string>").withColumn("hash", F.sha2("text", 256)))
    # Texts that are alike are weighed once.
    texts = settled(first.where("hash is not null").groupBy("hash").agg(F.first("text").alias("text"), F.first("needs").alias("needs")))
    pairs = settled(texts.select("hash", F.explode("needs").alias("word")))
    known = pairs.join(counts, "word").groupBy("hash").agg(F.collect_list(F.struct("word", "n")).alias("counts"))
    weighed = settled(texts.select("hash", "text").join(known, "hash").select("hash", "text", "counts").mapInArrow(weigh, "hash string, licence string, score double"))
    later = first.where("hash is not null").select("doc_id", "path", "hash").join(weighed, "hash").select("doc_id", "path", "licence", "score")
    own = settled(first.where("hash is null").select("doc_id", "path", "licence", "score").union(later))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    # One row per directory with a licence file, combined before the shuffle.
    given = own.where(F.col("licence").isNotNull() & name.rlike(LICENCE_FILE)).groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("worse"), "path", "licence")).alias("best"))
    given = given.select("dir", F.col("best.licence").alias("dir_licence"), F.col("best.path").alias("dir_path"))
    dirs = own.where("licence is null and path is not null").select(folder.alias("home")).distinct()
    depth = F.size(F.split("home", "/"))
    above = dirs.select("home", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).select("home", "depth", F.array_join(F.slice(F.split("home", "/"), 1, F.col("depth")), "/").alias("dir"))
    near = above.join(given, "dir").groupBy("home").agg(F.max_by(F.struct("dir_licence", "dir_path"), F.col("depth")).alias("up"))
    out = own.withColumn("home", folder).join(settled(near), "home", "left")
    mine = F.col("licence").isNotNull()
    return out.select("doc_id", "path", F.coalesce("licence", "up.dir_licence").alias("licence"), "score", F.when(mine, "own").when(F.col("up").isNotNull(), "inherited").alias("origin"), F.when(mine, F.col("path")).otherwise(F.col("up.dir_path")).alias("licence_path"))
