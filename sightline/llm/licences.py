"""Licence scan by sparse TF-IDF cosine to templates, with inheritance from the nearest ancestor directory (operator 9).

Every line of a text, and every run of neighbouring lines that could belong to a notice, is a vector of its words'
TF-IDF weights; the document frequencies of the templates' words are counted over all documents, other words weigh as if
they occurred once. The whole text, and at every line the runs of lines as long as a template, are also compared with the full
licence texts, their openings and headers (``TEXTS``) and with the longer notices. The best cosine to a template decides, from
``LEAST`` on, first among the parts that hold a fifth or more of the words. A document with such a part is a licence file: it also speaks for its directory, and every document without a notice of its own takes the licence of
the nearest directory above it that has one (the file with the highest cosine, then the smallest key). The ancestors are
found by an equality join of directory prefixes, over distinct directories only, so a directory with a third of
all documents is one row in it.

A line is left out early only where its share of template words proves, by the Cauchy-Schwarz bound, that no cosine can
reach the threshold; so whole texts are scanned and nothing is lost. So it is with runs: a template is passed over only where its
words that the text has carry too little of its weight, a run where its sum of weights is too small for its least norm.

Defined cases: a null, empty or wordless text has no notice but may inherit; a null path is in the root directory; a null key
stays null; of equal cosines the first template in order wins; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import bytes_of, settle, table, text_chunks, word_places
from sightline.llm.licence_texts import TEXTS

LEAST = 0.7
LOOSE = 0.4
FILE_SHARE = 0.2
#: Notices of so many words are wrapped; they are also compared with runs of lines.
WRAPPED = 20
#: Characters under which the registered query places a document in a higher directory.
HIGHER = 400
HIGHEST = 100
#: Common public licence notices, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met. Neither the name of the copyright holder nor the names of its contributors "
                     "may be used to endorse or promote products"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(text: str) -> np.ndarray:
    return word_places(*bytes_of(pa.array([text])), _WORD)[0]


NOTICES = np.unique(np.concatenate([_words(t) for _, t in TEMPLATES]))
LONG = (*TEXTS, *(t for t in TEMPLATES if len(_words(t[1])) >= WRAPPED))
VOCABULARY = np.unique(np.concatenate([NOTICES, *(_words(t) for _, t in LONG)]))


def _known(hashes: np.ndarray, vocabulary: np.ndarray = VOCABULARY) -> np.ndarray:
    """Place of each word in the vocabulary, or -1."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


class Matcher:
    """TF-IDF vectors of the templates and the scan of texts against them."""

    def __init__(self, frequency: dict[int, int], documents: int):
        self.most = math.log(1 + documents) + 1
        self.weight = np.array([math.log((1 + documents) / (1 + frequency.get(i, 0))) + 1 for i in range(len(VOCABULARY))])
        self.idf = self.weight[_known(NOTICES)]
        self.rows = self._unit([_known(_words(t), NOTICES) for _, t in TEMPLATES], self.idf)
        self.long = self._unit([_known(_words(t)) for _, t in LONG], self.weight)
        self.lengths = [len(_words(t)) for _, t in LONG]

    @staticmethod
    def _unit(places: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
        rows = np.stack([np.bincount(p, minlength=len(idf)) for p in places]) * idf
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def cosines(self, hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
        inside = known >= 0
        vector = np.bincount(known[inside], minlength=len(NOTICES)) * self.idf
        norm = self._norm(hashes, inside, vector)
        return self.rows @ vector / norm if norm else np.zeros(len(TEMPLATES))

    def _norm(self, hashes: np.ndarray, inside: np.ndarray, vector: np.ndarray) -> float:
        _, others = np.unique(hashes[~inside], return_counts=True)
        return math.sqrt(float(vector @ vector) + self.most ** 2 * float((others.astype(float) ** 2).sum()))

    def _possible(self, places: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, long template) pairs whose common words carry enough of the template's weight."""
        inside = places >= 0
        pairs = np.unique(text[inside] * len(VOCABULARY) + places[inside])
        if not len(pairs):
            return pairs, pairs
        of, word = pairs // len(VOCABULARY), pairs % len(VOCABULARY)
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        held = np.stack([np.add.reduceat(row[word], heads) for row in self.long ** 2], axis=1)
        t, template = np.nonzero(held >= LEAST ** 2 - 1e-9)
        return of[heads[t]], template

    def _best_run(self, hashes: np.ndarray, places: np.ndarray, ends: np.ndarray, template: int, floor: float) -> tuple[float, int]:
        """(cosine, words) of the whole text or the run of lines that is nearest to a long template, if above ``floor``.

        ``ends`` holds 0 and the end of each line. Runs go in descending order of a bound: a word's square counts at least once each time.
        """
        inside = places >= 0
        row, at = self.long[template], np.maximum(places, 0)
        dots = np.concatenate([[0.0], np.cumsum(np.where(inside, row[at] * self.weight[at], 0.0))])
        squares = np.concatenate([[0.0], np.cumsum(np.where(inside, self.weight[at] ** 2, self.most ** 2))])
        last = np.minimum(np.searchsorted(ends, ends[:-1] + self.lengths[template]), len(ends) - 1)
        begin = np.concatenate([[0], ends[:-1], ends[:-1]])
        until = np.concatenate([[ends[-1]], ends[last], ends[np.maximum(last - 1, 0)]])
        begin, until = begin[until > begin], until[until > begin]
        bound = (dots[until] - dots[begin]) / np.sqrt(squares[until] - squares[begin])
        best, size = floor, 0
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] < LEAST - 1e-9 or bound[i] <= best:
                break
            a, b = int(begin[i]), int(until[i])
            vector = np.bincount(places[a:b][inside[a:b]], minlength=len(VOCABULARY)) * self.weight
            cosine = float(row @ vector) / self._norm(hashes[a:b], inside[a:b], vector)
            if cosine >= LEAST and cosine > best:
                best, size = cosine, b - a
        return best, size

    def _may(self, known: np.ndarray, starts: np.ndarray, least: float) -> np.ndarray:
        """Which segments of words, from each start to the next, could reach a cosine of ``least``."""
        inside = known >= 0
        mass = np.add.reduceat(np.where(inside, self.idf[known], 0.0), starts)
        strange = np.add.reduceat((~inside).astype(np.float64), starts)
        return mass ** 2 * (1 - least ** 2) >= least ** 2 * strange * self.most ** 2

    def scan(self, column: pa.Array) -> list[tuple[str, float, float] | None]:
        """(licence, cosine, share of the words) of each text's best notice or licence text."""
        data, offsets = bytes_of(column)
        hashes, starts = word_places(data, offsets, _WORD)
        out: list[tuple[str, float, float] | None] = [None] * len(column)
        if not len(hashes):
            return out
        places = _known(hashes)
        known = np.append(_known(VOCABULARY, NOTICES), -1)[places]
        text = np.searchsorted(offsets, starts, side="right") - 1
        line = np.searchsorted(np.flatnonzero(data == 0x0A), starts)
        heads = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])]))
        ends = np.append(heads[1:], len(hashes))
        loose = np.flatnonzero(self._may(known, heads, LOOSE))
        words = np.bincount(text, minlength=len(column))
        runs = np.split(loose, np.flatnonzero((np.diff(loose) > 1) | (np.diff(text[heads[loose]]) > 0)) + 1) if len(loose) else []
        for run in runs:
            segments = [(heads[i], ends[i]) for i in run.tolist()]
            if len(run) > 1:
                segments.append((heads[run[0]], ends[run[-1]]))
            t = int(text[heads[run[0]]])
            for a, b in segments:
                if not self._may(known[a:b], np.array([0]), LEAST)[0]:
                    continue
                cosine = self.cosines(hashes[a:b], known[a:b])
                best = int(cosine.argmax())
                if cosine[best] >= LEAST:
                    out[t] = self._better(out[t], (TEMPLATES[best][0], float(cosine[best]), float((b - a) / words[t])))
        upto = np.concatenate([[0], np.cumsum(words)])
        for t, template in zip(*(x.tolist() for x in self._possible(places, text))):
            a, b = upto[t], upto[t + 1]
            stops = np.concatenate([[0], ends[np.searchsorted(ends, a, side="right"):np.searchsorted(ends, b, side="right")] - a])
            sure = out[t][1] if out[t] and out[t][2] >= FILE_SHARE else 0.0
            cosine, size = self._best_run(hashes[a:b], places[a:b], stops, template, sure)
            if size:
                out[t] = self._better(out[t], (LONG[template][0], cosine, float(size / words[t])))
        return out

    @staticmethod
    def _better(a: tuple[str, float, float] | None, b: tuple[str, float, float]) -> tuple[str, float, float]:
        """The part that makes a licence file comes first, then the higher cosine, then the earlier one."""
        return b if a is None or (b[2] >= FILE_SHARE, b[1]) > (a[2] >= FILE_SHARE, a[1]) else a


def frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[int, int], int]:
    """({vocabulary place: documents}, documents) over all rows; at most one row for each word of the templates."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(VOCABULARY), dtype=np.int64), 0
        for batch in text_chunks(batches, "text"):
            data, offsets = bytes_of(batch.column(0))
            hashes, starts = word_places(data, offsets, _WORD)
            known = _known(hashes)
            inside = known >= 0
            own = np.unique((np.searchsorted(offsets, starts[inside], side="right") - 1) * len(VOCABULARY) + known[inside])
            total += np.bincount(own % len(VOCABULARY), minlength=len(VOCABULARY))
            rows += batch.num_rows
        places = np.append(np.arange(len(VOCABULARY)), -1)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(np.append(total, rows))], names=["place", "n"])

    found = docs.select(docs[text].alias("text")).mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    seen = {r["place"]: r["n"] for r in found.collect()}
    return seen, seen.pop(-1, 0)


def _directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("/")), r"/[^/]*$", "")


def scan(docs: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(key, path, license, score, basis, inherited_from) of every row; basis is own, file, inherited or none."""
    matcher = Matcher(*frequencies(docs, text))
    sent = docs.sparkSession.sparkContext.broadcast(matcher)
    plain = docs.select(docs[key].alias("key"), docs[path].alias("path"), docs[text].alias("text"))
    kind = plain.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            found = sent.value.scan(batch.column(2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([f and f[0] for f in found], pa.string()),
                pa.array([f and f[1] for f in found], pa.float64()), pa.array([f and f[2] for f in found], pa.float64()),
            ], names=["key", "path", "license", "score", "share"])

    own = settle(plain.mapInArrow(work, f"key {kind}, path string, license string, score double, share double")
                 .withColumn("dir", _directory(F.col("path"))), "notices")
    is_file = F.col("license").isNotNull() & (F.col("share") >= FILE_SHARE)
    speakers = own.filter(is_file).groupBy(F.col("dir").alias("above")).agg(F.min(F.struct(
        (-F.col("score")).alias("order"), F.col("key").alias("key"), F.col("license").alias("license"))).alias("best"))
    depth = F.size(F.split("dir", "/"))
    prefixes = own.select("dir").distinct().withColumn("above", F.explode(F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))))
    nearest = prefixes.join(speakers, "above").groupBy("dir").agg(
        F.max_by("best", F.length("above")).alias("from_"))
    out = own.join(nearest, "dir", "left")
    inherits = F.col("license").isNull() & F.col("from_").isNotNull()
    return out.select(
        F.col("key").alias(key), F.col("path").alias(path), F.coalesce("license", F.col("from_.license")).alias("license"), "score",
        F.when(is_file, F.lit("file")).when(F.col("license").isNotNull(), F.lit("own")).when(inherits, F.lit("inherited"))
        .otherwise(F.lit("none")).alias("basis"),
        F.when(inherits, F.col("from_.key")).alias("inherited_from"))


def op9_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents lie at /source/language/hundreds of doc_id/doc_id, as the table has no path of its own.

    Short ones stand higher, as files that speak for a directory do: under ``HIGHER`` characters at /source/language, under
    ``HIGHEST`` at /source.
    """
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.length("text"), F.lit(HIGHER))
    parts = [F.coalesce(F.col("source"), F.lit("unknown")),
             F.when(size >= HIGHEST, F.coalesce(F.col("lang"), F.lit("unknown"))),
             F.when(size >= HIGHER, F.floor(F.col("doc_id") / 100).cast("string")), F.col("doc_id").cast("string")]
    return scan(docs.withColumn("path", F.concat(F.lit("/"), F.concat_ws("/", *parts))))


QUERIES = {"op9_licence_inheritance": op9_licence_inheritance}
ORACLES: dict[str, str] = {}
