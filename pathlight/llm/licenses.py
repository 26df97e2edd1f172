r"""License scans by diagonal voting (operator 1).

Every text becomes words (runs of 0-9, A-Z, a-z and non-ASCII, A-Z lowered). Each rolling
hash of k words is looked up in the template positions; a hit votes for the diagonal
`document position - template position`. A phrase stands where its diagonal has all
votes. For long templates, neighbouring diagonals merge, as edits shift the rest of a
text by a word or two, and the merged span is verified against the words themselves, window
by window over its whole length.

The hashes of a batch pass a bit table of template hashes before they become rows; only
what the table can't exclude goes to Spark's join, which decides. The template table is
broadcast: its size is that of the library of templates, not of the data.

Null and empty texts have no words: counts 0, no places, empty labels, score 0. Repeated
rows give repeated results (rows are told apart by a row number of their own, not by
doc_id), an empty table an empty one. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathlight.llm.common import ALNUM, bytes_of, documents, hash_phrase, materialize, rolling, slices, text_or_empty, words

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of a rolling window: for phrases their own length up to PHRASE_K, for long templates LONG_K.
PHRASE_K, LONG_K = 4, 5
#: Diagonals at most so many words apart merge.
MERGE = 8
#: Share of a template's words that a verified span must hold.
LEAST_SCORE = 0.5

#: Notices and license texts that long templates match.
LIBRARY = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy
of this license, visit http://creativecommons.org/licenses/by/4.0/""",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool

    @property
    def words(self) -> list[str]:
        return word_list(self.text)

    @property
    def k(self) -> int:
        return min(PHRASE_K, len(self.words)) if self.phrase else LONG_K


TEMPLATES = [*(Template(v, k, True) for k, v in PHRASES.items()), *(Template(k, v, False) for k, v in LIBRARY.items())]


def word_list(text: str) -> list[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, starts, ends = words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b].lower().decode() for a, b in zip(starts, ends, strict=True)]


def positions(templates: list[Template]) -> list[tuple[int, int, int, int]]:
    """(k, hash, template, position) of each window of each template."""
    out = []
    for t, x in enumerate(templates):
        h = hash_phrase(x.text, ALNUM)
        _, r = rolling(np.array([0, len(h)]), h, x.k)
        out += [(x.k, int(v), t, p) for p, v in enumerate(r.view(np.int64))]
    return out


#: Bits of a hash that index the bit table.
TABLE_BITS = 20
ROWS = "uid bigint, doc_id bigint, n_words bigint, text string, hits array<struct<k:int,pos:bigint,hash:bigint>>"


def window_rows(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """A row per document: n_words, the windows that may be in a template, and the text only if there are any."""
    known: dict[int, np.ndarray] = {}
    for k, h, _, _ in positions(templates):
        known.setdefault(k, np.zeros(1 << TABLE_BITS, bool))[h & ((1 << TABLE_BITS) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << TABLE_BITS) - 1)
        for whole in batches:
            for batch in slices(whole):
                data, offsets = bytes_of(batch.column("text"))
                first, hashes, _, _ = words(data, offsets, ALNUM)
                found = []
                for k, table in known.items():
                    begin, rolled = rolling(first, hashes, k)
                    at = np.flatnonzero(table[(rolled & low).astype(np.int64)])
                    row = np.searchsorted(begin, at, "right") - 1
                    found.append((row, np.full(len(at), k), at - begin[row], rolled[at].view(np.int64)))
                row, k, pos, value = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
                hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(k[order], pa.int32()), pa.array(pos[order], pa.int64()), pa.array(value[order], pa.int64())], ["k", "pos", "hash"]))
                text = batch.column("text").take(pa.array(np.arange(batch.num_rows), mask=np.diff(ends) == 0))
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), text, hits], ["uid", "doc_id", "n_words", "text", "hits"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, ROWS)


def spans(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """(uid, template, start, end): where diagonals vote for a template; start and end are words, end exclusive."""
    spark = rows.sparkSession
    lengths = [len(t.words) for t in templates]
    table = spark.createDataFrame([(k, h, t, p, lengths[t], templates[t].phrase) for k, h, t, p in positions(templates)], "k int, hash bigint, template int, tpos int, length int, phrase boolean")
    hits = rows.select("uid", F.explode("hits").alias("_h")).select("uid", "_h.*")
    votes = hits.join(F.broadcast(table), ["k", "hash"]).groupBy("uid", "template", "length", "phrase", "k", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    votes = votes.agg(F.count("*").alias("votes"), F.min("pos").alias("low"), (F.max("pos") + F.first("k")).alias("high"))
    full = F.col("votes") == F.col("length") - F.col("k") + 1
    exact = votes.filter(F.col("phrase") & full).select("uid", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("end"))
    by = Window.partitionBy("uid", "template").orderBy("diagonal")
    long = votes.filter(~F.col("phrase")).withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(by) > MERGE).cast("int"))
    long = long.withColumn("_group", F.sum(F.coalesce("_new", F.lit(0))).over(by))
    long = long.groupBy("uid", "template", "_group").agg(F.min("low").alias("start"), F.max("high").alias("end"))
    return exact.unionByName(long.drop("_group"))


FOUND = "uid bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,score:double>>"


def shared_words(a: list[str], b: list[str]) -> int:
    """How many words two lists share in order (the longest common subsequence)."""
    place: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        place.setdefault(w, []).append(i)
    best = np.zeros(len(a) + 1, np.int64)
    for w in b:
        if at := place.get(w):
            grown = best[at] + 1
            for i, v in zip(reversed(at), grown[::-1], strict=True):
                best[i + 1] = max(best[i + 1], v)
            np.maximum.accumulate(best, out=best)
    return int(best[-1])


def matched(template: list[str], have: list[str], start: int, end: int) -> list[tuple[int, int, float]]:
    """Where a merged span holds a template, with scores: windows of two template lengths in steps of one, so that a copy anywhere is in one of them whole. Of overlapping ones the best stays."""
    n, out = len(template), []
    for a in range(start, max(end - n, start) + n, n):
        b = min(end, a + 2 * n)
        score = shared_words(template, have[a:b]) / n
        if score < LEAST_SCORE or a >= b:
            continue
        if out and out[-1][1] > a:
            if score > out[-1][2]:
                out[-1] = (a, b, score)
        else:
            out.append((a, b, score))
    return out


def verified(rows: DataFrame, found: DataFrame, templates: list[Template]) -> DataFrame:
    """Checks each span's words against its template's and sums up by row."""
    text = [t.words for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for x in batch.to_pylist():
                have, kept = word_list(x["text"]), []
                for s in x["spans"]:
                    t, a, b = s["template"], s["start"], s["end"]
                    if templates[t].phrase:
                        if have[a:b] == text[t]:
                            kept.append((templates[t], a, b, 1.0))
                    else:
                        kept += [(templates[t], *w) for w in matched(text[t], have, a, b)]
                starts = [a for t, a, _, _ in kept if t.phrase]
                base = sorted({t.label for t, _, _, _ in kept if t.phrase})
                every = sorted({t.label for t, _, _, _ in kept})
                out.append({"uid": x["uid"], "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(base), "labels": ",".join(every), "score": max((s for *_, s in kept), default=0.0), "spans": [{"label": t.label, "start": a, "end": b, "score": s} for t, a, b, s in sorted(kept, key=lambda y: (y[1], y[2], y[0].label))]})
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    # a row's spans are at most as many as its words, so they fit where its text does
    listed = found.groupBy("uid").agg(F.collect_list(F.struct("template", "start", "end")).alias("spans"))
    return rows.filter(F.col("text").isNotNull()).select("uid", "text").join(listed, "uid").mapInArrow(run, FOUND)


SCHEMA = pa.schema(
    [("uid", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]
)


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """A row per document: doc_id, n_words, counts and labels of base phrases, all labels, score and verified spans."""
    rows = materialize(window_rows(docs, templates))
    out = rows.select("uid", "doc_id", "n_words").join(verified(rows, spans(rows, templates), templates), "uid", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<label:string,start:bigint,end:bigint,score:double>>")).alias("spans"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("spans")
