"""License scan: stated phrases, and notice templates found by diagonal voting.

One pass over the texts counts words, finds the phrases' places and keeps the
places of rolling word k-gram hashes that any template has.  Spark joins
these places to the template positions and counts votes per diagonal (text
place less template place); neighbouring diagonals merge; the words of each
merged span are then verified against the template's own.

The template table is fixed and small, so it is broadcast.  Votes are grouped
by text and template, never across texts.  Defined cases: null text is empty;
texts without words have 0 words and null places; labels are empty strings
where nothing is found; rows that repeat have equal results; a null doc_id is
kept; other columns are ignored.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlens.llm.common import bytes_view, stash, steps, text_key, text_of
from promptlens.llm.words import gram_hashes, word_hashes

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# The wording of common public license notices.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

K = 4
#: Diagonals this near belong to one place.
NEAR = 8
#: Share of the template's words that a verified span has in their order.
COVER = 0.6


def _words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def template_grams(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = [(int(h), label, i) for label, text in templates.items() for i, h in enumerate(gram_hashes(_words_of(text), K).view(np.int64))]
    return spark.createDataFrame(rows, "h long, label string, at int")


def _first_pass(docs: DataFrame, grams: np.ndarray) -> DataFrame:
    phrases = [(_words_of(p), label) for p, label in PHRASES.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            word, _, _, row = word_hashes(*bytes_view(batch.column("text")))
            n = batch.num_rows
            count = np.bincount(row, minlength=n)
            first = np.concatenate([[0], np.cumsum(count)])
            places = [[] for _ in range(n)]
            labels = [set() for _ in range(n)]
            for phrase, label in phrases:
                at = np.flatnonzero(word[: len(word) - len(phrase) + 1] == phrase[0]) if len(word) >= len(phrase) else np.zeros(0, np.int64)
                for k in range(1, len(phrase)):
                    at = at[word[at + k] == phrase[k]]
                at = at[row[at] == row[at + len(phrase) - 1]] if len(at) else at
                for a in at:
                    places[row[a]].append(int(a - first[row[a]]))
                    labels[row[a]].add(label)
            h = gram_hashes(word, K)
            hit = np.flatnonzero(np.isin(h, grams))
            hit = hit[row[hit] == row[hit + K - 1]] if len(hit) else hit
            hits, regions, begins = [None] * n, [None] * n, [None] * n
            for i in np.unique(row[hit]):
                own = hit[row[hit] == i] - first[i]
                lo, hi = max(0, int(own[0]) - 128), int(own[-1]) + 128
                hits[i] = [{"pos": int(p), "h": int(x)} for p, x in zip(own, h[own + first[i]].view(np.int64), strict=True)]
                begins[i], regions[i] = lo, word[first[i] + lo : min(first[i] + hi, first[i + 1])].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key").cast(pa.binary()),
                    pa.array(count, pa.int64()),
                    pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p, default=None) for p in places], pa.int64()),
                    pa.array([max(p, default=None) for p in places], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(hits, pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64())]))),
                    pa.array(begins, pa.int32()),
                    pa.array(regions, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits", "begin", "region"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text_of().alias("text")).mapInArrow(
        scan, "doc_id long, key binary, n_words long, n_base long, first_word long, last_word long, base_labels string, hits array<struct<pos:int,h:long>>, begin int, region array<long>"
    )


def license_spans(table: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """key, label, first and last word, cover of each verified span."""
    spark = table.sparkSession
    own = table.where("hits is not null").groupBy("key").agg(F.first("hits").alias("hits"), F.first("begin").alias("begin"), F.first("region").alias("region"))
    votes = own.select("key", F.explode("hits").alias("x")).select("key", "x.pos", "x.h").join(F.broadcast(template_grams(spark, templates)), "h")
    diagonals = votes.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("key", "label", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by = Window.partitionBy("key", "label").orderBy("diagonal")
    merged = diagonals.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEAR).cast("int"), F.lit(0))).withColumn("place", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("key", "label", "place").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), (F.max("hi") + K - 1).alias("hi")).where("votes >= 3")
    both = own.select("key", "begin", "region").join(spans.groupBy("key").agg(F.collect_list(F.struct("label", "lo", "hi")).alias("spans")), "key")
    wanted = {label: _words_of(text).view(np.int64).tolist() for label, text in templates.items()}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for s in r["spans"]:
                    t = wanted[s["label"]]
                    have = r["region"][max(0, s["lo"] - r["begin"]) : s["hi"] - r["begin"] + 1]
                    same = sum(m.size for m in difflib.SequenceMatcher(None, have, t, autojunk=False).get_matching_blocks())
                    if same >= COVER * len(t):
                        out.append((r["key"], s["label"], s["lo"], s["hi"], same / len(t)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["key", "label", "lo", "hi", "cover"])

    return both.mapInArrow(verify, "key binary, label string, lo int, hi int, cover double")


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """The base columns, all labels and a score for every row of ``docs``; score is 1 with a phrase, else the best verified cover."""
    grams = np.array([int(h) for t in templates.values() for h in gram_hashes(_words_of(t), K)], np.uint64)
    table = stash(_first_pass(docs, grams), "licenses")
    spans = license_spans(table, templates).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    rows = table.select("doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels")
    all_labels = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.coalesce("more", F.array().cast("array<string>")))))
    # Joined on a derived value, so that adaptive execution can split a text of very many copies.
    spans = spans.withColumn("j", F.xxhash64("key")).withColumnRenamed("key", "of")
    rows = rows.withColumn("j", F.xxhash64("key"))
    return rows.join(spans, (rows["j"] == spans["j"]) & (rows["key"] == spans["of"]), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(all_labels, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score")
    )
