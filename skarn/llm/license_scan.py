"""Licence notices found by votes on diagonals.

A template is the word list of a notice.  Where a document quotes it, word ``p`` of the
document is word ``q`` of the template for many pairs with one difference ``p - q``: a diagonal.

1. Every rolling k-gram hash of every text meets the k-grams of all templates in a Spark join
   (k is 3, or the length of a shorter template).
2. Matches are counted by text, template and diagonal.  A word put in or left out moves the rest
   of a quotation to a neighbouring diagonal, so diagonals at most ``GAP`` apart are merged; a
   complete diagonal is an exact quotation and stands for itself.
3. Merged diagonals with votes for ``MIN_VOTES`` of a template's k-grams are verified on the words
   themselves: the share of the template's words that stand in the text along these diagonals.
   Shares of ``MIN_SHARE`` or more are spans.

Base phrases are templates of which only exact quotations count, so each place is one span.

Texts with equal content are one text to steps 1 to 3 (told apart by SHA-256), so a notice in
thousands of copies is matched once; rows take their spans in a join that is salted, as one text
may be a third of all rows.  Only texts that a Bloom filter of those with candidates lets through
(of bounded size, so that it may be sent to all) go along in that join, to be verified.

Defined results: null or empty texts have no words and no spans; repeated rows get equal results,
one each, and so do null ids; an empty table gives an empty one; columns other than the id and the
text are ignored; ``score`` is the largest share of a template found, 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._jobs import arrow_stage, bloom, in_bloom, text_of, written


@dataclass(frozen=True)
class Template:
    """A notice: its label, its text, and whether only exact quotations count (a base phrase)."""

    label: str
    text: str
    exact: bool = False


# The base phrases.
BASE = [Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True)]

# The usual wording of notices.
NOTICES = [
    Template("mit", "Released under the MIT License."),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0."),
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("cc-by", "Licensed under CC BY 4.0."),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

GRAM, GAP, MIN_VOTES, MIN_SHARE = 3, 4, 0.3, 0.85
#: Templates of so many words in all are sent to all tasks; beyond that the k-grams of the texts are shuffled.
SMALL = 200_000
#: Rows of one text are dealt to so many places when they join their spans.
SALTS = 16

SPAN = "struct<template:int,label:string,start:bigint,end:bigint,share:double>"
FOUND = "doc_id {kind}, n_words bigint, spans array<" + SPAN + ">"


def _words(text: str) -> list[str]:
    c = next(T.chunks(pa.array([text])))
    w = T.words(c.lowered(), T.ALNUM, hashed=False)
    return [c.lowered().text(a, b).decode() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def _positions(spark, templates: list[list[str]]) -> DataFrame:
    """(template, k, hash, q): the k-grams of all templates; as many rows as they have words at most."""
    rows = []
    for t, words in enumerate(templates):
        c = next(T.chunks(pa.array([" ".join(words)])))
        w = T.words(c, T.ALNUM)
        k = min(GRAM, len(words))
        hashes, at, _ = T.grams(w.hash, w.counts, k)
        rows += [(t, k, h, q, len(words)) for h, q in zip(hashes.view(np.int64).tolist(), at.tolist(), strict=True)]
    out = spark.createDataFrame(rows, "template int, k int, hash bigint, q int, size int")
    return F.broadcast(out) if len(rows) <= SMALL else out


def _copy(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _rolling(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(copy, k, grams): the hashes of all k-grams of each text in order."""
    schema = "copy binary, k int, grams array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in T.chunks(b.column(1)):
                words = T.words(raw.lowered(), T.ALNUM)
                copy = b.column(0).slice(raw.first, raw.n)
                for k in lengths:
                    hashes, _, made = T.grams(words.hash, words.counts, k)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(made))), pa.int32()), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([copy, pa.array(np.full(raw.n, k, np.int32)), lists], ["copy", "k", "grams"])

    return arrow_stage(rows, run, schema)


def candidates(docs: DataFrame, templates: list[Template], text_col: str = "text") -> DataFrame:
    """(copy, found): per text with enough votes, its merged diagonals (template, [(diagonal, low, high)])."""
    spark = docs.sparkSession
    listed = [_words(t.text) for t in templates]
    places = _positions(spark, listed)
    lengths = sorted({min(GRAM, len(w)) for w in listed if w})
    text = F.col(f"`{text_col}`")
    rolled = _rolling(docs.select(_copy(text).alias("copy"), text.alias("text")), lengths)
    met = rolled.select("copy", "k", F.posexplode("grams").alias("p", "hash")).join(places, ["k", "hash"])
    # equal texts have equal matches: each counts once
    votes = met.select("copy", "template", "size", "k", (F.col("p") - F.col("q")).alias("diagonal"), "q").distinct()
    lines = votes.groupBy("copy", "template", "size", "k", "diagonal").agg(F.count("*").alias("votes"), F.min("q").alias("low"), F.max("q").alias("high"))
    all_grams = F.col("size") - F.col("k") + 1
    whole = F.col("votes") == all_grams
    w = Window.partitionBy("copy", "template").orderBy("diagonal")
    alone = F.col("whole") | F.coalesce(F.lag("whole").over(w), F.lit(True)) | (F.col("diagonal") - F.lag("diagonal").over(w) > GAP)
    marked = lines.withColumn("whole", whole).withColumn("new", alone.cast("int"))
    grouped = marked.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lone = [t for t, x in enumerate(templates) if x.exact]
    parts = grouped.groupBy("copy", "template", "size", "k", "part").agg(F.sum("votes").alias("votes"), F.max("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("diagonal", "low", "high"))).alias("lines"))
    enough = F.when(F.col("template").isin(lone), F.col("whole")).otherwise(F.col("votes") >= MIN_VOTES * all_grams)
    return parts.where(enough).groupBy("copy").agg(F.collect_list(F.struct("template", "k", "lines")).alias("found"))


def _counted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, copy, salt, n_words, text) of every row; the text only where its copy may be among those found."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    bits, table = bloom(found.select("copy"), *[F.xxhash64("copy", F.lit(s)) for s in (1, 2)])
    sent = rows.sparkSession.sparkContext.broadcast(table)
    placed = rows.select("doc_id", "copy", "salt", "text", *[F.pmod(F.xxhash64("copy", F.lit(s)), F.lit(1 << bits)).alias(f"b{s}") for s in (1, 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(sent.value, np.uint32)
        for b in batches:
            n = [T.words(c.lowered(), T.ALNUM, hashed=False).counts for c in T.chunks(b.column(3))]
            likely = in_bloom(seen, b.column(4).to_numpy()) & in_bloom(seen, b.column(5).to_numpy())
            text = pc.if_else(pa.array(likely), b.column(3), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.concatenate(n) if n else [], pa.int64()), text], ["doc_id", "copy", "salt", "n_words", "text"])

    return arrow_stage(placed, run, f"doc_id {kind}, copy binary, salt bigint, n_words bigint, text string")


def _verified(rows: DataFrame, templates: list[Template], min_share: float) -> DataFrame:
    """(doc_id, n_words, spans) from (doc_id, n_words, text, found), compared word by word."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    listed = [[w.encode() for w in _words(t.text)] for t in templates]
    schema = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def spans(found: list[dict], word) -> list[dict]:
        out = []
        for f in found:
            mine, met, first, last = listed[f["template"]], set(), None, 0
            for line in f["lines"]:
                d = line["diagonal"]
                for q in range(line["low"], line["high"] + f["k"]):
                    if word(d + q) == mine[q]:
                        met.add(q)
                        first = d + q if first is None else min(first, d + q)
                        last = max(last, d + q + 1)
            share = len(met) / len(mine)
            if share >= (1 if templates[f["template"]].exact else min_share):
                out.append({"template": f["template"], "label": templates[f["template"]].label, "start": first, "end": last, "share": share})
        return sorted(out, key=lambda s: (s["start"], s["end"], s["template"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list[list[dict]] = [[] for _ in range(b.num_rows)]
            at = np.flatnonzero(b.column(3).is_valid().to_numpy(zero_copy_only=False))
            for raw in T.chunks(b.column(2).take(pa.array(at))):
                c = raw.lowered()
                w = T.words(c, T.ALNUM, hashed=False)
                first = w.first
                for d in range(c.n):
                    base, n, row = int(first[d]), int(w.counts[d]), int(at[c.first + d])
                    lists[row] = spans(b.column(3)[row].as_py(), lambda p, base=base, n=n, w=w, c=c: c.text(int(w.starts[base + p]), int(w.ends[base + p])) if 0 <= p < n else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, schema)], ["doc_id", "n_words", "spans"])

    return arrow_stage(rows, run, FOUND.format(kind=kind))


def scan(docs: DataFrame, templates: list[Template] | None = None, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, n_base, first_word, last_word, base_labels, labels, score) per row.

    ``spans`` lists every verified quotation: template, label, first word, end, share of the
    template's words.  The base columns count spans of base phrases only.
    """
    every = BASE + (NOTICES if templates is None else templates)
    found = written(candidates(docs, every, text_col), "licences")
    rows = text_of(docs, {"doc_id": id_col, "text": text_col}).withColumn("copy", _copy(F.col("text"))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = found.select("copy", "found", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    out = _verified(_counted(rows, found).join(salted, ["copy", "salt"], "left").select("doc_id", "n_words", "text", "found"), every, min_share)
    base = F.filter("spans", lambda s: s["template"] < len(BASE))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    return out.withColumn("_base", base).select(
        "doc_id", "n_words", "spans", F.size("_base").cast("bigint").alias("n_base"), F.array_min(F.transform("_base", lambda s: s["start"])).alias("first_word"), F.array_max(F.transform("_base", lambda s: s["start"])).alias("last_word"),
        joined(F.col("_base")).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
