"""License scans by diagonal voting.

All rolling word k-grams of every document join, by hash, the positions at which
templates hold the same k-gram. A hit at document word i and template word j votes
for the offset diagonal i - j; every vote compares the words themselves, not only
their hash. A span is verified as a chain of votes: both its document words and its
template words run strictly forward, and the diagonal moves by a few words at most from
one vote to the next (words inserted or left out). So each place of a template counts
once in a span, and a span is never wider than a few times its template.

A chain counts for a template only if it also holds what tells that template from each
other one of the pack, and for a short notice only if every word that says anything is
there and nothing but common words stands between: a notice that differs in one word
names another license.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import Scratch

#: Words of a k-gram.
GRAM = 2
#: Diagonals of successive votes of a span are at most so far apart.
NEAR = 2
#: Share that a span must hold of a template's indexed k-grams, and of those that each other template lacks.
COVERAGE = 0.6
#: Templates of at most so many words are notices, which must be whole.
SHORT = 16

#: Templates of more k-grams in all are joined by shuffle instead of a broadcast.
BROADCAST_GRAMS = 200_000

#: Phrases whose every place counts (fixed by the contract), by label.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Longer notices of public licenses, by label.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version"
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer"
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions"
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "mit-warranty": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    ),
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "gpl-2.0-text": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version"
    ),
    "agpl-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version"
    ),
    "lgpl-text": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version"
    ),
    "hpnd-text": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without "
        "fee is hereby granted, provided that the above copyright notice appear in all copies and that both that "
        "copyright notice and this permission notice appear in supporting documentation"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

#: Words too common to make a k-gram telling if it holds nothing else.
COMMON = set("a an and any are as at be by for from in is it of on or that the this to under with".split())

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and code points above 127."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def indexed(words: list[str], gram: int) -> dict[int, tuple[str, ...]]:
    """The k-grams of a template by place, but for those of common words alone."""
    at = range(len(words) - gram + 1)
    return {i: tuple(words[i : i + gram]) for i in at if not COMMON.issuperset(words[i : i + gram])}


class Proof:
    """What a chain of votes must hold to be a template: made from the whole pack."""

    def __init__(self, templates: dict[str, str], gram: int, coverage: float):
        self.gram, self.coverage = gram, coverage
        self.words = {k: template_words(t) for k, t in templates.items()}
        grams = {k: indexed(w, gram) for k, w in self.words.items()}
        self.size = {k: len(g) for k, g in grams.items()}
        #: Of each template the places that another one lacks, for every other one.
        self.rivals = {}
        for k, own in grams.items():
            lacks = ({i for i, g in own.items() if g not in set(other.values())} for o, other in grams.items() if o != k)
            self.rivals[k] = [x for x in lacks if x]
        self.telling = {k: {i for i, w in enumerate(w_) if w not in COMMON} if len(w_) <= SHORT else set() for k, w_ in self.words.items()}

    def holds(self, label: str, chain: list[tuple[int, int]], around: dict[tuple[int, int], tuple[str | None, str | None]]) -> bool:
        """chain: (word, place) votes in order; around: the words before and after each vote's k-gram."""
        places = {place for _, place in chain}
        share = self.coverage
        if len(places) < share * self.size[label] or any(len(places & r) < share * len(r) for r in self.rivals[label]):
            return False
        if not self.telling[label]:
            return True
        covered = {p + k for p in places for k in range(self.gram)}
        if not self.telling[label] <= covered:
            return False
        # Whatever stands between two votes may be common words only.
        for (at, place), (then, later) in zip(chain, chain[1:], strict=False):
            if then > at + self.gram and not {around[at, place][1], around[then, later][0]} <= COMMON:
                return False
        return True


def template_grams(spark: SparkSession, base: dict[str, str], templates: dict[str, str], gram: int) -> DataFrame:
    """(hash, label, is_base, place, grams, gram): one row an indexed k-gram of a template.

    Broadcast up to ``BROADCAST_GRAMS`` rows.
    """
    rows = []
    for is_base, group in ((True, base), (False, templates)):
        for label, text in group.items():
            w = template_words(text)
            if len(w) < gram:
                raise ValueError(f"template {label} has fewer than {gram} words")
            at = range(len(w) - gram + 1) if is_base else indexed(w, gram)
            rows += [(label, is_base, i, len(at), w[i : i + gram]) for i in at]
    table = spark.createDataFrame(rows, "label string, is_base boolean, place int, grams int, gram array<string>")
    table = table.select(
        F.xxhash64(*(F.col("gram")[k] for k in range(gram))).alias("hash"), "label", "is_base", "place", "grams", "gram"
    )
    return F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table


def phrase_places(hits: list[tuple[int, int]], grams: int) -> list[tuple[int, int, int]]:
    """(first, last, votes) of every diagonal of (word, place) hits that holds all places."""
    by = defaultdict(list)
    for at, place in hits:
        by[at - place].append(at)
    return [(min(w), max(w), len(w)) for w in by.values() if len(w) == grams]


def chains(hits: list[tuple[int, int]], near: int = NEAR) -> list[tuple[int, int, int]]:
    """(first, last, votes) of the longest chains of (word, place) hits that do not overlap, longest first."""
    return [(c[0][0], c[-1][0], len(c)) for c in chained(hits, near)]


def chained(hits: list[tuple[int, int]], near: int = NEAR) -> list[list[tuple[int, int]]]:
    """The longest chains of (word, place) hits that do not overlap, longest first.

    Of the hits on one diagonal, the last that lies before a hit in word and place ends
    the longest chain there, so a hit looks at a few diagonals and a few hits on each.
    """
    hits = sorted(hits)
    on = defaultdict(list)
    best, before = [], []
    for k, (at, place) in enumerate(hits):
        length, link = 1, -1
        for d in range(at - place - near, at - place + near + 1):
            for j in reversed(on.get(d, ())):
                if hits[j][0] < at and hits[j][1] < place:
                    if best[j] + 1 > length or (best[j] + 1 == length and j > link):
                        length, link = best[j] + 1, j
                    break
        best.append(length)
        before.append(link)
        on[at - place].append(k)
    taken, out = set(), []
    for k in sorted(range(len(hits)), key=lambda k: (-best[k], hits[k])):
        chain, at = [], k
        while at >= 0:
            chain.append(hits[at])
            at = before[at]
        span = range(chain[-1][0], chain[0][0] + 1)
        if taken.isdisjoint(span):
            taken.update(span)
            out.append(chain[::-1])
    return out


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE,
    templates: dict[str, str] = TEMPLATES,
    gram: int = GRAM,
    coverage: float = COVERAGE,
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    documents: row, id and n_words of every row. spans: row, label, is_base, start and
    stop (words from 0), score (share of the template's k-grams found) of every span.
    Null text is empty and has no span. Repeated rows are rows of their own (row tells
    them apart). Other columns are not read.
    """
    spark = df.sparkSession
    grams = template_grams(spark, base, templates, gram)
    docs = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")
    )
    # Shifted copies side by side: the generator makes each k-gram with its neighbours, so no row holds all words of its text.
    none = F.array(F.lit(None).cast("string"))
    around = {"_before": F.concat(none, F.col("words")), "_w0": F.col("words")}
    around |= {("_after" if k == gram else f"_w{k}"): F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))) for k in range(1, gram + 1)}
    each = F.arrays_zip(*(x.alias(c) for c, x in around.items()))
    places = docs.select("row", "id", F.size("words").alias("n_words"), F.posexplode_outer(each).alias("at", "g"))
    places = places.select("row", "id", "n_words", "at", *(F.col("g")[c].alias(c) for c in around))
    word = [F.col(f"_w{k}") for k in range(gram)]
    hashed = places.withColumn("hash", F.when(word[-1].isNotNull(), F.xxhash64(*word)))
    same = F.lit(True)
    for k in range(gram):
        same = same & (word[k] == grams["gram"][k])
    joined = hashed.join(grams, (hashed["hash"] == grams["hash"]) & same, "left")
    # One row a document stays besides its hits, so documents without hits are not lost.
    kept = joined.where("label is not null or at is null or at = 0").select(
        "row", "id", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n_words")).alias("n_words"), "at", "label", "is_base", "place", "grams", "_before", "_after"
    )
    # Written once, for the two groupings: a row a document and a row a hit.
    dealt = Scratch(spark, "license").write(kept)
    documents = dealt.groupBy("row", "id").agg(F.max("n_words").cast("long").alias("n_words"))
    # A span holds at least that share of distinct places, so most hits go here.
    enough = F.when(F.col("is_base"), F.lit(1.0)).otherwise(F.lit(coverage))
    candidates = (
        dealt.where("label is not null")
        .groupBy("row", "label", "is_base", "grams")
        .agg(F.collect_list(F.struct("at", "place", "_before", "_after")).alias("hits"), F.count_distinct("place").alias("places"))
        .where(F.col("places") / F.col("grams") >= enough)
        .drop("places")
    )

    proof = Proof(templates, gram, coverage)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                hits = [(h["at"], h["place"]) for h in r["hits"]]
                if r["is_base"]:
                    found = phrase_places(hits, r["grams"])
                else:
                    beside = {(h["at"], h["place"]): (h["_before"], h["_after"]) for h in r["hits"]}
                    found = [(c[0][0], c[-1][0], len(c)) for c in chained(hits) if proof.holds(r["label"], c, beside)]
                for first, last, votes in found:
                    out.append((r["row"], r["label"], r["is_base"], first, last + gram, votes / r["grams"]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["row", "label", "is_base", "start", "stop", "score"],
            )

    spans = candidates.mapInArrow(verified, "row long, label string, is_base boolean, start long, stop long, score double")
    return documents, spans


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: word count, places of the base phrases, labels and best score.

    Whole texts, however long: a row holds a k-gram and its neighbours, never all words of
    its text, and only the hits of one document and template meet in a task. Null and
    empty texts have no words and no labels; repeated rows and null ids are rows of their
    own; an empty table gives no rows; other columns are not read.
    """
    documents, spans = scan(df, id_col, text_col, **options)
    found = spans.groupBy("row").agg(
        F.sum(F.col("is_base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("score").alias("score"),
    )

    def text(c: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c)

    return documents.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        text("base_labels"),
        text("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
