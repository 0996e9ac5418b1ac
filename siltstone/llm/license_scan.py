"""Operator 13, license scans by diagonal voting. DataFrame functions only.

Words are runs of digits, ASCII letters (A-Z folded) and characters beyond ASCII. Texts are cut into words once; what is needed
later is written: the number of words, the places of phrases, and the words themselves of texts that can have a hit at all
(every window of a template holds one of ``covering_words``; a text without any of those has no window to join). Every window of
``gram`` words of these texts is hash-joined with the windows of the templates; a hit at word p of the text and word q of a template votes for
the diagonal p - q. Votes are counted by (document, template, diagonal), with partial sums before the only shuffle, which
hits alone pass through. Diagonals of a document and template that lie at most ``gap`` apart are merged: words put in or left out
move the rest of a copy to a neighbouring diagonal. A merged group wider than ``width`` (a text that repeats itself with a
short period) is cut at multiples of ``width``.

Groups with ``votes`` or more distinct template positions hit go back to their texts, broadcast if they have been measured to take
at most ``broadcast_bytes``, joined otherwise, and are verified on the words themselves: a word of the template counts if it
stands in the text on one of the group's diagonals. The counted share of the template's words is the group's *coverage*; at
``least`` or more the document has the template's label.

Three phrases are templates of their own, too short for windows: the places where their words stand in a row are
looked for in the texts that have all of their words.

``score`` is 1 where a phrase stands, else the largest coverage of a verified group, accepted or not, else 0.

Defined results: null and empty texts have no words, no labels, empty strings and score 0; rows with equal doc_id and text are
scanned alike and each has its row; a null doc_id is reported as null; other columns are left behind; an empty table gives an
empty result; a template with fewer words than a window is refused (ValueError).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tables import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and characteristic passages of public licenses, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"),
    ("apache-2.0", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)


@dataclass(frozen=True)
class ScanParams:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    gram: int = 4
    gap: int = 6
    width: int = 64
    votes: int = 2
    least: float = 0.8
    broadcast_bytes: int = 32 << 20


def folded(text: Column) -> Column:
    """A-Z in lower case. Other letters change case too, which no comparison sees, since templates and phrases are ASCII:
    only the Kelvin sign would become an ASCII letter, so another letter stands for it."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def words(parts: Column) -> Column:
    """Of a text split at BETWEEN: without the empty parts at its ends."""
    first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def template_words(text: str) -> list[str]:
    """The same words, of a template, on the driver."""
    fold = str.maketrans(UPPER, LOWER)
    return re.findall(WORD, text.translate(fold))


def with_grams(df: DataFrame, size: int) -> DataFrame:
    """``w`` replaced by ``grams``: a hash of each ``size`` words in a row, in order, from hashes of spans of doubling length.
    A step is a projection of its own, so that nothing is worked out twice."""
    rest = [c for c in df.columns if c != "w"]
    out, have = df.select(*rest, F.transform("w", lambda x: F.xxhash64(x)).alias("grams")), 1  # noqa: PLW0108
    while have < size:
        step = min(have, size - have)
        left = F.greatest(F.size("grams") - step, F.lit(0))
        out = out.select(*rest, F.zip_with(F.slice("grams", 1, left), F.slice("grams", step + 1, left), lambda a, b: F.xxhash64(a, b)).alias("grams"))
        have += step
    return out


def template_grams(spark, p: ScanParams) -> DataFrame:
    """(h, t, q): each window of each template, with its place."""
    rows = [(t, template_words(text)) for t, (_, text) in enumerate(p.templates)]
    if short := [p.templates[t][0] for t, w in rows if len(w) < p.gram]:
        raise ValueError(f"templates with fewer than {p.gram} words: {', '.join(short)}")
    table = spark.createDataFrame(rows, "t int, w array<string>")
    return with_grams(table, p.gram).select("t", F.posexplode("grams").alias("q", "h"))


def covering_words(p: ScanParams) -> list[str]:
    """Words of which every window of every template has one: those in most of the windows that are left, long ones first."""
    open_ = {tuple(w[q : q + p.gram]) for _, text in p.templates for w in [template_words(text)] for q in range(len(w) - p.gram + 1)}
    out = []
    while open_:
        count: dict[str, int] = {}
        for g in open_:
            for x in set(g):
                count[x] = count.get(x, 0) + 1
        best = max(count, key=lambda x: (min(len(x), 8) ** 4 * count[x], x))
        out.append(best)
        open_ = {g for g in open_ if best not in g}
    return sorted(out)


def _sized(df: DataFrame, bytes_a_row: int, most: int) -> DataFrame:
    """``df``, to be broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.count() * bytes_a_row <= most else df


KEY = ("doc_id", "f")


def tokenised(docs: DataFrame, p: ScanParams) -> DataFrame:
    """(doc_id, f, n_words, places, w): ``f`` is a hash of the text; ``w`` are the words of texts that a window of a template may
    stand in, else null."""
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("f"), folded(text).alias("folded"))
    d = d.select(*KEY, "folded", F.split("folded", BETWEEN).alias("parts")).select(*KEY, "folded", words(F.col("parts")).alias("w"))
    some = F.arrays_overlap("w", F.array(*[F.lit(x) for x in covering_words(p)]))
    return d.select(*KEY, F.size("w").cast("long").alias("n_words"), base(F.col("w"), F.col("folded"), p.phrases).alias("places"), F.when(some, F.col("w")).alias("w"))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.f") == F.col(f"{right}.f"))


def hits(texts: DataFrame, p: ScanParams) -> DataFrame:
    """(doc_id, f, t, p, q): template windows found in ``tokenised`` texts, once for rows that are equal."""
    known = _sized(stored(template_grams(texts.sparkSession, p), "grams"), 64, p.broadcast_bytes)
    mine = with_grams(texts.where("w IS NOT NULL").select(*KEY, "w"), p.gram)
    # the outer form: for the other, the planner asks for the array's size first, and works the hashes out once more for that
    mine = mine.select(*KEY, F.posexplode_outer("grams").alias("p", "h"))
    return mine.join(known, "h").select(*KEY, "t", "p", "q").distinct()


def groups(found: DataFrame, p: ScanParams) -> DataFrame:
    """(doc_id, f, t, diagonals): merged neighbouring diagonals with enough votes."""
    d = found.groupBy(*KEY, "t", (F.col("p") - F.col("q")).alias("d")).agg(F.collect_set("q").alias("qs"))
    w = Window.partitionBy(*KEY, "t").orderBy("d")
    new = F.when(F.col("d") - F.lag("d").over(w) <= p.gap, 0).otherwise(1)
    d = d.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    d = d.withColumn("low", F.min("d").over(Window.partitionBy(*KEY, "t", "run")))
    part = F.expr(f"(d - low) div {p.width}").alias("part")
    g = d.groupBy(*KEY, "t", "run", part).agg(F.sort_array(F.collect_list("d")).alias("diagonals"), F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
    return g.where(F.size("qs") >= p.votes).select(*KEY, "t", "diagonals")


def _coverage(template: Column, diagonals: Column) -> Column:
    """The share of the template's words that stand on one of the diagonals in ``w``, the text's words."""
    stands = lambda x, q: F.exists(diagonals, lambda d: F.coalesce(F.try_element_at("w", F.when(q + d >= 0, q + d + 1).otherwise(F.size("w") + 1)) == x, F.lit(False)))
    n = F.aggregate(F.transform(template, lambda x, q: stands(x, q).cast("int")), F.lit(0), lambda a, b: a + b)
    return n / F.size(template)


def verified(texts: DataFrame, merged: DataFrame, p: ScanParams) -> DataFrame:
    """(doc_id, f, label, coverage): a row for each group, of documents with any."""
    spark = texts.sparkSession
    table = F.broadcast(spark.createDataFrame([(t, label, template_words(text)) for t, (label, text) in enumerate(p.templates)], "t int, label string, template array<string>"))
    per = stored(merged.groupBy(*KEY).agg(F.collect_list(F.struct("t", "diagonals")).alias("gs")), "groups")
    size = per.agg(F.sum(F.expr("40 + aggregate(gs, 0L, (a, g) -> a + 32 + 4 * size(g.diagonals))"))).first()[0] or 0
    mine = texts.where("w IS NOT NULL").select(*KEY, "w").alias("a")
    mine = mine.join((F.broadcast(per) if size <= p.broadcast_bytes else per).alias("b"), _same("a", "b")).select("a.*", "b.gs")
    once = mine.dropDuplicates(list(KEY)).select(*KEY, "w", F.explode("gs").alias("g"))
    once = once.join(table, F.col("g.t") == F.col("t"))
    return once.select(*KEY, "label", _coverage(F.col("template"), F.col("g.diagonals")).alias("coverage"))


def base(w: Column, folded: Column, phrases: dict[str, str]) -> Column:
    """array<struct<at, label>>: the places of all phrases among the words ``w`` of the text ``folded``."""
    none = F.array().cast("array<struct<at:int,label:string>>")
    out = []
    for phrase, label in phrases.items():
        parts = template_words(phrase)
        last = F.size(w) - len(parts)
        firsts = F.filter(F.transform(w, lambda x, i: F.when(x == parts[0], i)), lambda i: i.isNotNull() & (i <= last))  # noqa: B023
        whole = F.filter(firsts, lambda i: _all([F.element_at(w, i + k + 1) == x for k, x in enumerate(parts)]))  # noqa: B023
        at = F.transform(whole, lambda i: F.struct(i.cast("int").alias("at"), F.lit(label).alias("label")))  # noqa: B023
        out.append(F.when(_all([folded.contains(x) for x in parts]), at).otherwise(none))
    return F.concat(*out)


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out & x
    return out


def license_report(docs: DataFrame, params: ScanParams | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each document."""
    p = params or ScanParams()
    texts = stored(tokenised(docs, p), "words")
    merged = stored(groups(hits(texts, p), p), "diagonals")
    per = verified(texts, merged, p).groupBy(*KEY).agg(F.max("coverage").alias("coverage"), F.collect_set(F.when(F.col("coverage") >= p.least, F.col("label"))).alias("more"))
    per = stored(per, "labels")
    size = per.agg(F.sum(F.expr("48 + 24 * size(more)"))).first()[0] or 0
    d = texts.drop("w")
    d = d.alias("a").join((F.broadcast(per) if size <= p.broadcast_bytes else per).alias("b"), _same("a", "b"), "left").select("a.*", "b.coverage", "b.more")
    own = F.array_sort(F.array_distinct("places.label"))
    both = F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>"))))
    return d.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").cast("long").alias("first_word"),
        F.array_max("places.at").cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
