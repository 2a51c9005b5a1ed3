"""Licence scans: a sparse n-gram logistic regression over paragraphs, confirmed against templates.

A paragraph ends at a blank line; what is classified is a line of it or several neighbouring ones, since notices are wrapped. The classifier is trained here, on variants of short public notices and on a bounded sample of
lines from the documents as the unknown class; an L1 penalty leaves few n-grams with weight. Its probabilities are scaled by a temperature
fitted on variants and background lines it was not trained on. A span is scored in full only if the most that its words could speak for a family outweighs the
unknown class; this upper bound leaves out no span that could be reported. Predictions are confirmed by how much of a template of that family the span holds (or the template of the span).

Everything runs as DataFrame functions and Spark's own regression: no Python on the executors, no shuffle of text.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import stored

UNKNOWN = "unknown"
#: Wording of public licence notices, by family, and of notices that belong to none of them.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
            "either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
            "and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
             "either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "Distributed under the GNU LGPL, the Lesser General Public License."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
             "either version 3 of the License, or (at your option) any later version."),
    ("agpl", "Distributed under the GNU AGPL, the Affero General Public License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Published under the ISC License."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                  "for any purpose, commercial or non-commercial, and by any means."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc", "Content is available under CC BY-SA 4.0 unless otherwise noted."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright by the authors. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    (UNKNOWN, "Distributed under the terms of the community license of this site."),
    (UNKNOWN, "Use of this material is governed by our terms of service."),
    (UNKNOWN, "See the license file for details."),
    (UNKNOWN, "A driving license is required in this state, version of the law of 2004."),
    (UNKNOWN, "The software works with this program and any file, free of errors."),
]
SLOTS = 4096
#: Lines of a span, and characters in those between its first and last: half as much again as the words and characters of the longest notice.
SPAN_LINES = 3 * max(len(text.split()) for _, text in NOTICES) // 2
SPAN_CHARS = 3 * max(len(text) for _, text in NOTICES) // 2
#: Lines of a block: long texts are looked at block by block, each with the lines that a span from it may reach.
BLOCK = 256


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words))


def notice_grams(text: str) -> list[str]:
    """``grams_of`` of a notice (plain ASCII), for use as a constant."""
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))


@dataclass
class Model:
    families: list[str]                    # classes, unknown among them
    weights: dict[str, list[float]]        # n-gram -> weight by class
    bias: list[float]
    temperature: float
    gate: list[int]                        # bitmap of the words that speak for a family
    most: dict[str, list[float]]           # what such a word can add to each class at most, over unknown
    needed: list[float]                    # what a span's words must add up to, for a class to be more probable than unknown


def notices(spark) -> DataFrame:
    rows = [(i, f, t) for i, (f, t) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "template int, family string, text string").withColumn("words", words_of(F.col("text")))


def _variants(rows: DataFrame, first: int, many: int) -> DataFrame:
    """Each notice ``many`` times: as it is, with words missing, or a stretch of it; the choice follows from a hash."""
    r = rows.withColumn("seed", F.explode(F.sequence(F.lit(first), F.lit(first + many - 1))))
    h = lambda *c: F.pmod(F.xxhash64(*c, "template", "seed"), F.lit(1000))
    gone = F.filter("words", lambda w, i: h(w, i) >= 120)
    size = F.size("words")
    begin = F.floor(size * h(F.lit("b")) / 2500).cast("int")
    part = F.slice("words", begin + 1, F.greatest(F.least(size, F.lit(5)), F.floor(size * (F.lit(400) + h(F.lit("e")) / 2) / 1000).cast("int")))
    kind = F.pmod(F.col("seed"), F.lit(3))
    return r.select("family", F.when(kind == 0, F.col("words")).when(kind == 1, gone).otherwise(part).alias("words")).where(F.size("words") >= 3)


def background(docs: DataFrame, documents: int, lines: int) -> DataFrame:
    """Lines of at most ``documents`` documents, those with the smallest hash of doc_id; at most ``lines``, those with the smallest
    hash, whatever the files' order. ``part`` deals them into four. Lines that hold most of a notice are no example of the unknown class and are left out."""
    d = docs.select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text")).where("text is not null")
    edge = d.select("h").orderBy("h").limit(documents).agg(F.max("h")).first()[0]
    sample = d.where(F.col("h") <= F.lit(edge if edge is not None else -(1 << 63))).orderBy("h", F.xxhash64("text")).limit(documents)
    each = sample.select("h", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("g", F.xxhash64("line", "h", "pos"))
    w = each.orderBy("g", "line").limit(lines).select(F.pmod(F.xxhash64("line"), F.lit(4)).alias("part"), words_of(F.col("line")).alias("words"))
    like = F.lit(False)
    for family, text in NOTICES:
        if family != UNKNOWN:
            t = F.array_distinct(words_of(F.lit(text)))
            like = like | (F.size(F.array_intersect("words", t)) >= 0.7 * F.size(t))
    return w.where(~like & (F.size("words") > 0)).select(F.lit(UNKNOWN).alias("family"), "words", "part")


def _log_loss(t: float) -> Column:
    """Mean log loss of the scores ``z`` divided by ``t``."""
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - top) / t))
    return F.avg(F.log(total) - (F.get("z", F.col("label").cast("int")) - top) / t)


def train(docs: DataFrame, documents: int = 400, lines: int = 4000, variants: int = 60) -> Model:
    """The classifier, from ``variants`` variants of every notice and a sample of ``lines`` lines of ``docs`` at most (both bounds on the
    labelled rows, whatever the corpus). The temperature is fitted on further variants and on a quarter of the lines, which the regression does
    not see (equal lines are in the same quarter). An empty corpus leaves the notices alone as examples."""
    spark = docs.sparkSession
    own = notices(spark)
    vocabulary = sorted(r["g"] for r in own.where(F.col("family") != UNKNOWN).select(F.explode(grams_of(F.col("words"))).alias("g")).distinct().collect())
    families = sorted({f for f, _ in NOTICES})
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    ready = lambda d: d.select(label.alias("label"), grams_of(F.col("words")).alias("grams"))
    count = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    rest = background(docs, documents, lines).cache()
    fit = count.transform(ready(_variants(own, 0, variants).unionByName(rest.where("part < 3").drop("part")))).coalesce(1).cache()   # a few thousand short rows
    lr = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, standardization=False, maxIter=60).fit(fit)
    fresh = lr.transform(count.transform(ready(_variants(own, variants, variants // 3).unionByName(rest.where("part = 3").drop("part"))))).select("label", vector_to_array("rawPrediction").alias("z"))
    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4]
    loss = fresh.coalesce(1).agg(*[_log_loss(t) for t in grid]).first()
    own_words = [g for g in vocabulary if " " not in g]
    common = {r["w"]: r["n"] for r in rest.select(F.explode(F.array_distinct("words")).alias("w")).where(F.col("w").isin(own_words))
              .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}        # at most the words of the notices
    fit.unpersist()
    rest.unpersist()
    m = lr.coefficientMatrix.toArray()
    unknown = families.index(UNKNOWN)
    weights = {g: [float(x) for x in m[:, k]] for k, g in enumerate(vocabulary) if abs(m[:, k]).max() > 1e-6}
    # the most that each word can speak for each family, against unknown: its own gain and those of the pairs in which it is the
    # rarer word; a span cannot hold a pair without it, so these sums bound every span's score
    most: dict[str, list[float]] = {}
    for g, x in weights.items():
        gain = [max(w - x[unknown], 0.0) for w in x]
        if max(gain) > 0:
            word = min(reversed(g.split(" ")), key=lambda w: common.get(w, 0))
            most[word] = [a + b for a, b in zip(most.get(word, [0.0] * len(gain)), gain)]
    bits = [0] * (SLOTS // 64)
    if most:
        for r in spark.createDataFrame([(w,) for w in sorted(most)], "w string").select(_slot(F.col("w")).alias("s")).collect():
            bits[r["s"] >> 6] |= 1 << (r["s"] & 63)
    gate = [b - (1 << 64) if b >= 1 << 63 else b for b in bits]
    bias = [float(x) for x in lr.interceptVector]
    needed = [bias[unknown] - b if k != unknown else float("inf") for k, b in enumerate(bias)]
    return Model(families, weights, bias, grid[min(range(len(grid)), key=lambda k: loss[k])], gate, most, needed)


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def scan(docs: DataFrame, model: Model, probability: float = 0.5, similarity: float = 0.5) -> DataFrame:
    """One row per licence notice found in ``docs`` (doc_id, text): doc_id, paragraph (number of its first line, from 0), start and length in
    code points, family, probability (of the family), predicted, similarity (to the nearest template of the predicted family) and template.

    A notice is one line or several neighbouring ones of a paragraph, which ends at a blank line. Of the spans whose most probable class is a family
    with at least ``probability``, those most like a template are taken, the best first, as far as they do not overlap; spans of the same family
    that follow each other without a line between are one notice. Where no template of that family is as similar as ``similarity``, family is ``unknown`` and
    predicted tells what the classifier said. A span's lines between its first and last hold at most ``SPAN_CHARS`` characters, more than any template.
    Words are runs of a-z and 0-9 after lower-casing; all other characters, letters of other scripts among them, only separate words. Long texts are cut
    into blocks of ``BLOCK`` lines with the lines ahead that a span may reach, so time grows with a text's notices. Null and empty texts give no row; repeated rows give their findings each; an empty table gives an empty result; other columns are not read.
    """
    bits = F.array(*[F.lit(b) for b in model.gate])
    licence_word = lambda w: F.get(bits, F.shiftright(_slot(w), 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), _slot(w).bitwiseAND(F.lit(63)))) != 0
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / BLOCK).cast("int")), lambda j: F.struct(
        (j * BLOCK).alias("base"), F.least(F.size("lines") - j * BLOCK, F.lit(BLOCK)).alias("own"), F.slice("lines", j * BLOCK + 1, BLOCK + SPAN_LINES).alias("lines")))
    chars = F.transform("blocks", lambda b: F.when(F.size("blocks") > 1, F.aggregate(F.slice(b["lines"], 1, BLOCK), F.lit(0), lambda s, x: s + F.length(x) + 1)).otherwise(0))
    # the outer form: for the other one Spark would put a filter on the array below, and compute it again for every reference
    blocks = (rows.select("doc_id", "row", cut.alias("blocks")).select("doc_id", "row", "blocks", chars.alias("chars"))
              .select("doc_id", "row", F.explode_outer(F.transform("blocks", lambda b, j: F.struct(
                  b["base"].alias("base"), b["own"].alias("size"), b["lines"].alias("lines"), F.aggregate(F.slice("chars", F.lit(1), j), F.lit(0), lambda s, x: s + x).alias("before")))).alias("b"))
              .select("doc_id", "row", "b.*"))
    numbers = F.from_json(F.lit(json.dumps({w: k for k, w in enumerate(model.most)})), "map<string,int>")       # a word is looked up once
    gains = F.from_json(F.lit(json.dumps([max(g) for g in model.most.values()])), "array<double>")
    by_family = F.from_json(F.lit(json.dumps(list(model.most.values()))), "array<array<double>>")
    zeros = F.array(*[F.lit(0.0) for _ in model.bias])
    least = min(model.needed) - 1e-9
    needed = F.array(*[F.lit(min(x, 1e9) - 1e-9) for x in model.needed])

    reach = lambda words: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.get(gains, w))

    def passes(words: Column) -> Column:
        """Whether distinct words can make a family more probable than unknown."""
        sums = F.aggregate(words, zeros, lambda s, w: F.zip_with(s, F.get(by_family, w), lambda a, b: a + b))
        return F.when(reach(words) >= least, F.exists(F.zip_with(sums, needed, lambda a, b: a >= b), lambda x: x)).otherwise(False)

    place = ["doc_id", "row", "base", "size", "before"]
    each = blocks.select(*place, "lines", F.transform("lines", lambda l: F.struct(
        F.filter(F.transform(F.array_distinct(F.filter(F.split(F.lower(l), "[^a-z0-9]+"), licence_word)), lambda w: F.try_element_at(numbers, w)), lambda w: w.isNotNull()).alias("words"), F.length(F.btrim(l, F.lit(" \t\r\x0b\x0c"))).alias("size"))).alias("each"))
    each = each.select(*place, "lines", F.col("each.words").alias("words"), F.transform("each", lambda e: F.struct(
        reach(e["words"]).alias("reach"), e["size"].alias("size"))).alias("each"))
    # the longest span from a line: what its lines reach together bounds every shorter one
    ahead = lambda i: F.aggregate(
        F.slice("each", i + 1, SPAN_LINES), F.struct(F.lit(0.0).alias("reach"), F.lit(0).alias("inner"), F.lit(0).alias("lines"), F.lit(True).alias("open")),
        lambda s, x: F.when(s["open"] & (x["size"] > 0) & (s["inner"] <= SPAN_CHARS), F.struct(
            (s["reach"] + x["reach"]).alias("reach"), (s["inner"] + F.when(s["lines"] > 0, x["size"]).otherwise(0)).alias("inner"), (s["lines"] + 1).alias("lines"), F.lit(True).alias("open")))
        .otherwise(F.struct(s["reach"].alias("reach"), s["inner"].alias("inner"), s["lines"].alias("lines"), F.lit(False).alias("open"))))
    together = lambda words, first, many: F.array_distinct(F.flatten(F.slice(words, first, many)))
    hits = each.select(*place, "lines", "words", F.filter(
        F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(i.alias("i"), ahead(i).alias("a"))),
        lambda h: F.when((h["a"]["lines"] > 0) & (h["a"]["reach"] >= least), passes(together("words", h["i"] + 1, h["a"]["lines"]))).otherwise(False)).alias("hits"))
    block = hits.select("doc_id", "row", F.explode_outer(F.transform("hits", lambda h: F.struct(
        (F.col("base") + h["i"]).alias("first"), F.slice("lines", h["i"] + 1, h["a"]["lines"]).alias("block"), F.slice("words", h["i"] + 1, h["a"]["lines"]).alias("own"),
        (F.col("before") + F.aggregate(F.slice("lines", 1, h["i"]), F.lit(0), lambda s, x: s + F.length(x) + 1)).alias("start")))).alias("h")).where("h is not null").select("doc_id", "row", "h.*")
    block = block.repartition("row", "first")         # the few lines with a hit: those of one text are spread over tasks
    spans = F.filter(F.sequence(F.lit(1), F.size("block")), lambda k: passes(together("own", F.lit(1), k)))
    span = (block.select("doc_id", "row", "first", "start", "block", F.explode_outer(spans).alias("many")).where("many is not null")
            .withColumn("span", F.array_join(F.slice(F.col("block"), F.lit(1), F.col("many")), "\n"))
            .select("doc_id", "row", "first", "start", (F.col("first") + F.col("many") - 1).alias("last"), F.length("span").alias("length"), words_of(F.col("span")).alias("words")))
    known = sorted({g for f, text in NOTICES if f != UNKNOWN for g in notice_grams(text)})
    table = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")      # folded to one constant
    scored = span.withColumn("grams", grams_of(F.col("words")))                        # for the few spans that are left
    scored = scored.select("doc_id", "row", "first", "last", "start", "length", F.size("words").alias("n_words"), F.size("grams").alias("n_grams"),
                           F.array_intersect("grams", F.split(F.lit("|".join(known)), "[|]")).alias("grams"))
    scored = scored.withColumn("z", F.aggregate("grams", F.array(*[F.lit(b) for b in model.bias]), lambda z, g: F.zip_with(z, F.coalesce(F.try_element_at(table, g), zeros), lambda a, b: a + b)))
    scored = stored(scored, "licence-spans")           # few spans; what follows refers to these columns many times
    scored = scored.withColumn("z", F.transform("z", lambda x: x / model.temperature)).withColumn("best", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    scored = (scored.withColumn("probability", 1 / total)
              .withColumn("predicted", F.get(F.array(*[F.lit(f) for f in model.families]), (F.array_position("z", F.col("best")) - 1).cast("int")))
              .where((F.col("predicted") != UNKNOWN) & (F.col("probability") >= probability)))
    likeness = []
    for k, (family, text) in enumerate(NOTICES):
        if family != UNKNOWN:
            t = F.split(F.lit("|".join(notice_grams(text))), "[|]")
            both = F.size(F.array_intersect("grams", t))
            held = F.greatest(both / F.size(t), F.when(F.col("n_words") >= 5, both / F.col("n_grams")).otherwise(0.0))
            likeness.append(F.when(F.col("predicted") == family, F.struct(held.alias("s"), (2 * both / (F.size(t) + F.col("n_grams"))).alias("alike"), F.lit(-k).alias("k"))))
    scored = scored.withColumn("near", F.greatest(*likeness))
    order = F.struct((-F.col("near.alike")).alias("unlike"), "n_words", (F.col("last") - F.col("first")).alias("further"), "first", "last", "start", (F.col("start") + F.col("length")).alias("end"),
                     "probability", "predicted", F.col("near.s").alias("similarity"), (-F.col("near.k")).alias("template"))
    # spans between which no other one reaches are chosen apart; what is taken is kept by stretches of SPAN_LINES lines, as a span meets only those of its own and the two beside it
    above = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    apart = scored.withColumn("alone", F.coalesce(F.col("first") > F.max("last").over(above), F.lit(True)).cast("int"))
    apart = apart.withColumn("cluster", F.sum("alone").over(Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    found = apart.groupBy("row", "doc_id", "cluster").agg(F.min("first").alias("top"), F.max("first").alias("low"), F.sort_array(F.collect_list(order)).alias("spans"))
    stretch = lambda x: F.floor((x["first"] - F.col("top")) / SPAN_LINES).cast("int")
    meets = lambda taken, x: F.coalesce(F.exists(taken, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"])), F.lit(False))
    free = lambda taken, x: ~(meets(F.get(taken, stretch(x)), x) | meets(F.get(taken, stretch(x) - 1), x) | meets(F.get(taken, stretch(x) + 1), x))
    none = F.transform(F.sequence(F.lit(0), F.floor((F.col("low") - F.col("top")) / SPAN_LINES).cast("int")), lambda _: F.filter("spans", lambda x: F.lit(False)))
    chosen = F.flatten(F.aggregate("spans", none, lambda taken, x: F.when(free(taken, x), F.transform(
        taken, lambda t, k: F.when(k == stretch(x), F.concat(t, F.array(x))).otherwise(t))).otherwise(taken)))
    chosen = found.select("row", "doc_id", F.explode_outer(chosen).alias("c")).where("c is not null").select("row", "doc_id", "c.*")
    line = Window.partitionBy("row").orderBy("first")
    follows = (F.lag("last").over(line) + 1 == F.col("first")) & (F.lag("predicted").over(line) == F.col("predicted"))
    notice = F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    best = F.max(F.struct("similarity", "probability", (-F.col("template")).alias("k"))).alias("best")
    return (chosen.withColumn("notice", notice).groupBy("row", "doc_id", "notice", "predicted").agg(F.min("first").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"), best)
            .select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("length"),
                    F.when(F.col("best.similarity") >= similarity, F.col("predicted")).otherwise(UNKNOWN).alias("family"),
                    F.col("best.probability").alias("probability"), "predicted", F.col("best.similarity").alias("similarity"), (-F.col("best.k")).alias("template")))
