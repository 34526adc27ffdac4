"""Licence notices: a trained paragraph classifier with an unknown class and template comparison.

The units that are judged are the lines with an informative word, for notices of one line, and
paragraphs: windows of up to ``window`` lines, up to the next line without letters, which begin
where informative lines begin and every half window after that, so a notice wrapped over half a
window lies in one of them. Informative are all words of ``NOTICES`` but the function words of
``FUNCTION_WORDS``; the list does not depend on the corpus, so no text is left out because its
words are common there. Features are the words and word pairs of the notices that hold an
informative word. A multinomial logistic regression with an elastic-net penalty (Spark's own)
gives each family sparse weights. It is trained on the notices, on shortened and thinned-out
versions of them, and as class ``unknown`` on half of all different lines of the corpus with at most
one pair of a notice. Lines with the same features are one weighted row. The probability of a licence
from which a unit is believed to hold one is calibrated on all such lines of the other half. It is
then compared with the templates: of the families of which it holds enough of a notice, the most
probable one is confirmed; without any it is ``unknown``.

Scoring is joins and sums; the weights and templates (bounded by the notices) are broadcast.
A notice is reported once: a paragraph only if none of its lines and no paragraph that overlaps it
from before has its family, and unknown units only outside all confirmed ones.

Defined results: null and empty texts hold no licence; repeated rows are searched each; an empty
table gives no rows; of templates with the same coverage the last by name is given, of families
with the same probability the last; a corpus of licences alone is calibrated by
``least_probability``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.session import cut

# Short forms of published licence notices, by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GPL version 2 or later.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal, no rights reserved.",
        "This work has been dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this publication may be reproduced without permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
# Sentences with words of notices that grant nothing.
OTHERS = (
    "The licence to drive was renewed at the office in version two of the form.",
    "The general public may visit the work of art with permission of the holder.",
    "A copy of the software manual is on the shelf; the program was published later.",
    "The foundation reserved the hall and released the names under conditions.",
    "Commercial use of the file system is described in the international source.",
)
# Words of the notices that tell nothing about licences.
FUNCTION_WORDS = frozenset(
    "a above all along an and any are as be been by can except following for has have if in into is it its later may modify name names neither no nor not "
    "obtaining of on or part person should shall the this to under unless use used version with without work you".split()
)
UNKNOWN = "unknown"


@dataclass(frozen=True)
class LicenceParams:
    line_weight: float = 0.05  # of a line of class unknown in training
    most_weight: float = 100.0  # of all of them together; more lines weigh less each
    rows_per_task: int = 50_000  # of the training rows
    window: int = 12  # lines of a paragraph at most
    false_alarms: float = 0.0005  # of other lines, at the calibrated probability
    plain_pairs: int = 1  # pairs of a notice that a line of class unknown may hold
    least_probability: float = 0.5
    coverage: float = 0.6  # share of a notice's features that confirms it
    regularisation: float = 1e-4
    mixing: float = 0.2  # of the absolute penalty
    iterations: int = 80


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not once for each element that looks at it."""
    return F.get(F.transform(F.array(value), use), 0)


def _ngrams(words: Column) -> Column:
    def grams(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.array_distinct(F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w))

    return _bound(words, grams)


def _split(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _thinned(family: str, notice: str) -> list[str]:
    """The notice, its parts, and the notice without every k-th word.

    Words that no other family uses are never left out: without them the text would be another's.
    """
    others = {w for f, texts in NOTICES.items() if f != family for t in texts for w in _split(t)}
    own = lambda w: bool(set(_split(w)) - others)
    words = notice.split()
    half = len(words) // 2
    out = [words]
    if len(words) > 7:
        parts = [words[:half], words[half:], words[2:-2]]
        out += [p for p in parts if any(map(own, p)) or not any(map(own, words))]
    if len(words) > 4:
        out += [[w for i, w in enumerate(words) if own(w) or i % k != k - 1] for k in (3, 4, 5, 7)]
    return [" ".join(w) for w in out]


def _notices(spark: SparkSession) -> DataFrame:
    rows = [(f"{family}:{k}", family, text) for family, texts in NOTICES.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "template string, family string, line string")


INFORMATIVE = tuple(sorted({w for texts in NOTICES.values() for t in texts for w in _split(t)} - FUNCTION_WORDS - {str(n) for n in range(10)} - set("abcdefghijklmnopqrstuvwxyz")))


def _any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, common beginnings once."""
    rests: dict[str, list[str]] = {}
    for w in words:
        rests.setdefault(w[:1], []).append(w[1:])
    branches = [c + _any_of(tuple(r)) for c, r in sorted(rests.items()) if c]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)})" + ("?" if "" in rests else "")


def _notice_pairs() -> tuple[str, ...]:
    """The pairs of neighbouring words of the notices that hold an informative word."""
    words = [_split(t) for texts in NOTICES.values() for t in texts]
    return tuple(sorted({f"{a} {b}" for w in words for a, b in zip(w, w[1:]) if {a, b} & set(INFORMATIVE)}))


_GAP = "[^a-z0-9]++"
_NOTED = f"(?<![a-z0-9]){_any_of(INFORMATIVE)}(?![a-z0-9])"
# at the beginning of a word: a pair of the notices, else an informative word; pairs overlap
_SHARED = f"(?<![a-z0-9])(?=((?:{_any_of(_notice_pairs()).replace(' ', _GAP)}|{_any_of(INFORMATIVE)})(?![a-z0-9])))"


def _informative(line: Column) -> Column:
    return F.lower(line).rlike(_NOTED)


def _noted_ngrams(line: Column) -> Column:
    """Of :func:`_ngrams`, all that notices hold and that have an informative word; the first words of the pairs too."""
    found = F.regexp_extract_all(F.lower(line), F.lit(_SHARED), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(found, lambda x: _bound(F.regexp_replace(x, _GAP, " "), lambda n: F.array(n, F.substring_index(n, " ", 1))))))


def units_of(docs: DataFrame, params: LicenceParams) -> DataFrame:
    """(row, doc_id, text_hash, pos, wide, line): informative lines and the paragraphs that begin at them, by row of ``docs``."""

    def windows(lines: Column) -> Column:
        def noted(seen: Column) -> Column:
            def unit(i: Column) -> Column:
                begins = ~F.coalesce(F.get(seen, i - 1), F.lit(False)) | (i % (params.window // 2) == 0)
                body = F.concat_ws("\n", *[F.get(lines, i + k) for k in range(params.window)])
                return F.struct(i.alias("pos"), F.get(lines, i).alias("line"), F.when(begins, body).alias("body"))

            places = F.sequence(F.lit(0), F.size(lines) - 1)
            return F.transform(F.filter(places, lambda i: F.get(seen, i)), unit)

        return _bound(F.transform(lines, _informative), noted)  # a slice would copy all lines for each line

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.select("row", "doc_id", "text_hash", F.explode_outer(_bound(F.split("text", "\n"), windows)).alias("u"))
    rows = rows.filter(F.col("u").isNotNull()).select("row", "doc_id", "text_hash", "u.*")
    rows = rows.withColumn("body", F.get(F.split("body", "\n[^A-Za-z0-9\n]*(?=\n)", 2), 0))
    line = F.struct(F.lit(False).alias("wide"), "line")
    wide = F.when(F.contains("body", F.lit("\n")), F.struct(F.lit(True).alias("wide"), F.col("body").alias("line")))
    rows = rows.select("row", "doc_id", "text_hash", "pos", F.explode(F.array(line, wide)).alias("u")).filter(F.col("u").isNotNull())
    return rows.select("row", "doc_id", "text_hash", "pos", "u.wide", "u.line")


@dataclass(frozen=True)
class LicenceModel:
    weights: DataFrame  # feature, w: one weight per class
    bias: tuple[float, ...]
    classes: tuple[str, ...]
    threshold: float
    templates: DataFrame  # template, family, size, feature


def _features(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature): the n-grams of the units that notices may share."""
    # explode would compute the n-grams once more to leave out empty lists
    return units.select(*keys, F.explode_outer(_noted_ngrams(F.col("line"))).alias("feature")).filter(F.col("feature").isNotNull())


def _probabilities(sums: Column, bias: tuple[float, ...], use: Callable[[Column], Column]) -> Column:
    """``use`` of the class probabilities for the summed weights of a unit."""
    powers = lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    shares = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    logits = F.zip_with(sums, F.array(*[F.lit(b) for b in bias]), lambda x, b: x + b)
    return _bound(logits, lambda z: _bound(powers(z), lambda e: _bound(shares(e), use)))


def _weight_sums(classes: int) -> Column:
    return F.array(*[F.sum(F.get("w", k)) for k in range(classes)])


def _nth_largest(values: DataFrame, n: int, bins: int = 1024) -> float:
    """The ``n``-th largest value (from 0) of rows (value, count), by ever finer bins; 0.0 where there are fewer."""
    low, high = 0.0, 1.0
    while True:
        place = F.least(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(bins - 1))
        found = values.filter(F.col("value").between(low, high)).groupBy(place.alias("bin")).agg(
            F.sum("count").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        for row in sorted(found.collect(), key=lambda r: -r.bin):
            if n < row.total:
                break
            n -= row.total
        else:
            return 0.0
        if row.low == row.high:
            return row.low
        low, high = row.low, row.high


def other_lines(docs: DataFrame, templates: DataFrame, params: LicenceParams) -> tuple[DataFrame, list[int]]:
    """All different lines with at most ``plain_pairs`` pairs of a notice, in two halves by hash.

    Returns (half, features, count), lines with the same features together and those without any left
    out, and the number of all lines of each half. Only hashes and features of notices are shuffled.
    """
    half = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(2)).alias("half")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length(F.trim("line")) > 0)
    lines = lines.select("line", F.xxhash64("line").alias("h"))
    sizes = {r.half: r["count"] for r in lines.select("h").distinct().groupBy(half).count().collect()}
    hits = _features(lines.filter(_informative(F.col("line"))), ["h"]).join(F.broadcast(templates.select("feature").distinct()), "feature")
    sets = hits.groupBy("h").agg(F.sort_array(F.collect_set("feature")).alias("features"))
    noted = F.size(F.filter("features", lambda f: F.contains(f, F.lit(" ")))) > params.plain_pairs
    grouped = cut(sets.groupBy(half, noted.alias("noted"), F.when(~noted, F.col("features")).alias("features")).agg(F.count("*").alias("count")))
    for r in grouped.filter("noted").collect():
        sizes[r.half] -= r["count"]
    return grouped.filter("NOT noted").select("half", "features", "count"), [sizes.get(k, 0) for k in range(2)]


def learn(docs: DataFrame, params: LicenceParams = LicenceParams()) -> LicenceModel:
    """Fit the classifier on half of the corpus's different lines and calibrate it on the other half."""
    spark = docs.sparkSession
    notices = _notices(spark)
    templates = cut(
        notices.withColumn("features", _ngrams(_tokens(F.col("line")))).select("template", "family", F.explode("features").alias("feature"))
        .filter(F.arrays_overlap(F.split("feature", " "), F.array(*[F.lit(w) for w in INFORMATIVE])))
    )
    vocabulary = sorted(r.feature for r in templates.select("feature").distinct().collect())
    classes = (UNKNOWN, *NOTICES)
    known = [(classes.index(f), v, 1.0 / len(NOTICES[f])) for f, texts in NOTICES.items() for t in texts for v in _thinned(f, t)]
    other = [(0, t, 1.0) for t in OTHERS]
    sized = templates.join(F.broadcast(templates.groupBy("template").agg(F.count("*").alias("size"))), "template")
    plain, (n_fit, n_check) = other_lines(docs, templates, params)
    fit, check = plain.filter("half = 0"), plain.filter("half = 1")
    each = min(params.line_weight, params.most_weight / max(1, n_fit))
    shown, total = fit.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    rows = spark.createDataFrame([*known, *other], "label int, line string, weight double").select("label", "weight", _ngrams(_tokens(F.col("line"))).alias("features"))
    rows = rows.unionByName(fit.select(F.lit(0).alias("label"), (F.col("count") * each).alias("weight"), "features"))
    if n_fit > total:
        bare = spark.createDataFrame([(0, (n_fit - total) * each, [])], "label int, weight double, features array<string>")
        rows = rows.unionByName(bare)
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="features", outputCol="x")
    vectors.setBinary(True)
    train = vectors.transform(rows).select(F.col("label").cast("double"), "weight", "x").coalesce(1 + shown // params.rows_per_task).cache()
    fitted = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", standardization=False,
        regParam=params.regularisation, elasticNetParam=params.mixing, maxIter=params.iterations,
    ).fit(train)
    train.unpersist()
    matrix, bias = fitted.coefficientMatrix.toArray(), tuple(float(b) for b in fitted.interceptVector.toArray())
    table = [(f, [float(v) for v in matrix[:, k]]) for k, f in enumerate(vocabulary) if matrix[:, k].any()]
    weights = cut(spark.createDataFrame(table, "feature string, w array<double>"))
    summed = (
        check.select("features", "count", F.explode("features").alias("feature")).join(F.broadcast(weights), "feature")
        .groupBy("features", "count").agg(_weight_sums(len(bias)).alias("sums"))
    )
    tops = cut(summed.select(_probabilities(F.col("sums"), bias, lambda p: 1 - F.get(p, 0)).alias("value"), "count").groupBy("value").agg(F.sum("count").alias("count")))
    threshold = max(params.least_probability, _nth_largest(tops, int(params.false_alarms * n_check)))
    return LicenceModel(weights, bias, classes, threshold, cut(sized))


def judged(units: DataFrame, model: LicenceModel, params: LicenceParams = LicenceParams()) -> DataFrame:
    """doc_id, text_hash, pos, wide, family, probability, template, coverage of the units that hold a licence.

    ``family`` is ``unknown`` where no notice is covered; ``probability`` is that of any licence. The
    features of a unit meet weights and templates in one broadcast join, and one row per unit is
    shuffled: the sums of the weights and, in a byte each, the number of features of each template.
    """
    keys = ["doc_id", "text_hash", "pos", "wide"]
    rows = model.templates.collect()
    notices = sorted({(r.template, r.family, r.size) for r in rows})
    place = {template: divmod(k, 7) for k, (template, _, _) in enumerate(notices)}
    words = -(-len(notices) // 7)
    packed = {r.feature: [0] * words for r in rows}
    for r in rows:
        packed[r.feature][place[r.template][0]] += 1 << 8 * place[r.template][1]
    weights = {r.feature: r.w for r in model.weights.collect()}
    known = units.sparkSession.createDataFrame([(f, weights.get(f), held) for f, held in packed.items()], "feature string, w array<double>, held array<bigint>")
    counts = [F.sum(F.get("held", k)) for k in range(words)]
    summed = _features(units, ["row", *keys]).join(F.broadcast(known), "feature").groupBy("row", *keys).agg(
        F.count("w").alias("weighted"), _weight_sums(len(model.bias)).alias("sums"), F.array(*counts).alias("held")
    )
    scored = summed.filter("weighted > 0").select(*keys, "held", _probabilities(F.col("sums"), model.bias, lambda p: p).alias("p"))
    believed = scored.filter(1 - F.get("p", 0) > model.threshold)
    covers = []
    for template, family, size in notices:
        word, byte = place[template]
        share = F.shiftrightunsigned(F.get("held", word), 8 * byte).bitwiseAND(255) / size
        row = F.struct(F.get("p", model.classes.index(family)).alias("p"), share.alias("coverage"), F.lit(family).alias("family"), F.lit(template).alias("template"))
        covers.append(F.when(share >= params.coverage, row))
    out = believed.select(*keys, (1 - F.get("p", 0)).alias("probability"), F.array_max(F.array(*covers)).alias("best")).dropDuplicates(keys)
    return out.select(*keys, F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"), "probability", "best.template", F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"))


def find_licences(docs: DataFrame, model: LicenceModel, params: LicenceParams = LicenceParams()) -> DataFrame:
    """doc_id, text_hash, found, probability of every text with a licence.

    ``found`` holds (pos, family, wide), by line: each notice once.
    """
    units = judged(units_of(docs, params), model, params)
    per_text = units.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("pos", "family", "wide"))).alias("u"), F.max("probability").alias("probability"))

    def known(u: Column) -> Column:
        """Confirmed lines, and confirmed paragraphs that none of these and none before repeats."""
        sure = F.filter(u, lambda x: x["family"] != UNKNOWN)
        inside = lambda x, y: (y["family"] == x["family"]) & F.when(y["wide"], (y["pos"] < x["pos"]) & (y["pos"] > x["pos"] - params.window)).otherwise((y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + params.window))
        return _bound(sure, lambda s: F.filter(s, lambda x: ~x["wide"] | ~F.exists(s, lambda y: inside(x, y))))

    def left(u: Column, sure: Column) -> Column:
        """Unknown units outside all confirmed ones."""
        meets = lambda x, y: (x["pos"] < y["pos"] + F.when(y["wide"], params.window).otherwise(1)) & (y["pos"] < x["pos"] + F.when(x["wide"], params.window).otherwise(1))
        return F.filter(u, lambda x: (x["family"] == UNKNOWN) & ~x["wide"] & ~F.exists(sure, lambda y: meets(x, y)))

    found = _bound(known(F.col("u")), lambda sure: F.sort_array(F.concat(sure, left(F.col("u"), sure))))
    return per_text.select("doc_id", "text_hash", found.alias("found"), "probability")


def scan(docs: DataFrame, params: LicenceParams = LicenceParams()) -> DataFrame:
    """doc_id, n_licences, licences (family:line, comma-joined) and probability of every row."""
    found = find_licences(docs, learn(docs, params), params)
    per_text = found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("found").alias("f"), "probability")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    out = rows.join(per_text, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash")), "left")
    names = F.transform("f", lambda x: F.concat_ws(":", x["family"], x["pos"].cast("string")))
    return out.select(
        "doc_id", F.coalesce(F.size(F.filter("f", lambda x: x["family"] != UNKNOWN)), F.lit(0)).cast("bigint").alias("n_licences"),
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("licences"), F.coalesce("probability", F.lit(0.0)).alias("probability"),
    )
