"""Licence scans: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance from the nearest directory with a licence file."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is written in headers and licence files, by licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
}
TERM_PATTERN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Tasks that rows of one text or directory are dealt over.
SALTS = 16
LICENCE_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z0-9]+)?$"


def terms_of(text: str) -> list[str]:
    return re.findall(TERM_PATTERN, text.lower())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """(documents, documents with each term of ``vocabulary``) over all of ``docs``: a row for each term comes to the driver."""
    wanted = F.array(*[F.lit(t) for t in vocabulary])
    counted = docs.select(F.explode(F.concat(F.array_intersect(terms(F.coalesce(F.col(text), F.lit(""))), wanted), F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    got = {r["term"]: r["count"] for r in counted}
    return got.pop("", 0), got


def anchors(weights: dict[str, float], least: float) -> set[str]:
    """The heaviest terms of a template (its weights have length one) without which no text reaches the cosine ``least``: the other terms together are too light."""
    rest, out = 1.0, set()
    for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if rest < (least - 1e-9) ** 2:
            break
        out.add(t)
        rest -= w * w
    return out


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None, header_least: float = 0.7, file_least: float = 0.8) -> DataFrame:
    """``files`` without their text, with ``license``, ``license_via`` (header, file or inherited) and ``license_score`` (cosine, six decimals); nulls where none was found.

    Weights are tf * (ln((1 + N) / (1 + df)) + 1), with N and df over all files; a term that no template has counts as unseen (df 0).
    Every line of a text is a possible header, and so is every passage of as many terms as a template has, wherever lines break. A file
    is a licence file if its whole text's cosine reaches ``file_least``, or if it has a licence file's name and its text, a line or a passage
    reaches ``header_least``. A file's own header or text comes before what its directory gives; of several directories with a
    licence file the nearest counts, of several such files in one the best. Null or empty texts have no licence of their own; a null path
    has no directory; rows that repeat are judged alike; an empty table gives no rows; columns of the names that are added are replaced.

    Only texts with one of the templates' anchor terms can reach the thresholds (see ``anchors``), so only those are scored, and each
    different text and line once. Directories are joined as distinct values with their ancestors; tables that grow are joined by key.
    """
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    named = [(f"{k}#{i}", k, Counter(terms_of(t))) for k, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    vocabulary = sorted({t for _, _, c in named for t in c})
    n, df = document_frequencies(files, vocabulary, text)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log(1 + n) + 1
    weights, wanted = [], set()
    for key, name, count in named:
        raw = {t: c * idf[t] for t, c in count.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        unit = {t: x / length for t, x in raw.items()}
        wanted |= anchors(unit, min(header_least, file_least))
        weights += [(t, key, name, w) for t, w in unit.items()]
    # fixed by the templates, whatever the files
    weight_table = spark.createDataFrame(weights or [("", "", "", 0.0)], "term string, template string, name string, weight double").where("template <> ''")
    idf_table = spark.createDataFrame(list(idf.items()) or [("", 0.0)], "term string, idf double")
    anchor = F.lit(r"(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(wanted)) + r")(?![a-z0-9])") if wanted else None

    rest = [c for c in files.columns if c not in (text, "license", "license_via", "license_score")]
    keyed = files.select(*rest, F.col(text).alias("__text")).withColumn("__key", F.md5(F.coalesce("__text", F.lit(""))))
    possible = keyed.where(F.rlike(F.lower("__text"), anchor)) if anchor is not None else keyed.where("false")
    texts = possible.select("__key", "__text").groupBy("__key").agg(F.first("__text").alias("__text"))
    units = texts.select("__key", F.explode(F.concat(F.transform(F.split("__text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))), F.array(F.struct(F.lit(True).alias("whole"), F.col("__text").alias("unit"))))).alias("u"))
    units = units.select("__key", "u.whole", "u.unit").where(F.rlike(F.lower("unit"), anchor)) if anchor is not None else units.select("__key", "u.whole", "u.unit")
    units = units.withColumn("__unit", F.md5("unit"))
    counts = units.select("__unit", "unit").groupBy("__unit").agg(F.first("unit").alias("unit")).select("__unit", F.explode(terms(F.col("unit"))).alias("term")).groupBy("__unit", "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(F.broadcast(idf_table), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    lengths = weighed.groupBy("__unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.join(F.broadcast(weight_table), "term").groupBy("__unit", "template", "name").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = dots.join(lengths, "__unit").withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).groupBy("__unit").agg(F.max(F.struct("score", "name")).alias("best"))
    scored = units.select("__key", "whole", "__unit").distinct().join(best, "__unit")
    # a passage's dot product is a difference of running sums; so is a lower bound of its length, exact but for repeated terms
    frames = [(key, name, sum(c.values()), {t: w for t, k, _, w in weights if k == key}) for key, name, c in named if c]
    by_term = [(t, idf[t], *(f[3].get(t, 0.0) * idf[t] for f in frames)) for t in vocabulary]
    columns = [f"__c{i}" for i in range(len(frames))]
    table = spark.createDataFrame(by_term or [("", 0.0)], "term string, idf double" + "".join(f", {c} double" for c in columns))
    at = Window.partitionBy("__key").orderBy("pos")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    running = texts.select("__key", F.posexplode(terms(F.col("__text"))).alias("pos", "term")).join(F.broadcast(table), "term", "left")
    running = running.withColumns({"__sq": F.pow(F.coalesce("idf", F.lit(unseen)), F.lit(2)), **{c: F.coalesce(c, F.lit(0.0)) for c in columns}})
    running = running.select("__key", "pos", "__sq", *columns, F.sum("__sq").over(upto).alias("__sqs"), *[F.sum(c).over(upto).alias(f"{c}s") for c in columns])
    span = lambda c, n: F.lead(f"{c}s", n - 1).over(at) - F.col(f"{c}s") + F.col(c)
    bounds = [F.struct(F.lit(key).alias("template"), F.lit(name).alias("name"), F.lit(n).alias("size"), span(c, n).alias("dot"), span("__sq", n).alias("square")) for c, (key, name, n, _) in zip(columns, frames)]
    hits = running.select("__key", "pos", F.array(*bounds).alias("b")) if bounds else running.select("__key", "pos").where("false").withColumn("b", F.lit(None).cast("array<struct<template:string,name:string,size:int,dot:double,square:double>>"))
    hits = hits.select("__key", "pos", F.explode("b").alias("b")).select("__key", "pos", "b.*").where(F.col("dot") >= (header_least - 1e-6) * F.sqrt("square"))
    words = hits.join(texts.select("__key", terms(F.col("__text")).alias("__terms")), "__key").select("__key", "pos", "template", "name", "dot", F.explode(F.slice("__terms", F.col("pos") + 1, F.col("size"))).alias("term"))
    words = words.groupBy("__key", "pos", "template", "name", "dot", "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf_table), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    passages = words.groupBy("__key", "pos", "template", "name", "dot").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    passages = passages.select("__key", F.lit(False).alias("whole"), F.struct(F.round(F.col("dot") / F.col("length"), 6).alias("score"), "name").alias("best"))
    of_text = scored.select("__key", "whole", "best").unionByName(passages).groupBy("__key").agg(F.max(F.when(~F.col("whole"), F.col("best"))).alias("__line"), F.max(F.when(F.col("whole"), F.col("best"))).alias("__whole"))

    # rows of one text, or of one directory, may be any share of the table: they are dealt over SALTS tasks, and the few rows they meet repeated
    place = F.coalesce(F.col(path), F.lit(""))
    placed = keyed.withColumns({"__dir": F.regexp_extract(place, "^(.*)/[^/]*$", 1), "__named": place.rlike(LICENCE_FILE_NAME), "__salt": F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int")}).drop("__text")
    salted = lambda df: df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = placed.join(salted(of_text), ["__key", "__salt"], "left").drop("__key")
    best_of = F.greatest("__whole", "__line")
    as_file = F.when(F.col("__named") & (best_of["score"] >= header_least), best_of).when(F.col("__whole.score") >= file_least, F.col("__whole"))
    own = own.withColumns({"__file": as_file, "__header": F.when(F.col("__line.score") >= header_least, F.col("__line"))}).drop("__line", "__whole", "__named")
    given = own.where("__file is not null and __dir <> ''").groupBy("__dir").agg(F.max("__file").alias("__given"))
    steps = F.split("__dir", "/")
    up = own.select("__dir").where("__dir <> ''").distinct().select("__dir", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("__depth")).withColumn("__up", F.array_join(F.slice(steps, F.lit(1), F.col("__depth")), "/"))
    inherited = up.join(given.withColumnRenamed("__dir", "__up"), "__up").groupBy("__dir").agg(F.max_by("__given", "__depth").alias("__inherited"))
    out = own.join(salted(inherited), ["__dir", "__salt"], "left")
    pick = F.coalesce("__file", "__header", "__inherited")
    via = F.when(F.col("__file").isNotNull(), "file").when(F.col("__header").isNotNull(), "header").when(F.col("__inherited").isNotNull(), "inherited")
    return out.select(*rest, pick["name"].alias("license"), via.alias("license_via"), pick["score"].alias("license_score"))
