"""License scans (operator 2), in DataFrame functions only.

Lines with a licence cue, anywhere in a text, are compared with templates by the cosine of their sparse TF-IDF vectors;
document frequencies are counted over all texts. The best line names a file's own licence. A file without one inherits
from the licence file in the nearest directory at or above its own, found by joining directory paths.

``whole_licences`` compares all of a text instead, without cues: windows over its words, each as long as a template, with
full licence texts, standard headers, one-sentence notices and SPDX tags.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii

# What common licences call themselves in a header.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0",
    "Proprietary": "All rights reserved",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
CUE = r"(?i)licen[cs]|rights reserved|public domain|copyright|redistribution"
#: A line below this cosine is no licence.
LEAST = 0.5
#: Names of licence files, which a whole directory inherits.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"


def terms(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda x: x != "")


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, term, tf), a row for each word of each template."""
    values = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    one = spark.range(1).select(F.explode(values).alias("template", "text"))
    return one.select("template", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))


def own_licences(rows: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(row, licence, score) for each row of ``rows`` (row, text) with a line that is near enough to a template.

    idf = 1 + ln((1 + texts) / (1 + texts that hold the term)); a term that no template has weighs as one that no text
    holds. Scores are rounded to nine places; equal ones go to the first name. The templates and their terms are broadcast: their number is fixed.
    """
    spark = rows.sparkSession
    vocabulary = sorted({t for text in templates.values() for t in "".join(c if c.isalnum() else " " for c in text.lower()).split()})
    held = F.array_intersect(terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    texts = rows.count()
    df = rows.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = lambda n: 1 + F.log((1 + F.lit(float(texts))) / (1 + n))
    weight = _templates(spark, templates).join(F.broadcast(df), "term", "left").withColumn("idf", idf(F.coalesce("df", F.lit(0)))).withColumn("w", F.col("tf") * F.col("idf"))
    norm = weight.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weight = cut(weight.join(F.broadcast(norm), "template").select("template", F.col("term").alias("word"), "idf", (F.col("w") / F.col("norm")).alias("w")))
    # Copies of a text count their terms several times, all alike, which leaves cosines as they are.
    lines = rows.select("row", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))).alias("line", "words"))
    units = lines.select("row", "line", F.explode(terms(F.col("words"))).alias("term")).groupBy("row", "line", "term").agg(F.count("*").alias("tf"))
    units = units.join(F.broadcast(weight.groupBy("word").agg(F.max("idf").alias("idf"))), F.col("term") == F.col("word"), "left").select("row", "line", "term", (F.col("tf") * F.coalesce("idf", idf(F.lit(0)))).alias("u"))
    units = cut(units)
    length = units.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("length"))
    dots = units.join(F.broadcast(weight), F.col("term") == F.col("word")).groupBy("row", "line", "template").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    scored = dots.join(length, ["row", "line"]).select("row", "template", F.round(F.col("dot") / F.col("length"), 9).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("less"), "template")).alias("x"))
    return best.select("row", F.col("x.template").alias("licence"), (-F.col("x.less")).alias("score"))


#: Where whole texts are compared, a window below this cosine is no licence; a tag has to be there word for word.
LEAST_WINDOW, LEAST_TAG = 0.7, 0.999
#: What stands beside other licences as well, and names one only where nothing else does.
LAST = "Proprietary"
TAGS = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
Whole = list[tuple[str, str, float]]


def whole_templates() -> Whole:
    """(licence, text, least): full texts and standard headers in licence_texts, TEMPLATES, and SPDX tags."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
    out = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out.append((name.rsplit(".", 2)[0], f.read(), LEAST_WINDOW))
    out += [(k, v, LEAST_WINDOW) for k, v in TEMPLATES.items()]
    return out + [(k, f"SPDX-License-Identifier: {k}", LEAST_TAG) for k in TAGS]


def whole_licences(rows: DataFrame, templates: Whole | None = None) -> DataFrame:
    """(row, licence, score) for each row of ``rows`` (row, text) with a window that is near enough to a template.

    Windows have as many words as the template, start at every eighth of it and at the end of the text; a shorter text
    is one window. idf and rounding as in ``own_licences``. Windows without any of a template's heavy terms are ruled
    out first, which loses nothing: the rest of its terms, the frequent ones, have a norm below the least cosine. The
    highest score counts, then the longer template, then the first name; LAST comes after all others.
    """
    spark = rows.sparkSession
    templates = whole_templates() if templates is None else templates
    count = [Counter(re.findall("[a-z0-9]+", lower(text))) for _, text, _ in templates]
    vocabulary = sorted(set().union(*count))
    held = F.array_intersect(terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    # One row for each term of the templates at most.
    df = {r.term: r.df for r in rows.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    texts = rows.count()
    idf = {t: 1 + math.log((1 + texts) / (1 + df.get(t, 0))) for t in vocabulary}
    new = 1 + math.log(1 + texts)
    about, weights = [], []
    for i, ((licence, _, least), tf) in enumerate(zip(templates, count, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        w = {t: n * idf[t] / norm for t, n in tf.items()}
        heavy, rest = [], 1.0
        for t in sorted(w, key=lambda t: (df.get(t, 0), -w[t], t)):
            if rest < (least - 1e-6) ** 2:
                break
            heavy.append(t)
            rest -= w[t] ** 2
        about.append((i, licence, sum(tf.values()), least, heavy))
        weights += [(i, t, x) for t, x in w.items()]
    anywhere = sorted(set().union(*(a[4] for a in about)))
    about = spark.createDataFrame(about, "template int, licence string, size int, least double, heavy array<string>")
    weights = spark.createDataFrame(weights, "template int, term string, w double")
    idfs = spark.createDataFrame(list(idf.items()), "term string, idf double")

    found = rows.where(F.arrays_overlap(terms(F.col("text")), F.array(*map(F.lit, anywhere)))).dropDuplicates(["row"])
    found = cut(found.select("row", terms(F.col("text")).alias("words")))
    pairs = found.join(F.broadcast(about), F.arrays_overlap("words", "heavy"))
    end = F.greatest(F.size("words") - F.col("size"), F.lit(0))
    starts = F.array_union(F.sequence(F.lit(0), end, F.greatest(F.floor(F.col("size") / 8).cast("int"), F.lit(1))), F.array(end))
    windows = pairs.select("row", "template", "size", "heavy", "words", F.explode(starts).alias("at")).withColumn("words", F.slice("words", F.col("at") + 1, F.col("size"))).where(F.arrays_overlap("words", "heavy"))
    units = windows.select("row", "template", "at", F.explode("words").alias("term")).groupBy("row", "template", "at", "term").agg(F.count("*").alias("tf"))
    units = units.join(F.broadcast(idfs), "term", "left").join(F.broadcast(weights), ["template", "term"], "left")
    u = F.col("tf") * F.coalesce("idf", F.lit(new))
    cosine = F.coalesce(F.sum(u * F.col("w")), F.lit(0.0)) / F.sqrt(F.sum(u * u))
    scored = units.groupBy("row", "template", "at").agg(F.round(cosine, 9).alias("score")).join(F.broadcast(about.drop("heavy")), "template").where(F.col("score") >= F.col("least"))
    best = scored.groupBy("row").agg(F.min(F.struct((F.col("licence") == LAST).alias("last"), (-F.col("score")).alias("less"), (-F.col("size")).alias("shorter"), "licence")).alias("x"))
    return best.select("row", F.col("x.licence").alias("licence"), (-F.col("x.less")).alias("score"))


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, whole: bool = False) -> DataFrame:
    """One row per row of ``files`` (path, text; other columns are kept, but for text): own_licence, own_score,
    licence, licence_from (the directory that it comes from, '' the root; null for its own) and how: ``own``,
    ``inherited`` or ``none``.

    A null or empty text has no licence of its own; a null path inherits nothing. Of several licence files in one
    directory the best score counts, then the first name. Repeated paths are files of their own. Extra columns named
    like a result are replaced. ``whole``: whole texts are compared with ``whole_templates``, not lines with ``templates``.
    """
    drop = ["row", "own_licence", "own_score", "licence", "licence_from", "how", "directory"]
    rows = files.drop(*drop).withColumn("row", F.xxhash64("text"))  # equal texts have equal licences
    texts = rows.select("row", "text")
    own = (whole_licences(texts) if whole else own_licences(texts, templates, least)).select(F.col("row").alias("of"), F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    directory = F.regexp_replace(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), "/$", "")
    held = cut(rows.drop("text").withColumn("directory", directory).join(own, F.col("row") == F.col("of"), "left").drop("of"))

    name = F.regexp_extract("path", "([^/]*)$", 1)
    given = held.where(name.rlike(LICENCE_FILE) & F.col("own_licence").isNotNull()).groupBy(F.col("directory").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("less"), "own_licence")).alias("x"))
    given = given.select("above", F.col("x.own_licence").alias("given"))
    # Ancestors are taken once for each directory, not for each file, nearest last.
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    ancestors = F.when(F.col("directory") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))).otherwise(ancestors)
    directories = held.where("directory IS NOT NULL").select("directory").distinct()
    up = directories.select("directory", F.explode(ancestors).alias("a")).select("directory", "a.depth", "a.above")
    nearest = up.join(given, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "given")).alias("x"))
    nearest = nearest.select(F.col("directory").alias("below"), F.col("x.above").alias("above"), F.col("x.given").alias("given"))
    out = held.join(nearest, F.col("directory") == F.col("below"), "left")
    bare = F.col("own_licence").isNull()
    how = F.when(~bare, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select(*[c for c in held.columns if c not in ("row", "directory")], F.coalesce("own_licence", "given").alias("licence"), F.when(bare, F.col("above")).alias("licence_from"), how.alias("how"))
