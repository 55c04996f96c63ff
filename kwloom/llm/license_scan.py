"""Licences of files, in DataFrame functions only.

Every telling term of a licence template marks a window of the template's size in a file, placed as
the term is placed in the template; windows and templates are compared by sparse TF-IDF cosine,
weighted by counts over all files. A licence is named only where its naming terms are in the window.
A file without a notice of its own takes the licence of the nearest directory above it that holds a
licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import stored

#: Fixed values: (licence, notice or opening of the licence text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Fixed values: (licence, name in a notice); each makes short notices.
NAMED = (
    ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("0BSD", "Zero-Clause BSD"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1"), ("EPL-1.0", "Eclipse Public License, Version 1.0"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0"), ("Python-2.0", "Python"), ("Zlib", "zlib"), ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Artistic-2.0", "Artistic License, Version 2.0"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("WTFPL", "WTFPL"), ("EUPL-1.2", "European Union Public Licence, Version 1.2"),
    ("PostgreSQL", "PostgreSQL"), ("MS-PL", "Microsoft Public License"), ("OFL-1.1", "SIL Open Font License, Version 1.1"), ("Ruby", "Ruby"),
)
#: Words that notices share, whatever the licence.
COMMON = frozenset("a as by in is of on or the this to under with released licensed license licence licenses version general public software work".split())


def named_templates(named: Sequence[tuple[str, str]] = NAMED) -> list[tuple[str, str]]:
    """Short notices of each licence."""
    out = []
    for license_, name in named:
        word = "" if re.search("licen[cs]e", name, re.I) or name.startswith("CC") else " License"
        out += [(license_, f"Released under the {name}{word}."), (license_, f"Licensed under the {name}{word}.")]
    return out


#: A notice of a licence that no template names.
UNNAMED = "NOASSERTION"
#: Fixed value: names of licence files, without extension, in lower case.
LICENSE_NAMES = ("license", "licence", "copying", "unlicense", "notice")
THRESHOLD = 0.6
#: Words up to which a template is a short notice, which must share its naming terms.
SHORT = 16
_WORD = "[a-z0-9]+"
_VAGUE = r"(?i)\b(?:released|licensed|distributed)\s+under\s+(?:the\s+)?(?:terms\s+of\s+the\s+)?(?:[\w.+/\-]+[\s,]+){1,8}licen[cs]e\b"


class Weighted:
    """Templates as unit vectors of (1 + ln tf) * ln((1 + n) / (1 + df)).

    ``n`` and ``df`` count all files, and those that hold a term. Words in no template weigh as
    the templates' terms do on average.
    """

    def __init__(self, templates: Sequence[tuple[str, str]], n: int, df: dict[str, int]) -> None:
        self.words = [re.findall(_WORD, text.lower()) for _, text in templates]
        self.idf = {t: max(math.log((1 + n) / (1 + df.get(t, 0))), 1e-3) for t in sorted(vocabulary(templates))}
        self.other = sum(self.idf.values()) / max(1, len(self.idf))
        self.rows = []
        for i, ((name, _), words) in enumerate(zip(templates, self.words, strict=True)):
            weights = {t: (1 + math.log(k)) * self.idf[t] for t, k in Counter(words).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.rows += [(i, name, t, w / norm) for t, w in weights.items()]

    def naming(self, template: int) -> list[str]:
        """Terms of a short notice that a window must hold, all of them, to be of its licence."""
        words = self.words[template]
        return sorted(set(words) - COMMON) if len(words) <= SHORT else []

    def anchors(self, template: int, threshold: float) -> list[str]:
        """Terms of which a window must hold one: the rarest naming term, or the heaviest terms.

        What is left of a template without its heaviest terms is shorter than the threshold, so
        no window of other terms alone can come up to it.
        """
        if named := self.naming(template):
            return [max(named, key=lambda t: (self.idf[t], t))]
        out, rest = [], 1.0
        for w, t in sorted(((w, t) for j, _, t, w in self.rows if j == template), reverse=True):
            if rest < threshold**2 - 1e-9:
                break
            out.append(t)
            rest -= w * w
        return out

    def places(self, threshold: float) -> list[tuple[str, int, int, int]]:
        """(term, template, words before it there, words of the template) of all anchors."""
        return [
            (t, i, words.index(t), len(words)) for i, words in enumerate(self.words) for t in self.anchors(i, threshold)
        ]


def vocabulary(templates: Sequence[tuple[str, str]]) -> set[str]:
    return {t for _, text in templates for t in re.findall(_WORD, text.lower())}


def weigh(files: DataFrame, templates: Sequence[tuple[str, str]]) -> Weighted:
    """Term weights with counts over all files; of the templates' bounded vocabulary."""
    terms = sorted(vocabulary(templates))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORD})"), F.lit(1)))
    held = files.select(words.alias("words")).select(F.array_intersect("words", F.array(*map(F.lit, terms))).alias("terms"))
    df = {r.term: r["count"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    return Weighted(templates, files.count(), df)


def windows(files: DataFrame, model: Weighted, threshold: float) -> DataFrame:
    """(path, template, words): the words that stand where a template would, by each anchor of it."""
    spark = files.sparkSession
    places = model.places(threshold)
    anchor = r"(?<![a-z0-9])(?:" + "|".join(sorted({p[0] for p in places})) + r")(?![a-z0-9])"
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORD})"), F.lit(1))
    # the templates are a list of the caller's, so this table is small
    table = F.broadcast(spark.createDataFrame(places, "term string, template int, before int, length int"))
    begin = F.greatest(F.col("at") - F.col("before"), F.lit(0))
    return (
        files.where(F.lower("text").rlike(anchor)).select("path", words.alias("all"))
        .select("path", "all", F.posexplode("all").alias("at", "term")).join(table, "term")
        .select("path", "template", F.slice("all", begin + 1, F.col("length")).alias("words"))
    )


def notices(files: DataFrame, templates: Sequence[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, similarity): the best notice of each file (path, text) that has one.

    An SPDX identifier counts as it stands, with similarity 1. Then the window most like a
    template; ties go to the licence first in order. A file that only says it is under some
    other licence has ``NOASSERTION`` and a null similarity.
    """
    templates = TEMPLATES + tuple(named_templates()) if templates is None else templates
    spark = files.sparkSession
    model = weigh(files, templates)
    held = stored(windows(files, model, threshold).withColumn("digest", F.unhex(F.md5(F.concat_ws(" ", "words")))))
    rows = [(i, name, t, w, model.naming(i)) for i, name, t, w in model.rows]
    weights = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight double, naming array<string>"))
    idf = F.broadcast(spark.createDataFrame(list(model.idf.items()), "term string, idf double"))
    distinct = held.groupBy("digest").agg(F.first("words").alias("words"))
    terms = (
        distinct.select("digest", F.explode("words").alias("term")).groupBy("digest", "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(idf, "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(model.other)))
    )
    norms = terms.groupBy("digest").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(weights, "term").groupBy("digest", "template", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"), F.collect_set("term").alias("shared"), F.first("naming").alias("naming")
    )  # terms of one template
    cosines = (
        dots.where(F.size(F.array_except("naming", "shared")) == 0)
        .join(norms, "digest").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9))
        .where(F.col("similarity") >= threshold).select("digest", "template", "license", "similarity")
    )
    scored = stored(cosines)
    found = held.select("path", "digest", "template").distinct().join(scored, ["digest", "template"]).select("path", "license", "similarity")
    tag = F.regexp_extract("text", r"(?i)SPDX-License-Identifier:\s*\(?([a-z0-9.+\-]*[a-z0-9+])", 1)
    tagged = files.select("path", tag.alias("license")).where("license <> ''").select("path", "license", F.lit(2.0).alias("similarity"))
    vague = files.where(F.col("text").rlike(_VAGUE)).select("path", F.lit(UNNAMED).alias("license"), F.lit(-1.0).alias("similarity"))
    best = _best(found.union(tagged).union(vague), "path")
    similarity = F.when(F.col("similarity") > 0, F.least("similarity", F.lit(1.0)))
    return best.withColumn("similarity", similarity)


def _best(df: DataFrame, key: str) -> DataFrame:
    """(key, license, similarity): the highest similarity, of ties the first licence."""
    first = F.min(F.struct((-F.col("similarity")).alias("less"), "license"))
    return df.groupBy(key).agg(first.alias("b")).select(key, "b.license", (-F.col("b.less")).alias("similarity"))


def parent(path: str | Column) -> Column:
    """The directory of a path; the root is empty."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(directory: str | Column) -> Column:
    """Array of (depth, directory): a directory and all above it, down from the root."""
    directory = F.col(directory) if isinstance(directory, str) else directory
    parts = F.split(directory, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")),
    )
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))
    return F.when(directory == "", root).otherwise(F.concat(root, above))


def is_license_file(path: str | Column) -> Column:
    """Whether the file name, up to a dot or hyphen, is a licence file's."""
    name = F.lower(F.regexp_extract(path, r"([^/.\-]*)[^/]*$", 1))
    return name.isin(*LICENSE_NAMES)


def scan(
    files: DataFrame, templates: Sequence[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
    path_col: str = "path", text_col: str = "text",
) -> DataFrame:
    """(path, license, similarity, found, origin): the licence of every file.

    ``found`` is "own" for a notice in the file, "inherited" for the licence of the nearest
    directory above with a licence file, whose directory is ``origin``; all null if there is
    neither. Of several licence files in a directory the best match counts, ties the first
    licence in order; ``NOASSERTION`` gives way to any named licence. Null and empty texts have no notice of their own and may inherit; null
    paths are left out. Repeated paths are one file with all their texts. Extra columns are
    not read.
    """
    files = files.select(F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text")).where("path is not null")
    own = stored(notices(files, templates, threshold))
    sure = own.withColumn("similarity", F.coalesce("similarity", F.lit(-1.0)))
    at_directory = _best(sure.where(is_license_file("path")).withColumn("above", parent("path")), "above")
    at_directory = at_directory.withColumn("similarity", F.when(F.col("similarity") >= 0, F.col("similarity")))
    paths = files.select("path").distinct().withColumn("dir", parent("path"))
    directories = paths.select("dir").distinct()
    nearest = F.max(F.struct("depth", "above", "license", "similarity"))
    inherited = (
        directories.select("dir", F.explode(ancestors("dir")).alias("a")).select("dir", "a.depth", "a.above")
        .join(at_directory, "above").groupBy("dir").agg(nearest.alias("n"))
        .select("dir", F.col("n.above").alias("origin"), F.col("n.license").alias("from_dir"), F.col("n.similarity").alias("dir_similarity"))
    )
    mine = F.col("license").isNotNull()
    return (
        paths.join(own, "path", "left").join(inherited, "dir", "left")
        .select(
            "path", F.coalesce("license", "from_dir").alias("license"),
            F.when(mine, F.col("similarity")).otherwise(F.col("dir_similarity")).alias("similarity"),
            F.when(mine, "own").when(F.col("from_dir").isNotNull(), "inherited").alias("found"),
            F.when(mine, F.col("dir")).otherwise(F.col("origin")).alias("origin"),
        )
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """(path, text) of documents laid out as a tree: every hundredth is a licence file of its language's folder."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    id_ = F.col("doc_id")
    name = F.when(id_ % 100 == 0, F.concat(F.lit("LICENSE-"), id_.cast("string"))).otherwise(
        F.concat((id_ / 100).cast("long").cast("string"), F.lit("/"), id_.cast("string"), F.lit(".txt"))
    )
    return docs.select(F.concat(folder, F.lit("/"), name).alias("path"), "text", "doc_id")
