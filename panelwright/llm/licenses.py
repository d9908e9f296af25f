"""Licence scans: TF-IDF cosine of licence lines to templates, then inheritance from the nearest directory.

Lines that speak of a licence are compared with every template as sparse TF-IDF vectors; equal lines are compared
once, but count as often as they occur in the document frequencies. A text has the licence of its best line, if that
reaches the threshold; a line names a licence only if it holds the words that tell the licence and its version, and is
not a denial. A directory has the licence that most of its own licensed files name; a file without one takes
that of its nearest ancestor directory, found by joining the paths' prefixes.

Defined results: a missing or empty text has no line; a missing path lies in no directory and inherits nothing;
repeated rows each get their result; equally good licences are taken by name; an empty table gives no rows. Other
columns are carried along in ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import Stage, text_digest, whole_text

# Names of licences, the notices they are known by, and words a line must hold to name that one.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "general public 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met", "redistribution"),
    ("CC-BY-3.0", "Licensed under CC BY 3.0.", "cc by 3"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by 4"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc by 4"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by 4"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by 4"),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0.", "cc by 3"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by 4"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "general public 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "general public 3"),
    ("ISC", "Released under the ISC License.", "isc"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "general public 2 1"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", "general public 3"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission charge"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
)
# Words that a line and its template hold both or neither; no template holds the negations.
MARKS = ("affero", "lesser", "nc", "nd", "no", "not", "sa")
SPEAKS = "licen[sc]|copyright|permission is hereby|redistribution and use|source code form"
WORD = "[a-z0-9]+"
THRESHOLD = 0.6


def licence_lines(text: Column) -> Column:
    """Distinct lower-case lines of a text that speak of a licence."""
    lines = F.filter(F.split(F.lower(text), "\n", -1), lambda line: line.rlike(SPEAKS))
    return F.when(F.lower(text).rlike(SPEAKS), F.array_distinct(lines)).otherwise(F.array().cast("array<string>"))


def _weights(words: DataFrame, idf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, word, weight, norm): TF-IDF weights and the length of each vector."""
    counts = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counts.join(idf, "word").select(*keys, "word", (F.col("tf") * F.col("idf")).alias("weight"))
    norms = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norms, list(keys))


def line_licences(lines: DataFrame, templates: Sequence[tuple[str, str, str]], threshold: float) -> DataFrame:
    """``(line, licence)`` of the distinct lines that are near enough to a template; ``lines`` is ``(line, n)``."""
    spark = lines.sparkSession
    known = spark.createDataFrame([(k, *row) for k, row in enumerate(templates)], "template int, licence string, text string, needs string")
    words = lines.select("line", "n", F.explode(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("word"))
    template_words = known.select(
        "template", "licence", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    total = (lines.agg(F.sum("n")).first()[0] or 0) + len(templates)
    df = words.select("line", "n", "word").distinct().groupBy("word").agg(F.sum("n").alias("df")).unionByName(
        template_words.select("template", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ).groupBy("word").agg(F.sum("df").alias("df"))
    idf = df.select("word", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    left = _weights(words.select("line", "word"), idf, ["line"])
    # One row per template word: as bounded as the list of templates.
    right = _weights(template_words, idf, ["template", "licence"]).select(
        "template", "licence", "word", F.col("weight").alias("other"), F.col("norm").alias("other_norm"))
    dots = left.join(right, "word").groupBy("line", "template", "licence").agg(
        (F.sum(F.col("weight") * F.col("other")) / (F.max("norm") * F.max("other_norm"))).alias("cosine"))
    # The line must hold the words that tell this licence and version from others, and no other version's marks.
    def words_of(text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    marks = F.array(*[F.lit(m) for m in MARKS])
    rules = known.select("template", F.split("needs", " ").alias("needs"), F.array_intersect(marks, words_of(F.col("text"))).alias("marks"))
    heard = words_of(F.col("line"))
    agreeing = dots.join(rules, "template").filter(
        (F.size(F.array_except("needs", heard)) == 0) & (F.array_intersect(marks, heard) == F.col("marks")))
    best = agreeing.groupBy("line").agg(
        F.min(F.struct((-F.round("cosine", 9)).alias("far"), F.col("licence").alias("licence"))).alias("best"))
    return best.filter(F.col("best.far") <= -threshold).select(
        "line", F.col("best.licence").alias("licence"), F.col("best.far").alias("far"))


def own_licences(rows: DataFrame, templates: Sequence[tuple[str, str, str]], threshold: float) -> DataFrame:
    """``(digest, licence)`` of texts with a licence line; ``rows`` is ``(digest, lines)``."""
    lines = rows.select("digest", F.explode("lines").alias("line"))
    named = line_licences(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")), templates, threshold)
    found = lines.distinct().join(named, "line")
    return found.groupBy("digest").agg(F.min(F.struct("far", "licence")).alias("best")).select(
        "digest", F.col("best.licence").alias("own"))


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherited(licensed: DataFrame, directories: DataFrame) -> DataFrame:
    """``(directory, from_directory, licence)``: the licence of the nearest ancestor that has one, itself included.

    ``licensed`` is ``(directory, own)`` per licensed file, ``directories`` the distinct directories that ask.
    """
    votes = licensed.groupBy("directory", "own").agg(F.count(F.lit(1)).alias("n"))
    granted = votes.groupBy(F.col("directory").alias("from_directory")).agg(
        F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("most")).select("from_directory", F.col("most.own").alias("licence"))
    parts = F.split("directory", "/", -1)
    ancestors = directories.select("directory", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("from_directory"))
    return ancestors.join(granted, "from_directory").groupBy("directory").agg(
        F.max(F.struct(F.length("from_directory").alias("depth"), "from_directory", "licence")).alias("near")
    ).select("directory", "near.from_directory", "near.licence")


def scan(
    docs: DataFrame, path: Column, text: str = "text",
    templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``(row, path, own, licence, from_directory)``: the licence a file names, the one that holds, and the directory
    it came from if inherited; ``row`` is the input row without its text."""
    content = whole_text(text)
    stage = Stage(docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"), path.alias("path"),
        directory_of(path).alias("directory"), text_digest(content).alias("digest"), licence_lines(content).alias("lines"),
    ), "licence-lines")
    rows = stage.read()
    speaking = rows.filter(F.size("lines") > 0).select("digest", "lines")
    own = Stage(own_licences(speaking, templates, threshold), "licence-own").read()  # read twice below
    with_own = rows.drop("lines").join(own, "digest", "left")
    licensed = with_own.filter("own IS NOT NULL AND directory IS NOT NULL").select("directory", "own")
    asking = with_own.filter("own IS NULL AND directory IS NOT NULL").select("directory").distinct()
    near = inherited(licensed, asking)
    joined = with_own.join(near, "directory", "left")
    takes = F.col("own").isNull()
    return joined.select("row", "path", "own", F.coalesce("own", "licence").alias("licence"),
                         F.when(takes, F.col("from_directory")).alias("from_directory"))
