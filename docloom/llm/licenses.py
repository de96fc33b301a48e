"""Licence scans by a positional index of rare words.

Licence templates are runs of words, notices and whole licence texts. Their index lists for every word where in which
template it stands. Document frequencies over the whole corpus tell which licence words
are rare; each file looks up the rarest ones it has of every template that it has enough words of
to match at all. A posting and a place in the file give
the place where the template would begin; postings that agree on it are counted, and a
template is taken if enough of its looked-up words agree and, checked last, its mandatory phrase
stands in the file.

Base labels come from three fixed phrases and always stay. Everything is DataFrame
functions: one scan counts word frequencies, one finds the licence words each file has and keeps
the words of files that may hold a template, and the rest runs on that small stored table.

Defined results: a null or empty text has no words, no places and score 0; repeated rows
are scanned each (rows are told apart by a number of their own in the stored table).
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import WORD_REGEX
from docloom.plans.stored import stored

#: Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Fixed values. label: (words of the notice or text, mandatory phrase).
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-4.0": ("licensed under cc by 4 0", "cc by 4 0"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    "mpl-2.0": ("subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software"),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to "
        "in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        "unless required by applicable law",
    ),
    "gpl-3.0-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details",
        "published by the free software foundation",
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
        "to deal in the software without restriction",
    ),
}

#: Words of templates that ordinary English is full of; they are not indexed.
COMMON = frozenset(
    (
        "a all an and any are as at be by can do either even for http if in into is it may more not of on or org see so that the this to under "
        "use whom will with without work writing www you your"
    ).split()
)

#: Rarest words of a template that a file looks up for it.
LOOKUPS = 8
#: Share of a template's indexed words (of ``LOOKUPS`` at most) that must agree on its place.
AGREE = 0.6


def _words(text: str) -> Column:
    """Lower-cased words; only A-Z are lowered, so two letters that full lower-casing turns into ASCII are kept out of it."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    c = F.col(text)
    lowered = F.when(c.contains("K") | c.contains("İ"), F.translate(c, upper, upper.lower())).otherwise(F.lower(c))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), "[" + WORD_REGEX[2:-1] + "+"), "")


def indexed_words(notice: str) -> list[tuple[str, int]]:
    """(word, place) of what is indexed of a template: uncommon words that stand in it once."""
    words = notice.split()
    return [(w, i) for i, w in enumerate(words) if w not in COMMON and words.count(w) == 1]


def postings(spark, templates: Mapping[str, tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(word, template, at, indexed): where indexed words stand, and how many are looked up."""
    rows = []
    for label, (notice, _) in templates.items():
        places = indexed_words(notice)
        rows += [(w, label, i, min(LOOKUPS, len(places))) for w, i in places]
    return spark.createDataFrame(rows, "word string, template string, at int, indexed int")


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, counted in words."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        fits = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            fits = fits & (F.coalesce(F.get(words, i + k), F.lit("")) == part)
        return fits

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _holds(words: Column, phrase: str) -> Column:
    return F.size(_places(words, phrase)) > 0


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, str]] = TEMPLATES, base: Mapping[str, str] = BASE) -> DataFrame:
    """One row per row of ``docs`` with base places, labels and the method's matches."""
    spark = docs.sparkSession
    index = postings(spark, templates)
    own = {label: [w for w, _ in indexed_words(notice)] for label, (notice, _) in templates.items()}
    indexed = sorted(set().union(*own.values()))
    phrases = sorted({w for phrase in base for w in phrase.split()} - set(indexed))

    # document frequencies over the whole corpus; at most one row per indexed word comes back
    present = F.array_intersect(_words("text"), _array(indexed))
    seen = {r["word"]: r["count"] for r in docs.select(F.explode(present).alias("word")).groupBy("word").count().collect()}
    rarest = sorted(indexed, key=lambda w: (seen.get(w, 0), w))

    none = F.expr("CAST(array() AS array<int>)")
    read = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _words("text").alias("words"))
    read = read.withColumn("present", F.array_intersect(_array([*rarest, *phrases]), "words"))
    # a template needs so many of its words in a file at least, however they stand
    hopeful = []
    for label, words in own.items():
        least = math.ceil(AGREE * min(LOOKUPS, len(words)))
        hopeful.append(F.when(F.size(F.array_intersect(_array(words), "present")) >= least, F.lit(label)))
    told = read.withColumn("hopeful", F.array_compact(F.array(*hopeful)))
    bases = {
        label: F.when(F.size(F.array_intersect(_array(sorted(set(p.split()))), "present")) == len(set(p.split())), _places(F.col("words"), p))
        for p, label in base.items()
    }
    reduced = told.select(
        "row",
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        *[F.coalesce(places, none).alias(f"base_{label}") for label, places in bases.items()],
        F.when(F.size("hopeful") > 0, F.struct("hopeful", "present", "words")).alias("looked"),
    )
    files = stored(reduced, "licenses")

    # of each template the rarest words that the file has, and where they stand
    open_files = files.where("looked IS NOT NULL").select("row", "looked.*")
    rare = F.lit(None)
    for label, words in own.items():
        ordered = _array([w for w in rarest if w in words])
        rare = F.when(F.col("template") == label, F.slice(F.array_intersect(ordered, "present"), 1, LOOKUPS)).otherwise(rare)
    asked = open_files.select("row", "words", "present", F.explode("hopeful").alias("template")).select("row", "words", "template", rare.alias("rare"))
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word")))
    spots = asked.select("row", "template", F.explode(F.filter(numbered, lambda s: F.array_contains("rare", s["word"]))).alias("s"))

    # postings that agree on where their template begins
    met = spots.select("row", "template", "s.*").join(F.broadcast(index), ["word", "template"])
    begins = met.groupBy("row", "template", "indexed", (F.col("place") - F.col("at")).alias("begin"))
    agreed = begins.agg(F.count_distinct("at").alias("n")).withColumn("share", F.least(F.lit(1.0), F.col("n") / F.col("indexed")))
    agreed = agreed.where(F.col("share") >= AGREE).groupBy("row", "template").agg(F.max("share").alias("share"))
    # last the mandatory phrase, in the few files that are left
    verified = F.lit(False)
    for label, (_, must) in templates.items():
        verified = F.when(F.col("template") == label, _holds(F.col("words"), must)).otherwise(verified)
    sure = agreed.join(open_files.select("row", "words"), "row").where(verified)
    taken = sure.groupBy("row").agg(F.collect_set("template").alias("found"), F.max("share").alias("share"))
    return files.join(taken, "row", "left").drop("looked", "row")


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    bases = {label: F.col(f"base_{label}") for label in BASE.values()}
    every = F.concat(*bases.values())
    own = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in bases.items()]))
    start = lambda pick: F.when(F.size(every) > 0, pick(every).cast("bigint"))
    method = F.coalesce("found", F.expr("CAST(array() AS array<string>)"))
    sure = F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        start(F.array_min).alias("first_word"),
        start(F.array_max).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, method)), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), sure).alias("score"),
    )
