"""License notices in texts, found by voting on diagonals.

A template is a known notice, as a sequence of words. If a document holds it from word d on, every phrase of k words at place
t of the template stands at place d + t of the document: all its phrases vote for the diagonal d. The steps:

1. all phrases of k words of all documents, rolling, are joined by hash to the places of the templates' phrases; the
   words of both must agree, so a clash of hashes gives no vote,
2. votes are aggregated by document, template and diagonal,
3. neighbouring diagonals are merged: a few words put in or left out move the rest of a notice by as many words, so a diagonal
   takes in the votes of all within SLACK of it, and yields to one of them that has more votes,
4. spans are verified: the words of the template that the votes cover must be at least SIMILARITY of it, and hold the words that
   tell it from others (such as its version); an exact template must be covered whole by its own diagonal.

The documents are read once and their texts never shuffled: phrases are made and looked up in the task that reads a
document, and only votes and one row per document move on. Templates are a bounded table, checked before it is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words put in or left out that a notice may have; shorter than any template that allows for it.
SLACK = 4
SIMILARITY = 0.8
#: Words of a phrase in notices and in exact templates.
NOTICE_WORDS = 3
EXACT_WORDS = 2
#: Most words of all templates together: what is broadcast is smaller than some 100 bytes for each.
MOST_TEMPLATE_WORDS = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice: its label, its text, whether it must stand there word for word, and words it cannot do without."""

    label: str
    text: str
    exact: bool = False
    must: str = ""

    @property
    def words(self) -> list[str]:
        lower = self.text.translate(str.maketrans(UPPER, LOWER))
        return [w for w in re.split(GAPS, lower) if w]

    @property
    def must_places(self) -> list[int]:
        own, wanted = self.words, Template("", self.must).words
        for at in range(len(own) - len(wanted) + 1):
            if own[at : at + len(wanted)] == wanted:
                return list(range(at, at + len(wanted)))
        raise ValueError(f"{self.must!r} is not in {self.text!r}")

    @property
    def phrase(self) -> int:
        return EXACT_WORDS if self.exact else NOTICE_WORDS


# The base phrases with their labels.
BASE = [
    Template("gpl", "gnu general public license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("cc-by", "cc by", exact=True),
    Template("mit", "mit license", exact=True),
]

# Short notices and the customary headers of public licenses.
NOTICES = [
    Template("mit", "Released under the MIT License", must="the MIT License"),
    Template("mit", "Licensed under the MIT License", must="the MIT License"),
    Template("mit", "distributed under the terms of the MIT License", must="the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions",
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", must="Apache License, Version 2.0"),
    Template("apache-2.0", "Released under the Apache License, Version 2.0", must="Apache License, Version 2.0"),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        must="Apache License, Version 2.0",
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", must="General Public License, version 3"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", must="General Public License, version 2"),
    Template("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3", must="Lesser General Public License, version 3"),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", must="Affero General Public License, version 3"),
    Template(
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        must="either version 3 of the License",
    ),
    Template(
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        must="either version 2 of the License",
    ),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", must="CC BY 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", must="CC BY-SA 4.0"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", must="CC BY-NC 4.0"),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", must="CC BY-ND 4.0"),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", must="CC BY-NC-SA 4.0"),
    Template("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", must="CC BY-NC-ND 4.0"),
    Template(
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        must="Commons Attribution 4.0 International",
    ),
    Template(
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        must="Attribution-ShareAlike 4.0 International",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", must="License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", must="unencumbered software"),
]


def lower_words(text: Column) -> Column:
    """Runs of digits, letters and characters past ASCII, A-Z in lower case; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def _hash(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from a place on; null where they do not fit."""
    inside = at + size <= F.size(words)
    return F.when(inside, F.xxhash64(*(F.get(words, at + i) for i in range(size))))


def template_places(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``template, place, phrase, hash`` of every phrase of the templates: a table of a bounded size."""
    total = sum(len(t.words) for t in templates)
    if total > MOST_TEMPLATE_WORDS:
        raise ValueError(f"{total} words of templates; at most {MOST_TEMPLATE_WORDS} are sent to every task")
    for t in templates:
        if len(t.words) < t.phrase or not t.exact and len(t.words) <= SLACK:
            raise ValueError(f"template {t.text!r} is too short")
    rows = [
        (number, at, t.words[at : at + t.phrase])
        for number, t in enumerate(templates)
        for at in range(len(t.words) - t.phrase + 1)
    ]
    frame = spark.createDataFrame(rows, "template int, place int, phrase array<string>")
    sizes = {EXACT_WORDS, NOTICE_WORDS}
    hashes = [F.when(F.size("phrase") == n, _hash(F.col("phrase"), F.lit(0), n)) for n in sorted(sizes)]
    return frame.withColumn("hash", F.coalesce(*hashes))


def _votes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, mark, n_words, template, diagonal, place, copies``: every vote, and one row without a template per document."""
    words = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("mark"),
        lower_words(F.col("text")).alias("words"),
    )
    each = words.select("*", F.posexplode_outer("words").alias("at", "word"))
    at = F.coalesce("at", F.lit(0))
    phrases = [_hash(F.col("words"), at, n) for n in (EXACT_WORDS, NOTICE_WORDS)]
    nothing = F.lit(None).cast("bigint")
    # the first word of a document, and a document without words, also gives the row that stands for it
    hashes = F.when(at == 0, F.array(nothing, *phrases)).otherwise(F.array(*phrases))
    rolling = each.select("doc_id", "mark", "words", at.alias("at"), F.posexplode(hashes).alias("kind", "own_hash"))
    same = (F.col("own_hash") == F.col("hash")) & (F.slice("words", F.col("at") + 1, F.size("phrase")) == F.col("phrase"))
    # bounded by MOST_TEMPLATE_WORDS
    met = rolling.join(F.broadcast(places), same, "left")
    one = (F.col("at") == 0) & (F.col("kind") == 0)
    return (
        met.where(F.col("template").isNotNull() | one)
        .groupBy("doc_id", "mark", F.size("words").alias("n_words"), "template", (F.col("at") - F.col("place")).alias("diagonal"), "place")
        .agg(F.count("*").alias("copies"))
    )


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """``doc_id, n_words, spans`` for every row of ``docs(doc_id, text, ...)``.

    ``spans`` holds ``label, template, exact, start, end, score``, sorted by start, template: the first word of each notice
    found, the place after its last, and how much of the template is there (1.0 for exact ones). Words are counted from 0; they are runs of
    digits, letters and characters past ASCII, A-Z in lower case. A null or empty text has none. Repeated rows give equal rows; a null doc_id
    stays null. A notice that stands somewhere twice gives two spans; of overlapping finds of one template the one with more votes stays,
    then the first. Long texts are scanned whole. Columns beside doc_id and text are not read, whatever their names.
    """
    known = BASE + NOTICES if templates is None else templates
    spark = docs.sparkSession
    length = F.array(*(F.lit(len(t.words)) for t in known))
    phrase = F.array(*(F.lit(t.phrase) for t in known))
    exact = F.array(*(F.lit(t.exact) for t in known))
    label = F.array(*(F.lit(t.label) for t in known))
    must = F.array(*(F.array(*map(F.lit, t.must_places)).cast("array<int>") for t in known))
    of = lambda table: F.get(table, F.col("template"))

    key = ["doc_id", "mark"]
    # all that follows stays in this partitioning
    votes = _votes(docs, template_places(spark, known)).repartition(*key)
    diagonals = votes.groupBy(*key, "template", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.collect_list("place").alias("places"), F.count("place").alias("votes")
    )
    near = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(-SLACK, SLACK)
    earlier = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(-SLACK, -1)
    later = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(1, SLACK)
    beaten = (F.coalesce(F.max("votes").over(earlier), F.lit(0)) >= F.col("votes")) | (F.coalesce(F.max("votes").over(later), F.lit(0)) > F.col("votes"))
    merged = diagonals.select(
        *key, "n_words", "copies", "template", "diagonal", "places",
        F.flatten(F.collect_list("places").over(near)).alias("all_places"),
        F.min(F.col("diagonal") + F.array_min("places")).over(near).alias("start"),
        F.max(F.col("diagonal") + F.array_max("places") + of(phrase)).over(near).alias("end"),
        beaten.alias("beaten"),
    )
    covered = F.array_distinct(F.flatten(F.transform(F.when(of(exact), F.col("places")).otherwise(F.col("all_places")), lambda t: F.sequence(t, t + of(phrase) - 1))))
    share = F.size("covered") / of(length)
    verified = F.when(of(exact), share == 1).otherwise(~F.col("beaten") & (share >= SIMILARITY) & (F.size(F.array_except(of(must), F.col("covered"))) == 0))
    span = F.struct(
        F.when(of(exact), F.col("diagonal")).otherwise(F.col("start")).cast("bigint").alias("start"),
        "template",
        of(label).alias("label"),
        of(exact).alias("exact"),
        F.when(of(exact), F.col("diagonal") + of(length)).otherwise(F.col("end")).cast("bigint").alias("end"),
        share.alias("score"),
    )
    found = merged.withColumn("covered", covered).groupBy(*key).agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(verified, span))).alias("spans"),
    )
    rows = found.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    return rows.drop("copy")


def joined_labels(spans: Column) -> Column:
    """Distinct labels of spans, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
