"""License scan by diagonal voting, in DataFrame functions only.

Every run of ``GRAM`` words of every whole text is hashed and joined with the positions at which the templates hold that
run (a table whose size is fixed by the templates). A match at word ``pos`` of the text and ``place`` of the template
votes for the diagonal pos - place; on one diagonal lies one undisturbed copy. Diagonals of a template at most ``DRIFT``
apart are merged into one span, so a copy with words added or left out stays together. A span is verified by the
places of the template that its words match exactly: it counts if they are at least ``SHARE`` of the template.

The phrases are templates as well, and a place of a phrase is a diagonal with all of the phrase's runs.

A text's rows stay in the task that read it until its votes are known; only votes, and one row for each text, are
shuffled, by a number of the row, so that equal doc_ids, copies and frequent passages do not meet in one task.

Defined cases: a null or empty text has no word, no place, empty label lists and score 0; repeated rows and equal doc_ids
stay as rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM, DRIFT, SHARE = 3, 2, 0.7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_RUNS = 62  # the places of a template are bits of a long

# Phrases with their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# The words of public license notices with their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights "
     "to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("all rights reserved", "all-rights-reserved"),
]


def template_rows(phrases=None, notices=None, width: int = GRAM) -> tuple[list[tuple], list[tuple]]:
    """(number, label, is phrase, runs) of each template, and (number, place, run) of each run of words."""
    templates, runs = [], []
    for number, (words, label, base) in enumerate([(t.split(), b, True) for t, b in (phrases or PHRASES)]
                                                  + [(t.split(), b, False) for t, b in (notices or NOTICES)]):
        count = len(words) - width + 1
        if not 0 < count <= MOST_RUNS:
            raise ValueError(f"a template must have from 1 to {MOST_RUNS} runs of {width} words: {' '.join(words)}")
        templates.append((number, label, base, count))
        runs += [(number, k, " ".join(words[k:k + width])) for k in range(count)]
    return templates, runs


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of literals."""
    def literal(x) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x).lower()

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({columns})")


def votes(docs: DataFrame, runs: list[tuple], width: int = GRAM) -> DataFrame:
    """row, doc_id, n_words, template, place, pos: every exact match, and for each text one row without a template."""
    table = values(docs.sparkSession, runs, "template, place, template_run").withColumn("hash", F.xxhash64("template_run"))
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                        F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    each = F.transform(F.sequence(F.lit(0), F.size("words") - width),
                       lambda i: F.concat_ws(" ", *[F.get("words", i + k) for k in range(width)]))
    runs_of = words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"),
                           F.posexplode_outer(F.when(F.size("words") >= width, each)).alias("pos", "run"))
    hashed = runs_of.withColumn("hash", F.xxhash64("run"))
    # Some hundred rows, as many as the templates have words.
    met = hashed.join(F.broadcast(table), (hashed["hash"] == table["hash"]) & (F.col("run") == F.col("template_run")), "left")
    return (met.filter("template IS NOT NULL OR pos = 0 OR pos IS NULL")
            .select("row", "doc_id", "n_words", "template", "place", F.col("pos").cast("long").alias("pos")))


def spans(votes_: DataFrame, drift: int = DRIFT) -> DataFrame:
    """Votes by diagonal, neighbouring diagonals merged: one row for each text, template and span.

    ``mask``: the template's places that the span matches; ``starts``, ``first``, ``last``: number, smallest and largest
    of the diagonals that hold all of the template's first ``runs`` places.
    """
    key = ["row", "doc_id", "n_words", "template"]
    # By the row's number alone, which is enough for all that follows.
    diagonals = (votes_.repartition("row").withColumn("diagonal", F.col("pos") - F.col("place")).groupBy(*key, "diagonal")
                 .agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"), F.min("pos").alias("from_pos"),
                      F.max("pos").alias("to_pos")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= drift, 0).otherwise(1)
    return diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))


def find_licenses(docs: DataFrame, phrases=None, notices=None, width: int = GRAM, drift: int = DRIFT,
                  share: float = SHARE) -> DataFrame:
    """One row for each text: n_words, the phrases' places and labels, all labels, score, and the verified spans.

    ``spans``: label, from_word and to_word (exclusive) of every verified span, in that order; ``score``: the largest
    part of a template that a verified span matches.
    """
    templates, runs = template_rows(phrases, notices, width)
    names = values(docs.sparkSession, templates, "template, label, base, runs")
    key = ["row", "doc_id", "n_words"]
    with_names = spans(votes(docs, runs, width), drift).join(F.broadcast(names), "template", "left")
    # All bits up to the template's last place.
    whole = F.col("base") & (F.col("mask") == F.expr("shiftleft(1L, runs) - 1"))
    merged = (with_names.groupBy(*key, "template", "span", "label", "base", "runs")
              .agg(F.bit_count(F.bit_or("mask")).alias("hits"), F.min("from_pos").alias("from_pos"),
                   F.max("to_pos").alias("to_pos"), F.count_if(whole).alias("places"),
                   F.min(F.when(whole, F.col("diagonal"))).alias("first"),
                   F.max(F.when(whole, F.col("diagonal"))).alias("last")))
    good = F.col("hits") >= F.lit(share) * F.col("runs")
    span = F.struct("label", F.col("from_pos").alias("from_word"), (F.col("to_pos") + width).alias("to_word"))
    base_labels = F.collect_set(F.when(F.col("places") > 0, F.col("label")))
    labels = F.collect_set(F.when(good | (F.col("places") > 0), F.col("label")))
    return (merged.groupBy(*key)
            .agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n_base"), F.min("first").alias("first_word"),
                 F.max("last").alias("last_word"), F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
                 F.array_join(F.array_sort(labels), ",").alias("labels"),
                 F.coalesce(F.max(F.when(good, F.col("hits") / F.col("runs"))), F.lit(0.0)).alias("score"),
                 F.array_sort(F.collect_list(F.when(good, span))).alias("spans"))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"))
