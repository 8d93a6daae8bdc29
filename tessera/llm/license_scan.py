"""License scan by diagonal voting, in DataFrame operations alone.

Every rolling k-gram of a document's words is hashed and joined to the positions of the
known texts.  A hit at document word ``p`` and template word ``q`` votes for the diagonal
``p - q``: an uninterrupted copy puts all its votes on one diagonal, an inserted or missing
word moves the rest to a neighbouring one.  Votes are summed by diagonal, neighbouring
diagonals are merged, and spans are verified by the words of the template that their votes cover.
Each vote is checked word by word, so that a hash collision can't make a span.

Exact phrases are templates too: a phrase stands wherever a diagonal holds all its grams.

Scale: the templates come as a list; up to ``BROADCAST_ROWS`` positions (some 200 bytes each) the
join is a broadcast join inside the scan's stage, beyond that Spark chooses.  Only hits and one row
for each document are shuffled, once, by row.

Defined results: null or empty text has no words, no labels and score 0; rows with the same
id are scanned apart; other columns of the input are ignored; ties between templates keep all.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, words

K = 3
#: Share of a notice's words that must stand in found k-grams, and how far apart merged diagonals may be.
MIN_COVER, MAX_SHIFT = 0.8, 10
BROADCAST_ROWS = 100_000

#: Phrases that must stand word for word, with the label of each.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Notices of public licenses, found also with words changed.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
)


def template_positions(spark, phrases=PHRASES, notices=NOTICES, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    rows = []
    for n, (text, label, exact) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in notices]):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        if len(own) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(n, label, exact, len(own), q, own[q : q + k]) for q in range(len(own) - k + 1)]
    kind = "template int, label string, exact boolean, template_words int, q int, template_gram array<string>"
    grams = spark.createDataFrame(rows, kind)
    first = F.transform("template_gram", lambda w: F.xxhash64(w))
    grams = grams.withColumn("gram", F.aggregate(F.slice(first, 2, k - 1), first[0], lambda a, b: F.xxhash64(a, b)))
    return F.broadcast(grams) if len(rows) <= broadcast_rows else grams


def license_votes(docs: DataFrame, positions: DataFrame, id_col="doc_id", text_col="text", k: int = K) -> DataFrame:
    """One row for each vote, and one more at least for each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(text_or_empty(text_col)).alias("words"))
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = F.slice("h", 1, F.greatest(F.size("h") - (k - 1), F.lit(0)))
    for j in range(1, k):
        grams = F.zip_with(grams, F.slice("h", j + 1, F.greatest(F.size("h") - (k - 1), F.lit(0))), lambda a, b: F.xxhash64(a, b))
    rows = rows.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), grams.alias("grams"))
    rows = rows.select("row", "doc_id", "words", "n_words", F.posexplode_outer("grams").alias("p", "gram"))
    same = (rows.gram == positions.gram) & (F.slice("words", rows.p + 1, k) == F.col("template_gram"))
    voted = rows.join(positions, same, "left").where("template IS NOT NULL OR p IS NULL OR p = 0")
    return voted.select("row", "doc_id", "n_words", "template", "label", "exact", "template_words", "p", "q")


def license_spans(docs: DataFrame, id_col="doc_id", text_col="text", phrases=PHRASES, notices=NOTICES, k: int = K, min_cover: float = MIN_COVER, max_shift: int = MAX_SHIFT) -> DataFrame:
    """Spans of license texts: row, doc_id, n_words, label, exact, start, end (words, end
    exclusive), cover (share of the template found) and accepted.

    A document without any vote has one row, with null label and start.
    """
    positions = template_positions(docs.sparkSession, phrases, notices, k)
    votes = license_votes(docs, positions, id_col, text_col, k).repartition("row")
    by = ["row", "doc_id", "n_words", "template", "label", "exact", "template_words"]
    diagonals = votes.groupBy(*by, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.min("p").alias("low"), F.max("p").alias("high"), F.collect_set("q").alias("found"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    # A phrase must fill one diagonal; those of a notice merge with their neighbours.
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > max_shift)
    merged = diagonals.withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(along))
    spans = merged.groupBy(*by, "group").agg(F.min("low").alias("start"), (F.max("high") + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    # A changed word costs k grams but one word: what found grams cover is counted in words.
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda q: F.sequence(q, q + (k - 1))))))
    cover = covered / F.col("template_words")
    whole = (F.col("exact") & (F.col("cover") == 1)) | (~F.col("exact") & (F.col("cover") >= min_cover) & (F.col("end") - F.col("start") <= 1.5 * F.col("template_words")))
    spans = spans.withColumn("cover", F.when(F.col("template").isNull(), 0.0).otherwise(cover))
    return spans.select("row", "doc_id", "n_words", "label", "exact", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "cover", F.coalesce(whole, F.lit(False)).alias("accepted"))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document, made from its spans."""
    spans = license_spans(docs, **options)
    base = F.col("exact") & F.col("accepted")
    listed = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("accepted")).alias("labels"),
        F.max(F.least("cover", F.lit(1.0))).alias("score"),
    ).drop("row")
