"""License scans by diagonal voting, with DataFrame functions only.

Words of a text are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Every rolling two-word gram of every text is
joined by its hash (and confirmed by its words) to the places of the same gram in the templates, a broadcast
table of fixed size. A match votes for a diagonal, the difference of the two places; votes are aggregated by row of
the table, template and diagonal, as a mask of the template places that are met. A phrase template stands where one diagonal
meets every place. For a notice template diagonals of at least two places that differ by at most two from the next are
merged, which bridges a word put in or left out; a chain of them that would reach over more than twice the
template's length is cut there into spans. A span's cover is the number of distinct places it meets, out of all; it is
verified if that is at least 60 %.

score: 1 with a phrase, else the best cover of a span (also below 60 %), else 0.

The texts are read and split once: each row of the table hands on one row of its own beside its matches.

Defined cases: null is empty; an empty text has no word, no place and no label (empty strings); every row votes for
itself, also where rows repeat a doc_id or have none; columns other than doc_id and text are never read; a template of
more than 64 grams, or of one word, raises ValueError.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Openings of public license notices and their labels, 60 words at most.
NOTICES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHIFT, COVER, STRETCH, MOST_GRAMS = 2, 0.6, 2, 64
#: The one letter outside ASCII whose lower case is an ASCII letter, and another letter that lower-casing keeps outside ASCII.
KELVIN, OTHER = "K", "Å"

Templates = Sequence[tuple[str, str]]


def places(phrases: Templates = PHRASES, notices: Templates = NOTICES) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, is a phrase, its number of words, place, gram) of every gram of every template."""
    out = []
    for k, (text, label) in enumerate((*phrases, *notices)):
        words = text.split()
        if not 2 <= len(words) <= MOST_GRAMS + 1:
            raise ValueError(f"template {k} has {len(words)} words, not 2 to {MOST_GRAMS + 1}")
        out += [(k, label, k < len(phrases), len(words), i, f"{words[i]} {words[i + 1]}") for i in range(len(words) - 1)]
    return out


def words(text: F.Column) -> F.Column:
    """Words with A-Z in lower case; other letters may change too, but none of them into an ASCII letter."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER))), F.lit(f"({WORD})"), F.lit(1))


def template_places(spark: SparkSession, phrases: Templates = PHRASES, notices: Templates = NOTICES) -> DataFrame:
    schema = "template int, label string, phrase boolean, size int, place int, gram string"
    return spark.createDataFrame(places(phrases, notices), schema).withColumn("hash", F.xxhash64("gram"))


def spans(docs: DataFrame, phrases: Templates = PHRASES, notices: Templates = NOTICES) -> DataFrame:
    """row, doc_id, n_words, template, label, phrase, first_word, last_word, cover of every span, and of every row without one.

    ``row`` numbers the rows of docs; a row in which nothing is found comes once, with nulls from ``template`` on.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    grams = F.zip_with("w", F.expr("slice(w, 2, greatest(size(w) - 1, 0))"), lambda a, b: F.concat_ws(" ", a, b))
    each = base.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(grams).alias("i", "gram"))
    known = template_places(docs.sparkSession, phrases, notices)
    met = each.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(known), ["hash", "gram"], "left").where("template IS NOT NULL OR coalesce(i, 0) = 0")
    own = ["row", "doc_id", "n_words"]
    which = ["template", "label", "phrase", "size"]
    diagonals = met.groupBy(*own, *which, (F.col("i") - F.col("place")).alias("d")).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("seen"), F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"))
    stands = F.col("template").isNotNull() & (F.bit_count("seen") >= F.expr("IF(phrase, size - 1, 2)"))
    found = diagonals.select(*own, *(F.when(stands, F.col(c)).alias(c) for c in (*which, "d", "seen", "lo", "hi")))

    by = Window.partitionBy("row", "template").orderBy("d")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("phrase") | F.lag("d").over(by).isNull() | (F.col("d") - F.lag("d").over(by) > SHIFT)
    chained = found.withColumn("start", F.when(fresh, F.col("d"))).withColumn("start", F.max("start").over(so_far))
    chained = chained.withColumn("part", F.floor((F.col("d") - F.col("start")) / ((STRETCH - 1) * F.col("size"))))
    merged = chained.groupBy(*own, *which, "start", "part").agg(F.bit_count(F.bit_or("seen")).alias("places"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.select(*own, "template", "label", "phrase", F.col("lo").cast("long").alias("first_word"), F.col("hi").cast("long").alias("last_word"), (F.col("places") / (F.col("size") - 1)).alias("cover"))


def scan(docs: DataFrame, phrases: Templates = PHRASES, notices: Templates = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs."""
    base = F.col("phrase")
    place, label = F.when(base, F.col("first_word")), F.col("label")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans(docs, phrases, notices).groupBy("row", "doc_id", "n_words").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"), joined(F.when(base, label)).alias("base_labels"),
        joined(F.when(base | (F.col("cover") >= COVER), label)).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score")).drop("row")
