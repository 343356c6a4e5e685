"""License scans by diagonal voting: rolling word k-grams joined to the positions of templates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (name, label, text, exact).  Of an exact template only whole occurrences count; these are the base phrases.
TEMPLATES = [
    ("base-mit", "mit", "under the mit license", True),
    ("base-apache-2", "apache-2", "apache license version 2", True),
    ("base-cc-by-nc", "cc-by-nc", "cc by nc", True),
    ("mit-release", "mit", "released under the mit license", False),
    ("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    ("mit-warranty", "mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", False),
    ("apache-2-notice", "apache-2", "licensed under the apache license version 2 0", False),
    ("apache-2-copy", "apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    ("cc-by-nc-notice", "cc-by-nc", "licensed under cc by nc 4 0", False),
    ("cc-by-nc-name", "cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", False),
    ("gpl-3-notice", "gpl-3", "this work is licensed under the gnu general public license version 3", False),
    ("gpl-copy", "gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
    ("bsd-copy", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
]
#: K-grams of templates that may be broadcast, some 100 bytes each.
TEMPLATE_ROWS = 1_000_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_positions(spark: SparkSession, templates, k: int) -> DataFrame:
    """A row for each k-gram of each template (a list in the program), at most TEMPLATE_ROWS, as it is broadcast.

    An empty list gives no rows; a template of fewer than k words raises ValueError.
    """
    rows = []
    for name, label, text, exact in templates:
        words = _words(text)
        if len(words) < k:
            raise ValueError(f"{name} has fewer than {k} words")
        rows += [(name, label, exact, len(words), i, *words[i : i + k]) for i in range(len(words) - k + 1)]
    if len(rows) > TEMPLATE_ROWS:
        raise ValueError(f"templates of more than {TEMPLATE_ROWS} k-grams")
    grams = [f"t{j}" for j in range(k)]
    df = spark.createDataFrame(rows, "template string, label string, exact boolean, size int, at int, " + ", ".join(f"{g} string" for g in grams))
    return df.withColumn("gram", F.xxhash64(*grams))


def license_spans(docs: DataFrame, templates=TEMPLATES, k: int = 3, gap: int = 2, share: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verified spans of license texts in each document, as arrays.

    Returns one row per row of docs: id_col, n_words, spans: array<struct<template, label, exact, first, last, share>>
    (words from 0, last inclusive), in order of place.  An exact template has a span at each place where all its words
    stand in a row.  Another has one where, on neighbouring diagonals (offsets that differ by gap at most), at least
    the given share of its k-grams matched.

    A null or empty text has no words and no spans.  A null id is kept.  Rows that are alike come back as often.  The
    words of a text are never copied into a shuffle: only k-grams that equal one of a template are.
    """
    spark = docs.sparkSession
    if k < 1:
        raise ValueError("k: 1 or more")
    lookup = template_positions(spark, templates, k)
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.filter(F.split(text, GAP, -1), lambda w: w != "").alias("w"))
    # place -1 stands for the document itself, so that one scan gives the words' number and the matches
    places = base.select("id", "key", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("w") - k))).alias("place"))
    word = lambda j: F.when(F.col("place") >= 0, F.get("w", F.col("place") + j))
    grams = places.select("id", "key", F.when(F.col("place") < 0, F.size("w")).alias("n_words"), "place", *(word(j).alias(f"g{j}") for j in range(k)))
    grams = grams.withColumn("gram", F.when(F.col("place") >= 0, F.xxhash64(*(f"g{j}" for j in range(k)))))
    same = F.lit(True)
    for j in range(k):
        same = same & (F.col(f"g{j}") == F.col(f"t{j}"))
    hits = grams.join(F.broadcast(lookup), (grams["gram"] == lookup["gram"]) & same, "left").where("place < 0 or template is not null")
    hits = hits.select("id", "key", "n_words", "place", "template", "label", "exact", "size", "at").repartition("id", "key")

    votes = hits.groupBy("id", "key", "template", "label", "exact", "size", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.max("n_words").alias("n_words"), F.sum(F.when(F.col("place") < 0, 1)).alias("rows"))
    order = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= gap) & ~F.col("exact")
    votes = votes.withColumn("island", F.sum(F.when(near, 0).otherwise(1)).over(order))
    merged = votes.groupBy("id", "key", "template", "label", "exact", "size", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.min(F.col("diagonal") + F.array_min("ats")).alias("first"), F.max(F.col("diagonal") + F.array_max("ats") + k - 1).alias("last"),
        F.max("n_words").alias("n_words"), F.max("rows").alias("rows"))
    part = F.col("votes") / (F.col("size") - k + 1)
    span = F.when(F.col("template").isNotNull() & (part >= F.when(F.col("exact"), 1.0).otherwise(share)), F.struct("first", "last", "template", "label", "exact", part.alias("share")))
    per_row = merged.groupBy("id", "key").agg(F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.array_sort(F.collect_list(span)).alias("spans"))
    out = per_row.select(F.col("id").alias(id_col), "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_copy"))
    return out.drop("_copy")
