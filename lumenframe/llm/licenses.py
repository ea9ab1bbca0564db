"""License scanning by diagonal voting, with DataFrame operations only.

Every rolling 2-gram of a text is joined by its hash to the positions of the same 2-gram in a set of
license templates. Hits on one diagonal (text position minus template position) line up with the
template; neighbouring diagonals are merged, since an inserted or missing word moves the rest of a
passage by one. A span is verified by comparing the 2-grams themselves and by the share of the
template's positions that it covers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases of the contract and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Openings of public license notices and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased only; other letters keep their case."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z. Texts of ASCII only, most of them, go through lower()."""
    folded = text
    for a, b in zip(UPPER, LOWER, strict=True):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def template_grams(spark: SparkSession, phrases: list, notices: list) -> DataFrame:
    """A row for each 2-gram position of each template; their number is fixed by the two lists."""
    rows = [(-1, "", False, 0, 0, "")]
    for t, (text, label, exact) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        words = re.findall(r"[0-9a-z]+", text)
        rows += [(t, label, exact, i, len(words) - 1, f"{a} {b}") for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    table = spark.createDataFrame(rows, "template int, label string, exact boolean, at int, grams int, gram string")
    return table.withColumn("h", F.xxhash64("gram"))


def scan(docs: DataFrame, phrases: list = PHRASES, notices: list = NOTICES, slack: int = 2, min_cover: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    slack: diagonals at most so far apart are merged, or a quarter of the notice's 2-grams where that is more. min_cover: share of a notice's 2-grams that a span
    must hold. A null or empty text has no words, no places, empty label strings and score 0. Repeated
    rows are scanned each for itself, as is a null doc_id; an empty table gives no rows. Columns other than
    doc_id and text are ignored. The broadcast side is the template table, whose size is fixed by the lists.
    """
    bands = sorted({max(slack, (len(re.findall(r"[0-9a-z]+", text)) - 1) // 4) for text, _ in notices})
    templates = F.broadcast(template_grams(docs.sparkSession, phrases, notices))
    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("words"))
    bound = F.transform(
        F.array("words"),
        lambda w: F.concat(F.transform(w, lambda x, i: F.concat(x, F.lit(" "), F.coalesce(F.get(w, i + 1), F.lit("")))), F.array(F.lit(""))),
    )
    # The empty 2-gram at the end joins the template -1; its position is the number of words.
    grams = keyed.select("doc_id", "row", F.posexplode(F.element_at(bound, 1)).alias("pos", "text_gram")).withColumn("text_h", F.xxhash64("text_gram"))
    hits = grams.join(templates, (F.col("text_h") == F.col("h")) & (F.col("text_gram") == F.col("gram")))
    diagonals = (
        hits.groupBy("row", "template", "label", "exact", "grams", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.first("doc_id").alias("doc_id"), F.collect_set("at").alias("ats"), F.count("*").alias("votes"))
    )
    # A span is a band of neighbouring diagonals from one that has votes; its 2-grams then stand in the template's order, but for words
    # put in or left out, and it is longer than the template by the width of the band at most.
    near = [Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, width) for width in bands]
    in_band = F.lit(0)
    for width, window in zip(bands, near, strict=True):
        in_band = F.when(F.col("band") == width, F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(window))))).otherwise(in_band)
    spans = (
        diagonals.withColumn("band", F.greatest(F.lit(slack), F.floor(F.col("grams") / 4)).cast("int"))
        .withColumn("covered", F.when(F.col("exact") | (F.col("template") < 0), F.size("ats")).otherwise(in_band))
        .withColumn("cover", F.when(F.col("template") >= 0, F.col("covered") / F.col("grams")).otherwise(0.0))
        .withColumnRenamed("diagonal", "start")
    )
    base = F.col("exact") & (F.col("covered") == F.col("grams"))
    found = base | (~F.col("exact") & (F.col("template") >= 0) & (F.col("cover") >= min_cover))
    labels = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    return (
        spans.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max(F.when(F.col("template") == -1, F.col("start"))).cast("long").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(found).alias("labels"),
            F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
