"""License scan by diagonal voting, in DataFrame functions only.

A document's rolling word grams meet the grams of all templates in one broadcast hash
join with the fixed template table. A hit votes for the diagonal ``document position -
template position``; diagonals near each other belong to one copy with words put in or
left out. Grams are hashed for the join and compared word by word in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweir.llm.common import fold_ascii, stored

# fixed values: base phrases and their labels
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# fixed values: characteristic passages of public licenses and their labels
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("released under the mit license", "mit"),
)
MIN_COVERAGE = 0.8
MAX_DRIFT = 2
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A gram that every document has once, in front of its words; no word can be like it.
MARK = "\x00"


def license_words(text: Column) -> Column:
    """Runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII."""
    return F.array_remove(F.split(fold_ascii(text), WORD_BREAK), "")


def template_grams(spark: SparkSession) -> DataFrame:
    """Template positions: two-word grams of base phrases, three-word grams of passages; a fixed table."""
    rows = [(MARK, MARK, None, -1, 0, 1, "", False)]
    for number, (phrase, label) in enumerate(BASE + PASSAGES):
        words, base = phrase.split(), number < len(BASE)
        k = 2 if base else 3
        for at in range(len(words) - k + 1):
            rows.append((words[at], words[at + 1], None if base else words[at + 2], number, at, len(words) - k + 1, label, base))
    names = "t0 string, t1 string, t2 string, template int, t_pos int, grams int, label string, base boolean"
    return spark.createDataFrame(rows, names).withColumn("gram", F.xxhash64("t0", "t1"))


def diagonal_votes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Votes per (document row, template, diagonal); every document has the diagonal of the mark (template -1)."""
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), license_words(F.col(text)).alias("words")
    )
    marked = F.concat(F.array(F.lit(MARK), F.lit(MARK)), F.col("words"))
    lanes = [marked] + [F.slice(marked, i, F.greatest(F.size(marked) - (i - 1), F.lit(0))) for i in (2, 3)]
    grams = words.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.posexplode(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(lanes)])).alias("pos", "g"),
    ).select("row", "doc_id", "n_words", (F.col("pos") - 2).alias("pos"), F.xxhash64("g.w0", "g.w1").alias("gram"), "g.w0", "g.w1", "g.w2")
    same = (
        (F.col("d.gram") == F.col("t.gram")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
        & (F.col("t2").isNull() | (F.col("w2") == F.col("t2")))
    )
    # the template table is a constant of this module, a few hundred rows
    hits = grams.alias("d").join(F.broadcast(template_grams(docs.sparkSession).alias("t")), same)
    return hits.groupBy("row", "doc_id", "n_words", "template", "grams", "label", "base", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("t_pos").alias("t_first"), F.max("t_pos").alias("t_last")
    )


def license_spans(votes: DataFrame) -> DataFrame:
    """Verified spans: whole base phrases, and passages covered to MIN_COVERAGE by neighbouring diagonals.

    A base phrase needs every gram of it on one diagonal. Diagonals of a passage that
    lie at most MAX_DRIFT words from the one before are one copy; its coverage counts
    the grams found, at most once each, and a span more than half as long again as the
    passage is not one.
    """
    base = votes.filter("base and votes = grams").select(
        "row", "template", "label", "base", F.col("diagonal").alias("first"), F.lit(1.0).alias("coverage")
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(near)
    copies = (
        votes.filter("not base and template >= 0")
        .withColumn("opens", F.when(step <= MAX_DRIFT, 0).otherwise(1))
        .withColumn("copy", F.sum("opens").over(near))
        .groupBy("row", "template", "label", "base", "grams", "copy")
        .agg(
            F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("t_first")).alias("first"),
            F.max(F.col("diagonal") + F.col("t_last")).alias("last"),
        )
    )
    coverage = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    long = copies.filter((coverage >= MIN_COVERAGE) & (F.col("last") - F.col("first") < 1.5 * F.col("grams")))
    return base.unionByName(long.select("row", "template", "label", "base", "first", coverage.alias("coverage")))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """License facts of every document: words, base places, labels and a score.

    Words stand at positions from 0. ``n_base``, ``first_word`` and ``last_word`` cover base phrases;
    ``labels`` adds those of passages; ``score`` is the best coverage, 0 without any. Null
    and empty texts have no words; documents without hits keep their row.
    """
    # read three times; stored, the text is scanned once and rows keep their numbers
    votes = stored(diagonal_votes(docs, text, doc_id))
    spans = license_spans(votes)
    marks = votes.filter("template = -1").select("row", "doc_id", "n_words", F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("base"), F.lit(None).cast("long").alias("first"), F.lit(0.0).alias("coverage"))
    found = spans.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), "label", "base", F.col("first").cast("long").alias("first"), "coverage")
    start = F.when(F.col("base"), F.col("first"))

    def joined(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    return (
        marks.unionByName(found).groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(start).alias("n_base"),
            F.min(start).alias("first_word"), F.max(start).alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("coverage").alias("score"),
        )
        .drop("row")
    )
