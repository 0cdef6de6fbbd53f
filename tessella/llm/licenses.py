"""License scans by diagonal voting, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The phrases of the contract, and notices whose wording the licenses themselves prescribe.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "creative commons attribution"),
)
DELIMITER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A notice counts from this share of its word pairs on; a phrase needs all of them.
COVERAGE = 0.8
#: Diagonals at most so many words apart are one occurrence of a notice with words added or left out.
DRIFT = 2


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(id, label, is it a phrase of the contract, words)"""
    named = [(label, True, text) for label, text in PHRASES.items()] + [(label, False, text) for label, text in NOTICES]
    return [(i, label, base, text.split()) for i, (label, base, text) in enumerate(named)]


def template_pairs(spark: SparkSession) -> DataFrame:
    """The places of each word pair in the templates: a table of fixed size."""
    rows = [(i, label, base, len(w) - 1, p, w[p], w[p + 1]) for i, label, base, w in templates() for p in range(len(w) - 1)]
    return spark.createDataFrame(rows, "_template int, _label string, _base boolean, _pairs int, _place int, _t0 string, _t1 string").withColumn("_hash", F.xxhash64("_t0", "_t1"))


def words_of(text: str = "text"):
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), DELIMITER), "")


def license_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), coverage: float = COVERAGE, drift: int = DRIFT) -> DataFrame:
    """A row for each verified span, and one with a null label for each row of docs: _row, keep, n_words, label, base, start, votes, share.

    All word pairs of the texts, hashed, are joined with the templates' places (broadcast: their number is fixed). Hits vote
    for (row, template, place in the text - place in the template); a phrase needs every pair on one diagonal, a notice the
    given share of its pairs on diagonals that neighbour each other. Places met are bits of a long: a template has 64 pairs at most.
    """
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), words_of().alias("_words"))
    pairs = rows.select("_row", *keep, F.size("_words").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("_words").alias("w0"), F.expr("slice(_words, 2, greatest(size(_words), 1))").alias("w1"))).alias("_pos", "_pair"))
    t = F.broadcast(template_pairs(docs.sparkSession))
    met = (F.xxhash64("_pair.w0", "_pair.w1") == t["_hash"]) & (F.col("_pair.w0") == t["_t0"]) & (F.col("_pair.w1") == t["_t1"])
    hits = pairs.join(t, met, "left").where("_template is not null or _pos is null or _pos = n_words - 1")
    by_row = ["_row", *keep, "n_words", "_template", "_label", "_base", "_pairs"]
    diagonals = hits.groupBy(*by_row, (F.col("_pos") - F.col("_place")).alias("_diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, _place)")).alias("_places"), F.min("_pos").alias("_start"))
    w = Window.partitionBy("_row", "_template").orderBy("_diagonal")
    far = F.col("_diagonal") - F.lag("_diagonal").over(w) > F.when(F.col("_base"), 0).otherwise(drift)
    merged = diagonals.withColumn("_group", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(w)).groupBy(*by_row, "_group").agg(F.bit_count(F.bit_or("_places")).cast("long").alias("votes"), F.min("_start").alias("start"))
    share = F.col("votes") / F.col("_pairs")
    enough = F.col("_template").isNull() | F.when(F.col("_base"), F.col("votes") == F.col("_pairs")).otherwise(share >= coverage)
    return merged.where(enough).select("_row", *keep, "n_words", F.col("_label").alias("label"), F.col("_base").alias("base"), F.col("start").cast("long").alias("start"), "votes", share.alias("share"))


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE, drift: int = DRIFT) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words and no labels; rows that repeat give a row each; other columns of docs are not read.
    Of equal starts all count. score is the largest share of a found template's word pairs, 0 without any.
    """
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  at most as many as there are labels
    return (
        license_spans(docs, coverage=coverage, drift=drift)
        .groupBy("_row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.round(F.coalesce(F.max("share"), F.lit(0.0)), 6).alias("score"),
        )
        .drop("_row")
    )
