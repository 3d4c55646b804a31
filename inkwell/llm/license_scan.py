"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a text is hashed and joined to the positions the same k-gram has
in the templates. Hits of one template on one diagonal (text position minus template
position) are aligned: they vote together. Neighbouring diagonals, a few inserted or missing
words apart, are merged, and a merged span is verified by the share of the template's
words that its k-grams cover: a word put in costs nothing, one replaced or left out costs itself.
Notices of fewer than ten words differ from each other by one word, so they need all of theirs.

Phrases must stand word for word: all of a phrase's 2-grams on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.exact_dedup import lower_ascii
from inkwell.llm.license_texts import paragraphs

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_GRAM, NOTICE_GRAM = 2, 3
NEAR_DIAGONALS = 2  # words that may be inserted or missing between two stretches of one span
VERIFIED_SHARE = 0.9  # of a notice's words

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Opening words of well-known license notices.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]

# What is looked for by default: the openings, and whole paragraphs of notices and licenses, of any length.
TEMPLATES = NOTICES + paragraphs()

NO_HASH = -7046029254386353131  # marks the one row that every text has, k-grams or not


def words(text: Column) -> Column:
    """Runs of digits, small letters and non-ASCII characters, A-Z lower-cased; NULL is empty."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def rolling(hashed: Column, k: int) -> Column:
    """One hash per k neighbouring words, in order; ``hashed`` holds the words' own hashes."""
    n = F.size(hashed)
    gram = lambda i: F.xxhash64(F.lit(k), *(F.get(hashed, i + j) for j in range(k)))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), gram)).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession, phrases: list = PHRASES, notices: list = TEMPLATES) -> DataFrame:
    """(template, label, phrase, k, grams, hash, at): a row per k-gram position of every template, and the sentinel.

    As many rows as the templates have words: a fixed size, whatever the corpus."""
    known = [(t, label, True, PHRASE_GRAM) for t, label in phrases] + [(t, label, False, NOTICE_GRAM) for t, label in notices]
    fields = ("template", "text", "label", "phrase", "k")
    listed = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(fields, (i, *row), strict=True))) for i, row in enumerate(known)))
    split = spark.range(1).select(F.explode(listed).alias("_t")).select("_t.*").withColumn("_h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    grams = F.when(F.col("k") == PHRASE_GRAM, rolling(F.col("_h"), PHRASE_GRAM)).otherwise(rolling(F.col("_h"), NOTICE_GRAM))
    placed = split.withColumn("_g", grams).select("template", "label", "phrase", "k", F.size("_g").alias("grams"), F.posexplode("_g").alias("at", "hash"))
    sentinel = spark.range(1).select(
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("phrase"), F.lit(0).alias("k"), F.lit(1).alias("grams"), F.lit(0).alias("at"), F.lit(NO_HASH).cast("long").alias("hash")
    )
    return placed.unionByName(sentinel)


def hits(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every k-gram of every text that stands in a template: _row, doc_id, n_words, template..., diagonal, at."""
    split = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_w"))
    hashed = split.select("_row", "doc_id", F.size("_w").alias("n_words"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    grams = F.concat(F.array(F.lit(NO_HASH).cast("long")), rolling(F.col("_h"), PHRASE_GRAM), rolling(F.col("_h"), NOTICE_GRAM))
    # The outer form computes the array once; it always holds the sentinel.
    placed = hashed.select("_row", "doc_id", "n_words", F.posexplode_outer(grams).alias("_i", "hash"))
    joined = placed.join(F.broadcast(known), "hash")
    place = F.when(F.col("k") == PHRASE_GRAM, F.col("_i") - 1).otherwise(F.col("_i") - F.col("n_words"))
    return joined.select("_row", "doc_id", "n_words", "template", "label", "phrase", "k", "grams", "at", (place - F.col("at")).alias("diagonal"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list = PHRASES, notices: list = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base`` columns tell of the phrases; ``labels`` adds the notices whose spans are verified;
    ``score`` is the largest share of k-grams found of any template. NULL and empty texts have no words, labels ''
    and score 0. Repeated rows are scanned one by one. Other columns are not read."""
    spark = docs.sparkSession
    found = hits(docs, templates(spark, phrases, notices), id_col, text_col)
    keys = ["_row", "doc_id", "n_words", "template", "label", "phrase", "k", "grams"]
    order = Window.partitionBy("_row", "template").orderBy("diagonal")
    near = F.when(F.col("phrase"), 0).otherwise(NEAR_DIAGONALS)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True))
    spans = found.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(order))
    places = spans.groupBy(*keys, "_span", "at").agg(F.min("diagonal").alias("diagonal"))
    # A k-gram covers k words, or those up to where the next one that is held begins.
    after = F.lead("at").over(Window.partitionBy("_row", "template", "_span").orderBy("at")) - F.col("at")
    places = places.withColumn("_words", F.least(F.coalesce(after, F.col("k")), F.col("k")))
    merged = places.groupBy(*keys, "_span").agg(F.count("*").alias("held"), F.sum("_words").alias("covered"), F.min("diagonal").alias("diagonal"))
    exact = F.col("phrase") & (F.col("held") == F.col("grams"))
    share = F.when(F.col("template") >= 0, F.col("held") / F.col("grams")).otherwise(0.0)
    verified = ~F.col("phrase") & (F.col("template") >= 0) & (F.col("covered") >= VERIFIED_SHARE * (F.col("grams") + F.col("k") - 1))
    per_doc = merged.groupBy("_row", "doc_id", "n_words").agg(
        F.sum(exact.cast("long")).alias("n_base"),
        F.min(F.when(exact, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact | verified, F.col("label")))), ",").alias("labels"),
        F.max(share).alias("score"),
    )
    return per_doc.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
