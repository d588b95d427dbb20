"""License scans by diagonal voting, in DataFrame operations only.

Every run of ``K`` words of every document is hashed and joined to the places where the same run
stands in a license template. Hits on one diagonal (document place less template place) vote
together; diagonals that differ by at most ``MERGE`` words are merged, so small insertions and
losses don't break a match; a merged span is verified by the share of the template's words that it
covers. Phrases of two or three words are looked for in full beside it.

Defined results: null texts are empty; documents without places have null word numbers, empty label
strings and score 0; documents that repeat in id and text get equal rows; an empty table gives no
rows; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import picked

K = 5
MERGE = 3
COVERAGE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

#: Openings and notices of common licenses (their public texts).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once for each row."""
    return F.transform(F.array(value), use)[0]


def gram_hashes(text: Column) -> Column:
    """Hashes of all runs of ``K`` words of a lower-case text, in order."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(K)]))
    return bound(hashed, lambda h: F.when(F.size(h) >= K, runs(h)).otherwise(F.array().cast("array<bigint>")))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, label, template_words, place, gram): one row for each run of each template."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)])
    table = spark.range(1).select(F.inline(rows)).withColumn("low", lowered(F.col("text")))
    return table.select("template", "label", F.size(words(F.col("low"))).alias("template_words"), F.posexplode(gram_hashes(F.col("low"))).alias("place", "gram"))


def _places(low: Column, phrase: tuple[str, ...]) -> Column:
    """Starts of a phrase among the words; texts without its letters are passed over quickly."""
    at = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _all([F.get(w, i + k) == p for k, p in enumerate(phrase)]))
    none = F.array().cast("array<int>")
    found = bound(words(low), lambda w: F.when(F.size(w) >= len(phrase), at(w)).otherwise(none))
    return F.when(_all([F.contains(low, F.lit(p)) for p in phrase]), found).otherwise(none)


def _all(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def spans(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(key, template, label, first_word, last_word, coverage) of every verified span; ``docs`` has (key, low)."""
    known = template_grams(docs.sparkSession, templates or TEMPLATES)
    grams = docs.select("key", F.posexplode(gram_hashes(F.col("low"))).alias("at", "gram"))
    hits = grams.join(F.broadcast(known), "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    votes = hits.groupBy("key", "template", "label", "template_words", "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    # neighbouring diagonals of one template in one document
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= MERGE, 0).otherwise(1)
    merged = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(by)).groupBy("key", "template", "label", "template_words", "span").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first_word"), (F.max("last") + K - 1).alias("last_word"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (K - 1))))))
    share = covered / F.greatest("template_words", F.col("last_word") - F.col("first_word") + 1 - 2 * MERGE)
    found = merged.select("key", "template", "label", "first_word", "last_word", share.alias("coverage")).where(F.col("coverage") >= coverage)
    # of templates that begin at about the same word (versions of one license) the best covered stay
    rival = F.max("coverage").over(Window.partitionBy("key").orderBy("first_word").rangeBetween(-K, K))
    return found.withColumn("best", rival).where("coverage >= best").drop("best")


def report(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """The contract's rows: one per document."""
    docs, low = picked(docs, "doc_id", "text"), lowered(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), low.alias("low"))
    found = spans(rows.select("key", "low"), templates=templates).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"), F.min("first_word").alias("span_first"), F.max("last_word").alias("span_last"))
    each = {label: _places(F.col("low"), phrase) for label, phrase in PHRASES.items()}
    base = rows.select("doc_id", "key", F.size(words(F.col("low"))).cast("long").alias("n_words"), *[p.alias(label) for label, p in each.items()])
    places = F.concat(*[F.col(f"`{label}`") for label in PHRASES])
    labels = F.array_compact(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, F.lit(label)) for label in PHRASES]))
    base = base.select("doc_id", "key", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.sort_array(labels).alias("base"))
    none = F.array().cast("array<string>")
    joined = base.join(found, "key", "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("found", none)))).alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"), "span_first", "span_last",
    )
