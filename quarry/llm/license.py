"""License scans by diagonal voting.

All rolling word K-gram hashes of a text are joined to the K-grams of license templates. A hit at word i for a
template's K-gram j votes for the diagonal i - j; votes are summed by diagonal, neighbouring diagonals (words put in
or left out) are merged into spans, and a span's share of the template's K-grams is its score. Every hit is verified
word by word, so equal hashes of other words never count. Base phrases need all their K-grams on one diagonal: that
is, their words in a row. Other templates count from COVERAGE on, those of
at most SHORT K-grams only whole.

The templates are constants, so their side of the join is broadcast whatever the corpus; only hits, and one row a
document, are shuffled. All on Spark's own functions.

Defined cases: null or empty text has no words, no labels, score 0; texts shorter than K words have no K-grams; rows
with the same doc_id and text are counted once and returned as often as they stand; a null doc_id stays null; other
columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import id_back, id_key, text_of

K = 3
DRIFT = 2
COVERAGE = 0.6
#: Templates of at most so many K-grams must be there whole: a word apart is another license.
SHORT = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Wordings of public licenses and notices, at most 62 words each (a vote is a bit of a long).
OTHERS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced"),
)


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, base, words)."""
    both = [(label, True, text) for label, text in BASE] + [(label, False, text) for label, text in OTHERS]
    return [(i, label, base, text.split()) for i, (label, base, text) in enumerate(both)]


def _grams(spark: SparkSession) -> DataFrame:
    """K-grams of the templates; the row with template -1 meets the one row each document sends along."""
    rows = [(i, label, base, j, len(w) - K + 1, w[j : j + K]) for i, label, base, w in templates() for j in range(len(w) - K + 1)]
    found = spark.createDataFrame(rows, "template int, label string, base boolean, at int, grams int, own array<string>")
    found = found.withColumn("gram", F.xxhash64(*[F.get("own", F.lit(k)) for k in range(K)]))
    sent = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("at"), F.lit(1).alias("grams"), F.lit(None).cast("array<string>").alias("own"), F.lit(0).cast("long").alias("gram"))
    return found.unionByName(sent)


def votes(docs: DataFrame) -> DataFrame:
    """One row for each (document, template, diagonal) with its votes, and one (template -1) for each document."""
    words = F.regexp_extract_all(F.translate(text_of(), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(id_key().alias("doc"), F.xxhash64(text_of()).alias("same"), words.alias("words"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(K)]))
    rolled = F.concat(F.array(F.lit(0).cast("long")), F.when(F.size("words") >= K, hashes).otherwise(F.array().cast("array<bigint>")))
    cut = rows.select("doc", "same", "words", F.size("words").cast("long").alias("n_words"), rolled.alias("rolled"))
    every = cut.select("doc", "same", "words", "n_words", F.posexplode_outer("rolled").alias("place", "gram"))
    hits = every.join(F.broadcast(_grams(docs.sparkSession)), "gram")
    start = F.col("place") - 1
    real = (F.col("template") >= 0) & (F.col("place") > 0) & (F.slice("words", F.greatest(F.col("place"), F.lit(1)), K) == F.col("own"))
    kept = hits.where(((F.col("template") < 0) & (F.col("place") == 0)) | real)
    diagonal = F.when(F.col("template") < 0, 0).otherwise(start - F.col("at"))
    return kept.groupBy("doc", "same", "n_words", "template", "label", "base", "grams", diagonal.alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("votes"), F.count("*").alias("rows"))


def spans(found: DataFrame) -> DataFrame:
    """Neighbouring diagonals of a document and template, merged: start, places (whole diagonals) and coverage."""
    own = Window.partitionBy("doc", "same", "template").orderBy("diagonal")
    opens = F.when(F.col("diagonal") - F.lag("diagonal").over(own) <= DRIFT, 0).otherwise(1)
    numbered = found.withColumn("opens", opens).withColumn("span", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.bit_count("votes") == F.col("grams")
    return numbered.groupBy("doc", "same", "n_words", "template", "label", "base", "grams", "span").agg(
        F.min("diagonal").alias("start"),
        F.sum(whole.cast("long")).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
        (F.bit_count(F.bit_or("votes")) / F.col("grams")).alias("coverage"),
        F.max("rows").alias("rows"),
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = spans(votes(docs))
    base = F.col("base") & (F.col("places") > 0)
    named = base | (~F.col("base") & (F.col("template") >= 0) & (F.col("coverage") >= F.when(F.col("grams") <= SHORT, 1.0).otherwise(COVERAGE)))
    joined = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(kind, F.col("label")))), ",")
    out = found.groupBy("doc", "same", "n_words").agg(
        F.sum(F.when(F.col("base"), F.col("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(named).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template") < 0, F.col("rows"))).cast("int").alias("rows"),
    )
    again = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return again.select(id_back("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """The same by SQL: K-grams as lists of words instead of hashes."""
    rows = ", ".join(f"({i}, '{label}', {str(base).lower()}, {len(w) - K + 1}, {j}, {w[j : j + K]!r})" for i, label, base, w in templates() for j in range(len(w) - K + 1))
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') w from documents),
t(template, label, base, grams, pos, own) as (values {rows}),
g as (select doc_id, i - 1 i, w[i : i + {K - 1}] gram from d, unnest(range(1, greatest(len(w) - {K - 2}, 1))) u(i)),
v as (select doc_id, template, label, base, grams, i - pos diagonal, bit_or(1::bigint << pos::bigint) votes from g join t on gram = own group by all),
n as (select *, case when diagonal - lag(diagonal) over p <= {DRIFT} then 0 else 1 end opens from v window p as (partition by doc_id, template order by diagonal)),
m as (select *, sum(opens) over (partition by doc_id, template order by diagonal rows unbounded preceding) span from n),
s as (select doc_id, label, base, span, grams, count(*) filter (where bit_count(votes) = grams) places, min(diagonal) filter (where bit_count(votes) = grams) first,
  max(diagonal) filter (where bit_count(votes) = grams) last, bit_count(bit_or(votes)) / max(grams) coverage from m group by doc_id, template, label, base, grams, span),
r as (select doc_id, sum(places) filter (where base) n_base, min(first) filter (where base and places > 0) first_word, max(last) filter (where base and places > 0) last_word,
  array_to_string(list_sort(list_distinct(list(label) filter (where base and places > 0))), ',') base_labels,
  array_to_string(list_sort(list_distinct(list(label) filter (where (base and places > 0) or (not base and coverage >= case when grams <= {SHORT} then 1.0 else {COVERAGE} end)))), ',') labels, max(coverage) score from s group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0)::double score from d left join r using (doc_id)"""
