"""License scan by diagonal voting.

All rolling word pairs of every text are hashed and joined to the places of equal pairs in the templates. A hit at word ``p``
of a text and word ``q`` of a template votes for the diagonal ``p - q``; votes are gathered by text, template and diagonal,
neighbouring diagonals (words put in or left out) are merged, and spans are verified: a phrase needs all its pairs on one
diagonal, a notice needs ``SHARE`` of its words covered. Pairs are compared by 64-bit hashes; templates are a short fixed list,
which is broadcast.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Base labels come from phrases alone; notices add
labels of their own and a score, the largest covered share (1 for a phrase, 0 without any span).

Defined cases: a null text is an empty one; rows that repeat an id and text have the same result; an id may be null; a
text of one word has no pairs; phrases may overlap and each place counts; other columns are ignored; empty tables give empty
results. A long text is one array of its words and one of their pairs' hashes, which are then rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.llm.exprs import ascii_lower, let
from modelaudit.llm.storage import materialize

SHARE, NEAR_DIAGONAL = 0.8, 3
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def pairs(ws: Column) -> Column:
    """Hashes of each successive pair. ``ws`` must be cheap to repeat."""
    last = F.size(ws) - F.lit(2)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + F.lit(1)))))


def template_pairs(spark: SparkSession) -> DataFrame:
    """(h, template, n_template, q): one row for each word pair of each template."""
    rows = [(i, ws[q], ws[q + 1], len(ws), q) for i, text in enumerate([*PHRASES, *NOTICES]) if (ws := text.split()) for q in range(len(ws) - 1)]
    table = spark.createDataFrame(rows, "template int, t0 string, t1 string, n_template int, q int")
    return table.select(F.xxhash64("t0", "t1").alias("h"), "template", "n_template", "q")


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, n_template, diagonal, places): the template's places that a diagonal hits."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), let(words(F.col("text")), pairs).alias("pairs"))
    # outer: for an inner one Spark infers a filter on the array and computes it once more to test that
    each = keyed.select("doc_id", "text_hash", F.posexplode_outer("pairs").alias("p", "h"))
    found = each.join(F.broadcast(template_pairs(docs.sparkSession)), "h")
    found = found.groupBy("doc_id", "text_hash", "template", "n_template", (F.col("p") - F.col("q")).alias("diagonal"))
    return found.agg(F.collect_set("q").alias("places"))


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: (doc_id, text_hash, template, first_word, covered). Phrases are not merged across diagonals."""
    n_phrases = len(PHRASES)
    phrases = found.filter((F.col("template") < n_phrases) & (F.size("places") == F.col("n_template") - 1))
    phrases = phrases.select("doc_id", "text_hash", "template", F.col("diagonal").alias("first_word"), F.lit(1.0).alias("covered"))
    notices = found.filter((F.col("template") >= n_phrases) & (F.size("places") >= 2))
    by_diagonal = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR_DIAGONAL, F.lit(True))
    runs = notices.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_diagonal))
    both = F.array_distinct(F.flatten(F.collect_list(F.flatten(F.array("places", F.transform("places", lambda q: q + 1))))))
    merged = runs.groupBy("doc_id", "text_hash", "template", "n_template", "run").agg(F.size(both).alias("n"), F.min("diagonal").alias("first_word"))
    good = merged.withColumn("covered", F.col("n") / F.col("n_template")).filter(F.col("covered") >= SHARE)
    return phrases.unionByName(good.select(phrases.columns))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = F.create_map(*[F.lit(x) for pair in enumerate([*PHRASES.values(), *NOTICES.values()]) for x in pair])
    base = F.col("template") < len(PHRASES)
    label = F.element_at(names, F.col("template"))
    found = spans(materialize(votes(docs), "license-votes")).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.max("covered").alias("score"),
    )
    found = materialize(found, "license-labels").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
