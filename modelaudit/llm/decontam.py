"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over successive words that ignores some positions, so a hit survives substitutions there. Every
window of every benchmark text and of every document is hashed under each mask, equal hashes are joined, and each joined
pair fixes an alignment of document and benchmark text (their offset). The masks leave out nothing: whichever words differ,
an alignment that counts has a hit of one of ``MASKS`` (texts of ``WINDOW`` words or more) or of ``SHORT_MASKS`` (shorter ones;
documents are hashed under these only if the benchmark has such texts). A test goes through all patterns. An alignment counts if, within some run of
``WINDOW`` aligned words (the whole text if it is shorter), at least ``SHARE`` of the words are equal. DataFrame expressions only.

Benchmark texts under ``SPAN`` words are too short to differ in part: those of ``LEAST`` words or more count where all their
words stand consecutively, shorter ones where they are a document's only words. Documents are hashed for short texts only if
the benchmark has some.

The benchmark's hashes and words are written and their bytes counted: up to ``BROADCAST_BYTES`` they are broadcast, so documents
are hashed and probed where they are read; beyond that they are shuffled. Only documents with hits are read again for
verification.

Words are maximal runs of letters and digits, lower-cased. Defined cases: null texts and those without words match nothing;
benchmark rows with equal words count once, under their smallest id; rows of documents that repeat an id and text have one
result; null ids are kept as ids; other columns are ignored; empty tables give empty results. A long text is one array of
8-byte hashes a word, and of one for each mask and word while it is probed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm.exprs import let
from modelaudit.llm.storage import materialize

MASKS = ("111011101", "1110100111", "1001110111")
SHORT_MASKS = ("111011", "11010011", "11111")
LEAST, SPAN, WINDOW, SHARE, BROADCAST_BYTES = 5, 10, 13, 0.8, 64 << 20
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(hashes: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """Hashes of all windows, mask after mask; an array of (number of masks) * (windows) values, null where a mask is wider than
    what is left of the text. ``hashes`` must be cheap to repeat."""
    n = F.size(hashes)

    def of(mask: str) -> Column:
        kept = [i for i, x in enumerate(mask) if x == "1"]
        seed = lambda i: F.xxhash64(F.lit(mask), *[F.get(hashes, i + F.lit(j)) for j in kept])
        return F.transform(F.sequence(F.lit(0), windows(n, masks) - F.lit(1)), lambda i: F.when(i + F.lit(len(mask)) <= n, seed(i)))

    return F.when(windows(n, masks) > 0, F.concat(*[of(m) for m in masks]))


def windows(n_words: Column, masks: tuple[str, ...]) -> Column:
    """Windows of the narrowest mask; 0 or less: none."""
    return n_words - F.lit(min(map(len, masks)) - 1)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_words): one row for each distinct sequence of words, under its smallest id."""
    rows = benchmark.select("item_id", word_hashes(F.col("text")).alias("item_words"))
    return rows.filter(F.size("item_words") > 0).groupBy("item_words").agg(F.min("item_id").alias("item_id")).withColumn("item", F.xxhash64("item_words"))


def _maybe_broadcast(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    arrays = items.select("item", windows(F.size("item_words"), masks).alias("windows"), seeds(F.col("item_words"), masks).alias("s"))
    placed = arrays.select("item", "windows", F.posexplode("s").alias("at", "seed"))
    return placed.filter("seed is not null").select("seed", "item", F.pmod("at", "windows").alias("item_at"))


def hits(docs: DataFrame, masks: tuple[str, ...], seed_bytes: int, seed_table: DataFrame) -> DataFrame:
    """Distinct (doc_id, text_hash, item, shift) with equal seeds; shift: where the benchmark text's first word falls."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("w"))
    arrays = hashed.select("doc_id", "text_hash", windows(F.size("w"), masks).alias("windows"), let(F.col("w"), lambda w: seeds(w, masks)).alias("s"))
    # outer: for an inner one Spark infers a filter on the array and computes it once more to test that
    placed = arrays.select("doc_id", "text_hash", "windows", F.posexplode_outer("s").alias("at", "seed"))
    found = placed.join(_maybe_broadcast(seed_table, seed_bytes), "seed")
    shift = F.pmod(F.col("at"), F.col("windows")) - F.col("item_at")
    return found.select("doc_id", "text_hash", "item", shift.alias("shift")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: one row (doc_id, text_hash, item_id, matched, item_words, first_word) for each document and benchmark text."""
    items = materialize(benchmark_items(benchmark), "benchmark-items")
    n = F.size("item_words")
    known = items.agg(F.sum(8 * n + 24).alias("bytes"), F.collect_set(F.when(n < SPAN, n)).alias("short"), F.max((n >= SPAN) & (n < WINDOW)).alias("middling")).first()
    whole = tuple("1" * x for x in sorted(known["short"]) if x >= LEAST)
    table, masks = benchmark_seeds(items.filter(n >= WINDOW), MASKS), MASKS
    if known["middling"]:
        table, masks = table.unionByName(benchmark_seeds(items.filter((n >= SPAN) & (n < WINDOW)), SHORT_MASKS)), masks + SHORT_MASKS
    for mask in whole:
        table = table.unionByName(benchmark_seeds(items.filter(n == len(mask)), (mask,)))
    table = materialize(table, "benchmark-seeds")
    found = hits(docs, masks + tuple(m for m in whole if m not in masks), 32 * table.count(), table)
    if any(x < LEAST for x in known["short"]):
        tiny = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("w")).filter(F.size("w").between(1, LEAST - 1))
        tiny = tiny.join(_maybe_broadcast(items.filter(n < LEAST).select("item"), known["bytes"]), F.xxhash64("w") == F.col("item"))
        found = found.unionByName(tiny.select("doc_id", "text_hash", "item", F.lit(0).alias("shift")).distinct())
    found = materialize(found, "benchmark-hits")
    hit_docs = found.join(_maybe_broadcast(items, known["bytes"] or 0), "item")
    wanted = found.select(F.col("doc_id").alias("_w"), F.col("text_hash").alias("_h")).distinct()
    texts = docs.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_hash"))
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_w")) & (F.col("_hash") == F.col("_h")), "left_semi")
    texts = texts.select("_id", "_hash", word_hashes(F.col("text")).alias("w")).dropDuplicates(["_id", "_hash"])
    aligned = hit_docs.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # an index below 0 is outside the document, like one beyond its end
    at = lambda j: F.col("shift") + j
    equal = F.transform("item_words", lambda x, j: F.when((at(j) >= 0) & (F.get("w", at(j)) == x), 1).otherwise(0))
    aligned = aligned.withColumn("equal", equal)
    width = F.least(F.size("equal"), F.lit(WINDOW))
    runs = F.transform(F.sequence(F.lit(0), F.size("equal") - width), lambda i: F.aggregate(F.slice("equal", i + 1, width), F.lit(0), lambda a, x: a + x))
    aligned = aligned.withColumns({"best_run": F.array_max(runs), "matched": F.aggregate("equal", F.lit(0), lambda a, x: a + x), "width": width})
    enough = F.when(F.size("equal") < SPAN, F.col("width")).otherwise(F.ceil(F.col("width") * SHARE))
    good = aligned.filter((F.col("best_run") >= enough) & ((F.size("equal") >= LEAST) | (F.size("w") == F.size("equal"))))
    return good.groupBy("doc_id", "text_hash", "item_id").agg(F.max("matched").alias("matched"), F.first(F.size("item_words")).alias("item_words"), F.min(F.greatest("shift", F.lit(0))).alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap with a benchmark text."""
    bad = materialize(overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return overlaps(docs, benchmark).drop("text_hash")


#: Without seeds: equal words fix a shift each, and a shift counts if enough of them fall into one window.
SQL = rf"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '{NOT_WORD}'), lambda w: w <> '') AS ws FROM (SELECT DISTINCT doc_id, text FROM documents)),
b0 AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '{NOT_WORD}'), lambda w: w <> '') AS ws FROM benchmark),
b1 AS (SELECT min(item_id) AS item_id, ws, len(ws) AS n FROM b0 WHERE len(ws) > 0 GROUP BY ws),
b AS MATERIALIZED (SELECT item_id, n, unnest(ws) AS w, unnest(range(0, n)) AS j, CASE WHEN n < {SPAN} THEN n ELSE CAST(ceil(least(n, {WINDOW}) * {SHARE}) AS BIGINT) END AS need FROM b1),
d AS (SELECT r, doc_id, len(ws) AS words, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM d0),
s AS (SELECT r, any_value(doc_id) AS doc_id, item_id, i - j AS shift, any_value(n) AS n, any_value(need) AS need, list(j ORDER BY j) AS js FROM d JOIN b ON d.w = b.w
      WHERE n >= {LEAST} OR n = words GROUP BY r, item_id, i - j HAVING count(*) >= any_value(need)),
g AS (SELECT *, list_max(list_transform(range(1, len(js) - need + 2), lambda k: CASE WHEN js[k + need - 1] - js[k] < {WINDOW} THEN 1 ELSE 0 END)) AS ok FROM s)
SELECT doc_id, item_id, CAST(max(len(js)) AS INTEGER) AS matched, CAST(max(n) AS INTEGER) AS item_words, CAST(min(greatest(shift, 0)) AS INTEGER) AS first_word
FROM g WHERE ok = 1 GROUP BY r, doc_id, item_id
"""
