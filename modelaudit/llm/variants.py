"""Spelling variants of words: words one edit apart, found through pivotal grams, and the form that each belongs to.

1. Words are runs of Latin letters of whole texts, counted over all documents.
2. Bigrams of a word are ordered by how many words have them, rarest first. With one edit, a word's prefix is its three rarest
   bigrams (and any that are as rare as the third): two edits' worth of grams and one more. Of these a dynamic program picks
   two that don't overlap and have the least frequencies in sum: the pivots. One edit destroys one of two disjoint grams at most.
3. Of two words one edit apart, that with the lower third gram has a pivot which the other has among its prefix. Pivots
   are joined to prefixes on the gram with what lies before it, or with what lies behind it: the edit is on one side only, so
   the other side is the same in both words. That is the position limit: equal heads put the gram at the same place, equal
   tails at the same distance from the end, and lengths differ by one at most.
4. What meets is verified by edit distance inside the join, so only true pairs leave it.

A word's form is its most frequent near word, if that is ``TIMES`` times as frequent. Counts rise by that factor along forms, so
there are no cycles, and roots are found by doubling the way a few times.

Grams are of the alphabet of the runs (90 letters, so 8,100 grams at most), and their frequencies are broadcast. All is Spark
expressions; a gram with very many words is a key that Spark splits like any other.

Defined cases: a null text has no words; a null id is an empty string in the hash that picks what loses a letter; rows that
repeat an id are rows of their own and count each; long texts are matched by one expression, whose matches are held at once;
ties in count go to the smaller word; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm.exprs import LOWER, UPPER, let
from modelaudit.llm.storage import materialize

LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGED = 6, 5, 5, 199
LETTERS = r"A-Za-zÀ-ÿ"


def damaged(run: Column, doc_id: Column, of: int = DAMAGED) -> Column:
    """The run without one code point, if ``of`` divides the crc32 of ``<doc_id>:<run>``; else the run."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = lambda h: F.pmod(h, F.length(run)).cast("int")
    cut = lambda h: F.concat(F.substr(run, F.lit(1), at(h)), F.substr(run, at(h) + 2))
    return let(crc, lambda h: F.when(h % of == 0, cut(h)).otherwise(run))


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, of: int = DAMAGED) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur ``least_count`` times. Shorter runs are never matched:
    losing a letter makes no run longer."""
    pattern = F.lit(f"[{LETTERS}]{{{least_length},}}")
    runs = docs.select(F.col(id).alias("id"), F.explode(F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias("run"))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    words = runs.select(damaged(F.col("run"), F.col("id"), of).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def pivots(prefix: Column) -> Column:
    """Two disjoint grams (structs of f, g, p) with the least sum of f: the best pair that ends with each gram takes the best single
    gram two places or more before it."""
    single = lambda p: F.array_min(F.filter(prefix, lambda x: x["p"] <= p - 2))
    ending = lambda b: let(single(b["p"]), lambda a: F.when(a.isNotNull(), F.struct((a["f"] + b["f"]).alias("cost"), a.alias("a"), b.alias("b"))))
    return let(F.array_min(F.array_compact(F.transform(prefix, ending))), lambda best: F.array(best["a"], best["b"]))


def gram_table(words: DataFrame) -> DataFrame:
    """(word, size, last, prefix): grams up to the third rarest, and that one's (f, g)."""
    places = F.sequence(F.lit(0), F.length("word") - 2)
    grams = words.select("word", F.posexplode(F.transform(places, lambda i: F.substr("word", i + 1, F.lit(2)))).alias("p", "g"))
    frequency = grams.groupBy("g").agg(F.count("*").alias("f"))  # 8,100 rows at most: pairs of 90 letters
    grams = grams.join(F.broadcast(frequency), "g")
    table = grams.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("f", "g", "p"))).alias("grams"))
    third = F.get("grams", F.lit(2))
    table = table.select("word", F.length("word").alias("size"), F.struct(third["f"].alias("f"), third["g"].alias("g")).alias("last"), "grams")
    upto = lambda x: F.struct(x["f"].alias("f"), x["g"].alias("g")) <= F.col("last")
    return table.withColumn("prefix", F.filter("grams", upto)).drop("grams")


def _sides(p: Column) -> Column:
    """A gram with all before it, and with all behind it."""
    return F.array(F.concat(F.lit("<"), F.substr("word", F.lit(1), p + 2)), F.concat(F.lit(">"), F.substr("word", p + 1)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: words (of three code points or more) that differ by exactly one inserted, deleted or replaced code point."""
    table = materialize(gram_table(words.filter(F.length("word") >= 4)), "variant-grams")
    keys = lambda grams: F.explode(F.array_distinct(F.flatten(F.transform(grams, lambda x: _sides(x["p"]))))).alias("key")
    asked = table.select(F.col("word").alias("a"), F.col("last").alias("a_last"), "size", keys(pivots(F.col("prefix"))))
    asked = asked.withColumn("size", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)))
    known = table.select(F.col("word").alias("b"), F.col("last").alias("b_last"), "size", keys(F.col("prefix")))
    met = (asked["key"] == known["key"]) & (asked["size"] == known["size"]) & (F.col("a_last") <= F.col("b_last")) & (F.levenshtein("a", "b", 1) == 1)
    found = asked.join(known.hint("merge"), met)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    pairs = materialize(near_pairs(words), "variant-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    both = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    table = words.join(best, "word", "left").withColumn("best_n", -F.col("best.less"))
    has = F.col("best_n") >= F.col("n") * times
    table = table.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    table = materialize(table, "variant-forms")
    way = table.filter("form is not null").select("word", F.col("form").alias("top"))
    while True:  # each round doubles the steps that ``top`` is away
        further = way.select(F.col("word").alias("top"), F.col("top").alias("next"))
        moved = materialize(way.join(further, "top", "left").select("word", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        way = moved.select("word", "top")
        if moved.filter("moved").limit(1).count() == 0:
            break
    return table.join(way, "word", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


#: crc32 from its table; near words by what is left without one letter: a word itself, or the same at the same place of another.
SQL = r"""
WITH RECURSIVE bits AS (SELECT n AS i, n AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT run, count(*) AS m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, m, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM d, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT m, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
e AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM w)),
near AS (SELECT e.word AS a, w.word AS b FROM e JOIN w ON e.rest = w.word UNION SELECT w.word, e.word FROM e JOIN w ON e.rest = w.word
         UNION SELECT x.word, y.word FROM e x JOIN e y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word),
b AS (SELECT a AS word, count(*) AS n_near, max(w.n) AS best_n FROM near JOIN w ON w.word = near.b GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n,
        CASE WHEN best_n >= 5 * w.n THEN (SELECT min(y.word) FROM near z JOIN w y ON y.word = z.b WHERE z.a = w.word AND y.n = best_n) END AS form
      FROM w LEFT JOIN b ON b.word = w.word),
up AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word WHERE up.next IS NULL
"""
