"""Site-relative line removal: lines that too large a share of a site's pages carry are boilerplate.

Pages are grouped by host; each distinct line of a page counts once, the count is divided by the host's number of pages,
and lines over ``ratio`` (on at least ``min_pages`` pages) are dropped from all pages of that host. DataFrame expressions only.

Lines are compared without spaces, tabs and carriage returns around them, by two 64-bit hashes; blank lines stay. A
host has at most (lines a page) / ratio such lines, so they are one short list a host. Counting combines before its shuffle, so a common
line or a large host is one row a task. The lists are written and joined back to the pages by host: Spark broadcasts them
if their files are small enough, else pages of a host are dealt over ``SALTS`` partitions. Pages are never regrouped.

Defined cases: a null host is a host of its own; a null text stays null; an empty one stays empty; a page that has nothing but
boilerplate becomes empty and stays; each row counts as a page, rows that repeat an id too; a long text is one array of its lines
and one of two hashes a distinct line; other columns are carried along.

With ``spare_copies`` (for a pipeline that looks for near duplicates next) copies are no boilerplate: rows of a host with
equal texts count as one page, and a page is left whole if the lines that would go are so much of it that two pages with
nothing else in common would be near duplicates (100 * gone >= 75 * (2 * all - gone) characters, six sevenths).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm.exprs import let
from modelaudit.llm.storage import materialize

RATIO, MIN_PAGES, SALTS, NEAR_PERCENT = 0.08, 5, 32, 75
BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit("line")).alias("h2"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, spare_copies: bool = False) -> DataFrame:
    """(host, n_pages, drop): the keys of each host's boilerplate lines; hosts without any are left out."""
    trimmed = F.filter(F.transform(_lines(F.col(text)), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    keys = F.array_distinct(F.transform(trimmed, _key))
    if spare_copies:
        pages = pages.groupBy(F.col(host).alias("host"), _key(F.col(text)).alias("text_key")).agg(F.first(keys).alias("keys"))
        pages, host, keys = materialize(pages.select("host", "keys"), "line-pages"), "host", F.col("keys")
    total = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_pages"))
    # outer: for an inner one Spark infers a filter on the array and computes it once more to test that
    once = pages.select(F.col(host).alias("host"), F.explode_outer(keys).alias("key"))
    counts = once.filter("key is not null").groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    total = total.withColumnRenamed("host", "h")
    often = counts.join(total, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > ratio * F.col("n_pages"))
    return often.groupBy("host").agg(F.first("n_pages").alias("n_pages"), F.collect_list("key").alias("drop"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, spare_copies: bool = False) -> DataFrame:
    """``pages`` with ``clean_text``, ``n_lines`` and ``n_dropped``."""
    lists = materialize(boilerplate(pages.select(host, text), host, text, ratio, min_pages, spare_copies), "boilerplate")
    lists = lists.select(F.col("host").alias("__host"), F.col("drop").alias("__drop"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt_of"))
    salted = pages.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
    joined = salted.join(lists, F.col(host).eqNullSafe(F.col("__host")) & (F.col("__salt") == F.col("__salt_of")), "left")
    gone = F.col("__drop")
    keep = lambda lines: F.filter(lines, lambda x: ~F.array_contains(gone, _key(F.btrim(x, F.lit(BLANK)))) | (F.btrim(x, F.lit(BLANK)) == ""))
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(F.btrim(x, F.lit(BLANK))))
    is_copy = lambda n, left: 100 * (n - left) >= NEAR_PERCENT * (n + left)
    spare = lambda lines, left: F.when((F.size(left) < F.size(lines)) & is_copy(chars(lines), chars(left)), lines).otherwise(left)
    rest = lambda lines: let(keep(lines), lambda left: spare(lines, left)) if spare_copies else keep(lines)
    clean = let(_lines(F.col(text)), lambda lines: F.struct(F.size(lines).alias("n"), F.when(gone.isNull(), lines).otherwise(rest(lines)).alias("kept")))
    out = joined.withColumn("__clean", F.when(F.col(text).isNotNull(), clean))
    out = out.withColumns({"clean_text": F.array_join("__clean.kept", "\n"), "n_lines": F.coalesce("__clean.n", F.lit(0)), "n_dropped": F.coalesce(F.col("__clean.n") - F.size("__clean.kept"), F.lit(0))})
    return out.drop("__salt", "__salt_of", "__host", "__drop", "__clean")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_boilerplate(docs)
    return out.select("doc_id", "source", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.md5("clean_text").alias("clean_md5"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT r, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
y AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM x),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
c AS (SELECT source, t, count(DISTINCT r) AS k FROM y WHERE t <> '' GROUP BY source, t),
b AS (SELECT c.source, c.t FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE k >= {MIN_PAGES} AND k > {RATIO} * pages),
k AS (SELECT y.r, y.line, y.pos, b.t IS NULL AS keep FROM y LEFT JOIN b ON y.source IS NOT DISTINCT FROM b.source AND y.t = b.t),
e AS (SELECT r, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
             md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS clean_md5 FROM k GROUP BY r)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, clean_md5
FROM d LEFT JOIN e ON d.r = e.r
"""
