"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path.

Everything runs as DataFrame expressions: hosts and paths by string functions, n-grams by higher-order functions, the
model as one array of weights inside the plan. The labelled table that trains it is small by definition (``MAX_LABELLED``
rows at most are taken), so its size does not follow the corpus.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is judged on the empty
string; repeated rows are judged alike, each by itself; other columns are carried along untouched, but those named like
results (host, path, rule, score, verdict), which are replaced; an empty table gives an empty one. A long URL costs in
proportion to its length and is one array of characters; ties between rules of one length go to the alphabetically first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm.exprs import ascii_lower, let

BUCKETS = 2048
MAX_LABELLED = 10_000

#: (host, path, verdict). The longest rule that fits wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: A small labelled table: 1 means block.
LABELLED_URLS = [(f"http://{x}", 1) for x in (
    "cheap-pills.example.com/en/12", "www.cheap-pills.example.org/buy", "cheap-meds.example.net/order/9", "buy-pills-online.example.com/", "pills4u.example.net/fr/3",
    "spam-farm.example.org/en/7", "www.spam-farm.example.net/de/101", "spam-links.example.com/links", "link-farm.example.org/seo/2", "best-casino.example.com/play",
    "casino-bonus.example.net/free-spins", "online-casino.example.org/en/4", "m.casino-jackpot.example.com/es/8", "free-money-now.example.net/win", "win-prizes-now.example.com/claim",
    "fast-loans.example.org/apply", "payday-loans.example.com/en/22", "adult-cams.example.net/live", "xxx-videos.example.com/watch", "hot-singles.example.org/join",
    "crack-keygen.example.net/download", "warez-torrent.example.com/dl/5", "replica-watches.example.org/shop", "cheap-replica.example.com/bags", "weight-loss-miracle.example.net/buy",
    "miracle-pills.example.org/es/77", "crypto-doubler.example.com/send", "free-followers.example.net/get", "click-farm.example.org/fr/41", "spam-mailer.example.com/en/6",
    "www.casino-win.example.net/de/51", "casino-win.example.com/fr/9", "adult-x.example.org/en/17", "www.adult-x.example.com/de/80", "ads-track.example.com/en/3", "ads-track.example.net/de/64", "free-bets.example.org/en/71", "m.free-bets.example.com/fr/2")] + [(f"https://{x}", 0) for x in (
    "www.therti.example.org/en/334/", "blog.theren.example.net/en/455", "ththin.example.com/en/671", "m.therou.example.com/en/474.html", "ththble.example.net/es/797",
    "thering.example.com/en/328/", "news.harbour.example.com/en/2024/03/", "www.library.example.org/catalogue/item/9", "docs.python.example.org/3/tutorial", "blog.ththly.example.org/en/777",
    "wiki.garden.example.net/wiki/Rose", "www.university.example.org/courses/math", "forum.cycling.example.com/t/812", "recipes.kitchen.example.net/fr/soup", "museum.example.org/de/besuch",
    "www.ththen.example.com/en/148.html", "weather.coast.example.com/es/hoy", "shop.bakery.example.net/de/brot", "maps.city.example.org/en/centre", "blog.tionti.example.com/de/31",
    "www.erandon.example.org/fr/505", "anther.example.net/de/19", "m.stonha.example.org/es/260", "www.tionsh.example.net/en/533/", "reader.books.example.com/en/novel/3",
    "council.example.org/en/minutes", "www.reerth.example.com/de/912", "sports.arena.example.net/en/results", "blog.music.example.org/en/reviews/44", "heonsh.example.com/fr/5.html",
    "library.town.example.org/en/opening", "news.example.com/fr/monde", "www.school.example.net/en/terms", "garden.example.org/es/plantas", "blog.reading.example.net/de/buch", "www.anerst.example.net/en/66")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits. Ties in length go to the alphabetically first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def ngram_buckets(text: Column, sizes: Sequence[int] = (3, 4, 5), buckets: int = BUCKETS) -> Column:
    """Hash buckets of all character n-grams; each character is taken once, so the cost is linear in the length."""
    def of(chars: Column, n: int) -> Column:
        last = F.size(chars) - F.lit(n)
        gram = lambda i: F.concat(*[F.get(chars, i + F.lit(k)) for k in range(n)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(F.xxhash64(gram(i)), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))

    chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
    return let(chars, lambda c: F.concat(*[of(c, n) for n in sizes]))


def train(labelled: DataFrame, buckets: int = BUCKETS, reg: float = 0.002) -> tuple[list[float], float]:
    """Fit on (url, label) rows, ``MAX_LABELLED`` at most, in the order of the URL's hash. Rows with a null label are left out."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
    grams = rows.select("url", "label", F.explode(ngram_buckets(F.concat(host, path), buckets=buckets)).alias("b"))
    sets = grams.groupBy("url", "label").agg(F.collect_set("b").alias("b"))
    counts = sets.select(F.col("label").cast("double").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.when(F.array_contains("b", k), 1.0).otherwise(0.0)).alias("x"))
    held = counts.select("label", array_to_vector("x").alias("features")).coalesce(1).cache()
    model = LogisticRegression(regParam=reg, maxIter=25, standardization=False).fit(held)
    held.unpersist()
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def filter_urls(urls: DataFrame, weights: Sequence[float], intercept: float, rules: Sequence[tuple[str, str, str]] = (), threshold: float = 0.5, url: str = "url") -> DataFrame:
    """Add host, path, rule, score (likelihood of block by the model) and verdict to each row."""
    host, path = host_and_path(F.col(url))
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    w = F.lit([float(x) for x in weights])
    grams = F.array_distinct(ngram_buckets(F.concat("host", "path"), buckets=len(weights)))
    logit = F.aggregate(grams, F.lit(float(intercept)), lambda acc, b: acc + F.get(w, b))
    out = urls.withColumns({"host": host, "path": path})
    out = out.withColumns({"rule": rule, "score": F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))})
    return out.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(LABELLED_URLS, "url string, label int")
    weights, intercept = train(labelled)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, weights, intercept, RULES).select("page_id", "host", "path", "rule", "verdict", "score")
