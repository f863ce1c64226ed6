"""Splits, folds, subsets and weights. Every random order is a hash of seed and key, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.functions.items import SEED, hash01, order_key
from modelaudit.functions.ranges import pieces, running_before, sums_before

SPLITS = ("train", "val", "test")


def _cut(rank: Column, n: Column, test: float, val: float) -> Column:
    """Split of the rank-th (from 1) of n shuffled groups: ceil shares go to test, then to val of what is left."""
    n_test = F.ceil(F.round(n * F.lit(test), 9))
    n_val = F.ceil(F.round((n - n_test) * F.lit(val / (1 - test)), 9))
    return F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")


def group_split(items: DataFrame, klass: str = "class", group: str = "grp", val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Add ``split``; the groups of each class are shuffled and cut, so no group straddles splits. Groups are ranked in shards of
    their hash (see ``ranked``), so a class may have any number of them."""
    groups = ranked(items.select(F.col(klass).alias("_c"), F.col(group).alias("_g")).distinct(), "_g", "_c")
    cut = groups.select("_c", "_g", _cut(F.col("rank"), F.col("n"), test, val).alias("split"))
    return items.join(cut, items[klass].eqNullSafe(cut["_c"]) & items[group].eqNullSafe(cut["_g"])).drop("_c", "_g")


def stratified_split(items: DataFrame, key: str, klass: str = "class", val: float = 0.15, test: float = 0.15) -> DataFrame:
    """As T1 with each row a group of its own, cut in each class by exact ranks over shards of the hash (see ``ranked``)."""
    rows = ranked(items, key, klass)
    return rows.withColumn("split", _cut(F.col("rank"), F.col("n"), test, val)).drop("rank", "n")


def ranked(items: DataFrame, key: str, klass: str = "class", seed: int = SEED, per_shard: int | None = None) -> DataFrame:
    """Add ``rank`` (from 1) in the hash order of each class and the class's ``n``. A class is ranked in ranges of its hash, whose
    counts add up. How many ranges follows from the number of rows, so no task grows with them."""
    shards = pieces(items.select(key), per_shard)
    rows = items.withColumn("_rank_o", order_key(F.col(key), seed)).withColumn("_rank_s", F.floor(F.conv(F.substring("_rank_o", 1, 8), 16, 10).cast("long") * F.lit(shards) / F.lit(2**32)).cast("int"))
    counts = rows.groupBy(F.col(klass).alias("_rank_c"), F.col("_rank_s").alias("_rank_t")).count()
    counts = sums_before(counts, ["_rank_c"], "_rank_t", "count", "_rank_before", shards, "n").drop("count")
    rows = rows.withColumn("_rank_r", F.row_number().over(Window.partitionBy(klass, "_rank_s").orderBy("_rank_o", key)))
    rows = rows.join(counts, rows[klass].eqNullSafe(counts["_rank_c"]) & (rows["_rank_s"] == counts["_rank_t"]))
    return rows.withColumn("rank", F.col("_rank_r") + F.col("_rank_before")).drop("_rank_o", "_rank_s", "_rank_r", "_rank_c", "_rank_t", "_rank_before")


def stratified_fraction(items: DataFrame, fraction: float, key: str, klass: str = "class") -> DataFrame:
    """max(round-half-even(n * fraction), 1) rows of each class; subsets are nested in the fraction."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    keep = F.greatest(F.bround(F.col("n") * F.lit(float(fraction)), 0), F.lit(1.0))
    return ranked(items, key, klass).filter(F.col("rank") <= keep).drop("rank", "n")


def split_crosstab(items: DataFrame, klass: str = "class", split: str = "split") -> DataFrame:
    """T4: counts by class and split with totals; the class of the total row is ``total``."""
    counts = items.groupBy(F.coalesce(F.col(klass), F.lit("")).alias("class")).pivot(split, list(SPLITS)).count().na.fill(0)
    total = counts.agg(*[F.sum(s).alias(s) for s in SPLITS]).select(F.lit("total").alias("class"), *[F.coalesce(s, F.lit(0)).alias(s) for s in SPLITS])
    return counts.unionByName(total).withColumn("total", F.col("train") + F.col("val") + F.col("test"))


def stratified_kfold(items: DataFrame, key: str, klass: str = "class", k: int = 5) -> DataFrame:
    """T5: add ``fold`` from 0; classes are balanced per fold."""
    return ranked(items, key, klass).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank", "n")


def stratified_group_kfold(items: DataFrame, klass: str = "class", group: str = "grp", k: int = 5) -> DataFrame:
    """Add ``fold``; groups, largest first, are dealt in snake order to the folds of their class. Their places are running counts
    in ranges of (size, hash), so a class may have any number of groups."""
    sizes = items.groupBy(F.col(klass).alias("_c"), F.col(group).alias("_g")).count()
    at = running_before(sizes, ["_c"], [F.desc("count"), order_key(F.col("_g")), F.col("_g")], F.lit(1), "at")
    dealt = at.withColumn("_m", F.pmod("at", F.lit(k))).withColumn("fold", F.when(F.pmod(F.floor(F.col("at") / k), F.lit(2)) == 0, F.col("_m")).otherwise(F.lit(k - 1) - F.col("_m")).cast("int"))
    dealt = dealt.select("_c", "_g", "fold")
    return items.join(dealt, items[klass].eqNullSafe(dealt["_c"]) & items[group].eqNullSafe(dealt["_g"])).drop("_c", "_g")


def head_sample(items: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in key order."""
    return items.orderBy(key).limit(n)


def class_weights(items: DataFrame, klass: str = "class") -> DataFrame:
    """(class, n, balanced, inverse): n/(K*n_c), and inverse frequencies scaled to sum to K."""
    counts = items.groupBy(F.col(klass).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"), F.sum(F.lit(1.0) / F.col("n")).alias("_i"))
    joined = counts.join(F.broadcast(total))  # one row
    return joined.select("class", "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("balanced"), (F.col("_k") / F.col("n") / F.col("_i")).alias("inverse"))


def dummy_predictions(train: DataFrame, items: DataFrame, key: str, n_classes: int, target: str = "y_true", seed: int = 42) -> DataFrame:
    """Add ``majority`` (the training rows' commonest class, the smaller on ties) and ``uniform`` (a class by hash)."""
    top = train.groupBy(F.col(target).alias("majority")).count().orderBy(F.desc("count"), "majority").limit(1).drop("count")
    uniform = F.floor(hash01(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))) * n_classes).cast("int")
    return items.join(F.broadcast(top)).withColumn("uniform", uniform)  # one row


def random_pool(test: DataFrame, train: DataFrame, key: str, klass: str = "class", k: int = 5, trials: int = 5) -> DataFrame:
    """For each test row and trial, k distinct training rows of its class: (key, class, trial, train_key). A hash picks a
    start and a stride below n/k, so the k places are distinct; classes with fewer than k rows are left out."""
    numbered = ranked(train, key, klass).select(F.col(klass).alias("_c"), (F.col("rank") - 1).alias("_at"), F.col(key).alias("train_key"), "n")
    sizes = numbered.select("_c", "n").distinct()
    drawn = test.select(key, klass).join(F.broadcast(sizes), F.col(klass) == F.col("_c")).filter(F.col("n") >= k).drop("_c")  # a row a class
    drawn = drawn.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    draw = lambda what: hash01(F.concat(F.lit(what + "|"), F.col(key).cast("string"), F.lit("|"), F.col("trial").cast("string")))
    start, stride = F.floor(draw("start") * F.col("n")), F.floor(draw("stride") * F.floor((F.col("n") - 1) / F.lit(k - 1))) + 1
    places = drawn.withColumn("_place", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(start + i * stride, F.col("n")))))
    return places.drop("n").join(numbered.drop("n"), (F.col(klass) == F.col("_c")) & (F.col("_place") == F.col("_at"))).select(key, klass, "trial", "train_key")
