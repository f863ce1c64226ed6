"""Leakage between splits by keys: content hashes, fingerprints, rounded values; and what to do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.functions.ranges import percentiles

PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))


def _per_key(items: DataFrame, hash: str, split: str) -> DataFrame:
    """(hash, train, val, test): counts of each key in each split. One shuffle of keys, combined before it."""
    counts = [F.count(F.when(F.col(split) == s, 1)).alias(s) for s in ("train", "val", "test")]
    return items.filter(F.col(hash).isNotNull()).groupBy(F.col(hash).alias("hash")).agg(*counts)


def hash_leak_pairs(items: DataFrame, hash: str = "hash", split: str = "split") -> DataFrame:
    """For each two splits the number of (a, b) pairs with equal keys and of distinct items of b among them. Pairs are
    products of counts; none is listed."""
    per = _per_key(items, hash, split)
    rows = [F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), (F.col(a) * F.col(b)).alias("pairs"), F.when(F.col(a) > 0, F.col(b)).otherwise(0).alias("b_items")) for a, b in PAIRS]
    return per.select(F.inline(F.array(*rows))).groupBy("split_a", "split_b").agg(F.sum("pairs").alias("pairs"), F.sum("b_items").alias("b_items"))


def leak_members(items: DataFrame, hash: str = "hash", split: str = "split", key: str = "item_id", klass: str = "class") -> DataFrame:
    """(hash, split, key, class) of every item whose key occurs in more than one split: the sides of all leaking pairs, one row
    an item, so m copies against n give m + n rows."""
    per = _per_key(items, hash, split)
    spans = (F.col("train") > 0).cast("int") + (F.col("val") > 0).cast("int") + (F.col("test") > 0).cast("int") > 1
    shared = per.filter(spans).select(F.col("hash").alias("_h"))
    return items.join(shared, items[hash] == shared["_h"], "left_semi").select(F.col(hash).alias("hash"), split, key, klass)


def fingerprints(rows: DataFrame, by: list[str], value: str, decimals: int = 6, bins: int = 256, span: tuple[float, float] = (0.0, 256.0)) -> DataFrame:
    """P10: a group's mean, std, skewness, kurtosis, five percentiles and the entropy of its histogram over ``span`` (values
    outside are left out of the histogram), each rounded."""
    moments = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))
    places = {f"p{q}": q / 100 for q in (10, 25, 50, 75, 90)}
    middle = percentiles(rows, by, value, places)
    lo, hi = span
    at = F.least(F.floor((F.col(value) - lo) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
    cells = rows.filter(F.col(value).between(lo, hi)).groupBy(*by, at.alias("_at")).agg(F.count("*").alias("_n"))
    # sum of p * log2(p) with p = n / all, from sums that need no second pass
    sums = cells.groupBy(*by).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.log2("_n")).alias("_nlogn"))
    entropy = sums.select(*by, (F.log2("_all") - F.col("_nlogn") / F.col("_all")).alias("entropy"))
    out = moments
    for more in (middle, entropy):
        more = more.withColumnsRenamed({c: f"_of_{c}" for c in by})
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        out = out.join(more, on, "left").drop(*[f"_of_{c}" for c in by])
    return out.select(*by, *[F.round(c, decimals).alias(c) for c in ("mean", "std", "skew", "kurtosis", *places)], F.round(F.coalesce("entropy", F.lit(0.0)), decimals).alias("entropy"))


def leak_examples(items: DataFrame, hash: str = "hash", split: str = "split", key: str = "item_id", most: int = 20) -> DataFrame:
    """J1 with K5: example pairs, at most ``most`` for each two splits, of the smallest ids of each shared key."""
    per = items.filter(F.col(hash).isNotNull()).groupBy(F.col(hash).alias("hash")).agg(*[F.min(F.when(F.col(split) == s, F.col(key))).alias(s) for s in ("train", "val", "test")])
    rows = [F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(a).alias("a_id"), F.col(b).alias("b_id")) for a, b in PAIRS]
    pairs = per.select("hash", F.inline(F.array(*rows))).filter("a_id is not null and b_id is not null")
    return capped(pairs, ["split_a", "split_b"], ["a_id", "b_id"], most)


def capped(rows: DataFrame, section: list[str], order: list[str], most: int = 20) -> DataFrame:
    """K5: the first rows of each section, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*section).orderBy(*order))).filter(F.col("rank") <= most)


def key_overlap(items: DataFrame, hash: str = "hash", split: str = "split") -> DataFrame:
    """Distinct keys common to each two splits; ``integrity_ok`` if there is none anywhere."""
    per = _per_key(items, hash, split)
    shared = per.agg(*[F.count(F.when((F.col(a) > 0) & (F.col(b) > 0), 1)).alias(f"{a}_{b}") for a, b in PAIRS])
    return shared.withColumn("integrity_ok", (F.col("train_val") + F.col("train_test") + F.col("val_test")) == 0)


def rounded_value_overlap(items: DataFrame, value: str, decimals: int = 2, split: str = "split") -> DataFrame:
    """Distinct rounded values in each split and common to each two."""
    per = _per_key(items.withColumn("_v", F.round(value, decimals)), "_v", split)
    here = [F.count(F.when(F.col(s) > 0, 1)).alias(f"n_{s}") for s in ("train", "val", "test")]
    return per.agg(*here, *[F.count(F.when((F.col(a) > 0) & (F.col(b) > 0), 1)).alias(f"{a}_{b}") for a, b in PAIRS])


def duplicate_impact(scored: DataFrame, train: DataFrame, hash: str = "hash") -> DataFrame:
    """Accuracy per model on items that have an exact copy in ``train``, and on the rest. ``scored``: model, hash, correct."""
    seen = train.select(F.col(hash).alias("_h")).filter(F.col("_h").isNotNull()).distinct()
    flagged = scored.join(seen, scored[hash] == seen["_h"], "left").withColumn("has_copy", F.col("_h").isNotNull())
    return flagged.groupBy("model", "has_copy").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def within_split_duplicates(items: DataFrame, hash: str = "hash", split: str = "split") -> DataFrame:
    """J11."""
    return items.filter(F.col(hash).isNotNull()).groupBy(split, hash).agg(F.count("*").alias("copies")).filter("copies > 1")


def cross_split_groups(items: DataFrame, hash: str = "hash", split: str = "split") -> DataFrame:
    """Groups over more than one split, test items with a copy in train, and in train or val."""
    per = _per_key(items, hash, split)
    spans = F.when((F.col("train") > 0).cast("int") + (F.col("val") > 0).cast("int") + (F.col("test") > 0).cast("int") > 1, 1)
    return per.agg(F.count(spans).alias("groups"), F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("test"))), F.lit(0)).alias("test_in_train"), F.coalesce(F.sum(F.when((F.col("train") > 0) | (F.col("val") > 0), F.col("test"))), F.lit(0)).alias("test_in_train_or_val"))


def dedup_exact(items: DataFrame, hash: str = "hash", key: str = "item_id") -> DataFrame:
    """The copy with the smallest key of each content hash; only keys and hashes are shuffled for it."""
    first = items.filter(F.col(hash).isNotNull()).groupBy(hash).agg(F.min(key).alias("_k")).select("_k")
    return items.join(first, items[key] == first["_k"], "left_semi")


def pool_splits(*splits: DataFrame) -> DataFrame:
    """J16."""
    out = splits[0]
    for more in splits[1:]:
        out = out.unionByName(more)
    return out
