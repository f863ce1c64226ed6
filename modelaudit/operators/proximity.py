"""Is an item nearer to training items of neighbouring numbers than to random ones? Effect sizes and verdicts by class."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelaudit.functions.ranges import rank_sums


def mann_whitney(values: DataFrame, klass: str = "class") -> DataFrame:
    """(class, n1, n2, u, p): U of ``side`` 1 over side 2 by midranks, and the one-sided normal p with tie and continuity
    correction. Values are counted before they are ranked, and ranked in ranges."""
    counts = values.groupBy(klass, "value").agg(F.sum((F.col("side") == 1).cast("long")).alias("a"), F.sum((F.col("side") == 2).cast("long")).alias("b"))
    t = (F.col("a") + F.col("b")).cast("double")
    out = rank_sums(counts, [klass], "value", "a", "b", {"ties": t * t * t - t}).withColumnsRenamed({"p": "n1", "n": "n2"})
    return out.withColumn("p", _tail("n1", "n2", "u", "ties")).select(klass, "n1", "n2", "u", "p")


@F.pandas_udf(T.DoubleType())
def _tail(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series) -> pd.Series:
    def p(a: float, b: float, u: float, t: float) -> float | None:
        n = a + b
        var = a * b / 12 * ((n + 1) - t / (n * (n - 1))) if n > 1 else 0
        return 0.5 * math.erfc((u - a * b / 2 - 0.5) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None

    return pd.Series([p(*map(float, x)) for x in zip(n1, n2, u, ties, strict=True)], dtype="float64")


def effect_size(near: DataFrame, random: DataFrame, klass: str = "class") -> DataFrame:
    """By class, nearest against random similarity: means, population stds, ratio, delta, Cohen's d (pooled sample stds),
    probability of superiority and room left (delta / (1 - random mean)). Both: (class, sim)."""
    both = near.select(klass, F.col("sim").alias("value"), F.lit(1).alias("side")).unionByName(random.select(klass, F.col("sim").alias("value"), F.lit(2).alias("side")))
    one = lambda f, s: f(F.when(F.col("side") == s, F.col("value")))
    s = both.groupBy(klass).agg(one(F.avg, 1).alias("near_mean"), one(F.avg, 2).alias("random_mean"), one(F.stddev_pop, 1).alias("near_std"), one(F.stddev_pop, 2).alias("random_std"), one(F.stddev_samp, 1).alias("s1"), one(F.stddev_samp, 2).alias("s2"), one(F.count, 1).alias("m1"), one(F.count, 2).alias("m2"))
    pooled = F.sqrt(((F.col("m1") - 1) * F.col("s1") * F.col("s1") + (F.col("m2") - 1) * F.col("s2") * F.col("s2")) / (F.col("m1") + F.col("m2") - 2))
    delta = F.col("near_mean") - F.col("random_mean")
    s = s.withColumns({"delta": delta, "ratio": F.when(F.col("random_mean") != 0, F.col("near_mean") / F.col("random_mean")), "d": F.when(pooled > 0, delta / pooled), "room": F.when(F.col("random_mean") != 1, delta / (1 - F.col("random_mean")))})
    u = mann_whitney(both, klass).select(klass, "n1", "n2", "u", (F.col("u") / (F.col("n1") * F.col("n2"))).alias("cles"))
    return s.drop("s1", "s2", "m1", "m2").join(u, klass)


def leakage_verdict(effects: DataFrame) -> DataFrame:
    """E20 by class: strong (ratio >= 1.5 and d >= 0.8), saturated (d >= 0.8 but ratio < 1.05), moderate (ratio >= 1.05) or none."""
    ratio, d = F.coalesce("ratio", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    return effects.withColumn("verdict", F.when((ratio >= 1.5) & (d >= 0.8), "strong").when((d >= 0.8) & (ratio < 1.05), "saturated").when(ratio >= 1.05, "moderate").otherwise("none"))


def overall_verdict(verdicts: DataFrame) -> DataFrame:
    """E20 over all: one row with the number of classes by verdict, and the rule on those numbers."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    out = verdicts.agg(n("strong"), n("saturated"), n("moderate"), n("none"))
    return out.withColumn("overall", F.when(F.col("strong") >= 1, "strong").when(F.col("saturated") >= 2, "saturated").when(F.col("moderate") >= 2, "moderate").otherwise("none"))
