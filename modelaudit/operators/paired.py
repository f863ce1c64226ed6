"""Models compared on the same items: alignment, McNemar's test, outcome buckets, error pairs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align(preds: DataFrame, models: list[str]) -> DataFrame:
    """One row an item with the predictions and outcomes of all models; fails if labels differ or a model lacks an item.

    One shuffle on the item, no self-join.
    """
    picked = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"pred_{m}") for m in models]
    rows = preds.filter(F.col("model").isin(models)).groupBy("item_id").agg(F.min("y_true").alias("y_true"), F.max("y_true").alias("_t"), F.countDistinct("model").alias("_n"), *picked)
    sound = F.when(F.col("y_true") != F.col("_t"), F.raise_error(F.lit("labels differ between models"))).when(F.col("_n") != len(models), F.raise_error(F.lit("a model lacks an item"))).otherwise(F.col("y_true"))
    return rows.select("item_id", sound.cast("int").alias("y_true"), *[f"pred_{m}" for m in models])


def outcomes(aligned: DataFrame, a: str, b: str) -> DataFrame:
    """P5: right or wrong per model, the bucket, and each model's error direction."""
    ok_a, ok_b = F.col("y_true") == F.col(f"pred_{a}"), F.col("y_true") == F.col(f"pred_{b}")
    bucket = F.when(ok_a & ok_b, "both_right").when(ok_b, "only_a_wrong").when(ok_a, "only_b_wrong").otherwise("both_wrong")
    way = lambda m, ok: F.when(~ok, F.concat_ws("->", F.col("y_true").cast("string"), F.col(f"pred_{m}").cast("string")))
    return aligned.select("item_id", "y_true", F.col(f"pred_{a}").alias("pred_a"), F.col(f"pred_{b}").alias("pred_b"), bucket.alias("bucket"), way(a, ok_a).alias("error_a"), way(b, ok_b).alias("error_b"))


@F.pandas_udf(T.DoubleType())
def _mcnemar_p(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    """One value a pair of models: exact below 25 discordant items, else chi-square with continuity correction."""

    def p(a: int, b: int) -> float:
        n = a + b
        if n < 25:
            return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n)
        return math.erfc(math.sqrt((abs(a - b) - 1) ** 2 / n / 2))

    return pd.Series([p(int(a), int(b)) for a, b in zip(only_a, only_b, strict=True)])


def all_pairs(preds: DataFrame) -> DataFrame:
    """For every two models the table of outcomes, the statistic and p. Pairs are made within an item's row, so there is
    one shuffle of items and one of counts. ``only_a``: only model_a is wrong."""
    ok = F.struct("model", (F.col("y_true") == F.col("y_pred")).alias("ok"))
    items = preds.groupBy("item_id").agg(F.array_sort(F.collect_list(ok)).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), lambda y: F.struct(x["model"].alias("model_a"), y["model"].alias("model_b"), x["ok"].alias("a"), y["ok"].alias("b")))))
    rows = items.select(F.inline(pairs))
    n = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy("model_a", "model_b").agg(n(F.col("a") & F.col("b")).alias("both_right"), n(~F.col("a") & F.col("b")).alias("only_a"), n(F.col("a") & ~F.col("b")).alias("only_b"), n(~F.col("a") & ~F.col("b")).alias("both_wrong"))
    discordant = F.col("only_a") + F.col("only_b")
    chi = F.when(discordant < 25, F.least("only_a", "only_b").cast("double")).otherwise(F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(2.0)) / discordant)
    return out.withColumns({"discordant": discordant, "statistic": chi, "p": _mcnemar_p("only_a", "only_b")})


def confusion_pairs(rows: DataFrame) -> DataFrame:
    """(true, predicted) counts within each bucket of wrong predictions, most common first. ``rows`` from ``outcomes``."""
    a = rows.filter("bucket in ('only_a_wrong', 'both_wrong')").select("bucket", "y_true", F.lit("a").alias("side"), F.col("pred_a").alias("y_pred"))
    b = rows.filter("bucket in ('only_b_wrong', 'both_wrong')").select("bucket", "y_true", F.lit("b").alias("side"), F.col("pred_b").alias("y_pred"))
    return a.unionByName(b).groupBy("bucket", "side", "y_true", "y_pred").agg(F.count("*").alias("n")).orderBy("bucket", "side", F.desc("n"), "y_true", "y_pred")


def coverage(preds: DataFrame) -> DataFrame:
    """Items by the pattern of right (1) and wrong (0), models in name order."""
    ok = F.struct("model", F.when(F.col("y_true") == F.col("y_pred"), "1").otherwise("0").alias("ok"))
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(ok)), lambda x: x["ok"]), "")
    return preds.groupBy("item_id").agg(pattern.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
