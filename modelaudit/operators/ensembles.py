"""Ensembles of predictions, and choices among rows by confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.functions.items import argmax_class
from modelaudit.operators import metrics


def _side_by_side(preds: DataFrame, a: str, b: str) -> DataFrame:
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("y_prob")))
    rows = preds.filter(F.col("model").isin(a, b)).groupBy("item_id").agg(F.min("y_true").alias("y_true"), pick(a).alias("p_a"), pick(b).alias("p_b"))
    return rows.filter("p_a is not null and p_b is not null")


def soft_vote(preds: DataFrame, a: str, b: str, weight: float = 0.5, name: str = "ensemble") -> DataFrame:
    """H1: weight * a + (1 - weight) * b, first largest on ties; rows like ``preds``."""
    w = F.lit(float(weight))
    p = F.zip_with("p_a", "p_b", lambda x, y: w * x + (F.lit(1.0) - w) * y)
    rows = _side_by_side(preds, a, b).select(F.lit(name).alias("model"), "item_id", "y_true", p.alias("y_prob"))
    return rows.select("model", "item_id", "y_true", argmax_class(F.col("y_prob")).alias("y_pred"), "y_prob")


def weight_grid(preds: DataFrame, a: str, b: str, k: int, steps: int = 20) -> DataFrame:
    """H2: macro-F1, accuracy and errors for each weight i / steps; ``best`` is the first maximum, ``tied`` all within 1e-9 of it.
    Weights fan out inside the map side; only counts are shuffled."""
    rows = _side_by_side(preds, a, b).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = F.col("step") / F.lit(float(steps))
    p = F.zip_with("p_a", "p_b", lambda x, y: w * x + (F.lit(1.0) - w) * y)
    counts = rows.select("step", "y_true", p.alias("p")).select("step", "y_true", argmax_class(F.col("p")).alias("y_pred")).groupBy("step", "y_true", "y_pred").agg(F.count("*").alias("n"))
    table = metrics.headline(counts, k, ("step",)).withColumn("errors", F.bround((1 - F.col("accuracy")) * F.col("n"), 0).cast("long"))
    top = table.agg(F.max("macro_f1").alias("top"))
    table = table.join(F.broadcast(top)).withColumn("tied", F.col("macro_f1") >= F.col("top") - 1e-9)  # one row
    first = table.filter("macro_f1 = top").agg(F.min("step").alias("first"))
    return table.join(F.broadcast(first)).withColumn("best", F.col("step") == F.col("first")).drop("top", "first")


def _mean(preds: DataFrame, weight: Column | None, name: str) -> DataFrame:
    """Probabilities of an item's rows, added label by label and divided by the sum of weights: one shuffle of items."""
    row = F.struct((weight if weight is not None else F.lit(1.0)).alias("w"), F.col("y_prob").alias("p"))
    items = preds.groupBy("item_id").agg(F.min("y_true").alias("y_true"), F.array_sort(F.collect_list(row)).alias("rows"))  # a row a model or view
    zero = F.transform(F.get("rows", F.lit(0))["p"], lambda _: F.lit(0.0))
    sums = F.aggregate("rows", zero, lambda s, r: F.zip_with(s, r["p"], lambda a, x: a + r["w"] * x))
    total = F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["w"])
    rows = items.select("item_id", "y_true", sums.alias("s"), total.alias("w")).select("item_id", "y_true", F.transform("s", lambda x: x / F.col("w")).alias("y_prob"))
    return rows.select(F.lit(name).alias("model"), "item_id", "y_true", argmax_class(F.col("y_prob")).alias("y_pred"), "y_prob")


def weighted_ensemble(preds: DataFrame, weights: dict[str, float], name: str = "ensemble") -> DataFrame:
    """H3: any number of models, weights normalised to 1."""
    w = F.element_at(F.create_map(*[F.lit(x) for m, v in weights.items() for x in (m, float(v))]), F.col("model"))
    return _mean(preds.filter(F.col("model").isin(list(weights))), w, name)


def seed_ensemble(preds: DataFrame, prefix: str, name: str = "ensemble") -> DataFrame:
    """H4: mean over the models there are whose names start with ``prefix``."""
    return _mean(preds.filter(F.col("model").startswith(prefix)), None, name)


def view_average(views: DataFrame, name: str = "views") -> DataFrame:
    """H5: mean probability over an item's views, then the largest."""
    return _mean(views, None, name)


def most_confident_errors(preds: DataFrame, n: int) -> DataFrame:
    """K1: wrong rows by confidence, the first n."""
    c = F.get("y_prob", F.col("y_pred"))
    return preds.filter("y_true <> y_pred").select("model", "item_id", "y_true", "y_pred", c.alias("confidence")).orderBy(F.desc("confidence"), "model", "item_id").limit(n)


def best_correct_per_class(preds: DataFrame) -> DataFrame:
    """K2: for each model and class the right row with the largest probability, the smaller id on ties."""
    right = preds.filter("y_true = y_pred").withColumn("confidence", F.get("y_prob", F.col("y_pred")))
    best = F.max_by(F.struct("item_id", "confidence"), F.struct("confidence", -F.col("item_id"))).alias("b")
    return right.groupBy("model", "y_true").agg(best).select("model", "y_true", "b.*")


def quota_sample(rows: DataFrame, quota: dict[str, int], priority: list[int], bucket: str = "bucket", key: str = "item_id") -> DataFrame:
    """K3: so many rows of each bucket, true classes in ``priority`` first, then by key."""
    at = F.array_position(F.lit(priority), F.col("y_true"))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(F.when(at > 0, at).otherwise(F.lit(len(priority) + 1)), key))
    most = F.element_at(F.create_map(*[F.lit(x) for b, n in quota.items() for x in (b, n)]), F.col(bucket))
    return rows.filter(F.col(bucket).isin(list(quota))).withColumn("rank", rank).filter(F.col("rank") <= most)


def select_best(board: DataFrame, metric: str = "macro_f1", order: str = "model") -> DataFrame:
    """K4."""
    return board.orderBy(F.desc(metric), order).limit(1)
