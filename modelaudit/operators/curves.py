"""Learning curves: one row an epoch, windows by run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def _run() -> WindowSpec:
    return Window.partitionBy("run")


def indexed(epochs: DataFrame) -> DataFrame:
    """Add ``index``, from 0 over the stages of a run."""
    return epochs.withColumn("index", (F.row_number().over(_run().orderBy("stage", "epoch")) - 1).cast("int"))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """First index with the largest validation macro-F1, its value, and the last index of stage 1."""
    best = F.max_by("index", F.struct("val_macro_f1", -F.col("index")))
    return indexed(epochs).groupBy("run").agg(best.alias("best_index"), F.max("val_macro_f1").alias("best_f1"), F.max(F.when(F.col("stage") == 1, F.col("index"))).alias("last_stage1"), F.count("*").cast("int").alias("n"))


def improvement_trace(epochs: DataFrame, patience: int = 5) -> DataFrame:
    """Running best, whether an epoch improves it, epochs since (counted anew from stage 2), and where patience ends."""
    w = _run().orderBy("index")
    rows = indexed(epochs).withColumn("before", F.max("val_macro_f1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("improved", F.col("before").isNull() | (F.col("val_macro_f1") > F.col("before")))
    start2 = F.min(F.when(F.col("stage") == 2, F.col("index"))).over(_run()) - 1
    last = F.max(F.when(F.col("improved"), F.col("index"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    since = F.col("index") - F.greatest(last, F.when(F.col("stage") == 2, start2))
    rows = rows.withColumn("since", since).withColumn("best", F.greatest("before", "val_macro_f1"))
    stop = F.min(F.when(F.col("since") >= patience, F.col("index"))).over(_run())
    return rows.withColumn("stops_at", stop).select("run", "index", "best", "improved", "since", "stops_at")


def loss_rebound(epochs: DataFrame, least: int = 5) -> DataFrame:
    """In stage 2, last validation loss minus the minimum, and how far training loss falls after the (first) minimum."""
    s = indexed(epochs).filter("stage = 2")
    low = F.min_by("train_loss", F.struct("val_loss", "index"))
    out = s.groupBy("run").agg(F.count("*").alias("n"), (F.max_by("val_loss", "index") - F.min("val_loss")).alias("rebound"), (F.max_by("train_loss", "index") - low).alias("train_change"))
    verdict = F.when(F.col("n") < least, "too short").when((F.col("rebound") > 0.05) & (F.col("train_change") < 0), "overfitting").when(F.col("rebound") > 0.02, "mild rebound").otherwise("stable")
    return out.withColumn("verdict", verdict)


def round_curve(rounds: DataFrame, deployed: int) -> DataFrame:
    """Boosting series (run, round, train_loss, val_loss, and train_error, val_error if there are errors): first best round, losses
    at the deployed one, the final gap (validation minus training) and what it says; of errors the first best round, the least and the
    deployed ones, and the final gap."""
    at = lambda c: F.max(F.when(F.col("round") == deployed, F.col(c)))
    gap = lambda what: F.max_by(F.col(f"val_{what}") - F.col(f"train_{what}"), "round")
    columns = [F.min_by("round", F.struct("val_loss", "round")).alias("best_round"), F.min("val_loss").alias("best_val"), at("train_loss").alias("deployed_train"), at("val_loss").alias("deployed_val"), gap("loss").alias("final_gap"), F.max("round").alias("last_round")]
    if "val_error" in rounds.columns:
        columns += [F.min_by("round", F.struct("val_error", "round")).alias("best_error_round"), F.min("val_error").alias("best_error"), at("train_error").alias("deployed_train_error"), at("val_error").alias("deployed_val_error"), gap("error").alias("final_error_gap")]
    out = rounds.groupBy("run").agg(*columns)
    return out.withColumn("verdict", F.when(F.col("final_gap") > 0.05, F.when(F.col("best_round") < F.col("last_round"), "overfits after the best round").otherwise("wide gap, still improving")).otherwise("no wide gap"))


def learning_curve_gain(sweep: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Gain over the next smaller fraction, by model."""
    return sweep.withColumn("gain", F.col(metric) - F.lag(metric).over(Window.partitionBy("model").orderBy("fraction")))


def sweep_curve(grid: DataFrame, raw: DataFrame, augmented: DataFrame) -> DataFrame:
    """Each (model, fraction) of the grid with both results, null where one is absent."""
    on = ["model", "fraction"]
    return grid.join(raw.select(*on, F.col("macro_f1").alias("raw_macro_f1")), on, "left").join(augmented.select(*on, F.col("macro_f1").alias("tta_macro_f1")), on, "left")
