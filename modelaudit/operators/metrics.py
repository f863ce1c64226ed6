"""Evaluation of predictions. Everything but AUC and paired tests starts from the counts of (true, predicted), one small
shuffle whatever the number of rows. Undefined precision, recall and F1 are 0."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.functions.ranges import percentiles, same, sums_before
from modelaudit.sources.shared import materialize


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def cells(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Counts of (true, predicted) by model. They are written, as most metrics read them more than once, and else all rows each time."""
    return materialize(preds.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n")), "cells")


def confusion_matrix(counts: DataFrame, k: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """All k * k cells, zeros kept."""
    grid = counts.select(*by).distinct().withColumn("y_true", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("y_pred", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").na.fill(0, ["n"])


def row_normalised(matrix: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Cells divided by their row's sum; null in an empty row."""
    total = F.sum("n").over(Window.partitionBy(*by, "y_true"))
    return matrix.withColumn("share", F.when(total > 0, F.col("n") / total))


def per_class(counts: DataFrame, k: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """Precision, recall, F1, support and number predicted for all k labels."""
    roles = counts.select(*by, "n", F.inline(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))), (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit"))
    grid = counts.select(*by).distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    sums = roles.groupBy(*by, "label").agg(F.sum(F.col("n") * F.col("t") * F.col("hit")).alias("tp"), F.sum(F.col("n") * F.col("t")).alias("support"), F.sum(F.col("n") * F.col("p")).alias("predicted"))
    out = grid.join(sums, [*by, "label"], "left").na.fill(0, ["tp", "support", "predicted"])
    return out.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support")), "f1": _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))})


def headline(counts: DataFrame, k: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """N, accuracy, macro-F1 over labels that occur, F1 weighted by support."""
    table = per_class(counts, k, by)
    present = (F.col("support") + F.col("predicted")) > 0
    return table.groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def _beside(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """``a`` with the columns of ``b``, which has one row for each value of ``by``."""
    b = b.withColumnsRenamed({c: f"_of_{c}" for c in by})
    return a.join(b, same(a, b, by, "_of_"), "left").drop(*[f"_of_{c}" for c in by])


def report(counts: DataFrame, k: int, intervals: DataFrame | None = None, by: Sequence[str] = ("model",)) -> DataFrame:
    """E3 as one nested object a model: (*by, report) with n, accuracy, macro_f1, weighted_f1, per_class (an object a label), matrix (rows
    of true labels) and, with ``intervals`` (as ``bootstrap_f1``), the interval of macro-F1 and each class's."""
    row = F.struct("label", "precision", "recall", "f1", "support", "predicted")
    classes = per_class(counts, k, by).groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("per_class"))  # k rows a model
    lines = confusion_matrix(counts, k, by).groupBy(*by, "y_true").agg(F.array_sort(F.collect_list(F.struct("y_pred", "n"))).alias("_row"))
    matrix = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y_true", F.transform("_row", lambda x: x["n"]).alias("n")))).alias("_rows"))
    out = _beside(_beside(headline(counts, k, by), classes, by), matrix.select(*by, F.transform("_rows", lambda x: x["n"]).alias("matrix")), by)
    fields = ["n", "accuracy", "macro_f1", "weighted_f1", "per_class", "matrix"]
    if intervals is not None:
        out = _beside(out, intervals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("label", "mean", "lo", "hi"))).alias("intervals")), by)
        fields.append("intervals")
    return out.select(*by, F.struct(*fields).alias("report"))


#: scores a range, and rows whose scores are sorted together
RANGE, TOGETHER = 4_000_000, 200_000


def packed_scores(preds: DataFrame, by: Sequence[str], ends: list[float]) -> DataFrame:
    """(*by, label, bin, v, pos, neg, odd): for some rows at a time, the distinct scores of a label in a range (8 bytes each, ascending; null
    is the least) and how many rows of that class and of others have each. ``odd``: whether a row's probabilities don't sum to 1."""
    kinds = ", ".join(f"`{c}` {preds.schema[c].dataType.simpleString()}" for c in by)
    cuts = np.array(ends, float)

    def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch["y_prob"]
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, flat = np.repeat(np.arange(len(size)), size), lists.flatten()
        label = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        score, null = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_null().to_numpy(zero_copy_only=False)
        total = np.bincount(row, np.where(null, 0, score), len(size))
        odd = ~(np.abs(total - 1) <= 1e-3) & ~(np.bincount(row, null, len(size)) > 0)
        score = np.where(null, -np.inf, score)
        known = batch["y_true"].is_valid().to_numpy(zero_copy_only=False)
        true = pc.fill_null(batch["y_true"], -1).to_numpy(zero_copy_only=False)
        groups: dict[tuple, int] = {}
        code = np.array([groups.setdefault(g, len(groups)) for g in zip(*[batch[c].to_pylist() for c in by], strict=True)] if by else [groups.setdefault((), 0)] * len(size), np.int64)
        order = np.lexsort((score, label, code[row]))
        row, label, score = row[order], label[order], score[order]
        part, bin = code[row], np.searchsorted(cuts, score, side="right")
        cell = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (label[1:] != label[:-1]) | (bin[1:] != bin[:-1])])) if len(row) else np.zeros(0, int)
        hit, keys = known[row] & (true[row] == label), list(groups)
        miss = known[row] & ~hit
        out = {c: [] for c in (*by, "label", "bin", "v", "pos", "neg", "odd")}
        for a, b in zip(cell, [*cell[1:], len(row)], strict=True):
            v, at = np.unique(score[a:b], return_inverse=True)
            values = (*keys[part[a]], int(label[a]), int(bin[a]), v.tobytes(), np.bincount(at, hit[a:b]).astype(np.int64).tobytes(), np.bincount(at, miss[a:b]).astype(np.int64).tobytes(), int(odd[row[a:b]].any()))
            for c, x in zip(out, values, strict=True):
                out[c].append(x)
        types = {c: batch.schema.field(c).type for c in by} | {"label": pa.int32(), "bin": pa.int32(), "v": pa.binary(), "pos": pa.binary(), "neg": pa.binary(), "odd": pa.int64()}
        yield pa.RecordBatch.from_pydict({c: pa.array(x, types[c]) for c, x in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                yield from chunks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n = [], 0
        if n:
            yield from chunks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return preds.select(*by, "y_true", "y_prob").mapInArrow(run, f"{kinds}{', ' if by else ''}label int, bin int, v binary, pos binary, neg binary, odd long")


def roc_auc(preds: DataFrame, k: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """E5: unweighted mean of one-vs-rest AUCs by midranks; null where a class is missing or probabilities don't sum to 1.

    Scores are dealt to ranges, whose ends are quantiles of some of them, as sorted chunks of counted values (``packed_scores``), and
    a task sums up the pairs within a range, so neither a class nor scores that crowd near 0 and 1 are one task. What lies in the ranges
    before comes from a table of range totals.
    """
    preds = materialize(preds.select(*by, "y_true", "y_prob"), "auc-scores")
    n = preds.count()
    flat = preds.sample(min(1.0, 100_000 / max(n, 1)), 42).select(F.explode("y_prob").alias("s"))  # it sets ends of ranges alone
    wanted = -(-n * k // RANGE)
    ends = flat.agg(F.percentile_approx("s", [(i + 1) / wanted for i in range(wanted - 1)], 10_000)).first()[0] if wanted > 1 else []
    chunks = packed_scores(preds, by, sorted(set(ends or [])))
    names = [*by, "label", "bin"]
    kinds = ", ".join(f"`{c}` {preds.schema[c].dataType.simpleString()}" for c in by)
    dealt = chunks.repartition(max(wanted, preds.sparkSession.sparkContext.defaultParallelism), *names).sortWithinPartitions(*names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total() -> pa.RecordBatch:
            v, pos, neg = (np.concatenate([np.frombuffer(c[i], kind) for c in held]) for i, kind in ((0, float), (1, np.int64), (2, np.int64)))
            _, back = np.unique(v, return_inverse=True)
            pos, neg = np.bincount(back, pos), np.bincount(back, neg)
            row = dict(zip(names, key, strict=True)) | {"u": float((pos * (np.cumsum(neg) - neg / 2)).sum()), "p": int(pos.sum()), "n": int(neg.sum()), "odd": max(c[3] for c in held)}
            return pa.RecordBatch.from_pydict({c: pa.array([x], types.get(c)) for c, x in row.items()})

        key, held, types = None, [], {}
        for batch in batches:
            types = {c: batch.schema.field(c).type for c in names}
            for r in range(batch.num_rows):
                now = tuple(batch[c][r].as_py() for c in names)
                if now != key and held:
                    yield total()
                    held = []
                key = now
                held.append((*(batch[c][r].as_buffer().to_pybytes() for c in ("v", "pos", "neg")), batch["odd"][r].as_py()))
        if held:
            yield total()

    bins = materialize(dealt.mapInArrow(summed, f"{kinds}{', ' if by else ''}label int, bin int, u double, p long, n long, odd long"), "range-sums")
    each = sums_before(bins, [*by, "label"], "bin", "n", "_under", len(ends or []) + 1)
    each = each.groupBy(*by, "label").agg(F.sum(F.col("u") + F.col("_under") * F.col("p")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("odd").alias("odd"))
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n")))
    out = each.groupBy(*by).agg(F.avg(auc).alias("auc"), F.count(auc).alias("labels"), F.max("odd").alias("odd"))
    problem = F.when(F.col("odd") > 0, "probabilities don't sum to 1").when(F.col("labels") < k, "a class is missing")
    return out.select(*by, F.when(problem.isNull(), F.col("auc")).alias("auc"), problem.alias("problem"))


def metrics_table(counts: DataFrame, k: int, stages: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of each stage side by side, a row a class and one for the means (label null). ``counts`` by stage."""
    table = per_class(counts, k, ("stage",))
    both = table.select("stage", "label", "precision", "recall", "f1").unionByName(table.groupBy("stage").agg(F.lit(None).cast("int").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")))
    return both.groupBy("label").pivot("stage", list(stages)).agg(F.first("precision").alias("precision"), F.first("recall").alias("recall"), F.first("f1").alias("f1"))


def long_metrics(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, label, metric, value) of a ``per_class`` table: precision, recall and F1 of each label, and their means (label null)."""
    long = table.select(*by, "label", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")])))
    means = long.groupBy(*by, "metric").agg(F.avg("value").alias("value")).withColumn("label", F.lit(None).cast("int"))
    return long.unionByName(means)


def cv_stability(folds: DataFrame, test: DataFrame) -> DataFrame:
    """Mean, population std, min and max over folds of each label's precision, recall and F1 and of their means (label
    null), and how many stds the test value is away, with a verdict. ``folds``: ``per_class`` by fold; ``test``: ``per_class``."""
    s = long_metrics(folds, ("fold",)).groupBy("label", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))
    t = long_metrics(test).select(F.col("label").alias("_l"), F.col("metric").alias("_m"), F.col("value").alias("test"))
    s = s.join(t, s["label"].eqNullSafe(t["_l"]) & (s["metric"] == t["_m"])).drop("_l", "_m")
    away = F.when(F.col("std") >= 1e-9, (F.col("test") - F.col("mean")) / F.col("std"))
    far = F.abs(F.col("sigma"))
    return s.withColumn("sigma", away).withColumn("verdict", F.when(far.isNull(), "skipped").when(far >= 1.5, "structural mismatch").when(far >= 1, "borderline").otherwise("within bounds"))


def gap(reports: DataFrame, key: str, between: str, first: str, second: str, value: str) -> DataFrame:
    """The same model's value in two settings, and first minus second."""
    wide = reports.groupBy(key).pivot(between, [first, second]).agg(F.first(value))
    return wide.withColumn("gap", F.col(first) - F.col(second))


def val_test_gap(epochs: DataFrame, test: DataFrame, key: str = "run") -> DataFrame:
    """The best validation macro-F1 of a run's epochs minus the run's macro-F1 on test. ``epochs``: (key, val_macro_f1), a
    row an epoch; ``test``: (key, macro_f1). Runs that lack either are left out."""
    best = epochs.groupBy(key).agg(F.max("val_macro_f1").alias("best_val")).filter(F.col("best_val").isNotNull())
    return best.join(test.select(key, F.col("macro_f1").alias("test")), key).withColumn("gap", F.col("best_val") - F.col("test"))


def error_counts(preds: DataFrame) -> DataFrame:
    """Errors counted, and the count that accuracy and n give, half to even."""
    wrong = (F.col("y_true") != F.col("y_pred")).cast("long")
    out = preds.groupBy("model").agg(F.sum(wrong).alias("errors"), F.count("*").alias("n"))
    return out.withColumn("from_accuracy", F.bround((1 - (1 - F.col("errors") / F.col("n"))) * F.col("n"), 0).cast("long"))


def confidence_by_outcome(preds: DataFrame) -> DataFrame:
    """Mean and median confidence of right and wrong predictions."""
    rows = preds.select("model", (F.col("y_true") == F.col("y_pred")).alias("correct"), F.get("y_prob", F.col("y_pred")).alias("c"))
    middle = percentiles(rows, ["model", "correct"], "c", {"median": 0.5}).withColumnsRenamed({"model": "_m", "correct": "_c"})
    sums = rows.groupBy("model", "correct").agg(F.count("*").alias("n"), F.avg("c").alias("mean"))
    return sums.join(middle, F.col("model").eqNullSafe(F.col("_m")) & F.col("correct").eqNullSafe(F.col("_c")), "left").drop("_m", "_c")


def true_class_rank(preds: DataFrame) -> DataFrame:
    """Histogram of the true class's rank among a row's probabilities (ties by lower index), and accuracy within the top so many."""
    p = F.get("y_prob", F.col("y_true"))
    ahead = F.size(F.filter(F.transform("y_prob", lambda x, i: (x > p) | ((x == p) & (i < F.col("y_true")))), lambda x: x))
    counts = preds.groupBy("model", (ahead + 1).alias("rank")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("model")
    return counts.withColumn("top_accuracy", F.sum("n").over(w.orderBy("rank")) / F.sum("n").over(w))


def leaderboard(counts: DataFrame, k: int, label: int) -> DataFrame:
    """Accuracy, macro-F1 and one class's F1 of each model, ranked by macro-F1."""
    one = per_class(counts, k).filter(F.col("label") == label).select("model", F.col("f1").alias("class_f1"))
    board = headline(counts, k).select("model", "accuracy", "macro_f1").join(one, "model")
    return board.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("macro_f1"), F.desc("accuracy"))))


def direction_tally(counts: DataFrame, true: int, predicted: int) -> DataFrame:
    """Errors in one direction by model, zeros kept."""
    hit = (F.col("y_true") == true) & (F.col("y_pred") == predicted)
    return counts.groupBy("model").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("errors"))
