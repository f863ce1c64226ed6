"""Training and choosing classifiers on feature tables (item_id, features array<double>, y_true), with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.functions.items import argmax_class, order_key
from modelaudit.operators import metrics
from modelaudit.operators.bootstrap import bootstrap_f1
from modelaudit.operators.leakage import pool_splits
from modelaudit.operators.neighbours import borderline_smote
from modelaudit.operators.splits import class_weights, ranked, stratified_fraction, stratified_kfold
from modelaudit.operators.trees import boosting_rounds, forest_cells
from modelaudit.sources.shared import materialize


COVERED = 20_000  # covered images a task


def fit_standard(train: DataFrame) -> tuple[list[float], list[float]]:
    """M1: mean and population std of each dimension of the training rows; 1 where the std is 0."""
    rows = train.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # a row a dimension
    return [r["m"] for r in rows], [r["s"] or 1.0 for r in rows]


def standardise(rows: DataFrame, fitted: tuple[list[float], list[float]]) -> DataFrame:
    pairs = F.arrays_zip("features", F.lit(fitted[0]).alias("m"), F.lit(fitted[1]).alias("s"))
    return rows.withColumn("features", F.transform(pairs, lambda z: (z["features"] - z["m"]) / z["s"]))


def pca_project(train: DataFrame, rows: DataFrame, n: int = 50) -> DataFrame:
    """M2: ``rows`` on up to ``n`` components of the standardised training rows; each component's largest weight is positive."""
    size, dim = train.count(), len(train.select("features").first()[0])
    n = min(n, size - 1, dim)
    model = PCA(k=n, inputCol="v", outputCol="p").fit(train.select(array_to_vector("features").alias("v")))
    w = model.pc.toArray()
    sign = np.sign(w[np.abs(w).argmax(axis=0), np.arange(n)])
    out = model.transform(rows.withColumn("v", array_to_vector("features"))).withColumn("p", vector_to_array("p"))
    return out.withColumn("features", F.zip_with("p", F.lit(sign.tolist()), lambda a, s: a * s)).drop("v", "p")


def _weighted(rows: DataFrame) -> DataFrame:
    w = class_weights(rows, "y_true").select(F.col("class").alias("_y"), F.col("balanced").alias("weight"))
    return rows.join(F.broadcast(w), F.col("y_true") == F.col("_y")).select("weight", F.col("y_true").cast("double").alias("label"), array_to_vector("features").alias("v"))


def _fit_cached(learner: Estimator, rows: DataFrame) -> Model:
    """For learners that pass over the rows many times."""
    held = _weighted(rows).cache()
    try:
        return learner.fit(held)
    finally:
        held.unpersist()


def linear_svm(rows: DataFrame, reg: float = 0.01, iterations: int = 10) -> Model:
    """M4: one-vs-rest linear machines on balanced weights. It has margins only, of which ``score`` takes the softmax; for probabilities
    see ``calibrated_svm``."""
    base = LinearSVC(featuresCol="v", labelCol="label", weightCol="weight", regParam=reg, maxIter=iterations)
    return _fit_cached(OneVsRest(classifier=base, featuresCol="v", labelCol="label", weightCol="weight"), rows)


class Calibrated:
    """A one-vs-rest machine with a sigmoid for each member's margin; probabilities are the sigmoids' shares of their sum."""

    def __init__(self, model: Model, sigmoids: list[tuple[float, float]]) -> None:
        self.model, self.sigmoids = model, sigmoids

    def transform(self, rows: DataFrame) -> DataFrame:
        margins = self.model.transform(rows)
        m = vector_to_array("rawPrediction")
        each = F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.get(m, F.lit(i)) + F.lit(b)))) for i, (a, b) in enumerate(self.sigmoids)])
        margins = margins.withColumn("_each", each)
        total = F.aggregate("_each", F.lit(1e-300), lambda s, x: s + x)
        return margins.withColumn("_total", total).withColumn("probability", array_to_vector(F.transform("_each", lambda x: x / F.col("_total")))).drop("_each", "_total")


def fit_sigmoids(margins: DataFrame, k: int) -> list[tuple[float, float]]:
    """Slope and intercept of each class's sigmoid by maximum likelihood on (y_true, margins), with targets (n1 + 1) / (n1 + 2) and
    1 / (n0 + 2) in place of 1 and 0, so that margins that part the classes have a finite slope. Newton steps; each is one pass, whose
    few sums for all classes go to the driver."""
    counts = {r["y_true"]: r["count"] for r in margins.groupBy("y_true").count().collect()}  # a row a class
    n = sum(counts.values())
    found = [(1.0, 0.0)] * k
    for _ in range(30):
        sums = []
        for i, (a, b) in enumerate(found):
            n1 = counts.get(i, 0)
            t = F.when(F.col("y_true") == i, F.lit((n1 + 1.0) / (n1 + 2.0))).otherwise(F.lit(1.0 / (n - n1 + 2.0)))
            x = F.get("margins", F.lit(i))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * x + F.lit(b))))
            sums += [F.sum(y).alias(f"{name}{i}") for name, y in (("ga", (t - p) * x), ("gb", t - p), ("aa", p * (1 - p) * x * x), ("ab", p * (1 - p) * x), ("bb", p * (1 - p)))]
        r = margins.agg(*sums).first()
        moved, largest = [], 0.0
        for i, (a, b) in enumerate(found):
            g, h = np.array([r[f"ga{i}"], r[f"gb{i}"]]), np.array([[r[f"aa{i}"], r[f"ab{i}"]], [r[f"ab{i}"], r[f"bb{i}"]]]) + 1e-10 * np.eye(2)
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            moved.append((a + step[0], b + step[1]))
            largest = max(largest, float(np.abs(step).max()))
        found = [(float(a), float(b)) for a, b in moved]
        if largest < 1e-6:
            break
    return found


def calibrated_svm(rows: DataFrame, k: int, folds: int = 5, fit: Callable[[DataFrame], Model] = linear_svm) -> Calibrated:
    """M4 with probabilities: sigmoids are fitted to margins of rows that the machine hasn't seen (stratified folds), then the machine is
    fitted on all rows."""
    dealt = materialize(stratified_kfold(rows.select("item_id", "features", "y_true"), "item_id", "y_true", folds), "calibration-folds")

    def unseen(f: int) -> DataFrame:
        model = fit(dealt.filter(F.col("fold") != f).drop("fold"))
        out = model.transform(dealt.filter(F.col("fold") == f).withColumn("v", array_to_vector("features")))
        return materialize(out.select("y_true", vector_to_array("rawPrediction").alias("margins")), "margins")

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(unseen), range(folds)))
    return Calibrated(fit(rows), fit_sigmoids(pool_splits(*parts), k))


def _waves(dim: int, gamma: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (dim, n)), rng.uniform(0, 2 * np.pi, n)


def fourier(rows: DataFrame, gamma: float, n: int = 128, seed: int = 42) -> DataFrame:
    """M5: random Fourier features of the RBF kernel exp(-gamma * |x - y|^2)."""

    def run(batches):  # noqa: ANN001, ANN202
        for df in batches:
            x = np.stack(df["features"].to_numpy()) if len(df) else np.empty((0, 1))
            w, b = _waves(x.shape[1], gamma, n, seed)
            df["features"] = list(np.sqrt(2 / n) * np.cos(x @ w + b))
            yield df

    return rows.mapInPandas(run, rows.schema)


def kernel_error(x: np.ndarray, gamma: float, n: int, seed: int = 42) -> float:
    """Root mean square difference of the kernel and its approximation by ``n`` features, over all pairs of the rows of ``x``."""
    w, b = _waves(x.shape[1], gamma, n, seed)
    z = np.sqrt(2 / n) * np.cos(x @ w + b)
    true = np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0))
    return float(np.sqrt(np.mean((z @ z.T - true) ** 2)))


def fourier_size(rows: DataFrame, gamma: float, bound: float = 0.03, most: int = 8192, sample: int = 256, seed: int = 42) -> tuple[int, float]:
    """How many Fourier features keep the kernel's error within ``bound``, and that error: measured on ``sample`` rows (those with the
    smallest hashes), doubling from 64. Beyond ``most`` features it is an error, as the bound was not met."""
    some = rows.orderBy(order_key(F.col("item_id")), "item_id").select("features").limit(sample).collect()
    x = np.array([r["features"] for r in some], float)
    n = 64
    while (error := kernel_error(x, gamma, n, seed)) > bound:
        n *= 2
        if n > most:
            raise ValueError(f"{most} features leave an error of {error:.3f}, over {bound}")
    return n, error


class KernelMachine:
    """M5: a linear machine on Fourier features, which it makes of the rows it is given."""

    def __init__(self, model: Model | Calibrated, gamma: float, n: int, error: float) -> None:
        self.model, self.gamma, self.n, self.error = model, gamma, n, error

    def transform(self, rows: DataFrame) -> DataFrame:
        given = fourier(rows.drop("v"), self.gamma, self.n)
        return self.model.transform(given.withColumn("v", array_to_vector("features")))


def rbf_svm(rows: DataFrame, c: float = 1.0, gamma: float | str = "scale", bound: float = 0.03, iterations: int = 20) -> KernelMachine:
    """M5: an RBF machine with cost ``c`` and ``gamma`` (a number; scale: 1 / (dimensions * variance of all values); auto: 1 / dimensions),
    on as many Fourier features as the bound on the kernel's error asks for."""
    if isinstance(gamma, str):
        r = rows.select(F.size("features").alias("d"), F.explode("features").alias("x")).agg(F.max("d").alias("d"), F.var_pop("x").alias("v")).first()
        gamma = 1 / r["d"] if gamma == "auto" else 1 / (r["d"] * (r["v"] or 1.0))
    n, error = fourier_size(rows, gamma, bound)
    count = rows.count()
    return KernelMachine(linear_svm(fourier(rows, gamma, n), 1 / (max(count, 1) * c), iterations), gamma, n, error)


def oversampled(rows: DataFrame, m: int = 10, k: int = 5) -> DataFrame:
    """M6 with T9: training rows and the made-up ones of smaller classes; made-up rows have the id of the row they lie next to."""
    return borderline_smote(rows, klass="y_true", m=m, k=k).select("item_id", "features", "y_true")


def random_forest(rows: DataFrame, trees: int = 20, depth: int = 5, features: str = "sqrt", least: int = 1) -> Model:
    """M6. ``features``: how many of them a split looks at (sqrt, log2, all or a number); ``least``: rows in a leaf."""
    learner = RandomForestClassifier(featuresCol="v", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy=features, minInstancesPerNode=least, seed=42)
    return learner.fit(_weighted(rows))


def boosted_trees(rows: DataFrame, rounds: int = 5, depth: int = 3, rate: float = 0.1, features: str = "all", share: float = 1.0) -> Model:
    """M7. ``rate``: a round's weight; ``features``: the share of columns a split looks at; ``share``: of rows in a round."""
    base = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, featureSubsetStrategy=features, subsamplingRate=share, seed=42)
    return _fit_cached(OneVsRest(classifier=base, featuresCol="v", labelCol="label", weightCol="weight"), rows)


def round_series(model: Model, train: DataFrame, val: DataFrame) -> DataFrame:
    """M7, for W4: (run, round, train_loss, val_loss, train_error, val_error) of each member (run: its label) and of all together (run:
    all), after every round, in one pass over the rows."""
    both = train.select("features", "y_true", F.lit("train").alias("part")).unionByName(val.select("features", "y_true", F.lit("val").alias("part")))
    series = boosting_rounds(train.sparkSession, model, both, ("part",))
    at = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{part}_{c}")
    return series.groupBy(F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("run"), "round").agg(*[at(p, c) for c in ("loss", "error") for p in ("train", "val")])


def score(model: Model, rows: DataFrame, k: int, name: str = "model") -> DataFrame:
    """M8: model, item_id, y_true, y_pred, y_prob."""
    out = model.transform(rows.withColumn("v", array_to_vector("features")))
    known = "probability" in out.columns
    out = out.select("item_id", "y_true", vector_to_array("probability" if known else "rawPrediction").alias("raw"))
    if not known:
        total = F.aggregate(F.transform("raw", lambda x: F.exp(x)), F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("raw", F.transform("raw", lambda x: F.exp(x) / total))
    prob = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get("raw", i), F.lit(0.0)))
    out = out.select(F.lit(name).alias("model"), "item_id", "y_true", prob.alias("y_prob"))
    return out.withColumn("y_pred", argmax_class(F.col("y_prob")))


def macro_f1(preds: DataFrame, k: int) -> float:
    return metrics.headline(metrics.cells(preds), k).first()["macro_f1"]


def prepared_folds(rows: DataFrame, folds: int, oversample: Callable[[DataFrame], DataFrame] | None, pool: ThreadPoolExecutor) -> list[tuple[DataFrame, DataFrame]]:
    """What belongs to a fold: the scaling is fitted on its training rows, which are scaled and, with ``oversample`` (as ``oversampled``,
    T9), filled up; its test rows are only scaled."""

    def prepared(f: int) -> tuple[DataFrame, DataFrame]:
        train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        fitted = fit_standard(train)
        train = standardise(train, fitted)
        return materialize(oversample(train) if oversample else train, "fold-train"), materialize(standardise(test, fitted), "fold-test")

    return list(pool.map(inheritable_thread_target(rows.sparkSession)(prepared), range(folds)))


def grid_search_cv(rows: DataFrame, fit: Callable[..., Model], grid: dict[str, Sequence], k: int, folds: int, oversample: Callable[[DataFrame], DataFrame] | None = None, at_once: int = 4) -> list[tuple[dict, float]]:
    """M3: mean macro-F1 over folds (column ``fold``) of each parameter set, in the grid's order. Folds are made once for all sets;
    ``at_once`` fits run side by side."""
    sets = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]

    def scored(job: tuple[dict, tuple[DataFrame, DataFrame]]) -> float:
        params, (train, test) = job
        return macro_f1(score(fit(train, **params), test, k), k)

    with ThreadPoolExecutor(at_once) as pool:
        parts = prepared_folds(rows, folds, oversample, pool)
        scores = list(pool.map(inheritable_thread_target(rows.sparkSession)(scored), [(params, part) for params in sets for part in parts]))
    return [(params, float(np.mean(scores[i * folds : (i + 1) * folds]))) for i, params in enumerate(sets)]


def forest_search_cv(rows: DataFrame, grid: dict[str, Sequence], k: int, folds: int, oversample: Callable[[DataFrame], DataFrame] | None = None, at_once: int = 4) -> list[tuple[dict, float]]:
    """M3 for forests (``trees`` and ``depth``, and any other of ``random_forest``): as ``grid_search_cv``, but a fold is fitted once for
    all numbers of trees and all depths. The largest, deepest forest has the others inside: its first trees, cut at a depth.
    Draws differ from those of a forest fitted at the smaller size, the distribution doesn't."""
    others = {p: values for p, values in grid.items() if p not in ("trees", "depth")}
    sets = [dict(zip(others, values, strict=True)) for values in product(*others.values())]
    sizes, depths, spark = list(grid["trees"]), list(grid["depth"]), rows.sparkSession

    def scored(job: tuple[dict, tuple[DataFrame, DataFrame]]) -> dict[tuple[int, int], float]:
        params, (train, test) = job
        model = random_forest(train, max(sizes), max(depths), **params)
        table = metrics.headline(forest_cells(spark, model, test, sizes, depths), k, ("trees", "depth"))
        return {(r["trees"], r["depth"]): r["macro_f1"] for r in table.collect()}  # a row a parameter set

    with ThreadPoolExecutor(at_once) as pool:
        parts = prepared_folds(rows, folds, oversample, pool)
        found = list(pool.map(inheritable_thread_target(spark)(scored), [(params, part) for params in sets for part in parts]))
    out = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        i = sets.index({p: params[p] for p in others})
        out.append((params, float(np.mean([f[params["trees"], params["depth"]] for f in found[i * folds : (i + 1) * folds]]))))
    return out


def train_select_refit(train: DataFrame, val: DataFrame, candidates: dict[str, Callable[[DataFrame], Model]], k: int) -> tuple[str, Model, dict[str, float]]:
    """Fit each candidate, take the best macro-F1 on val (first on ties), fit it again on train and val together."""
    scores = {name: macro_f1(score(fit(train), val, k), k) for name, fit in candidates.items()}
    best = max(scores, key=scores.get)
    return best, candidates[best](pool_splits(train, val)), scores


def rows_of(table: DataFrame) -> DataFrame:
    """A table of few rows, held by the driver: computed once."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def data_efficiency_sweep(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], Model], k: int, fractions: Sequence[float] = (0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """M9: (fraction, n_train, macro_f1, lo, hi) on a fixed test split; subsets are nested."""
    out = None
    for f in fractions:
        part = stratified_fraction(train, f, "item_id", "y_true")
        counts = metrics.cells(score(fit(part), test, k))
        counts = rows_of(counts)  # k * k rows at most
        ci = bootstrap_f1(counts, k, 200).filter("label is null").select("lo", "hi")
        row = metrics.headline(counts, k).select(F.lit(f).alias("fraction"), F.lit(part.count()).alias("n_train"), "macro_f1").join(F.broadcast(ci))
        out = row if out is None else out.unionByName(row)
    return out


def permutation_importance(model: Model, test: DataFrame, groups: dict[str, Sequence[int]], k: int, repeats: int = 3) -> DataFrame:
    """(group, drop, std): fall of macro-F1 when a group of features comes from another row. Donors are rows by rank: in each
    repeat, row r gives to the row whose hash rank is r. Ranks are taken of ids alone, in ranges of the hash."""
    ids = test.select("item_id").withColumn("_all", F.lit(0))
    rank_of = lambda seed: ranked(ids, "item_id", "_all", seed=seed).select(F.col("item_id").alias("_i"), F.col("rank").alias("r"))
    first = rank_of(0)
    base = test.select("item_id", "y_true", "features").join(first, F.col("item_id") == F.col("_i")).drop("_i")
    names = list(groups)
    masks = F.array(*[F.struct(F.lit(n).alias("grp"), F.lit([int(i) for i in groups[n]]).alias("at")) for n in names])
    rows = base.withColumn("m", F.explode(masks)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).select("item_id", "y_true", "features", "r", "m.*", "rep")
    donors = None
    for rep in range(1, repeats + 1):
        d = rank_of(rep).withColumn("rep", F.lit(rep))
        donors = d if donors is None else donors.unionByName(d)
    donors = donors.join(test.select(F.col("item_id").alias("_i"), F.col("features").alias("other")), "_i").drop("_i")
    mixed = rows.join(donors, ["r", "rep"]).withColumn("features", F.transform("features", lambda x, i: F.when(F.array_contains("at", i), F.get("other", i)).otherwise(x)))
    mixed = mixed.withColumn("item", F.col("item_id")).withColumn("item_id", F.concat_ws("|", "grp", "rep", "item_id"))
    out = score(model, mixed, k).withColumns({"grp": F.split("item_id", "\\|")[0], "rep": F.split("item_id", "\\|")[1]})
    scores = metrics.headline(metrics.cells(out, ("grp", "rep")), k, ("grp", "rep"))
    full = macro_f1(score(model, test, k), k)
    return scores.groupBy("grp").agg((F.lit(full) - F.avg("macro_f1")).alias("drop"), F.stddev_pop("macro_f1").alias("std")).withColumnRenamed("grp", "group")


def occlusion_map(model: Model, images: DataFrame, extract: Callable[[DataFrame], DataFrame], k: int, patch: int = 48, stride: int = 24, fill: int = 128) -> DataFrame:
    """(item_id, y, x, heat): fall of the predicted class's confidence when a grey patch covers a place; falls are averaged
    over the patches that cover a cell of ``stride`` pixels and scaled to at most 1. Positions fan out; pixels change in the worker."""
    import pandas as pd

    size = images.select("height").first()[0]
    starts = list(range(0, max(1, size - patch + 1), stride))
    spots = F.array(F.struct(F.lit(-1).alias("py"), F.lit(-1).alias("px")), *[F.struct(F.lit(y).alias("py"), F.lit(x).alias("px")) for y in starts for x in starts])
    # few files may hold many images, and each is work for a task as often as there are positions
    n = images.count()
    parts = max(-(-n * (len(starts) ** 2 + 1) // COVERED), min(images.sparkSession.sparkContext.defaultParallelism, n), 1)
    rows = images.repartition(parts, "item_id").withColumn("s", F.explode(spots)).select("class", "pixels", "height", "width", "s.py", "s.px", F.concat_ws("|", "item_id", F.col("s.py").cast("string"), F.col("s.px").cast("string")).alias("item_id"))

    def cover(frames):  # noqa: ANN001, ANN202
        for df in frames:
            out = []
            for data, h, w, y, x in zip(df["pixels"], df["height"], df["width"], df["py"], df["px"], strict=True):
                img = np.frombuffer(data, np.uint8).reshape(h, w).copy()
                if y >= 0:
                    img[y : y + patch, x : x + patch] = fill
                out.append(img.tobytes())
            yield pd.DataFrame({"item_id": df["item_id"], "class": df["class"], "pixels": out, "height": df["height"], "width": df["width"]})

    covered = rows.select("item_id", "class", "pixels", "height", "width", "py", "px").mapInPandas(cover, "item_id string, class string, pixels binary, height int, width int")
    scored = score(model, extract(covered).withColumn("features", F.col("features").cast("array<double>")).withColumn("y_true", F.lit(0)), k)
    at = F.split("item_id", "\\|")
    scored = scored.select(at[0].alias("item_id"), at[1].cast("int").alias("py"), at[2].cast("int").alias("px"), "y_prob", "y_pred")
    whole = scored.filter("py < 0").select("item_id", F.col("y_pred").alias("target"), F.get("y_prob", F.col("y_pred")).alias("conf"))
    drops = scored.filter("py >= 0").join(whole, "item_id").withColumn("drop", F.greatest(F.lit(0.0), F.col("conf") - F.get("y_prob", F.col("target"))))
    steps = F.sequence(F.lit(0), F.lit(max(0, patch - 1)), F.lit(stride))
    cells = drops.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    heat = cells.groupBy("item_id", (F.col("py") + F.col("dy")).alias("y"), (F.col("px") + F.col("dx")).alias("x")).agg(F.avg("drop").alias("heat"))
    top = F.max("heat").over(Window.partitionBy("item_id"))
    return heat.withColumn("heat", F.when(top > 0, F.col("heat") / top).otherwise(F.lit(0.0)))
