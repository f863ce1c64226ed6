"""Queries on stores, images and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelaudit.functions import items as fn
from modelaudit.operators import curves, ensembles, metrics, ml, splits
from modelaudit.plans import views as v
from modelaudit.plans.catalog import query
from modelaudit.plans.q_metrics import CELLS, GRID, K, STAGES_SQL, per_class_sql, stage_table
from modelaudit.plans.q_models import EPOCHS, epochs, item_splits
from modelaudit.sources import images, stores
from modelaudit.sources.shared import materialize, new_dir

R6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]
K3 = 3


@query("s1_scan_images", f"WITH {v.ITEMS} SELECT class || '/' || replace(name, '.jpg', '.png') AS item_id, class, 8 AS height, 8 AS width FROM items")
def s1(spark, sf_dir):
    return scanned(spark, sf_dir).select("item_id", "class", "image.height", "image.width")


def scanned(spark, sf_dir):
    """The vectors as 8 x 8 images, written as files and found again."""
    path = new_dir(spark, "images")
    names = v.items(spark, sf_dir).withColumn("file", F.replace("name", F.lit(".jpg"), F.lit(".png")))
    images.write_images(images.pixel_table(names, "file"), path)
    return images.scan_images(spark, path, [f"c{i}" for i in range(10)])


@query("s3_load_split", f"WITH {v.ITEMS}, {v.split_sql('items')} SELECT name AS filename, class, '/data/' || class || '/' || name AS abs_path, class_idx FROM split_items WHERE split = 'val'")
def s3(spark, sf_dir):
    path = new_dir(spark, "manifest")
    stores.write_manifest(splits.group_split(v.items(spark, sf_dir)).withColumnRenamed("name", "filename"), path)
    return stores.load_split(spark, "val", path, "/data/", [f"c{i}" for i in range(10)]).select("filename", "class", "abs_path", "class_idx")


@query("s4_write_manifest", f"WITH {v.ITEMS}, {v.split_sql('items')} SELECT name AS filename, class, split FROM split_items")
def s4(spark, sf_dir):
    path = new_dir(spark, "manifest")
    stores.write_manifest(splits.group_split(v.items(spark, sf_dir)).withColumnRenamed("name", "filename"), path)
    return spark.read.csv(path, header=True)


@query("s5_feature_store", f"WITH {v.ITEMS} SELECT item_id, round(list_sum(features), 5) AS total FROM items")
def s5(spark, sf_dir):
    path, rows = new_dir(spark, "features"), v.items(spark, sf_dir).select("item_id", "features")
    compute = lambda d: d.select("item_id", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"))
    stores.append_features(spark, rows.filter("item_id % 3 = 0"), compute, path)
    return stores.append_features(spark, rows, compute, path).withColumn("total", F.round("total", 5))


@query("s6_prediction_store", f"WITH {v.PREDICTIONS} SELECT model, item_id, y_true, y_pred FROM predictions")
def s6(spark, sf_dir):
    path = new_dir(spark, "predictions")
    stores.write_predictions(v.predictions(spark, sf_dir), path)
    return spark.read.parquet(path).select("model", "item_id", "y_true", "y_pred")


@query("s7_reports", f"""WITH {CELLS}, {per_class_sql()}, {GRID}, m AS (SELECT model, sum(tp) / sum(support) AS accuracy, avg(f1) FILTER (support + predicted > 0) AS macro_f1, list(round(f1, 6) ORDER BY label) AS f1 FROM pc GROUP BY 1),
l AS (SELECT model, y_true, list(n ORDER BY y_pred) AS r FROM cm GROUP BY 1, 2), x AS (SELECT model, CAST(to_json(list(r ORDER BY y_true)) AS VARCHAR) AS matrix FROM l GROUP BY 1)
SELECT m.model, round(accuracy, 6) AS report_accuracy, round(macro_f1, 6) AS report_macro_f1, f1[3] AS f1_of_2, matrix FROM m JOIN x ON m.model = x.model""")
def s7(spark, sf_dir):
    """Nested reports, written as JSON and read back."""
    path = new_dir(spark, "reports")
    stores.write_reports(metrics.report(metrics.cells(v.predictions(spark, sf_dir)), K), path)
    fields = ["model", "report.accuracy", "report.macro_f1", "report.per_class", "report.matrix"]
    out = stores.read_reports(spark, path, fields)
    return out.select("model", *R6("report_accuracy", "report_macro_f1"), F.round(F.get("report_per_class", F.lit(2))["f1"], 6).alias("f1_of_2"), F.to_json("report_matrix").alias("matrix"))


@query("s8_read_run_logs", f"WITH {EPOCHS} SELECT CAST(run AS VARCHAR) AS run, idx AS index, stage, epoch, round(val_loss, 6) AS val_loss FROM ep")
def s8(spark, sf_dir):
    path = new_dir(spark, "logs")
    e = epochs(spark, sf_dir)
    logs = e.groupBy(F.col("run").cast("string").alias("run")).agg(F.array_sort(F.collect_list(F.struct("stage", "epoch", "train_loss", "val_loss", "val_macro_f1"))).alias("epochs"))
    logs.write.json(path)
    return stores.read_run_logs(spark, path, multi_line=False).select("run", "index", "stage", "epoch", *R6("val_loss"))


@query("s9_metrics_table", STAGES_SQL.format(4))
def s9(spark, sf_dir):
    """Precision, recall and F1 of three stages side by side, a row a class and one for the means, as a CSV table of four decimals."""
    path, names = new_dir(spark, "table"), [f"{s}_{m}" for s in ("train", "val", "test") for m in ("precision", "recall", "f1")]
    stores.write_metrics_table(stage_table(spark, sf_dir).select("label", *names), path)
    return spark.read.schema(", ".join(["label int", *[f"{n} double" for n in names]])).csv(path, header=True)


@query("s10_missing_files", f"WITH {v.ITEMS} SELECT class, name AS filename FROM items WHERE item_id % 7 = 0")
def s10(spark, sf_dir):
    m = v.items(spark, sf_dir).select("item_id", "class", F.col("name").alias("filename"))
    return stores.missing_files(m.drop("item_id"), m.filter("item_id % 7 <> 0"))


PIX = f"""{v.ITEMS}, px AS (SELECT CAST(item_id AS VARCHAR) AS item_id, CAST(least(255, greatest(0, floor(128.0 + 512.0 * features[i]))) AS INTEGER) AS v, i - 1 AS pos FROM items, range(1, 65) t(i))"""


@query("s2_standardise_images", f"WITH {PIX} SELECT i.class || '/' || replace(i.name, '.jpg', '.png') AS item_id, string_agg(lpad(upper(hex(v)), 2, '0'), '' ORDER BY pos) AS pixels FROM px JOIN items i ON CAST(i.item_id AS VARCHAR) = px.item_id GROUP BY 1")
def s2(spark, sf_dir):
    return images.standardise_images(scanned(spark, sf_dir), 8).select("item_id", F.hex("pixels").alias("pixels"))


def kernel(spark, sf_dir, f, names):
    """One kernel over the 8 x 8 images of the vectors."""
    import pandas as pd

    from modelaudit.sources.images import _image

    def run(frames):
        for df in frames:
            rows = [f(_image(*x)) for x in zip(df["pixels"], df["height"], df["width"], strict=True)]
            yield pd.DataFrame({"item_id": df["item_id"], **{n: [r[i] for r in rows] for i, n in enumerate(names)}})

    table = images.pixel_table(v.items(spark, sf_dir))
    out = table.mapInPandas(run, "item_id string, " + ", ".join(f"{n} double" for n in names))
    return out.select("item_id", *R6(*names))


@query("f1_stat_features", f"""WITH {PIX}, m AS (SELECT item_id, avg(v) AS mu, stddev_pop(v) AS sd FROM px GROUP BY 1), h AS (SELECT item_id, v, count(*) / 64 AS p FROM px GROUP BY 1, 2), e AS (SELECT item_id, -sum(p * log2(p)) AS entropy FROM h GROUP BY 1)
SELECT px.item_id, round(any_value(mu), 6) AS mean, round(any_value(sd), 6) AS std, round(CASE WHEN any_value(sd) > 0 THEN avg(power((v - mu) / sd, 3)) ELSE 0 END, 6) AS skew, round(CASE WHEN any_value(sd) > 0 THEN avg(power((v - mu) / sd, 4)) - 3 ELSE 0 END, 6) AS kurtosis, round(any_value(entropy), 6) AS entropy,
round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90
FROM px JOIN m ON m.item_id = px.item_id JOIN e ON e.item_id = px.item_id GROUP BY px.item_id""")
def f1(spark, sf_dir):
    from modelaudit.kernels import pixels

    return kernel(spark, sf_dir, pixels.stat_features, ["mean", "std", "skew", "kurtosis", "entropy", "p10", "p25", "p50", "p75", "p90"])


@query("f5_hist_features", f"WITH {PIX} SELECT item_id, {', '.join(f'round(count(*) FILTER (v // 16 = {b}) / 64, 6) AS h{b}'.replace('v // 16', 'CAST(floor(v / 16) AS INTEGER)') for b in range(16))}, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM px GROUP BY 1")
def f5(spark, sf_dir):
    from modelaudit.kernels import pixels

    return kernel(spark, sf_dir, pixels.hist_features, [f"h{b}" for b in range(16)] + ["p95", "p99"])


@query("f6_raw_intensity_features", f"WITH {PIX} SELECT item_id, CAST(max(v) AS DOUBLE) AS most, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(count(*) FILTER (v > 200) / 64, 6) AS share, round(coalesce(avg(v) FILTER (v > 200), 0), 6) AS bright_mean, round(CASE WHEN count(*) FILTER (v > 200) >= 2 THEN stddev_pop(v) FILTER (v > 200) ELSE 0 END, 6) AS bright_std, round(stddev_pop(v), 6) AS std FROM px GROUP BY 1")
def f6(spark, sf_dir):
    from modelaudit.kernels import pixels

    return kernel(spark, sf_dir, pixels.raw_intensity_features, ["most", "p95", "p99", "share", "bright_mean", "bright_std", "std"])


@query("f2_glcm_horizontal", f"""WITH {PIX}, q AS (SELECT item_id, CAST(floor(v * 64 / 256) AS INTEGER) AS g, CAST(floor(pos / 8) AS INTEGER) AS y, pos % 8 AS x FROM px), pr AS (SELECT a.item_id, a.g AS i, b.g AS j FROM q a JOIN q b ON a.item_id = b.item_id AND a.y = b.y AND b.x = a.x + 1)
SELECT item_id, round(avg(power(i - j, 2)), 6) AS contrast, round(avg(abs(i - j)), 6) AS dissimilarity, round(avg(1 / (1 + power(i - j, 2))), 6) AS homogeneity FROM pr GROUP BY 1""")
def f2(spark, sf_dir):
    import numpy as np

    from modelaudit.kernels import pixels

    def f(img):
        m = pixels.glcm(img, 0, 1)
        i, j = np.meshgrid(np.arange(pixels.GREYS), np.arange(pixels.GREYS), indexing="ij")
        return [float((m * (i - j) ** 2).sum()), float((m * abs(i - j)).sum()), float((m / (1 + (i - j) ** 2)).sum())]

    return kernel(spark, sf_dir, f, ["contrast", "dissimilarity", "homogeneity"])


_GLCM = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")


@query("f2_glcm_features", f"""WITH {PIX}, q AS (SELECT item_id, CAST(floor(v * 64 / 256) AS INTEGER) AS g, CAST(floor(pos / 8) AS INTEGER) AS y, pos % 8 AS x FROM px),
sh AS (SELECT * FROM (VALUES (1, 0, 1), (1, -1, 1), (1, -1, 0), (1, -1, -1), (3, 0, 3), (3, -2, 2), (3, -3, 0), (3, -2, -2)) t(d, dy, dx)),
pr AS (SELECT a.item_id, d, dy, dx, a.g AS i, b.g AS j FROM q a CROSS JOIN sh JOIN q b ON a.item_id = b.item_id AND b.y = a.y + dy AND b.x = a.x + dx),
sy AS (SELECT * FROM pr UNION ALL SELECT item_id, d, dy, dx, j, i FROM pr),
m AS (SELECT item_id, d, dy, dx, i, j, count(*) / sum(count(*)) OVER (PARTITION BY item_id, d, dy, dx) AS p FROM sy GROUP BY 1, 2, 3, 4, 5, 6),
mu AS (SELECT item_id, d, dy, dx, sum(p * i) AS mi FROM m GROUP BY 1, 2, 3, 4),
st AS (SELECT m.item_id, m.d, m.dy, m.dx, sum(p * power(i - j, 2)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + power(i - j, 2))) AS homogeneity, sqrt(sum(p * p)) AS energy, CASE WHEN sum(p * power(i - mi, 2)) > 1e-15 THEN sum(p * (i - mi) * (j - mi)) / sum(p * power(i - mi, 2)) ELSE 1 END AS correlation, sum(p * p) AS asm FROM m JOIN mu ON m.item_id = mu.item_id AND m.d = mu.d AND m.dy = mu.dy AND m.dx = mu.dx GROUP BY 1, 2, 3, 4)
SELECT item_id, {', '.join(f'round(avg({x}) FILTER (d = {d}), 6) AS {x}{d}' for d in (1, 3) for x in _GLCM)} FROM st GROUP BY 1""")
def f2_all(spark, sf_dir):
    from modelaudit.kernels import pixels

    return kernel(spark, sf_dir, pixels.glcm_features, [f"{x}{d}" for d in (1, 3) for x in _GLCM])


@query("f_feature_matrix")
def f_all(spark, sf_dir):
    """All 138 features (F0-F7) of each image, long."""
    m = images.feature_matrix(images.pixel_table(v.items(spark, sf_dir)))
    return m.select("item_id", F.posexplode("features").alias("at", "value"))


@query("h6_expand_views", f"WITH {PIX}, o AS (SELECT item_id, view, string_agg(lpad(upper(hex(v)), 2, '0'), '' ORDER BY CASE view WHEN 'original' THEN pos ELSE CAST(floor(pos / 8) AS INTEGER) * 8 + 7 - pos % 8 END) AS pixels FROM px, (VALUES ('original'), ('hflip')) t(view) GROUP BY 1, 2) SELECT * FROM o")
def h6(spark, sf_dir):
    out = images.expand_views(images.pixel_table(v.items(spark, sf_dir)), "hflip")
    return out.select("item_id", "view", F.hex("pixels").alias("pixels"))


def learnable(df):
    """Vectors with three classes to learn: label mod 3."""
    return df.select("item_id", "features", F.pmod("class_idx", F.lit(K3)).cast("int").alias("y_true"), "grp")


@query("m1_standardise", f"""WITH {v.ITEMS}, {v.split_sql('items')}, e AS (SELECT item_id, split, i, features[i] AS x FROM split_items, range(1, 65) t(i)), m AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM e WHERE split = 'train' GROUP BY i)
SELECT item_id, round(sum(abs((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END)), 4) AS l1 FROM e JOIN m ON e.i = m.i WHERE split = 'test' GROUP BY 1""")
def m1(spark, sf_dir):
    train, test = item_splits(spark, sf_dir)
    out = ml.standardise(test, ml.fit_standard(train))
    return out.select("item_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("l1"))


def _ready(spark, sf_dir):
    train, test = (learnable(x) for x in item_splits(spark, sf_dir))
    fitted = ml.fit_standard(train)
    return materialize(ml.standardise(train, fitted), "train"), materialize(ml.standardise(test, fitted), "test")


@query("m2_pca_project")
def m2(spark, sf_dir):
    train, test = _ready(spark, sf_dir)
    return ml.pca_project(train, test).select("item_id", F.posexplode("features").alias("component", "value"))


@query("m3_grid_search_cv")
def m3(spark, sf_dir):
    """Sixteen forests by five group-aware folds from twenty fits."""
    rows = materialize(splits.stratified_group_kfold(learnable(v.items(spark, sf_dir)), "y_true", "grp", 5), "folds")
    found = ml.forest_search_cv(rows, {"trees": [5, 10], "depth": [2, 4], "features": ["sqrt", "log2"], "least": [1, 2]}, K3, 5)
    return spark.createDataFrame([(str(p), s) for p, s in found], "params string, macro_f1 double")


@query("m6_oversampled_folds")
def m6_smote(spark, sf_dir):
    """The forest with made-up rows in the training part of each fold."""
    rows = materialize(splits.stratified_group_kfold(learnable(v.items(spark, sf_dir)), "y_true", "grp", 3), "folds")
    found = ml.grid_search_cv(rows, ml.random_forest, {"trees": [5], "depth": [4]}, K3, 3, ml.oversampled)
    return spark.createDataFrame([(str(p), s) for p, s in found], "params string, macro_f1 double")


def _scored(fit):
    def f(spark, sf_dir):
        train, test = _ready(spark, sf_dir)
        return ml.score(fit(train), test, K3).select("item_id", "y_true", "y_pred")

    return f


query("m4_linear_svm")(_scored(ml.linear_svm))
query("m6_random_forest")(_scored(ml.random_forest))
query("m7_boosted_trees")(_scored(lambda rows: ml.boosted_trees(rows, 3, 2)))


@query("m4_calibrated_svm")
def m4_calibrated(spark, sf_dir):
    """The linear machine's calibrated probabilities, in a soft vote with a forest (H1)."""
    train, test = _ready(spark, sf_dir)
    both = ml.score(ml.calibrated_svm(train, K3, 3), test, K3, "svm").unionByName(ml.score(ml.random_forest(train, 5, 4), test, K3, "forest"))
    out = both.unionByName(ensembles.soft_vote(materialize(both, "votes"), "svm", "forest"))
    return out.select("model", "item_id", "y_true", "y_pred", F.round(fn.predicted_confidence(F.col("y_prob"), F.col("y_pred")), 6).alias("confidence"))


@query("m5_rbf_svm")
def m5(spark, sf_dir):
    """As many Fourier features as keep the kernel's error within 0.05."""
    train, test = _ready(spark, sf_dir)
    return ml.score(ml.rbf_svm(train, 1.0, 1 / 128, 0.05), test, K3).select("item_id", "y_true", "y_pred")


@query("w4_boosting_rounds")
def w4_rounds(spark, sf_dir):
    """Loss and error of boosted trees after each round on train and test, and what W4 says of them."""
    train, test = _ready(spark, sf_dir)
    return curves.round_curve(ml.round_series(ml.boosted_trees(train, 5, 2), train, test), 3)


@query("m8_score")
def m8(spark, sf_dir):
    train, test = _ready(spark, sf_dir)
    return ml.score(ml.random_forest(train, 10, 4), test, K3).select("item_id", "y_pred", F.round(fn.predicted_confidence(F.col("y_prob"), F.col("y_pred")), 6).alias("confidence"))


@query("m9_data_efficiency_sweep")
def m9(spark, sf_dir):
    train, test = _ready(spark, sf_dir)
    return ml.data_efficiency_sweep(train, test, lambda r: ml.random_forest(r, 5, 3), K3)


@query("m10_train_select_refit")
def m10(spark, sf_dir):
    s = splits.group_split(v.items(spark, sf_dir))
    parts = [materialize(learnable(s.filter(F.col("split") == x)), x) for x in ("train", "val", "test")]
    best, model, _ = ml.train_select_refit(parts[0], parts[1], {"rf2": lambda r: ml.random_forest(r, 5, 2), "rf5": lambda r: ml.random_forest(r, 5, 5)}, K3)
    return ml.score(model, parts[2], K3, best).select("model", "item_id", "y_true", "y_pred")


@query("m11_permutation_importance")
def m11(spark, sf_dir):
    train, test = _ready(spark, sf_dir)
    return ml.permutation_importance(ml.random_forest(train, 10, 4), test, {"first": range(32), "second": range(32, 64)}, K3, 10)


@query("m12_occlusion_map")
def m12(spark, sf_dir):
    table = images.pixel_table(v.items(spark, sf_dir))
    rows = images.feature_matrix(table).select("item_id", F.col("features").cast("array<double>").alias("features"), F.pmod(F.substring("class", 2, 9).cast("int"), F.lit(K3)).alias("y_true"))
    model = ml.random_forest(materialize(rows, "image-features"), 5, 4)
    return ml.occlusion_map(model, table, images.feature_matrix, K3, patch=4, stride=2)
