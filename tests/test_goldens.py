"""Published values (fixed) and edge cases of metrics, splits and curves."""

import pytest
from pyspark.sql import functions as F

from modelaudit.operators import bootstrap, curves, leakage, metrics, neighbours, paired, splits

# fixed values: a published confusion matrix of four classes and its metrics
MATRIX = [[496, 0, 17, 0], [6, 757, 7, 7], [17, 46, 181, 4], [0, 32, 0, 318]]
ACCURACY, MACRO, WEIGHTED = 0.9279661016949152, 0.9090587097629588, 0.9263217019936351
F1 = [0.9612403100775194, 0.9392059553349876, 0.7991169977924945, 0.9366715758468336]
INTERVAL = (0.8944227909457778, 0.9229045782314158)


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([("svm", t, p, n) for t, row in enumerate(MATRIX) for p, n in enumerate(row) if n], "model string, y_true int, y_pred int, n long")


def test_published_metrics(counts):
    r = metrics.headline(counts, 4).first()
    assert (r.accuracy, r.macro_f1, r.weighted_f1) == pytest.approx((ACCURACY, MACRO, WEIGHTED))
    assert [r.f1 for r in metrics.per_class(counts, 4).orderBy("label").collect()] == pytest.approx(F1)
    assert metrics.confusion_matrix(counts, 4).count() == 16
    ci = bootstrap.bootstrap_f1(counts, 4, 1000).filter("label is null").first()
    assert (ci.lo, ci.hi) == pytest.approx(INTERVAL, abs=0.003)


@pytest.mark.parametrize(("only_a", "only_b", "statistic", "p"), [(51, 17, 16.014705882352942, 6.285237771203324e-05), (5, 11, 5.0, 0.210113525390625), (0, 0, 0.0, 1.0), (12, 12, 12.0, 1.0)])
def test_published_mcnemar(spark, only_a, only_b, statistic, p):
    rows = []
    for i in range(only_a + only_b + 5):
        a, b = (1, 0) if i < only_a else (0, 1) if i < only_a + only_b else (0, 0)
        rows += [("a", i, 0, a), ("b", i, 0, b)]
    r = paired.all_pairs(spark.createDataFrame(rows, "model string, item_id long, y_true int, y_pred int")).first()
    assert (r.only_a, r.only_b) == (only_a, only_b) and (r.statistic, r.p) == pytest.approx((statistic, p))


def test_published_class_weights(spark):
    sizes = {"Cyst": 2233, "Normal": 3436, "Stone": 894, "Tumor": 1583}
    df = spark.createDataFrame(list(sizes.items()), "class string, n int").select("class", F.explode(F.sequence(F.lit(1), "n")))
    got = {r["class"]: r.inverse for r in splits.class_weights(df).collect()}
    assert got == pytest.approx({"Cyst": 0.7196497917175293, "Normal": 0.46768859028816223, "Stone": 1.7975144386291504, "Tumor": 1.0151472091674805})


def test_macro_f1_leaves_out_labels_that_do_not_occur(spark):
    c = spark.createDataFrame([("m", 0, 0, 5), ("m", 1, 0, 5)], "model string, y_true int, y_pred int, n long")
    assert metrics.headline(c, 4).first().macro_f1 == pytest.approx((2 * 5 / 15 + 0) / 2)
    assert [r.f1 for r in metrics.per_class(c, 4).orderBy("label").collect()][2:] == [0, 0]


def test_auc_ties_and_missing_class(spark):
    rows = [("m", i, i % 2, [0.5, 0.5]) for i in range(10)] + [("n", i, 0, [0.5, 0.5]) for i in range(4)] + [("o", i, i % 2, [0.9, 0.9]) for i in range(4)]
    got = {r.model: (r.auc, r.problem) for r in metrics.roc_auc(spark.createDataFrame(rows, "model string, item_id long, y_true int, y_prob array<double>"), 2).collect()}
    assert got == {"m": (0.5, None), "n": (None, "a class is missing"), "o": (None, "probabilities don't sum to 1")}


def test_alignment_fails_on_other_labels_or_missing_items(spark):
    schema = "model string, item_id long, y_true int, y_pred int"
    with pytest.raises(Exception, match="labels differ"):
        paired.align(spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 1, 0)], schema), ["a", "b"]).collect()
    with pytest.raises(Exception, match="lacks an item"):
        paired.align(spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 0, 0), ("a", 2, 0, 0)], schema), ["a", "b"]).collect()


def test_split_properties(spark):
    df = spark.range(2000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("class"))
    df = df.withColumn("grp", F.concat_ws("_", "class", F.floor(F.col("item_id") / 50).cast("string")))
    s = splits.group_split(df)
    assert s.count() == 2000 and s.groupBy("grp").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    small, large = (set(r.item_id for r in splits.stratified_fraction(df, f, "item_id").collect()) for f in (0.1, 0.5))
    assert small < large and len(small) == 200
    again = splits.stratified_fraction(df.repartition(7), 0.1, "item_id").collect()
    assert {r.item_id for r in again} == small
    folds = splits.stratified_kfold(df, "item_id").groupBy("class", "fold").count().collect()
    assert {r["count"] for r in folds if r["class"] == "common"} == {360}
    groups = splits.stratified_group_kfold(df)
    assert groups.groupBy("grp").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        splits.stratified_fraction(df, 0.0, "item_id")


def test_hash_pairs_are_products_of_counts(spark):
    df = spark.createDataFrame([(i, "h", "train") for i in range(2000)] + [(9000 + i, "h", "test") for i in range(3)] + [(9999, None, "test")], "item_id long, hash string, split string")
    got = {(r.split_a, r.split_b): (r.pairs, r.b_items) for r in leakage.hash_leak_pairs(df).collect()}
    assert got == {("train", "val"): (0, 0), ("train", "test"): (6000, 3), ("val", "test"): (0, 0)}


def test_loss_rebound_verdicts(spark):
    def run(name, val, train):
        return [(name, 2, i, float(t), float(v), 0.5) for i, (v, t) in enumerate(zip(val, train, strict=True))]

    rows = run("short", [1, 1, 1, 1], [1] * 4) + run("down", [5, 4, 3, 2, 1], [5, 4, 3, 2, 1]) + run("mild", [1, 0.5, 0.5, 0.51, 0.53], [5, 4, 3, 2, 1]) + run("over", [1, 0.5, 0.5, 0.51, 0.56], [5, 4, 3, 2, 1])
    got = {r.run: r.verdict for r in curves.loss_rebound(spark.createDataFrame(rows, "run string, stage int, epoch int, train_loss double, val_loss double, val_macro_f1 double")).collect()}
    assert got == {"short": "too short", "down": "stable", "mild": "mild rebound", "over": "overfitting"}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(10, 15)] + [(30, 30 + i) for i in range(1, 5)]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = {r.node: r.label for r in neighbours.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 16)}, **{30 + i: 30 for i in range(5)}}


def test_borderline_smote(spark):
    rows = [(i, "big", [float(i % 7), float(i % 5)]) for i in range(40)] + [(100 + i, "small", [float(i % 7) + 0.5, float(i % 5) + 0.1]) for i in range(10)]
    out = neighbours.borderline_smote(spark.createDataFrame(rows, "item_id long, class string, features array<double>"), m=8)
    counts = {(r["class"], r.synthetic): r["count"] for r in out.groupBy("class", "synthetic").count().collect()}
    assert counts[("big", False)] == 40 and counts[("small", False)] == 10 and counts.get(("small", True), 30) == 30
