"""Learning operators against plain versions at small size, and against what must hold of fits."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelaudit.functions import ranges
from modelaudit.operators import bootstrap, curves, ensembles, leakage, metrics, ml, neighbours, proximity, splits, trees, vector_index

SCHEMA = "item_id long, features array<double>, y_true int"


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def blobs(spark):
    """Three classes, parted by the first two of four dimensions."""
    rng = np.random.default_rng(1)
    y = np.arange(150) % 3
    x = np.array([[0, 0, 0, 0], [4, 0, 0, 0], [0, 4, 0, 0]])[y] + rng.normal(0, 0.6, (150, 4))
    return table(spark, x, y).cache()


def right(preds):
    return preds.filter("y_pred = y_true").count() / preds.count()


def f1_of(pairs, k):
    out = []
    for c in range(k):
        tp, t, p = (sum(n for n in hits) for hits in ([a == b == c for a, b in pairs], [a == c for a, _ in pairs], [b == c for _, b in pairs]))
        if t + p:
            out.append(2 * tp / (t + p))
    return sum(out) / len(out)


@pytest.mark.parametrize("fit", [ml.linear_svm, lambda r: ml.random_forest(r, 10, 4), lambda r: ml.boosted_trees(r, 3, 2)], ids=["svm", "forest", "boosted"])
def test_learners_part_what_can_be_parted(blobs, fit):
    preds = ml.score(fit(blobs), blobs, 3, "m")
    assert right(preds) > 0.97 and preds.columns == ["model", "item_id", "y_true", "y_prob", "y_pred"]
    for r in preds.collect():
        assert sum(r.y_prob) == pytest.approx(1) and r.y_pred == int(np.argmax(r.y_prob)) and len(r.y_prob) == 3


def test_staged_boosting_equals_the_learners_own(blobs):
    model = ml.boosted_trees(blobs, 5, 2)
    halves = blobs.filter("item_id % 2 = 0"), blobs.filter("item_id % 2 = 1")
    series = {(r.run, r["round"]): r for r in ml.round_series(model, *halves).collect()}
    for label, member in enumerate(model.models):
        for part, rows in zip(("train", "val"), halves, strict=True):
            own = rows.select((F.col("y_true") == label).cast("double").alias(member.getLabelCol()), F.lit(1.0).alias(member.getWeightCol()), ml.array_to_vector("features").alias("v"))
            assert [series[str(label), r][f"{part}_loss"] for r in range(1, 6)] == pytest.approx(member.evaluateEachIteration(own))
    last = right(ml.score(model, halves[1], 3))
    assert series["all", 5].val_error == pytest.approx(1 - last) and series["all", 5].train_loss < series["all", 1].train_loss
    curve = curves.round_curve(ml.round_series(model, *halves), 3).filter("run = 'all'").first()
    assert curve.deployed_val_error == pytest.approx(series["all", 3].val_error) and curve.best_error <= curve.deployed_val_error


def test_one_forest_holds_the_smaller_ones(spark, blobs):
    """The whole forest scores as the learner does; its parts as trees voted by hand; a search finds the same as separate fits."""
    model = ml.random_forest(blobs, 7, 4, least=2)
    cells = {(r.trees, r.depth, r.y_true, r.y_pred): r.n for r in trees.forest_cells(spark, model, blobs, [3, 7], [1, 4]).collect()}
    own = {(r.y_true, r.y_pred): r["count"] for r in ml.score(model, blobs, 3).groupBy("y_true", "y_pred").count().collect()}
    assert {k[2:]: n for k, n in cells.items() if k[:2] == (7, 4)} == own
    rows = blobs.orderBy("item_id").toPandas()
    x = np.stack(rows["features"])
    votes = sum(trees.descend(t, x, [1])[0] for t in trees.read_trees(spark, model, True)[:3])
    by_hand: dict = {}
    for y, p in zip(rows["y_true"], votes.argmax(axis=1), strict=True):
        by_hand[y, p] = by_hand.get((y, p), 0) + 1
    assert {k[2:]: n for k, n in cells.items() if k[:2] == (3, 1)} == by_hand
    folded = splits.stratified_kfold(blobs, "item_id", "y_true", 2)
    grid = {"trees": [2, 6], "depth": [5], "least": [1, 3]}
    shared, apart = ml.forest_search_cv(folded, grid, 3, 2), ml.grid_search_cv(folded, ml.random_forest, grid, 3, 2)
    assert [p for p, _ in shared] == [p for p, _ in apart]
    whole = [(a, b) for (params, a), (_, b) in zip(shared, apart, strict=True) if (params["trees"], params["depth"]) == (6, 5)]
    assert len(whole) == 2 and all(a == pytest.approx(b, abs=0.12) for a, b in whole)  # rows come to the learners in any order


def test_calibrated_probabilities(spark):
    """Sigmoids are those of a plain fit; probabilities agree with frequencies by bins, where the margins' softmax doesn't; H1 takes them."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 1500)
    x = np.stack([(y == 0) * 1.2 + rng.normal(size=1500), (y == 1) * 1.2 + rng.normal(size=1500), rng.normal(size=1500)], axis=1)
    df = table(spark, x, y)
    train, test = df.filter("item_id < 1000"), df.filter("item_id >= 1000")
    model = ml.calibrated_svm(train, 3, 2)
    margins = model.model.transform(train.withColumn("v", ml.array_to_vector("features"))).select("y_true", ml.vector_to_array("rawPrediction").alias("margins"))
    got = ml.fit_sigmoids(margins, 3)
    plain = margins.toPandas()
    for k in range(3):
        m, t = np.array([v[k] for v in plain["margins"]]), (plain["y_true"] == k).to_numpy()
        goal = np.where(t, (t.sum() + 1) / (t.sum() + 2), 1 / ((~t).sum() + 2))
        a, b = got[k]
        p = 1 / (1 + np.exp(-(a * m + b)))
        assert a > 0 and abs(((goal - p) * m).sum()) < 1e-3 and abs((goal - p).sum()) < 1e-3  # where the likelihood is flat
    scored = ml.score(model, test, 3, "svm")
    sure, plainly = scored.toPandas(), ml.score(model.model, test, 3).toPandas()

    def off(rows):  # mean gap of confidence and accuracy over bins
        c, ok = np.array([max(p) for p in rows["y_prob"]]), (rows["y_true"] == rows["y_pred"]).to_numpy(float)
        at = np.digitize(c, np.linspace(0.3, 1, 6))
        return sum(abs(c[at == i].mean() - ok[at == i].mean()) * (at == i).mean() for i in set(at))

    assert off(sure) < 0.08 and off(sure) < off(plainly)
    assert np.allclose([sum(p) for p in sure["y_prob"]], 1)
    both = scored.unionByName(ml.score(ml.random_forest(train, 5, 3), test, 3, "forest"))
    assert right(ensembles.soft_vote(both, "svm", "forest")) > 0.5


def test_fourier_features_are_the_kernel(spark):
    rng = np.random.default_rng(2)
    x, gamma = rng.normal(size=(20, 5)), 0.2
    got = np.array([r.features for r in ml.fourier(table(spark, x, np.zeros(20)), gamma, 20_000).orderBy("item_id").collect()])
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(got @ got.T - want).max() < 0.04
    ring = rng.normal(size=(300, 2))
    y = (np.linalg.norm(ring, axis=1) > 1.1).astype(int)
    rows = table(spark, ring, y)
    bent, straight = ml.fourier(rows, 1.0), rows
    assert right(ml.score(ml.linear_svm(bent), bent, 2)) > 0.93 > 0.75 > right(ml.score(ml.linear_svm(straight), straight, 2))


def test_kernel_machine_keeps_its_bound(spark):
    """Two rings, which no linear machine parts; the kernel's error, measured on rows that weren't in the sample, is about the bound."""
    rng = np.random.default_rng(6)
    angle, y = rng.uniform(0, 2 * np.pi, 300), rng.integers(0, 2, 300)
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1) * np.where(y == 1, 2.0, 0.7)[:, None] + rng.normal(0, 0.1, (300, 2))
    df = table(spark, x, y)
    model = ml.rbf_svm(df, 10.0, "scale", 0.05)
    assert model.error <= 0.05 and ml.kernel_error(x, model.gamma, model.n) < 0.06
    assert ml.fourier_size(df, model.gamma, 0.025)[0] > model.n
    with pytest.raises(ValueError, match="over"):
        ml.fourier_size(df, 50.0, 0.001, most=128)
    assert right(ml.score(model, df, 2)) > 0.95 > right(ml.score(ml.linear_svm(df), df, 2)) + 0.2
    assert ml.rbf_svm(df, 1.0, "auto", 0.05, 2).gamma == 0.5


def test_pca_is_that_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    x -= x.mean(0)
    got = np.array([r.features for r in ml.pca_project(table(spark, x, np.zeros(60)), table(spark, x, np.zeros(60)), 4).orderBy("item_id").collect()])
    w = np.linalg.svd(x, full_matrices=False)[2][:4].T
    w *= np.sign(w[np.abs(w).argmax(0), np.arange(4)])
    assert np.allclose(got, x @ w, atol=1e-8)
    assert len(ml.pca_project(table(spark, x[:4], np.zeros(4)), table(spark, x, np.zeros(60)), 50).first().features) == 3


def test_grid_search_is_the_mean_over_folds(spark, blobs):
    rows = splits.stratified_kfold(blobs, "item_id", "y_true", 3)
    found = ml.grid_search_cv(rows, ml.random_forest, {"trees": [3], "depth": [1, 4]}, 3, 3)
    assert [p for p, _ in found] == [{"trees": 3, "depth": 1}, {"trees": 3, "depth": 4}]
    for params, got in found:
        scores = []
        for f in range(3):
            train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
            data = np.array([r.features for r in train.collect()])
            fitted = (data.mean(0).tolist(), data.std(0).tolist())
            preds = ml.score(ml.random_forest(ml.standardise(train, fitted), **params), ml.standardise(test, fitted), 3).collect()
            scores.append(f1_of([(r.y_true, r.y_pred) for r in preds], 3))
        assert got == pytest.approx(np.mean(scores), abs=0.02)
    assert found[1][1] > 0.95 > found[0][1]


def test_oversampling_touches_training_rows_only(spark, blobs):
    few = blobs.filter("y_true > 0 or item_id % 5 = 0").withColumn("features", F.transform("features", lambda x: x / 3))
    rows = splits.stratified_kfold(few, "item_id", "y_true", 2)
    seen = []

    def fit(train, **params):
        seen.append(sorted((r.y_true, r["count"]) for r in train.groupBy("y_true").count().collect()))
        return ml.random_forest(train, **params)

    ml.grid_search_cv(rows, fit, {"trees": [2]}, 3, 2, ml.oversampled)
    assert all(dict(s)[0] == dict(s)[1] == dict(s)[2] for s in seen) and len(seen) == 2


def test_sweep_and_refit(spark, blobs):
    train, test = blobs.filter("item_id < 100"), blobs.filter("item_id >= 100")
    out = ml.data_efficiency_sweep(train, test, lambda r: ml.random_forest(r, 5, 3), 3, (0.1, 1.0)).orderBy("fraction").collect()
    assert [(r.fraction, r.n_train) for r in out] == [(0.1, 9), (1.0, 100)]
    assert all(r.lo <= r.macro_f1 <= r.hi for r in out) and out[1].macro_f1 > 0.85
    fits = []

    def learner(depth):
        return lambda r: fits.append((depth, r.count())) or ml.random_forest(r, 3, depth)

    best, model, scores = ml.train_select_refit(train, test, {"flat": learner(0), "deep": learner(3)}, 3)
    assert best == "deep" and fits == [(0, 100), (3, 100), (3, 150)] and scores["deep"] > scores["flat"]
    assert right(ml.score(model, blobs, 3)) > 0.97


def test_permuting_what_matters_costs_most(blobs):
    out = {r.group: r for r in ml.permutation_importance(ml.random_forest(blobs, 10, 4), blobs, {"used": [0, 1], "noise": [2, 3]}, 3, 4).collect()}
    assert out["used"].drop > 0.4 and abs(out["noise"].drop) < 0.05 and out["used"].std >= 0


def test_occlusion_finds_the_place(spark):
    """The class is the brightness of one corner, so only patches over it cost confidence."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        img = rng.integers(60, 100, (8, 8)).astype(np.uint8)
        img[:2, :2] = 250 if i % 2 else 5
        rows.append((str(i), f"c{i % 2}", img.tobytes(), 8, 8))
    images = spark.createDataFrame(rows, "item_id string, class string, pixels binary, height int, width int")

    def extract(df):
        def run(frames):
            for f in frames:
                yield pd.DataFrame({"item_id": f["item_id"], "class": f["class"], "features": [np.frombuffer(p, np.uint8)[[0, 1, 8, 9, 40, 63]].astype(float).tolist() for p in f["pixels"]]})

        return df.select("item_id", "class", "pixels").mapInPandas(run, "item_id string, class string, features array<double>")

    model = ml.random_forest(extract(images).withColumn("y_true", F.substring("class", 2, 1).cast("int")), 10, 2)
    heat = ml.occlusion_map(model, images, extract, 2, patch=2, stride=2, fill=250).collect()
    assert len(heat) == 40 * 16
    dark = {(r.y, r.x): r.heat for r in heat if r.item_id == "0"}
    assert dark[0, 0] == 1 and max(v for k, v in dark.items() if k != (0, 0)) < 0.2
    assert all(r.heat == 0 for r in heat if r.item_id == "1" and (r.y, r.x) == (0, 0))


def test_bootstrap_of_a_users_metric(spark):
    rows = [(i, i % 2, i % 2 if i % 10 else 1 - i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "item_id long, y_true int, y_pred int")
    got = bootstrap.bootstrap_udf(df, lambda t, p: float((t == p).mean()), 300).first()
    cells = [(t, p) for _, t, p in rows]
    rng, values = np.random.default_rng(0), []
    for _ in range(2000):
        at = rng.integers(0, 400, 400)
        values.append(np.mean([cells[i][0] == cells[i][1] for i in at]))
    assert got.mean == pytest.approx(0.9, abs=0.005) and (got.lo, got.hi) == pytest.approx(tuple(np.percentile(values, (2.5, 97.5))), abs=0.01)
    assert bootstrap.bootstrap_udf(df, lambda t, p: float(len(t)), 5).first().lo == 400


@pytest.fixture(scope="module")
def lopsided(spark):
    """One group of nearly all rows, small ones, ties, nulls in value and group."""
    rng = np.random.default_rng(7)
    rows = [("big", float(v)) for v in np.round(rng.normal(size=3000), 2)] + [("small", 1.0), ("small", 4.0), ("one", 2.5), (None, 3.0), (None, 5.0), ("big", None)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def test_percentiles_of_groups_of_any_size(lopsided):
    rows, df = lopsided
    got = {r.g: (r.a, r.b, r.c) for r in ranges.percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.975}).collect()}
    for g in ("big", "small", "one", None):
        assert got[g] == pytest.approx(tuple(np.percentile([v for k, v in rows if k == g and v is not None], (10, 50, 97.5))))


def test_running_sums_and_their_tasks(lopsided):
    """Sums equal counts by hand, and twice the rows are twice the ranges, none of them larger."""
    rows, df = lopsided
    df = df.filter("v is not null").repartition(3)
    got = ranges.running_before(df, ["g"], [F.col("v")], F.lit(1), "before", 100).groupBy("g", "v").agg(F.min("before").alias("n"), F.max("before").alias("m")).collect()
    for r in got:
        below = sum(1 for k, v in rows if k == r.g and v is not None and v < r.v)
        assert (r.n, r.m) == (below, below + sum(1 for k, v in rows if k == r.g and v == r.v) - 1)
    most = []
    for times in (1, 2, 4):
        more = df.withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(times))))
        per = ranges.in_ranges(more.withColumn("x", F.lit(1)), ["g"], [F.col("v"), F.col("w")], "x", 300).groupBy("_bin").count().agg(F.max("count").alias("most"), F.count("*").alias("bins")).first()
        most.append(per.most)
        assert per.bins >= times * 8
    assert max(most) < 3 * 300  # the group that has nearly all rows, too


def test_prefix_sums_on_two_levels(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(b), int(rng.integers(0, 9))) for g in ("a", None) for b in rng.permutation(500)[:333]]
    df = spark.createDataFrame(rows, "g string, b int, n long")
    for fan in (7, 1000):
        for r in ranges.sums_before(df, ["g"], "b", "n", "before", 500, "all", fan).collect():
            assert r.before == sum(n for g, b, n in rows if g == r.g and b < r.b) and r["all"] == sum(n for g, _, n in rows if g == r.g)


def test_ranks_and_folds_of_a_class_in_many_shards(spark):
    """Shards follow from the number of rows; ranks are those of one sort."""
    import hashlib

    rows = [(i, "all" if i % 10 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "item_id long, class string").repartition(3)
    got = {r.item_id: r for r in splits.ranked(df, "item_id", per_shard=50).collect()}
    for klass in ("all", None):
        ids = sorted((i for i, c in rows if c == klass), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
        assert [got[i].rank for i in ids] == list(range(1, len(ids) + 1)) and got[ids[0]].n == len(ids)
    plans = [splits.ranked(df.limit(n), "item_id", per_shard=50)._jdf.queryExecution().toString() for n in (1000, 2000)]
    assert "* 20" in plans[0] and "* 40" in plans[1]
    # folds of groups: sizes of a class's folds differ by less than its largest group
    items = spark.createDataFrame([(g, k) for g in range(400) for k in range(1 + g % 7)], "grp int, item_id int").withColumn("class", F.lit("c"))
    sizes = [r["count"] for r in splits.stratified_group_kfold(items).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 7


def test_mann_whitney_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(0.3, 1, 80), 1), np.round(rng.normal(0, 1, 120), 1)
    df = spark.createDataFrame([("c", float(v), 1) for v in a] + [("c", float(v), 2) for v in b], "class string, value double, side int")
    r = proximity.mann_whitney(df).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (r.n1, r.n2, r.u) == (80, 120, u)
    # one-sided normal p with tie and continuity correction, from its definition
    import math

    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    n = 200
    var = 80 * 120 / 12 * ((n + 1) - (counts.astype(float) ** 3 - counts).sum() / (n * (n - 1)))
    z = (u - 80 * 120 / 2 - 0.5) / math.sqrt(var)
    assert r.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_auc_of_crowded_scores(spark):
    """Scores that crowd near 0 and 1, with ties: as many pairs of a positive and a negative that are in order."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 500)
    p = np.clip(np.round(np.where(y == 1, 1 - rng.exponential(0.01, 500), rng.exponential(0.01, 500)) + rng.normal(0, 0.4, 500) * (rng.random(500) < 0.2), 4), 0, 1)
    df = spark.createDataFrame([("m", i, int(t), [1 - float(s), float(s)]) for i, (t, s) in enumerate(zip(y, p, strict=True))], "model string, item_id long, y_true int, y_prob array<double>")
    one, none = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in none])
    assert metrics.roc_auc(df, 2).first().auc == pytest.approx(want)


def test_near_copies_give_few_links(spark):
    rng = np.random.default_rng(10)
    base, other = rng.normal(size=16), rng.normal(size=16)
    x = [base] * 30 + [base + rng.normal(0, 1e-3, 16) for _ in range(40)] + [other, other] + [rng.normal(size=16) for _ in range(20)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(200, None)], "item_id long, features array<double>")
    got = {r.item_id: (r.component, r.kept) for r in neighbours.dedup_near(df, 0.999).collect()}
    assert all(got[i] == (0, i == 0) for i in range(70)) and got[70] == (70, True) and got[71] == (70, False)
    assert all(got[i] == (i, True) for i in range(72, 92)) and got[200] == (200, True)
    assert neighbours.spanning_links(df.filter("item_id < 70"), 0.999, ring=16, pivots=2).count() < 70 * 10  # not 70 * 69


def plain_neighbours(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -np.inf)
    return {int(i): [int(j) for j in ids[np.lexsort((ids, -s))[:k]]] for i, s in zip(ids, sims, strict=True)}


@pytest.fixture(scope="module")
def clustered():
    """Vectors in tight clusters of several sizes, some without a cluster, copies, and zero vectors."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 8))
    x = np.concatenate([centres[rng.integers(0, 40, 1500)] + rng.normal(0, 0.02, (1500, 8)), rng.normal(size=(60, 8))])
    x[1400:1420] = x[3]
    x[[7, 77, 777]] = 0
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_index_equals_brute_force_and_skips(spark, clustered):
    df = spark.createDataFrame(clustered, "item_id long, features array<double>").repartition(3)
    for k, sizes in ((1, {"ring": 40, "pivots": 32}), (4, {"ring": 40, "pivots": 32}), (3, {"ring": 5000, "pivots": 1})):
        got: dict = {}
        for r in neighbours.top_neighbours(df, df, k=k, **sizes).orderBy("rank").collect():
            got.setdefault(r.b_id, []).append(r.a_id)
        assert got == plain_neighbours(clustered, k)
    few = neighbours.top_neighbours(df.filter("item_id < 50"), df.filter("item_id in (3, 9, 60)"), k=5)
    assert few.count() == 48 * 3 + 2 * 2  # all there are, but not itself
    assert neighbours.top_neighbours(df.limit(0), df).count() == 0 and neighbours.top_neighbours(df, df.limit(0)).count() == 0
    # what near copies visit, at five times the rows: pairs of row and ring grow far less than with the square
    shares, looked = [], []
    for n in (300, 1500):
        part = df.filter(F.col("item_id") < n)
        index = vector_index.Index(part, ring=20, pivots=64)
        near = part.select(F.col("item_id").alias("id"), "features", F.lit(0.05).alias("within"))
        visits, rings = index.visits(near, "within").count(), index.rings.count()
        shares.append(visits / (n * rings)), looked.append(visits)
    assert shares[1] < 0.15 and looked[1] < 10 * looked[0]


def test_visits_are_no_rows_of_a_shuffle(spark, monkeypatch):
    """Vectors in all directions alike, which all visit all rings: dealt to tiles are a row's visit to its own ring, and no more."""
    x = np.random.default_rng(11).normal(size=(300, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, features array<double>")
    dealt, meet = [], vector_index.Index.meet

    def counted(self, rows, visits, kernel, schema):
        dealt.append(visits.count())
        return meet(self, rows, visits, kernel, schema)

    monkeypatch.setattr(vector_index.Index, "meet", counted)
    got = {(r.b_id, r["rank"]): r.a_id for r in neighbours.top_neighbours(rows, rows, k=2, ring=40, pivots=4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T - 9 * np.eye(300)
    assert got == {(i, n + 1): a for i in range(300) for n, a in enumerate(np.argsort(-sims[i])[:2])}
    assert neighbours.spanning_links(rows, 0.2, ring=40, pivots=4).count() > 0 and sum(dealt) == 300


def test_near_copies_through_the_index_equal_brute_force(spark, clustered):
    df = spark.createDataFrame(clustered, "item_id long, features array<double>")
    x = np.array([r[1] for r in clustered])
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    sims = np.round(x @ x.T, 9)
    label = np.arange(len(x))
    while True:
        new = np.array([label[sims[i] > 0.9995].min() if (sims[i] > 0.9995).any() else label[i] for i in range(len(x))])
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    got = {r.item_id: r.component for r in neighbours.dedup_near(df, 0.9995).collect()}
    zero = {7, 77, 777}  # equal vectors are linked
    assert got == {i: (7 if i in zero else int(label[i])) for i in range(len(x))}
    summary = neighbours.nearest_summary(neighbours.nearest_neighbour(df, df)).first()
    best = np.where(np.eye(len(x), dtype=bool), -1, sims).max(axis=1)
    assert (summary.n, summary.most) == (len(x), best.max()) and summary.mean == pytest.approx(best.mean()) and summary.near_duplicate == (best >= 0.9999).sum()


def test_bootstrap_sums(spark):
    """Weights are Poisson; sums by group equal rows repeated by hand; no rows are an error."""
    rng = np.random.default_rng(2)
    rows = [(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.normal(1, 1, 3000))]
    df = spark.createDataFrame(rows, "item_id long, g string, x double").repartition(3)
    got = {r.g: r for r in bootstrap.bootstrap_ci(df, "item_id", {"x": F.col("x"), "n": F.lit(1)}, lambda s: s["x"] / s["n"], 300, ("g",)).collect()}
    keys = np.array([r.k for r in df.select("item_id", bootstrap.draw_key(F.col("item_id")).alias("k")).orderBy("item_id").collect()])
    w = np.searchsorted(bootstrap.POISSON, bootstrap.draws(keys, np.arange(300)), side="right")
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and w.max() <= 12
    for g in "ab":
        at = np.array([r[1] == g for r in rows])
        x = np.array([r[2] for r in rows])[at]
        values = (w[at] * x[:, None]).sum(axis=0) / w[at].sum(axis=0)
        assert (got[g].mean, got[g].lo, got[g].hi) == pytest.approx((values.mean(), *np.percentile(values, (2.5, 97.5))))
    with pytest.raises(ValueError, match="no rows"):
        bootstrap.bootstrap_ci(df.limit(0), "item_id", {"n": F.lit(1)}, lambda s: s["n"])


def test_smote_obeys_its_rules(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (60, 3)) + 2, rng.normal(0, 1, (15, 3)) + 1.2])
    y = [0] * 60 + [1] * 15
    df = spark.createDataFrame([(i, [float(v) for v in r], c) for i, (r, c) in enumerate(zip(x, y, strict=True))], "item_id long, features array<double>, class int")
    out = neighbours.borderline_smote(df).collect()
    made = [r for r in out if r.synthetic]
    assert len(out) == 120 and all(r["class"] == 1 for r in made) and sorted(r.i for r in made) == list(range(1, 46))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -9)
    for r in made:
        near = sorted(range(75), key=lambda j: (-sims[r.item_id, j], j))[:10]
        others = sum(y[j] == 0 for j in near)
        assert 5 <= others < 10
        same = [j for j in near if y[j] == 1][:5]
        a, f = x[r.item_id], np.array(r.features)
        assert any(np.linalg.norm(f - a - np.dot(f - a, x[j] - a) / np.dot(x[j] - a, x[j] - a) * (x[j] - a)) < 1e-9 and 0 <= np.dot(f - a, x[j] - a) <= np.dot(x[j] - a, x[j] - a) for j in same)


def test_smote_partners_come_from_the_whole_class(spark):
    """A spawning row with one of its own class among its m nearest has k partners all the same; rows' own columns are no obstacle."""
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(0, 1, (70, 3)) + 2, rng.normal(0, 1, (12, 3)) + 1.2, rng.normal(0, 1, (3, 3)) + 2])
    y = [0] * 70 + [1] * 12 + [2] * 3
    rows = [(i, r.tolist(), c, "own", 7) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (85, None, 1, "own", 7)], "item_id long, features array<double>, class int, grp string, of int")
    got = {(r.item_id, r.i): r.features for r in neighbours.borderline_smote(df).collect() if r.synthetic}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    draw = lambda what, *at: int(hashlib.md5("|".join(["42", what, *map(str, at)]).encode()).hexdigest()[:8], 16) / 2**32
    order = [sorted((j for j in range(85) if j != i), key=lambda j: (-sims[i, j], j)) for i in range(85)]
    want, beyond = {}, 0
    for klass, need in ((1, 57), (2, 67)):
        danger = [i for i in range(85) if y[i] == klass and 5 <= sum(y[j] != klass for j in order[i][:10]) < 10]
        danger.sort(key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        for n in range(1, need + 1) if danger else ():
            a = danger[n % len(danger)]
            same = [j for j in order[a] if y[j] == klass][:5]
            j = same[int(draw("partner", a, n) * len(same))]
            beyond += j not in order[a][:10]
            want[a, n] = x[a] + draw("gap", a, n) * (x[j] - x[a])
    assert beyond > 0 and got.keys() == want.keys()
    assert all(got[at] == pytest.approx(f.tolist()) for at, f in want.items())


def test_neighbours_in_groups_equal_brute_force(spark, clustered, monkeypatch):
    """Groups of one row, of some, and of many rings; every third row asks."""
    group = [0 if i < 900 else 1 if i < 1500 else 2 if i < 1530 else i for i in range(len(clustered))]
    rows = [(i, g, group.count(g), i % 3 == 0 or g > 0, f) for g, (i, f) in zip(group, clustered, strict=True)]
    df = spark.createDataFrame(rows, "id long, grp long, of long, asks boolean, features array<double>").repartition(3)
    pairs, passing = [], vector_index.passing

    def counted(rings, visitors, *args):
        out = passing(rings, visitors, *args)
        pairs.append((out.count(), rings.join(visitors, F.col("grp") == F.col("v_grp")).count()))
        return out

    monkeypatch.setattr(vector_index, "passing", counted)
    asks = {r[0] for r in rows if r[3]}
    for k, sizes in ((1, {"ring": 40, "pivots": 64}), (4, {"ring": 40, "pivots": 64}), (40, {"ring": 40, "pivots": 8}), (3, {"ring": 5000})):
        got: dict = {}
        for r in neighbours.top_in_groups(df, k, **sizes).orderBy("rank").collect():
            got.setdefault(r.b_id, []).append(r.a_id)
        want = {}
        for g in (0, 1, 2):
            want |= plain_neighbours([r for r, of in zip(clustered, group, strict=True) if of == g], k)
        assert got == {i: [j for j in near if j != i] for i, near in want.items() if i in asks}
    assert pairs[0][0] < 0.4 * pairs[0][1] and pairs[-1] == (0, 0)
    assert neighbours.top_in_groups(df.limit(0), 3).count() == 0



def test_leak_members_are_both_sides(spark):
    rows = [(1, "a", "train", "h"), (2, "a", "test", "h"), (3, "b", "test", "h"), (4, "a", "val", "g"), (5, "a", "val", "g"), (6, "b", "train", None), (7, "b", "test", None)]
    df = spark.createDataFrame(rows, "item_id long, class string, split string, hash string")
    assert sorted(r.item_id for r in leakage.leak_members(df).collect()) == [1, 2, 3]


def test_fingerprint_entropy(spark):
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.integers(0, 256, 400).astype(float), [256.0, 300.0, -1.0]])
    got = leakage.fingerprints(spark.createDataFrame([("g", float(x)) for x in v] + [("none", 999.0)], "g string, v double"), ["g"], "v").collect()
    hist = np.histogram(v, bins=256, range=(0, 256))[0]
    p = hist[hist > 0] / hist.sum()
    by = {r.g: r for r in got}
    assert by["g"].entropy == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-6) and by["none"].entropy == 0


def test_best_epoch_against_test(spark):
    logs = spark.createDataFrame([("a", 0.5), ("a", 0.8), ("a", 0.7), ("b", 0.4), ("c", None)], "run string, val_macro_f1 double")
    test = spark.createDataFrame([("a", 0.75), ("b", 0.5), ("c", 0.1)], "run string, macro_f1 double")
    assert {r.run: round(r.gap, 9) for r in metrics.val_test_gap(logs, test).collect()} == {"a": 0.05, "b": -0.1}


def test_store_errors_are_not_swallowed(spark, tmp_path):
    from modelaudit.sources import stores

    wanted = spark.createDataFrame([(1, 2.0)], "item_id long, x double")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stores.append_features(spark, wanted, lambda d: spark.read.parquet(str(tmp_path / "nothing")), str(tmp_path / "store"))
    store = str(tmp_path / "store")
    assert stores.append_features(spark, wanted, lambda d: d, store).count() == 1
    assert stores.append_features(spark, wanted, lambda d: d, store).count() == 1


def test_store_takes_concurrent_and_repeated_appends(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from modelaudit.sources import stores

    store, wanted = str(tmp_path / "store"), spark.createDataFrame([(i, float(i)) for i in range(100)], "item_id long, x double")
    assert stores.read_features(spark, store) is None
    started = []

    def slow(d):  # all find the store empty before one of them writes
        import time

        started.append(1)
        while len(started) < 3:
            time.sleep(0.05)
        return d

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: stores.append_features(spark, wanted, slow, store).count(), range(3)))
    assert len(stores.commits(store)) == 3 and sorted(r.item_id for r in stores.read_features(spark, store).collect()) == list(range(100))
    more = spark.createDataFrame([(5, -1.0), (200, 2.0)], "item_id long, x double")
    assert {tuple(r) for r in stores.append_features(spark, more, lambda d: d, store).collect()} == {(5, 5.0), (200, 2.0)}  # 5 was there
    more.write.parquet(f"{store}/commit=9")  # a later commit wins
    assert {r.item_id: r.x for r in stores.read_features(spark, store).collect()}[5] == -1.0
    more.write.parquet(f"{store}/commit=99")
    (tmp_path / "store" / "commit=99" / "_SUCCESS").unlink()  # one that never ended doesn't count
    assert len(stores.commits(store)) == 5 and stores.read_features(spark, store).count() == 101


def test_images_that_cannot_be_read_are_named(spark, tmp_path):
    from modelaudit.sources import images

    for klass in ("a b", "c+d"):
        (tmp_path / klass).mkdir()
        for n in (1, 2):
            (tmp_path / klass / f"x ({n}).png").write_bytes(images.png(np.full((4, 4), 9, np.uint8)))
    (tmp_path / "a b" / "broken%.png").write_bytes(b"no image")
    (tmp_path / "a b" / "notes.txt").write_text("no image, and not named as one")
    root, classes = f"file://{tmp_path}", ["a b", "c+d"]
    assert images.scan_images(spark, root, classes).count() == 4
    assert [tuple(r) for r in images.unreadable_images(spark, root, classes).collect()] == [("a b/broken%.png", "a b")]


def test_shared_folder_is_cleared(spark):
    from modelaudit.sources import shared

    kept = dict(shared.MADE)
    shared.MADE.clear()
    try:
        held = shared.materialize(spark.range(5), "to-clear")
        path = shared.MADE[spark.sparkContext.applicationId][0]
        assert held.count() == 5 and shared.clear(spark) == 1 and shared.clear(spark) == 0
        store, plain = shared.file_system(path)
        assert store.get_file_info(plain).type.name == "NotFound"
    finally:
        shared.MADE.update(kept)


def test_whole_number_weights_are_those_of_the_draws():
    """Bounds of a Poisson draw met in whole numbers; a row's weight is the same in all groups, and term sums are exact."""
    rng = np.random.default_rng(1)
    keys, reps = rng.integers(0, 2**32, 3000), np.arange(200)
    want = np.searchsorted(bootstrap.POISSON, bootstrap.draws(keys, reps), side="right")
    assert (bootstrap.weights(keys, reps) == want).all() and want.max() >= 7
    edges = np.concatenate([bootstrap.BOUNDS.astype(np.int64) - 1, bootstrap.BOUNDS.astype(np.int64)])
    assert (np.searchsorted(bootstrap.BOUNDS, edges, side="right") == np.searchsorted(bootstrap.POISSON, edges / 2**32, side="right")).all()


def test_cells_are_counted_once(spark):
    """Metrics that read the cells several times don't read the rows again."""
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.createDataFrame([("m", i % 3, i % 2) for i in range(60)], "model string, y_true int, y_pred int").mapInPandas(run, "model string, y_true int, y_pred int")
    assert metrics.report(metrics.cells(rows), 3).first()["report"]["n"] == 60 and seen.value == 60


def test_scores_travel_in_chunks(spark, monkeypatch):
    """Scores reach the shuffle as a row a label, range and some thousand rows; many ranges, ties and all, give the AUC of all pairs."""
    rng = np.random.default_rng(2)
    p = np.round(rng.uniform(size=(900, 2)), 2)
    rows = [("m", int(rng.integers(0, 2)), [float(a), float(1 - a)]) for a in p[:, 0]]
    df = spark.createDataFrame(rows, "model string, y_true int, y_prob array<double>")
    assert metrics.packed_scores(df.coalesce(1), ("model",), [0.3, 0.6]).count() == 2 * 3
    monkeypatch.setattr(metrics, "RANGE", 100)
    a, b = [x[2][1] for x in rows if x[1]], [x[2][1] for x in rows if not x[1]]
    want = np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])
    assert metrics.roc_auc(df, 2).first().auc == pytest.approx(want, abs=1e-12)
