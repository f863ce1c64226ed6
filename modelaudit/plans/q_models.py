"""Queries on ensembles, curves, choices of rows and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelaudit.functions import items as fn
from modelaudit.operators import curves, ensembles, metrics, neighbours, paired, proximity, splits
from modelaudit.plans import views as v
from modelaudit.plans.catalog import query
from modelaudit.plans.q_metrics import CELLS, K, SPLIT_PRED, per_class_sql, split_predictions
from modelaudit.sources.shared import shared_dir

R6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


def _vote(expr: str) -> str:
    """CTEs en: item_id, y_true, y_pred of ``expr``, a list of probabilities from a_k, b_k, c_k."""
    return f"""w AS (SELECT item_id, any_value(y_true) AS y_true, max(y_prob) FILTER (model = 'A') AS a, max(y_prob) FILTER (model = 'B') AS b, max(y_prob) FILTER (model = 'C') AS c FROM predictions GROUP BY 1),
e0 AS (SELECT item_id, y_true, [{', '.join(expr.replace('#', str(k + 1)) for k in range(K))}] AS p FROM w), en AS (SELECT item_id, y_true, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS y_pred, p FROM e0)"""


_TOP = "SELECT item_id, y_pred, round(list_max(p), 6) AS confidence FROM en"
top = lambda df: df.select("item_id", "y_pred", F.round(F.array_max("y_prob"), 6).alias("confidence"))


@query("h1_soft_vote", f"WITH {v.PREDICTIONS}, {_vote('0.35::DOUBLE * a[#] + (1.0::DOUBLE - 0.35::DOUBLE) * b[#]')} {_TOP}")
def h1(spark, sf_dir):
    return top(ensembles.soft_vote(v.predictions(spark, sf_dir), "A", "B", 0.35))


@query("h2_weight_grid", f"""WITH {v.PREDICTIONS}, w AS (SELECT item_id, any_value(y_true) AS y_true, max(y_prob) FILTER (model = 'A') AS a, max(y_prob) FILTER (model = 'B') AS b FROM predictions GROUP BY 1),
g AS (SELECT CAST(i AS INTEGER) AS step, y_true, [{', '.join(f'(i / 20.0::DOUBLE) * a[{k + 1}] + (1.0::DOUBLE - i / 20.0::DOUBLE) * b[{k + 1}]' for k in range(K))}] AS p FROM w, range(21) t(i)),
cells AS (SELECT step, y_true, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS y_pred, count(*) AS n FROM g GROUP BY 1, 2, 3), {per_class_sql(by='step')},
hd AS (SELECT step, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS accuracy, avg(f1) FILTER (support + predicted > 0) AS macro_f1 FROM pc GROUP BY step)
SELECT step, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, CAST(round_even((1 - accuracy) * n, 0) AS BIGINT) AS errors, macro_f1 >= max(macro_f1) OVER () - 1e-9 AS tied FROM hd""")
def h2(spark, sf_dir):
    g = ensembles.weight_grid(v.predictions(spark, sf_dir), "A", "B", K)
    return g.select("step", "n", "errors", "tied", *R6("accuracy", "macro_f1"))


@query("h3_weighted_ensemble", f"WITH {v.PREDICTIONS}, {_vote('(0.5::DOUBLE * a[#] + 0.3::DOUBLE * b[#] + 0.2::DOUBLE * c[#]) / (0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE)')} {_TOP}")
def h3(spark, sf_dir):
    return top(ensembles.weighted_ensemble(v.predictions(spark, sf_dir), {"A": 0.5, "B": 0.3, "C": 0.2}))


@query("h4_seed_ensemble", f"WITH {v.PREDICTIONS}, {_vote('(a[#] + b[#] + c[#]) / 3')} {_TOP}")
def h4(spark, sf_dir):
    return top(ensembles.seed_ensemble(v.predictions(spark, sf_dir), ""))


@query("h5_view_average", f"WITH {v.PREDICTIONS}, {_vote('(a[#] + b[#]) / 2')} {_TOP}")
def h5(spark, sf_dir):
    """Models A and B stand for two views of each order."""
    return top(ensembles.view_average(v.predictions(spark, sf_dir).filter("model in ('A', 'B')")))


@query("h7_ensemble_vs_components", f"""WITH {v.PREDICTIONS}, {_vote('0.5::DOUBLE * a[#] + (1.0::DOUBLE - 0.5::DOUBLE) * b[#]')},
o AS (SELECT model, item_id, y_true = y_pred AS ok FROM predictions WHERE model IN ('A', 'B') UNION ALL SELECT 'ensemble', item_id, y_true = y_pred FROM en)
SELECT *, round({v.mcnemar_sql('only_a', 'only_b')}, 6) AS p FROM (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (NOT a.ok AND b.ok) AS only_a, count(*) FILTER (a.ok AND NOT b.ok) AS only_b FROM o a JOIN o b ON a.item_id = b.item_id AND a.model < b.model WHERE b.model = 'ensemble' GROUP BY 1, 2)""")
def h7(spark, sf_dir):
    p = v.predictions(spark, sf_dir, ("A", "B"))
    return paired.all_pairs(p.unionByName(ensembles.soft_vote(p, "A", "B"))).filter("model_b = 'ensemble'").select("model_a", "model_b", "only_a", "only_b", F.round("p", 6).alias("p"))


@query("k1_most_confident_errors", f"WITH {v.PREDICTIONS} SELECT model, item_id, y_true, y_pred, round(y_prob[y_pred + 1], 6) AS confidence FROM predictions WHERE y_true <> y_pred ORDER BY y_prob[y_pred + 1] DESC, model, item_id LIMIT 50")
def k1(spark, sf_dir):
    return ensembles.most_confident_errors(v.predictions(spark, sf_dir), 50).withColumn("confidence", F.round("confidence", 6))


@query("k2_best_correct_per_class", f"WITH {v.PREDICTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY model, y_true ORDER BY y_prob[y_pred + 1] DESC, item_id) AS r FROM predictions WHERE y_true = y_pred) SELECT model, y_true, item_id, round(y_prob[y_pred + 1], 6) AS confidence FROM r WHERE r = 1")
def k2(spark, sf_dir):
    return ensembles.best_correct_per_class(v.predictions(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("k3_quota_sample", f"""WITH {v.PREDICTIONS}, w AS (SELECT item_id, any_value(y_true) AS y_true, max(y_pred) FILTER (model = 'A') AS pa, max(y_pred) FILTER (model = 'B') AS pb FROM predictions GROUP BY 1),
x AS (SELECT item_id, y_true, CASE WHEN y_true = pa AND y_true = pb THEN 'both_right' WHEN y_true = pb THEN 'only_a_wrong' WHEN y_true = pa THEN 'only_b_wrong' ELSE 'both_wrong' END AS bucket FROM w),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY CASE y_true WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END, item_id) AS INTEGER) AS rank FROM x)
SELECT item_id, y_true, bucket, rank FROM r WHERE (bucket = 'only_a_wrong' AND rank <= 5) OR (bucket = 'both_wrong' AND rank <= 8)""")
def k3(spark, sf_dir):
    rows = paired.outcomes(paired.align(v.predictions(spark, sf_dir), ["A", "B"]), "A", "B").select("item_id", "y_true", "bucket")
    return ensembles.quota_sample(rows, {"only_a_wrong": 5, "both_wrong": 8}, [3, 1])


@query("k4_select_best", f"WITH {CELLS}, {per_class_sql()}, m AS (SELECT model, avg(f1) FILTER (support + predicted > 0) AS macro_f1 FROM pc GROUP BY 1) SELECT model, round(macro_f1, 6) AS macro_f1 FROM m ORDER BY m.macro_f1 DESC, model LIMIT 1")
def k4(spark, sf_dir):
    return ensembles.select_best(metrics.headline(metrics.cells(v.predictions(spark, sf_dir)), K)).select("model", *R6("macro_f1"))


def epochs(spark, sf_dir):
    from pyspark.sql.window import Window

    t = v.read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").cast("double").alias("value"))
    n = F.row_number().over(Window.partitionBy("run").orderBy("ts", "event_id"))
    t = t.withColumn("epoch", n).withColumn("stage", F.when(n <= 5, 1).otherwise(2))
    return t.select("run", "stage", "epoch", (F.col("value") * fn.hash01(F.concat(F.lit("t"), F.col("event_id").cast("string")))).alias("train_loss"), F.col("value").alias("val_loss"), fn.hash01(F.concat_ws("|", F.col("run").cast("string"), F.col("epoch").cast("string"))).alias("val_macro_f1"))


EPOCHS = f"""ev AS (SELECT user_id AS run, event_id, CAST(value AS DOUBLE) AS value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch FROM events),
ep AS (SELECT run, CASE WHEN epoch <= 5 THEN 1 ELSE 2 END AS stage, epoch, epoch - 1 AS idx, value * {v.h01("'t' || event_id")} AS train_loss, value AS val_loss, {v.h01("run || '|' || epoch")} AS f1 FROM ev)"""


_RUN_TEST = f"""WITH {SPLIT_PRED}, {EPOCHS}, cells AS (SELECT model, y_true, y_pred, count(*) AS n FROM sp WHERE split = 'test' GROUP BY 1, 2, 3), {per_class_sql()},
mt AS (SELECT model, avg(f1) FILTER (support + predicted > 0) AS test FROM pc GROUP BY 1),
be AS (SELECT run, max(f1) AS best_val FROM ep GROUP BY 1)"""


@query("e16_val_test_gap", f"{_RUN_TEST} SELECT run, round(best_val, 6) AS best_val, round(test, 6) AS test, round(best_val - test, 6) AS gap FROM be JOIN mt ON mt.model = substr('ABC', CAST(run % 3 AS INTEGER) + 1, 1)")
def e16(spark, sf_dir):
    """Runs are tested as models A, B and C in turn."""
    board = metrics.headline(metrics.cells(split_predictions(spark, sf_dir).filter("split = 'test'")), K)
    logs = epochs(spark, sf_dir).select("run", "val_macro_f1")
    model = F.substring(F.lit("ABC"), F.pmod("run", F.lit(3)).cast("int") + F.lit(1), F.lit(1))
    test = logs.select("run", model.alias("model")).distinct().join(board, "model").select("run", "macro_f1")
    return metrics.val_test_gap(logs, test).select("run", *R6("best_val", "test", "gap"))


@query("w1_best_epoch", f"WITH {EPOCHS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, idx) AS r FROM ep) SELECT run, max(idx) FILTER (r = 1) AS best_index, round(max(f1), 6) AS best_f1, max(idx) FILTER (stage = 1) AS last_stage1, CAST(count(*) AS INTEGER) AS n FROM r GROUP BY run")
def w1(spark, sf_dir):
    return curves.best_epoch(epochs(spark, sf_dir)).withColumn("best_f1", F.round("best_f1", 6))


@query("w2_improvement_trace", f"""WITH {EPOCHS}, b AS (SELECT *, max(f1) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ep),
i AS (SELECT *, before IS NULL OR f1 > before AS improved FROM b), l AS (SELECT *, max(CASE WHEN improved THEN idx END) OVER (PARTITION BY run ORDER BY idx) AS last, min(CASE WHEN stage = 2 THEN idx END) OVER (PARTITION BY run) - 1 AS s2 FROM i),
s AS (SELECT *, idx - greatest(last, CASE WHEN stage = 2 THEN s2 END) AS since FROM l)
SELECT run, idx AS index, round(greatest(before, f1), 6) AS best, improved, since, min(CASE WHEN since >= 5 THEN idx END) OVER (PARTITION BY run) AS stops_at FROM s""")
def w2(spark, sf_dir):
    return curves.improvement_trace(epochs(spark, sf_dir)).withColumn("best", F.round("best", 6))


@query("w3_loss_rebound", f"""WITH {EPOCHS}, s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, idx) AS lo, row_number() OVER (PARTITION BY run ORDER BY idx DESC) AS hi FROM ep WHERE stage = 2),
a AS (SELECT run, count(*) AS n, max(val_loss) FILTER (hi = 1) - min(val_loss) AS rebound, max(train_loss) FILTER (hi = 1) - max(train_loss) FILTER (lo = 1) AS train_change FROM s GROUP BY run)
SELECT run, n, round(rebound, 6) AS rebound, round(train_change, 6) AS train_change, CASE WHEN n < 5 THEN 'too short' WHEN rebound > 0.05 AND train_change < 0 THEN 'overfitting' WHEN rebound > 0.02 THEN 'mild rebound' ELSE 'stable' END AS verdict FROM a""")
def w3(spark, sf_dir):
    return curves.loss_rebound(epochs(spark, sf_dir)).select("run", "n", "verdict", *R6("rebound", "train_change"))


@query("w4_round_curve", f"""WITH {EPOCHS}, s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS lo, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS hi FROM ep),
a AS (SELECT run, max(epoch) FILTER (lo = 1) AS best_round, min(val_loss) AS best_val, max(train_loss) FILTER (epoch = 10) AS deployed_train, max(val_loss) FILTER (epoch = 10) AS deployed_val, max(val_loss - train_loss) FILTER (hi = 1) AS final_gap, max(epoch) AS last_round FROM s GROUP BY run)
SELECT run, best_round, last_round, round(best_val, 6) AS best_val, round(deployed_train, 6) AS deployed_train, round(deployed_val, 6) AS deployed_val, round(final_gap, 6) AS final_gap,
CASE WHEN final_gap > 0.05 THEN CASE WHEN best_round < last_round THEN 'overfits after the best round' ELSE 'wide gap, still improving' END ELSE 'no wide gap' END AS verdict FROM a""")
def w4(spark, sf_dir):
    out = curves.round_curve(epochs(spark, sf_dir).withColumn("round", F.col("epoch")), 10)
    return out.select("run", "best_round", "last_round", "verdict", *R6("best_val", "deployed_train", "deployed_val", "final_gap"))


def sweep(spark, sf_dir):
    """Macro-F1 of each model on nested hash subsets of 10, 25, 50 and 100 per cent."""
    p = v.predictions(spark, sf_dir).withColumn("h", fn.hash01(F.concat(F.lit("sw|"), F.col("item_id").cast("string"))))
    p = p.withColumn("fraction", F.explode(F.lit([10, 25, 50, 100]))).filter(F.col("h") * 100 < F.col("fraction"))
    return metrics.headline(metrics.cells(p, ("model", "fraction")), K, ("model", "fraction")).select("model", "fraction", "macro_f1")


SWEEP = f"""{v.PREDICTIONS}, swp AS (SELECT p.*, CAST(f AS INTEGER) AS fraction FROM predictions p, unnest([10, 25, 50, 100]) t(f) WHERE {v.h01("'sw|' || item_id")} * 100 < f),
swc AS (SELECT model || '|' || fraction AS mf, y_true, y_pred, count(*) AS n FROM swp GROUP BY 1, 2, 3), {per_class_sql('swc', 'mf')},
sweep AS (SELECT split_part(mf, '|', 1) AS model, CAST(split_part(mf, '|', 2) AS INTEGER) AS fraction, avg(f1) FILTER (support + predicted > 0) AS macro_f1 FROM pc GROUP BY mf)"""


@query("w5_learning_curve_gain", f"WITH {SWEEP} SELECT model, fraction, round(macro_f1, 6) AS macro_f1, round(macro_f1 - lag(macro_f1) OVER (PARTITION BY model ORDER BY fraction), 6) AS gain FROM sweep")
def w5(spark, sf_dir):
    return curves.learning_curve_gain(sweep(spark, sf_dir)).select("model", "fraction", *R6("macro_f1", "gain"))


@query("j15_sweep_curve", f"WITH {SWEEP} SELECT s.model, s.fraction, round(s.macro_f1, 6) AS raw_macro_f1, round(CASE WHEN s.model <> 'C' AND s.fraction <> 25 THEN s.macro_f1 END, 6) AS tta_macro_f1 FROM sweep s")
def j15(spark, sf_dir):
    s = sweep(spark, sf_dir)
    out = curves.sweep_curve(s.select("model", "fraction"), s, s.filter("model <> 'C' and fraction <> 25"))
    return out.select("model", "fraction", *R6("raw_macro_f1", "tta_macro_f1"))


@query("p7_l2_normalise", f"WITH {v.ITEMS} SELECT item_id, round(list_sum(list_transform(features, lambda x: abs(x / (sqrt(list_sum(list_transform(features, lambda y: y * y))) + 1e-12)))), 5) AS l1 FROM items")
def p7(spark, sf_dir):
    unit = fn.l2_normalise(F.col("features"))
    return v.items(spark, sf_dir).select("item_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("l1"))


@query("p9_vector_key", f"WITH {v.ITEMS} SELECT count(*) AS n, count(DISTINCT features) AS keys FROM items")
def p9(spark, sf_dir):
    return v.items(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct(fn.vector_key(F.col("features"))).alias("keys"))


def item_splits(spark, sf_dir):
    s = splits.group_split(v.items(spark, sf_dir))
    return s.filter("split = 'train'"), s.filter("split = 'test'")


_SIM = f"{v.ITEMS}, {v.split_sql('items')}, u AS (SELECT item_id, class, split, features, sqrt(list_sum(list_transform(features, lambda y: y * y))) + 1e-12 AS nn FROM split_items)"


@query("j6_nearest_neighbour", f"""WITH {_SIM}, s AS (SELECT b.item_id AS b_id, a.item_id AS a_id, round(list_dot_product(b.features, a.features) / (a.nn * b.nn), 9) AS sim FROM u b, u a WHERE b.split = 'test' AND a.split = 'train'),
r AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY sim DESC, a_id) AS r FROM s) SELECT b_id, a_id, round(sim, 6) AS sim, sim >= 0.9999 AS near_duplicate, sim >= 0.999 AND sim < 0.9999 AS very_close FROM r WHERE r = 1""")
def j6(spark, sf_dir):
    train, test = item_splits(spark, sf_dir)
    return neighbours.nearest_neighbour(test, train).withColumn("sim", F.round("sim", 6))


@query("j6_nearest_summary", f"""WITH {_SIM}, s AS (SELECT b.item_id AS b_id, max(round(list_dot_product(b.features, a.features) / (a.nn * b.nn), 9)) AS sim FROM u b, u a WHERE b.split = 'test' AND a.split = 'train' GROUP BY 1)
SELECT count(*) AS n, round(max(sim), 6) AS most, round(avg(sim), 6) AS mean, count(*) FILTER (sim >= 0.9999) AS near_duplicate, count(*) FILTER (sim >= 0.999 AND sim < 0.9999) AS very_close FROM s""")
def j6_summary(spark, sf_dir):
    train, test = item_splits(spark, sf_dir)
    return neighbours.nearest_summary(neighbours.nearest_neighbour(test, train)).select("n", "near_duplicate", "very_close", *R6("most", "mean"))


_KNN = """, pr AS (SELECT b.item_id AS key, b.class, a.item_id AS train_key, abs(a.item_id - b.item_id) AS gap, list_dot_product(b.features, a.features) / (a.nn * b.nn) AS sim, row_number() OVER (PARTITION BY b.item_id ORDER BY abs(a.item_id - b.item_id), a.item_id) AS r FROM u b JOIN u a ON a.class = b.class WHERE b.split = 'test' AND a.split = 'train' AND b.class IN (SELECT class FROM u WHERE split = 'train' GROUP BY class HAVING count(*) > 5)),
near AS (SELECT * FROM pr WHERE r <= 5)"""


@query("j7_k_nearest_by_id", f"WITH {_SIM}{_KNN} SELECT key, class, train_key, gap, round(sim, 6) AS sim FROM near")
def j7(spark, sf_dir):
    train, test = item_splits(spark, sf_dir)
    number = lambda d: d.withColumn("number", fn.item_number(F.col("name"), None))
    return neighbours.k_nearest_by_id(number(test), number(train), "number").withColumn("sim", F.round("sim", 6))


_RB = """, rbs AS (SELECT p.item_id, p.class, p.trial, avg(list_dot_product(b.features, a.features) / (a.nn * b.nn)) AS s FROM pool p JOIN u b ON b.item_id = p.item_id JOIN u a ON a.item_id = p.train_key GROUP BY 1, 2, 3), rb AS (SELECT item_id, class, avg(s) AS sim FROM rbs GROUP BY 1, 2)"""
_U = ", u AS (SELECT item_id, class, split, features, sqrt(list_sum(list_transform(features, lambda y: y * y))) + 1e-12 AS nn FROM split_items)"


def pool_sql():
    from modelaudit.plans.q_splits import _POOL

    return _POOL + _U


@query("j8_random_baseline", f"WITH {pool_sql()}{_RB} SELECT item_id, class, round(sim, 6) AS sim FROM rb")
def j8(spark, sf_dir):
    train, test = item_splits(spark, sf_dir)
    return neighbours.random_baseline(test, train).withColumn("sim", F.round("sim", 6))


@query("j14_dedup_near", f"""WITH RECURSIVE {v.ITEMS}, n AS (SELECT item_id, features, sqrt(list_sum(list_transform(features, lambda y: y * y))) + 1e-12 AS nn FROM items),
l AS (SELECT a.item_id AS a, b.item_id AS b FROM n a, n b WHERE a.item_id <> b.item_id AND round(list_dot_product(a.features, b.features) / (a.nn * b.nn), 9) > 0.9),
c AS (SELECT item_id, item_id AS reach FROM items UNION SELECT c.item_id, l.b FROM c JOIN l ON c.reach = l.a)
SELECT item_id, min(reach) AS component, min(reach) = item_id AS kept FROM c GROUP BY item_id""")
def j14(spark, sf_dir):
    """A threshold of 0.9 here: the given vectors hold no copies."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return neighbours.dedup_near(v.items(spark, sf_dir), 0.9)


def _proximity(spark, sf_dir):
    train, test = item_splits(spark, sf_dir)
    number = lambda d: d.withColumn("number", fn.item_number(F.col("name"), None))
    near = neighbours.k_nearest_by_id(number(test), number(train), "number").groupBy("key", "class").agg(F.round(F.avg("sim"), 9).alias("sim"))
    return near, neighbours.random_baseline(test, train).withColumn("sim", F.round("sim", 9))


_VALUES = f"""WITH {pool_sql()}{_RB}{_KNN}, nm AS (SELECT key, class, round(avg(sim), 9) AS sim FROM near GROUP BY 1, 2),
val AS (SELECT class, sim AS value, 1 AS side FROM nm UNION ALL SELECT class, round(sim, 9), 2 FROM rb),
mw AS (SELECT a.class, sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM val a JOIN val b ON a.class = b.class WHERE a.side = 1 AND b.side = 2 GROUP BY 1),
sts AS (SELECT class, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2, avg(value) FILTER (side = 1) AS m1, avg(value) FILTER (side = 2) AS m2, stddev_pop(value) FILTER (side = 1) AS p1, stddev_pop(value) FILTER (side = 2) AS p2, stddev_samp(value) FILTER (side = 1) AS s1, stddev_samp(value) FILTER (side = 2) AS s2 FROM val GROUP BY 1),
ef AS (SELECT sts.class, n1, n2, u, m1, m2, p1, p2, m1 - m2 AS delta, m1 / nullif(m2, 0) AS ratio, (m1 - m2) / nullif(sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 0) AS d, (m1 - m2) / nullif(1 - m2, 0) AS room, u / (n1 * n2) AS cles FROM sts JOIN mw ON sts.class = mw.class),
vd AS (SELECT *, CASE WHEN coalesce(ratio, 0) >= 1.5 AND coalesce(d, 0) >= 0.8 THEN 'strong' WHEN coalesce(d, 0) >= 0.8 AND coalesce(ratio, 0) < 1.05 THEN 'saturated' WHEN coalesce(ratio, 0) >= 1.05 THEN 'moderate' ELSE 'none' END AS verdict FROM ef)"""


@query("e18_effect_size", f"{_VALUES} SELECT class, n1, n2, u, round(m1, 6) AS near_mean, round(m2, 6) AS random_mean, round(p1, 6) AS near_std, round(p2, 6) AS random_std, round(delta, 6) AS delta, round(ratio, 4) AS ratio, round(d, 6) AS d, round(room, 6) AS room, round(cles, 6) AS cles FROM ef")
def e18(spark, sf_dir):
    out = proximity.effect_size(*_proximity(spark, sf_dir))
    return out.select("class", "n1", "n2", "u", F.round("ratio", 4).alias("ratio"), *R6("near_mean", "random_mean", "near_std", "random_std", "delta", "d", "room", "cles"))


@query("e19_mann_whitney", f"""{_VALUES}, tie AS (SELECT class, sum(c * c * c - c) AS t FROM (SELECT class, value, count(*)::DOUBLE AS c FROM val GROUP BY 1, 2) GROUP BY 1),
zs AS (SELECT ef.class, n1, n2, u, (u - n1 * n2 / 2.0::DOUBLE - 0.5) / sqrt(n1 * n2 / 6.0::DOUBLE * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM ef JOIN tie ON ef.class = tie.class)
SELECT class, n1, n2, u, round(0.5 * {v.erfc_sql('z')}, 6) AS p FROM zs""")
def e19(spark, sf_dir):
    near, rand = _proximity(spark, sf_dir)
    both = near.select("class", F.col("sim").alias("value"), F.lit(1).alias("side")).unionByName(rand.select("class", F.col("sim").alias("value"), F.lit(2).alias("side")))
    return proximity.mann_whitney(both).withColumn("p", F.round("p", 6))


@query("e20_leakage_verdict", f"""{_VALUES}, n AS (SELECT count(*) FILTER (verdict = 'strong') AS strong, count(*) FILTER (verdict = 'saturated') AS saturated, count(*) FILTER (verdict = 'moderate') AS moderate, count(*) FILTER (verdict = 'none') AS none FROM vd)
SELECT *, CASE WHEN strong >= 1 THEN 'strong' WHEN saturated >= 2 THEN 'saturated' WHEN moderate >= 2 THEN 'moderate' ELSE 'none' END AS overall FROM n""")
def e20(spark, sf_dir):
    return proximity.overall_verdict(proximity.leakage_verdict(proximity.effect_size(*_proximity(spark, sf_dir))))


_SMOTE = f"""WITH {v.ITEMS}, un AS (SELECT item_id, class, features, sqrt(list_sum(list_transform(features, lambda y: y * y))) + 1e-12 AS nn FROM items),
sz AS (SELECT class, count(*) AS c FROM items GROUP BY 1), need AS (SELECT class, (SELECT max(c) FROM sz) - c AS need FROM sz WHERE c < (SELECT max(c) FROM sz)),
sm AS (SELECT b.item_id AS b_id, b.class AS b_class, a.item_id AS a_id, a.class AS a_class, round(list_dot_product(b.features, a.features) / (a.nn * b.nn), 9) AS sim FROM un b JOIN need ON need.class = b.class JOIN un a ON a.item_id <> b.item_id),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY sim DESC, a_id) AS rank FROM sm) WHERE rank <= 10),
dg AS (SELECT b_id, b_class FROM nr GROUP BY 1, 2 HAVING 2 * count(*) FILTER (a_class <> b_class) >= count(*) AND count(*) FILTER (a_class <> b_class) < count(*)),
sd AS (SELECT *, row_number() OVER (PARTITION BY b_class ORDER BY md5('42|' || b_id), b_id) - 1 AS at, count(*) OVER (PARTITION BY b_class) AS of FROM dg),
mk AS (SELECT sd.b_id, sd.b_class, i FROM (SELECT class, unnest(range(1, need + 1)) AS i FROM need) m JOIN sd ON sd.b_class = m.class AND sd.at = m.i % sd.of),
pt AS (SELECT b_id, a_id, row_number() OVER (PARTITION BY b_id ORDER BY sim DESC, a_id) - 1 AS place, least(5, count(*) OVER (PARTITION BY b_id)) AS n FROM sm WHERE a_class = b_class AND b_id IN (SELECT b_id FROM sd)),
dr AS (SELECT mk.*, CAST(floor({v.h01("'42|partner|' || mk.b_id || '|' || i")} * n) AS BIGINT) AS place, {v.h01("'42|gap|' || mk.b_id || '|' || i")} AS g FROM mk JOIN (SELECT DISTINCT b_id, n FROM pt) p ON p.b_id = mk.b_id),
nw AS (SELECT dr.b_class AS class, dr.b_id AS item_id, CAST(i AS BIGINT) AS i, TRUE AS synthetic, list_transform(range(1, 65), lambda k: fa.features[k] + g * (fb.features[k] - fa.features[k])) AS f
       FROM dr JOIN pt ON pt.b_id = dr.b_id AND pt.place = dr.place JOIN items fa ON fa.item_id = dr.b_id JOIN items fb ON fb.item_id = pt.a_id)
SELECT class, item_id, i, synthetic, round(list_sum(list_transform(range(1, 65), lambda k: k * f[k])), 5) AS weighted FROM (SELECT * FROM nw UNION ALL SELECT class, item_id, NULL, FALSE, features FROM items)"""


@query("t9_borderline_smote", _SMOTE)
def t9(spark, sf_dir):
    """All rows, made up or not; the features as a sum weighted by their place."""
    weighted = F.aggregate(F.transform("features", lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, x: a + x)
    return neighbours.borderline_smote(v.items(spark, sf_dir)).select("class", "item_id", "i", "synthetic", F.round(weighted, 5).alias("weighted"))
