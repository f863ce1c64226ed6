"""Queries on evaluation and paired comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelaudit.functions import items as fn
from modelaudit.operators import bootstrap, metrics, paired, splits
from modelaudit.plans import views as v
from modelaudit.plans.catalog import query

R6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]
K = v.K
CELLS = f"{v.PREDICTIONS}, cells AS (SELECT model, y_true, y_pred, count(*) AS n FROM predictions GROUP BY 1, 2, 3)"


def per_class_sql(cells: str = "cells", by: str = "model") -> str:
    """CTEs pc: by, label, tp, support, predicted, precision, recall, f1."""
    return f"""gr AS (SELECT DISTINCT {by}, CAST(l AS INTEGER) AS label FROM {cells}, range({K}) t(l)),
pc0 AS (SELECT gr.{by}, label, coalesce(sum(n) FILTER (y_true = label AND y_pred = label), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (y_true = label), 0)::BIGINT AS support, coalesce(sum(n) FILTER (y_pred = label), 0)::BIGINT AS predicted FROM gr JOIN {cells} c ON c.{by} = gr.{by} GROUP BY 1, 2),
pc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM pc0)"""


def cells(spark, sf_dir):
    return metrics.cells(v.predictions(spark, sf_dir))


@query("p4_argmax_class", f"WITH {v.PREDICTIONS} SELECT model, item_id, y_pred FROM predictions")
def p4(spark, sf_dir):
    return v.predictions(spark, sf_dir).select("model", "item_id", "y_pred")


@query("p5_outcome_flags", f"""WITH {v.PREDICTIONS}, w AS (SELECT item_id, any_value(y_true) AS y_true, max(y_pred) FILTER (model = 'A') AS pred_a, max(y_pred) FILTER (model = 'B') AS pred_b FROM predictions GROUP BY 1)
SELECT *, CASE WHEN y_true = pred_a AND y_true = pred_b THEN 'both_right' WHEN y_true = pred_b THEN 'only_a_wrong' WHEN y_true = pred_a THEN 'only_b_wrong' ELSE 'both_wrong' END AS bucket,
CASE WHEN y_true <> pred_a THEN y_true || '->' || pred_a END AS error_a, CASE WHEN y_true <> pred_b THEN y_true || '->' || pred_b END AS error_b FROM w""")
def p5(spark, sf_dir):
    return paired.outcomes(paired.align(v.predictions(spark, sf_dir), ["A", "B"]), "A", "B")


@query("p6_predicted_confidence", f"WITH {v.PREDICTIONS} SELECT model, item_id, round(y_prob[y_pred + 1], 6) AS confidence FROM predictions")
def p6(spark, sf_dir):
    return v.predictions(spark, sf_dir).select("model", "item_id", F.round(fn.predicted_confidence(F.col("y_prob"), F.col("y_pred")), 6).alias("confidence"))


@query("j9_align_predictions", f"WITH {v.PREDICTIONS} SELECT item_id, any_value(y_true) AS y_true, max(y_pred) FILTER (model = 'A') AS \"pred_A\", max(y_pred) FILTER (model = 'B') AS \"pred_B\", max(y_pred) FILTER (model = 'C') AS \"pred_C\" FROM predictions GROUP BY 1")
def j9(spark, sf_dir):
    return paired.align(v.predictions(spark, sf_dir), ["A", "B", "C"])


GRID = f"g AS (SELECT model, CAST(t AS INTEGER) AS y_true, CAST(p AS INTEGER) AS y_pred FROM (SELECT DISTINCT model FROM cells), range({K}) a(t), range({K}) b(p)), cm AS (SELECT g.*, coalesce(c.n, 0) AS n FROM g LEFT JOIN cells c ON c.model = g.model AND c.y_true = g.y_true AND c.y_pred = g.y_pred)"


@query("e1_confusion_matrix", f"WITH {CELLS}, {GRID} SELECT * FROM cm")
def e1(spark, sf_dir):
    return metrics.confusion_matrix(cells(spark, sf_dir), K)


@query("e2_per_class", f"WITH {CELLS}, {per_class_sql()} SELECT model, label, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc")
def e2(spark, sf_dir):
    return metrics.per_class(cells(spark, sf_dir), K).select("model", "label", "tp", "support", "predicted", *R6("precision", "recall", "f1"))


@query("e3_accuracy", f"WITH {v.PREDICTIONS} SELECT model, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS accuracy FROM predictions GROUP BY 1")
def e3(spark, sf_dir):
    return metrics.headline(cells(spark, sf_dir), K).select("model", *R6("accuracy"))


_HEAD = "SELECT model, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS accuracy, avg(f1) FILTER (support + predicted > 0) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM pc GROUP BY model"


@query("e4_headline", f"WITH {CELLS}, {per_class_sql()}, hd AS ({_HEAD}) SELECT model, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM hd")
def e4(spark, sf_dir):
    return metrics.headline(cells(spark, sf_dir), K).select("model", "n", *R6("accuracy", "macro_f1", "weighted_f1"))


@query("e5_roc_auc", f"""WITH {v.PREDICTIONS}, l AS (SELECT model, y_true, l AS label, y_prob[l + 1] AS score FROM predictions, range({K}) t(l)),
r AS (SELECT *, rank() OVER (PARTITION BY model, label ORDER BY score) + (count(*) OVER (PARTITION BY model, label, score) - 1) / 2 AS rk FROM l),
a AS (SELECT model, label, (sum(rk) FILTER (y_true = label) - count(*) FILTER (y_true = label) * (count(*) FILTER (y_true = label) + 1) / 2) / (count(*) FILTER (y_true = label) * count(*) FILTER (y_true <> label)) AS auc FROM r GROUP BY 1, 2)
SELECT model, round(avg(auc), 6) AS auc FROM a GROUP BY 1""")
def e5(spark, sf_dir):
    return metrics.roc_auc(v.predictions(spark, sf_dir), K).select("model", *R6("auc"))


@query("e6_bootstrap_f1")
def e6(spark, sf_dir):
    return bootstrap.bootstrap_f1(cells(spark, sf_dir), K)


_BOUNDS = [float(x) for x in bootstrap.POISSON[:12]]  # 32-bit draws end before the others
_W = "CASE " + " ".join(f"WHEN u < {b!r}::DOUBLE THEN {i}" for i, b in enumerate(_BOUNDS)) + " ELSE 12 END"


_DRAWS = f"""k AS MATERIALIZED (SELECT model, y_true, y_pred, CAST('0x' || substr(md5('42|' || item_id), 1, 8) AS UBIGINT) AS k FROM predictions),
d0 AS (SELECT model, y_true, y_pred, rep, (k + CAST(rep AS UBIGINT) * 2654435769) % 4294967296 AS x FROM k, range(1000) t(rep)),
d1 AS (SELECT model, y_true, y_pred, rep, xor(x, x >> 16) * 2246822507 % 4294967296 AS x FROM d0), d2 AS (SELECT model, y_true, y_pred, rep, xor(x, x >> 13) * 3266489909 % 4294967296 AS x FROM d1),
d AS (SELECT model, y_true, y_pred, rep, xor(x, x >> 16) / 4294967296.0::DOUBLE AS u FROM d2),
w AS (SELECT model, rep, y_true, y_pred, sum({_W}) AS w FROM d GROUP BY 1, 2, 3, 4)"""


@query("e6_f1_of_weighted_rows", f"""WITH {v.PREDICTIONS}, {_DRAWS}, l AS (SELECT model, rep, CAST(l AS INTEGER) AS label, sum(CASE WHEN y_true = l AND y_pred = l THEN w ELSE 0 END) AS tp, sum(CASE WHEN y_true = l THEN w ELSE 0 END) + sum(CASE WHEN y_pred = l THEN w ELSE 0 END) AS n FROM w, range({K}) t(l) GROUP BY 1, 2, 3),
f AS (SELECT model, rep, label, 2 * tp / nullif(n, 0) AS f1 FROM l), a AS (SELECT model, label, coalesce(f1, 0) AS value FROM f UNION ALL SELECT model, NULL, avg(f1) FROM f GROUP BY model, rep)
SELECT model, label, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM a GROUP BY 1, 2""")
def e6_rows(spark, sf_dir):
    return bootstrap.bootstrap_f1_of_rows(v.predictions(spark, sf_dir), "item_id", K).select("model", "label", *R6("mean", "lo", "hi"))


@query("e7_bootstrap_ci", f"""WITH {v.PREDICTIONS}, {_DRAWS}, m AS (SELECT model, rep, sum(CASE WHEN y_true = y_pred THEN w ELSE 0 END) / sum(w) AS value FROM w GROUP BY 1, 2)
SELECT model, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM m GROUP BY 1""")
def e7(spark, sf_dir):
    ok = (F.col("y_true") == F.col("y_pred")).cast("int")
    return bootstrap.bootstrap_ci(v.predictions(spark, sf_dir), "item_id", {"hits": ok, "n": F.lit(1)}, lambda s: s["hits"] / s["n"], 1000, ("model",)).select("model", *R6("mean", "lo", "hi"))


_PAIR = f"""WITH {v.PREDICTIONS}, o AS (SELECT model, item_id, y_true = y_pred AS ok FROM predictions),
q AS (SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.ok AND b.ok) AS both_right, count(*) FILTER (NOT a.ok AND b.ok) AS only_a, count(*) FILTER (a.ok AND NOT b.ok) AS only_b, count(*) FILTER (NOT a.ok AND NOT b.ok) AS both_wrong FROM o a JOIN o b ON a.item_id = b.item_id AND a.model < b.model GROUP BY 1, 2),
s AS (SELECT *, only_a + only_b AS discordant, round(CASE WHEN only_a + only_b < 25 THEN least(only_a, only_b) ELSE power(abs(only_a - only_b) - 1, 2) / (only_a + only_b) END, 6) AS statistic, round({v.mcnemar_sql('only_a', 'only_b')}, 6) AS p FROM q)"""


@query("e8_mcnemar", f"{_PAIR} SELECT model_a, model_b, only_a, only_b, statistic, p FROM s WHERE model_a = 'A' AND model_b = 'B'")
def e8(spark, sf_dir):
    return paired.all_pairs(v.predictions(spark, sf_dir).filter("model in ('A', 'B')")).select("model_a", "model_b", "only_a", "only_b", *R6("statistic", "p"))


@query("e9_pair_summary", f"{_PAIR} SELECT both_right, only_a, only_b, both_wrong, discordant FROM s WHERE model_a = 'A' AND model_b = 'C'")
def e9(spark, sf_dir):
    return paired.all_pairs(v.predictions(spark, sf_dir).filter("model in ('A', 'C')")).select("both_right", "only_a", "only_b", "both_wrong", "discordant")


@query("e10_all_pairs", f"{_PAIR} SELECT * FROM s")
def e10(spark, sf_dir):
    return paired.all_pairs(v.predictions(spark, sf_dir)).withColumns({"statistic": F.round("statistic", 6), "p": F.round("p", 6)})


@query("e11_confusion_pairs", f"""WITH {v.PREDICTIONS}, w AS (SELECT item_id, any_value(y_true) AS y_true, max(y_pred) FILTER (model = 'A') AS pa, max(y_pred) FILTER (model = 'B') AS pb FROM predictions GROUP BY 1),
x AS (SELECT *, CASE WHEN y_true = pa AND y_true = pb THEN 'both_right' WHEN y_true = pb THEN 'only_a_wrong' WHEN y_true = pa THEN 'only_b_wrong' ELSE 'both_wrong' END AS bucket FROM w),
y AS (SELECT bucket, 'a' AS side, y_true, pa AS y_pred FROM x WHERE bucket IN ('only_a_wrong', 'both_wrong') UNION ALL SELECT bucket, 'b', y_true, pb FROM x WHERE bucket IN ('only_b_wrong', 'both_wrong'))
SELECT bucket, side, y_true, y_pred, count(*) AS n FROM y GROUP BY 1, 2, 3, 4""")
def e11(spark, sf_dir):
    return paired.confusion_pairs(paired.outcomes(paired.align(v.predictions(spark, sf_dir), ["A", "B"]), "A", "B"))


@query("e12_row_normalised_confusion", f"WITH {CELLS}, {GRID} SELECT model, y_true, y_pred, n, round(n / nullif(sum(n) OVER (PARTITION BY model, y_true), 0), 6) AS share FROM cm")
def e12(spark, sf_dir):
    return metrics.row_normalised(metrics.confusion_matrix(cells(spark, sf_dir), K)).select("model", "y_true", "y_pred", "n", *R6("share"))


def split_predictions(spark, sf_dir):
    s = splits.group_split(v.orders(spark, sf_dir)).select("item_id", "split")
    return v.predictions(spark, sf_dir).join(s, "item_id")


SPLIT_PRED = f"{v.PREDICTIONS}, {v.split_sql('ord')}, sp AS (SELECT p.*, split FROM predictions p JOIN split_items s ON p.item_id = s.item_id)"


#: to be formatted with the number of decimals
STAGES_SQL = (f"""WITH {SPLIT_PRED}, cells AS (SELECT split AS stage, y_true, y_pred, count(*) AS n FROM sp WHERE model = 'A' GROUP BY 1, 2, 3), {per_class_sql(by='stage')},
al AS (SELECT stage, label, precision, recall, f1 FROM pc UNION ALL SELECT stage, NULL, avg(precision), avg(recall), avg(f1) FROM pc GROUP BY stage)""".replace("{", "{{").replace("}", "}}")
+ f" SELECT label, {', '.join(f'round(max({m}) FILTER (stage = {chr(39)}{s}{chr(39)}), {{0}}) AS {s}_{m}' for s in ('train', 'val', 'test') for m in ('precision', 'recall', 'f1'))} FROM al GROUP BY label")


def stage_table(spark, sf_dir):
    c = metrics.cells(split_predictions(spark, sf_dir).filter("model = 'A'").withColumn("stage", F.col("split")), ("stage",))
    return metrics.metrics_table(c, K, ["train", "val", "test"])


@query("e13_metrics_table", STAGES_SQL.format(6))
def e13(spark, sf_dir):
    out = stage_table(spark, sf_dir)
    return out.select("label", *R6(*[c for c in out.columns if c != "label"]))


@query("e14_cv_stability", f"""WITH {SPLIT_PRED}, rk AS (SELECT item_id, (row_number() OVER (PARTITION BY class ORDER BY md5('42|' || item_id), item_id) - 1) % 5 AS fold FROM ord),
cells AS (SELECT fold::VARCHAR AS fold, y_true, y_pred, count(*) AS n FROM sp JOIN rk ON sp.item_id = rk.item_id WHERE model = 'A' AND split <> 'test' GROUP BY 1, 2, 3 UNION ALL SELECT 'test', y_true, y_pred, count(*) FROM sp WHERE model = 'A' AND split = 'test' GROUP BY 1, 2, 3), {per_class_sql(by='fold')},
lg AS (SELECT fold, label, metric, value FROM (SELECT fold, label, precision, recall, f1 FROM pc) UNPIVOT (value FOR metric IN (precision, recall, f1))),
al AS (SELECT * FROM lg UNION ALL SELECT fold, NULL, metric, avg(value) FROM lg GROUP BY fold, metric),
s AS (SELECT label, metric, avg(value) FILTER (fold <> 'test') AS mean, stddev_pop(value) FILTER (fold <> 'test') AS std, min(value) FILTER (fold <> 'test') AS least, max(value) FILTER (fold <> 'test') AS most, max(value) FILTER (fold = 'test') AS test FROM al GROUP BY label, metric),
z AS (SELECT *, CASE WHEN std >= 1e-9 THEN (test - mean) / std END AS sigma FROM s)
SELECT label, metric, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most, round(test, 6) AS test, round(sigma, 6) AS sigma, CASE WHEN sigma IS NULL THEN 'skipped' WHEN abs(sigma) >= 1.5 THEN 'structural mismatch' WHEN abs(sigma) >= 1 THEN 'borderline' ELSE 'within bounds' END AS verdict FROM z""")
def e14(spark, sf_dir):
    folds = splits.stratified_kfold(v.orders(spark, sf_dir), "item_id").select("item_id", "fold")
    rows = split_predictions(spark, sf_dir).filter("model = 'A'").join(folds, "item_id")
    f = metrics.per_class(metrics.cells(rows.filter("split <> 'test'"), ("fold",)), K, ("fold",))
    t = metrics.per_class(metrics.cells(rows.filter("split = 'test'")), K)
    return metrics.cv_stability(f, t).select("label", "metric", "verdict", *R6("mean", "std", "least", "most", "test", "sigma"))


def _split_macro(spark, sf_dir):
    return metrics.headline(metrics.cells(split_predictions(spark, sf_dir), ("model", "split")), K, ("model", "split"))


def _gap_sql(a: str, b: str) -> str:
    return f"""WITH {SPLIT_PRED}, c0 AS (SELECT model, split, y_true, y_pred, count(*) AS n FROM sp GROUP BY 1, 2, 3, 4), l AS (SELECT DISTINCT model, split, CAST(x AS INTEGER) AS label FROM c0, range({K}) t(x)),
f AS (SELECT l.model, l.split, label, 2 * coalesce(sum(n) FILTER (y_true = label AND y_pred = label), 0) / nullif(coalesce(sum(n) FILTER (y_true = label), 0) + coalesce(sum(n) FILTER (y_pred = label), 0), 0) AS f1 FROM l JOIN c0 ON c0.model = l.model AND c0.split = l.split GROUP BY 1, 2, 3),
m AS (SELECT model, split, avg(f1) AS v FROM f GROUP BY 1, 2) SELECT model, round(max(v) FILTER (split = '{a}'), 6) AS {a}, round(max(v) FILTER (split = '{b}'), 6) AS {b}, round(max(v) FILTER (split = '{a}') - max(v) FILTER (split = '{b}'), 6) AS gap FROM m GROUP BY 1"""


@query("e15_clean_vs_leaky_gap", _gap_sql("train", "test"))
def e15(spark, sf_dir):
    return metrics.gap(_split_macro(spark, sf_dir), "model", "split", "train", "test", "macro_f1").select("model", *R6("train", "test", "gap"))


@query("e17_error_count", f"WITH {v.PREDICTIONS}, e AS (SELECT model, count(*) FILTER (y_true <> y_pred) AS errors, count(*) AS n FROM predictions GROUP BY 1) SELECT *, CAST(round_even((1 - (1 - errors / n)) * n, 0) AS BIGINT) AS from_accuracy FROM e")
def e17(spark, sf_dir):
    return metrics.error_counts(v.predictions(spark, sf_dir))


@query("e21_confidence_by_outcome", f"WITH {v.PREDICTIONS} SELECT model, y_true = y_pred AS correct, count(*) AS n, round(avg(y_prob[y_pred + 1]), 6) AS mean, round(median(y_prob[y_pred + 1]), 6) AS median FROM predictions GROUP BY 1, 2")
def e21(spark, sf_dir):
    return metrics.confidence_by_outcome(v.predictions(spark, sf_dir)).select("model", "correct", "n", *R6("mean", "median"))


@query("e22_true_class_rank", f"""WITH {v.PREDICTIONS}, r AS (SELECT model, CAST(1 + {' + '.join(f'(CASE WHEN y_prob[{k + 1}] > y_prob[y_true + 1] OR (y_prob[{k + 1}] = y_prob[y_true + 1] AND {k} < y_true) THEN 1 ELSE 0 END)' for k in range(K))} AS INTEGER) AS rank FROM predictions),
c AS (SELECT model, rank, count(*) AS n FROM r GROUP BY 1, 2) SELECT model, rank, n, round(sum(n) OVER (PARTITION BY model ORDER BY rank) / sum(n) OVER (PARTITION BY model), 6) AS top_accuracy FROM c""")
def e22(spark, sf_dir):
    return metrics.true_class_rank(v.predictions(spark, sf_dir)).select("model", "rank", "n", *R6("top_accuracy"))


@query("e23_coverage_buckets", f"WITH {v.PREDICTIONS}, p AS (SELECT item_id, string_agg(CASE WHEN y_true = y_pred THEN '1' ELSE '0' END, '' ORDER BY model) AS pattern FROM predictions GROUP BY 1) SELECT pattern, count(*) AS n FROM p GROUP BY 1")
def e23(spark, sf_dir):
    return paired.coverage(v.predictions(spark, sf_dir))


@query("e24_leaderboard", f"WITH {CELLS}, {per_class_sql()}, hd AS ({_HEAD}), o AS (SELECT model, f1 FROM pc WHERE label = 2) SELECT hd.model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(o.f1, 6) AS class_f1, CAST(dense_rank() OVER (ORDER BY macro_f1 DESC, accuracy DESC) AS INTEGER) AS rank FROM hd JOIN o ON o.model = hd.model")
def e24(spark, sf_dir):
    return metrics.leaderboard(cells(spark, sf_dir), K, 2).select("model", "rank", *R6("accuracy", "macro_f1", "class_f1"))


@query("e25_direction_tally", f"WITH {CELLS} SELECT model, coalesce(sum(n) FILTER (y_true = 1 AND y_pred = 3), 0)::BIGINT AS errors FROM cells GROUP BY 1")
def e25(spark, sf_dir):
    return metrics.direction_tally(cells(spark, sf_dir), 1, 3)
