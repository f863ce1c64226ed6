"""Queries on splits, subsets, weights and key leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelaudit.functions import items as fn
from modelaudit.operators import leakage, splits
from modelaudit.plans import views as v
from modelaudit.plans.catalog import query

R6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


@query("p1_item_number", f"WITH {v.ITEMS} SELECT item_id, CAST(regexp_extract(name, '\\((\\d+)\\)', 1) AS BIGINT) AS number, class || '_' || CAST(floor(CAST(regexp_extract(name, '\\((\\d+)\\)', 1) AS BIGINT) / 50) AS BIGINT) AS grp50 FROM items")
def p1(spark, sf_dir):
    n = fn.item_number(F.col("name"))
    return v.items(spark, sf_dir).select("item_id", n.alias("number"), fn.group_id(F.col("class"), n).alias("grp50"))


@query("p3_class_index", f"WITH {v.ORDERS} SELECT item_id, CAST(list_position({list(v.PRIORITIES)}, class) - 1 AS INTEGER) AS class_idx FROM ord")
def p3(spark, sf_dir):
    return v.orders(spark, sf_dir).select("item_id", fn.class_index(F.col("class"), v.PRIORITIES).alias("class_idx"))


@query("p8_content_hash", "SELECT doc_id AS item_id, md5(text) AS hash FROM documents")
def p8(spark, sf_dir):
    return v.doc_items(spark, sf_dir).select("item_id", "hash")


_STAT = "round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(CASE WHEN var_pop(value) > 0 THEN m3 / power(var_pop(value), 1.5) END, 6) AS skew, round(CASE WHEN var_pop(value) > 0 THEN m4 / power(var_pop(value), 2) - 3 END, 6) AS kurtosis"


@query("p10_fingerprint", """
WITH m AS (SELECT user_id, avg(value) AS mu FROM events GROUP BY 1),
hb AS (SELECT user_id, least(floor(value), 255) AS at, count(*) AS n FROM events WHERE value BETWEEN 0 AND 256 GROUP BY 1, 2),
hp AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM hb),
en AS (SELECT m.user_id, round(coalesce(-sum(p * log2(p)), 0), 6) AS entropy FROM m LEFT JOIN hp ON m.user_id = hp.user_id GROUP BY 1)
SELECT e.user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(CASE WHEN var_pop(value) > 0 THEN avg(power(value - mu, 3)) / power(var_pop(value), 1.5) END, 6) AS skew,
  round(CASE WHEN var_pop(value) > 0 THEN avg(power(value - mu, 4)) / power(var_pop(value), 2) - 3 END, 6) AS kurtosis,
  any_value(entropy) AS entropy, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90
FROM events e JOIN m ON e.user_id = m.user_id JOIN en ON e.user_id = en.user_id GROUP BY e.user_id""")
def p10(spark, sf_dir):
    return leakage.fingerprints(v.read(spark, sf_dir, "events").withColumn("value", F.col("value").cast("double")), ["user_id"], "value")


@query("t1_group_split", f"WITH {v.DOC_SPLIT} SELECT item_id, class, grp, split FROM split_items")
def t1(spark, sf_dir):
    return v.doc_split(spark, sf_dir).select("item_id", "class", "grp", "split")


_RANKED = f"{v.ORDERS}, rk AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || item_id), item_id) AS r, count(*) OVER (PARTITION BY class) AS n FROM ord)"


@query("t2_stratified_split", f"WITH {_RANKED} SELECT item_id, class, {v.SPLIT_RULE} AS split FROM rk")
def t2(spark, sf_dir):
    return splits.stratified_split(v.orders(spark, sf_dir), "item_id").select("item_id", "class", "split")


@query("t3_stratified_fraction", f"WITH {_RANKED} SELECT item_id, class FROM rk WHERE r <= greatest(round_even(n * 0.25, 0), 1)")
def t3(spark, sf_dir):
    return splits.stratified_fraction(v.orders(spark, sf_dir), 0.25, "item_id").select("item_id", "class")


@query("t4_split_crosstab", f"""WITH {v.DOC_SPLIT}, c AS (SELECT class, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM split_items GROUP BY class)
SELECT * FROM c UNION ALL SELECT 'total', sum(train)::BIGINT, sum(val)::BIGINT, sum(test)::BIGINT, sum(total)::BIGINT FROM c""")
def t4(spark, sf_dir):
    return splits.split_crosstab(v.doc_split(spark, sf_dir))


@query("t5_stratified_kfold", f"WITH {_RANKED} SELECT item_id, class, CAST((r - 1) % 5 AS INTEGER) AS fold FROM rk")
def t5(spark, sf_dir):
    return splits.stratified_kfold(v.orders(spark, sf_dir), "item_id").select("item_id", "class", "fold")


@query("t6_group_kfold", f"""WITH {v.ORDERS}, g AS (SELECT class, grp, count(*) AS c FROM ord GROUP BY 1, 2),
a AS (SELECT class, grp, row_number() OVER (PARTITION BY class ORDER BY c DESC, md5('42|' || grp), grp) - 1 AS pos FROM g)
SELECT o.item_id, o.class, o.grp, CAST(CASE WHEN CAST(floor(pos / 5) AS BIGINT) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold FROM ord o JOIN a ON o.class = a.class AND o.grp = a.grp""")
def t6(spark, sf_dir):
    return splits.stratified_group_kfold(v.orders(spark, sf_dir)).select("item_id", "class", "grp", "fold")


@query("t7_head_sample", f"WITH {v.ORDERS} SELECT item_id, class FROM ord ORDER BY item_id LIMIT 64")
def t7(spark, sf_dir):
    return splits.head_sample(v.orders(spark, sf_dir).select("item_id", "class"), "item_id", 64)


@query("t8_class_weights", f"""WITH {v.ORDERS}, c AS (SELECT class, count(*) AS n FROM ord GROUP BY 1), t AS (SELECT sum(n) AS a, count(*) AS k, sum(1.0::DOUBLE / n) AS i FROM c)
SELECT class, n, round(a / (k * n), 6) AS balanced, round(k / n / i, 6) AS inverse FROM c, t""")
def t8(spark, sf_dir):
    return splits.class_weights(v.orders(spark, sf_dir)).select("class", "n", *R6("balanced", "inverse"))


@query("t10_dummy_predictions", f"""WITH {v.ORDERS}, o AS (SELECT item_id, CAST(substr(class, 1, 1) AS INTEGER) - 1 AS y_true FROM ord), m AS (SELECT y_true AS majority FROM o GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT item_id, y_true, majority, CAST(floor({v.h01("'42|' || item_id")} * 5) AS INTEGER) AS uniform FROM o, m""")
def t10(spark, sf_dir):
    rows = v.orders(spark, sf_dir).select("item_id", (F.substring("class", 1, 1).cast("int") - 1).alias("y_true"))
    return splits.dummy_predictions(rows, rows, "item_id", v.K).select("item_id", "y_true", "majority", "uniform")


_POOL = f"""{v.ITEMS}, {v.split_sql('items')}, tr AS (SELECT class, item_id AS train_key, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || item_id), item_id) - 1 AS at, count(*) OVER (PARTITION BY class) AS n FROM split_items WHERE split = 'train'),
sz AS (SELECT DISTINCT class, n FROM tr WHERE n >= 5), dr AS (SELECT t.item_id, t.class, n, trial FROM split_items t JOIN sz ON t.class = sz.class, range(5) r(trial) WHERE split = 'test'),
st AS (SELECT *, CAST(floor({v.h01("'start|' || item_id || '|' || trial")} * n) AS BIGINT) AS s0, CAST(floor({v.h01("'stride|' || item_id || '|' || trial")} * floor((n - 1) / 4)) AS BIGINT) + 1 AS sd FROM dr),
pool AS (SELECT st.item_id, st.class, CAST(trial AS INTEGER) AS trial, train_key FROM st, range(5) q(i) JOIN tr ON tr.class = st.class AND tr.at = (s0 + i * sd) % st.n)"""


@query("t11_random_pool", f"WITH {_POOL} SELECT * FROM pool")
def t11(spark, sf_dir):
    s = splits.group_split(v.items(spark, sf_dir))
    return splits.random_pool(s.filter("split = 'test'"), s.filter("split = 'train'"), "item_id")


_LEAK = """, per AS (SELECT hash, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM {src} WHERE hash IS NOT NULL GROUP BY hash),
u AS (SELECT 'train' AS split_a, 'val' AS split_b, train AS a, val AS b FROM per UNION ALL SELECT 'train', 'test', train, test FROM per UNION ALL SELECT 'val', 'test', val, test FROM per)"""
_PAIRS = "SELECT split_a, split_b, sum(a * b)::BIGINT AS pairs, sum(CASE WHEN a > 0 THEN b ELSE 0 END)::BIGINT AS b_items FROM u GROUP BY 1, 2"


@query("j1_hash_leak_pairs", f"WITH {v.DOC_SPLIT}{_LEAK.format(src='split_items')} {_PAIRS}")
def j1(spark, sf_dir):
    return leakage.hash_leak_pairs(v.doc_split(spark, sf_dir))


@query("j1_leak_members", f"WITH {v.DOC_SPLIT}{_LEAK.format(src='split_items')}, sh AS (SELECT hash FROM per WHERE (train > 0)::INT + (val > 0)::INT + (test > 0)::INT > 1) SELECT s.hash, split, item_id, class FROM split_items s JOIN sh ON s.hash = sh.hash")
def j1_members(spark, sf_dir):
    return leakage.leak_members(v.doc_split(spark, sf_dir))


@query("j2_fingerprint_leak_pairs", f"""WITH {v.DOC_ITEMS}, {v.split_sql('doc_items')}, fp AS (SELECT split, md5(class || '|' || n_chars) AS hash FROM split_items){_LEAK.format(src='fp')} {_PAIRS}""")
def j2(spark, sf_dir):
    """Fingerprint of a document here: its language and length."""
    s = v.doc_split(spark, sf_dir).withColumn("hash", F.md5(F.concat_ws("|", "class", F.col("n_chars").cast("string"))))
    return leakage.hash_leak_pairs(s)


@query("j3_key_overlap", f"""WITH {v.DOC_SPLIT}{_LEAK.format(src='split_items')}, o AS (SELECT count(*) FILTER (train > 0 AND val > 0) AS train_val, count(*) FILTER (train > 0 AND test > 0) AS train_test, count(*) FILTER (val > 0 AND test > 0) AS val_test FROM per)
SELECT *, train_val + train_test + val_test = 0 AS integrity_ok FROM o""")
def j3(spark, sf_dir):
    return leakage.key_overlap(v.doc_split(spark, sf_dir))


@query("j4_vector_overlap", f"""WITH {v.ITEMS}, {v.split_sql('items')}, fp AS (SELECT split, features AS hash FROM split_items){_LEAK.format(src='fp')}, o AS (SELECT count(*) FILTER (train > 0 AND val > 0) AS train_val, count(*) FILTER (train > 0 AND test > 0) AS train_test, count(*) FILTER (val > 0 AND test > 0) AS val_test FROM per)
SELECT *, train_val + train_test + val_test = 0 AS integrity_ok FROM o""")
def j4(spark, sf_dir):
    s = splits.group_split(v.items(spark, sf_dir)).withColumn("hash", fn.vector_key(F.col("features")))
    return leakage.key_overlap(s)


@query("j5_rounded_value_overlap", f"""WITH {v.ITEMS}, {v.split_sql('items')}, fp AS (SELECT split, round(features[1], 2) AS hash FROM split_items){_LEAK.format(src='fp')}
SELECT count(*) FILTER (train > 0) AS n_train, count(*) FILTER (val > 0) AS n_val, count(*) FILTER (test > 0) AS n_test, count(*) FILTER (train > 0 AND val > 0) AS train_val, count(*) FILTER (train > 0 AND test > 0) AS train_test, count(*) FILTER (val > 0 AND test > 0) AS val_test FROM per""")
def j5(spark, sf_dir):
    s = splits.group_split(v.items(spark, sf_dir)).withColumn("v", F.get("features", F.lit(0)))
    return leakage.rounded_value_overlap(s, "v")


@query("j10_duplicate_impact", f"""WITH {v.DOC_SPLIT}, m AS (SELECT 'A' AS model UNION ALL SELECT 'B'), sc AS (SELECT model, hash, {v.h01("model || '|' || item_id")} < 0.8 AS correct FROM split_items, m WHERE split = 'test'), s AS (SELECT DISTINCT hash FROM split_items WHERE split = 'train')
SELECT model, s.hash IS NOT NULL AS has_copy, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM sc LEFT JOIN s ON sc.hash = s.hash GROUP BY 1, 2""")
def j10(spark, sf_dir):
    s = v.doc_split(spark, sf_dir)
    scored = s.filter("split = 'test'").select("item_id", "hash", F.explode(F.lit(["A", "B"])).alias("model"))
    scored = scored.withColumn("correct", fn.hash01(F.concat_ws("|", "model", F.col("item_id").cast("string"))) < 0.8)
    return leakage.duplicate_impact(scored, s.filter("split = 'train'")).withColumn("accuracy", F.round("accuracy", 6))


@query("j11_within_split_duplicates", f"WITH {v.DOC_SPLIT} SELECT split, hash, count(*) AS copies FROM split_items WHERE hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def j11(spark, sf_dir):
    return leakage.within_split_duplicates(v.doc_split(spark, sf_dir))


@query("j12_cross_split_groups", f"""WITH {v.DOC_SPLIT}{_LEAK.format(src='split_items')} SELECT count(*) FILTER ((train > 0)::INT + (val > 0)::INT + (test > 0)::INT > 1) AS groups, coalesce(sum(test) FILTER (train > 0), 0)::BIGINT AS test_in_train, coalesce(sum(test) FILTER (train > 0 OR val > 0), 0)::BIGINT AS test_in_train_or_val FROM per""")
def j12(spark, sf_dir):
    return leakage.cross_split_groups(v.doc_split(spark, sf_dir))


@query("j13_dedup_exact", f"WITH {v.DOC_ITEMS} SELECT item_id, class, hash FROM doc_items WHERE item_id IN (SELECT min(item_id) FROM doc_items GROUP BY hash)")
def j13(spark, sf_dir):
    return leakage.dedup_exact(v.doc_items(spark, sf_dir)).select("item_id", "class", "hash")


@query("j16_pool_splits", f"WITH {v.DOC_SPLIT} SELECT item_id, class, split FROM split_items WHERE split IN ('train', 'val')")
def j16(spark, sf_dir):
    s = v.doc_split(spark, sf_dir).select("item_id", "class", "split")
    return leakage.pool_splits(s.filter("split = 'train'"), s.filter("split = 'val'"))


@query("k5_capped_examples", f"""WITH {v.DOC_SPLIT}, per AS (SELECT hash, min(item_id) FILTER (split = 'train') AS train, min(item_id) FILTER (split = 'val') AS val, min(item_id) FILTER (split = 'test') AS test FROM split_items WHERE hash IS NOT NULL GROUP BY hash),
u AS (SELECT hash, 'train' AS split_a, 'val' AS split_b, train AS a_id, val AS b_id FROM per UNION ALL SELECT hash, 'train', 'test', train, test FROM per UNION ALL SELECT hash, 'val', 'test', val, test FROM per),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY split_a, split_b ORDER BY a_id, b_id) AS INTEGER) AS rank FROM u WHERE a_id IS NOT NULL AND b_id IS NOT NULL) SELECT * FROM r WHERE rank <= 20""")
def k5(spark, sf_dir):
    return leakage.leak_examples(v.doc_split(spark, sf_dir))
