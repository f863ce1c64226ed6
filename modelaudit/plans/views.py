"""The tables that queries work on, as Spark views of the given tables and as SQL of the same."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.functions.items import group_id, hash01
from modelaudit.operators.splits import group_split

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MODELS = (("A", 0.85), ("B", 0.7), ("C", 0.4))
K = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors: item_id, class, class_idx, name, grp, features (doubles)."""
    t = read(spark, sf_dir, "embeddings")
    klass = F.concat(F.lit("c"), F.col("label").cast("string"))
    return t.select(F.col("vec_id").alias("item_id"), klass.alias("class"), F.col("label").alias("class_idx"), F.concat(klass, F.lit("- ("), F.col("vec_id").cast("string"), F.lit(").jpg")).alias("name"), group_id(klass, F.col("vec_id"), 10).alias("grp"), F.col("embedding").cast("array<double>").alias("features"))


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: item_id, class (lang), grp, hash (md5 of the text)."""
    t = read(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("class"), group_id(F.col("lang"), F.col("doc_id")).alias("grp"), F.md5("text").alias("hash"), F.length("text").alias("n_chars"))


def doc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_split(doc_items(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "orders")
    return t.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("class"), group_id(F.col("o_orderpriority"), F.col("o_orderkey")).alias("grp"), F.col("o_totalprice").alias("price"))


def predictions(spark: SparkSession, sf_dir: str, names: Sequence[str] = tuple(m for m, _ in MODELS)) -> DataFrame:
    """Scores of three models (or those of ``names``) on orders: model, item_id, y_true, y_pred, y_prob (array of 5), from hashes. Rows of
    an item stand together. Hashes are plain columns, which Spark compiles; shares and classes are made in Arrow batches, which no filter
    goes through, so a reader takes the hashes of a row once."""
    base = orders(spark, sf_dir).select("item_id", (F.substring("class", 1, 1).cast("int") - 1).alias("y_true"))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(b).alias("boost")) for m, b in MODELS if m in names])).alias("m")
    rows = base.select("item_id", "y_true", models).select("item_id", "y_true", "m.*")
    raw = [hash01(F.concat_ws("|", "model", F.col("item_id").cast("string"), F.lit(str(k)))) + F.when(F.col("y_true") == k, F.col("boost")).otherwise(F.lit(0.0)) for k in range(K)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = np.stack([batch[f"r{k}"].to_numpy(zero_copy_only=False) for k in range(K)], axis=1)
            total = shares[:, 0].copy()
            for k in range(1, K):  # in the order of SQL's sum
                total += shares[:, k]
            shares = shares / total[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, K * len(shares) + 1, K, dtype=np.int32)), pa.array(shares.ravel()))
            given = [batch[c] for c in ("model", "item_id", "y_true")]
            yield pa.RecordBatch.from_arrays([*given, pa.array(shares.argmax(axis=1).astype(np.int32)), lists], ["model", "item_id", "y_true", "y_pred", "y_prob"])

    kind = base.schema["item_id"].dataType.simpleString()
    return rows.select("model", "item_id", "y_true", *[r.alias(f"r{k}") for k, r in enumerate(raw)]).mapInArrow(run, f"model string, item_id {kind}, y_true int, y_pred int, y_prob array<double>")


H01 = "(CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def h01(text: str) -> str:
    return H01.format(text)


def erfc_sql(z: str) -> str:
    """erfc by Simpson's rule on exp(-z^2) * integral of exp(-u^2 - 2uz) from 0 to 12, for z of either sign."""
    tail = f"(2 / sqrt(pi()) * exp(-abs({z}) * abs({z})) / 600 * list_sum(list_transform(range(0, 2401), lambda i: (CASE WHEN i IN (0, 2400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(i / 200.0::DOUBLE) * (i / 200.0::DOUBLE) - (i / 100.0::DOUBLE) * abs({z})))))"
    return f"(CASE WHEN {z} < 0 THEN 2 - {tail} ELSE {tail} END)"


def mcnemar_sql(a: str, b: str) -> str:
    """p of McNemar's test: binomial below 25 discordant items, else chi-square with continuity correction."""
    exact = f"least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least({a}, {b}) + 1), lambda i: CAST(factorial(CAST(least({a} + {b}, 25) AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(least(i, 25) AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(greatest(least({a} + {b}, 25) - i, 0) AS INTEGER)) AS DOUBLE))) / power(2.0::DOUBLE, {a} + {b}))"
    return f"(CASE WHEN {a} + {b} < 25 THEN {exact} ELSE {erfc_sql(f'(abs(abs({a} - {b}) - 1) / sqrt(2.0::DOUBLE * greatest({a} + {b}, 1)))')} END)"


SPLIT_RULE = "CASE WHEN r <= ceil(round(n * 0.15, 9)) THEN 'test' WHEN r <= ceil(round(n * 0.15, 9)) + ceil(round((n - ceil(round(n * 0.15, 9))) * (0.15 / 0.85), 9)) THEN 'val' ELSE 'train' END"


def split_sql(source: str) -> str:
    """CTEs ``split_items``: the columns of ``source`` and split."""
    return f"""sg AS (SELECT DISTINCT class, grp FROM {source}),
sr AS (SELECT class, grp, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || grp), grp) AS r, count(*) OVER (PARTITION BY class) AS n FROM sg),
split_items AS (SELECT i.*, {SPLIT_RULE} AS split FROM {source} i JOIN sr ON i.class = sr.class AND i.grp = sr.grp)"""


ITEMS = "items AS (SELECT vec_id AS item_id, 'c' || label AS class, label AS class_idx, 'c' || label || '- (' || vec_id || ').jpg' AS name, 'c' || label || '_' || CAST(floor(vec_id / 10) AS BIGINT) AS grp, CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"
DOC_ITEMS = "doc_items AS (SELECT doc_id AS item_id, lang AS class, lang || '_' || CAST(floor(doc_id / 50) AS BIGINT) AS grp, md5(text) AS hash, length(text) AS n_chars FROM documents)"
ORDERS = "ord AS (SELECT o_orderkey AS item_id, o_orderpriority AS class, o_orderpriority || '_' || CAST(floor(o_orderkey / 50) AS BIGINT) AS grp, o_totalprice AS price FROM orders)"
DOC_SPLIT = f"{DOC_ITEMS}, {split_sql('doc_items')}"
_raw = ", ".join(f"{h01(f'''model || '|' || item_id || '|{k}' ''')} + CASE WHEN y_true = {k} THEN boost ELSE 0.0 END AS r{k}" for k in range(K))
PREDICTIONS = f"""{ORDERS},
models AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {b}::DOUBLE)" for m, b in MODELS)}) t(model, boost)),
raw AS (SELECT model, item_id, y_true, {_raw} FROM (SELECT item_id, CAST(substr(class, 1, 1) AS INTEGER) - 1 AS y_true FROM ord), models),
prob AS (SELECT model, item_id, y_true, [{', '.join(f'r{k} / (r0 + r1 + r2 + r3 + r4)' for k in range(K))}] AS y_prob FROM raw),
predictions AS (SELECT model, item_id, y_true, CAST(list_position(y_prob, list_max(y_prob)) - 1 AS INTEGER) AS y_pred, y_prob FROM prob)"""
