"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and its deviation (root of the sum of squared differences to the mean).
For a segment of width w, q.x <= w*mean_q*mean_x + dev_q*dev_x, so means and deviations bound the score from above (and
the distance from below). Segments go from coarse to fine, a pair of vectors is dropped as soon as its bound is below the
k-th best score found so far, and exact integer products are computed for the survivors alone.

Queries and candidates are packed into blocks of bounded size; each query block meets each candidate block of its
dimension once, through an equi-join on the candidate block's number. One task streams ``LANE`` candidate blocks for a query
block and keeps only the k-th best score per query. Best rows of each pair are cut to k per query by a window rank, which
Spark limits before its shuffle too. Scores are exact integers of any size inside tasks, and travel as two 64-bit halves.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an
id. Vectors of different length are never compared. Each row is a candidate of its own, but not for its own id; rows that
repeat an id rank together as queries. Ties in score go to the smaller id. A component that doesn't fit 64 bits once scaled,
or one of the best scores that doesn't, is an error that says so. Long vectors: a block holds ``block_rows`` of them. Other
columns are ignored; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.llm.storage import materialize

LEVELS, LANE, HALF = (4, 16, 32), 16, 62


def _matrix(cells: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in cells), dtype="<i8").reshape(-1, dim)


def pack_blocks(vectors: DataFrame, block_rows: int, name: str) -> DataFrame:
    """Rows (row, id, ints array<long>) as blocks (dim, block, ids binary, data binary), dealt by the hash of the row's number."""
    sizes = vectors.groupBy(F.size("ints").alias("dim")).count().select("dim", F.ceil(F.col("count") / block_rows).cast("int").alias("n_blocks"))
    dealt = vectors.withColumn("dim", F.size("ints")).join(sizes, "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ints = table["ints"].combine_chunks()
        flat = ints.flatten().to_numpy(zero_copy_only=False).astype("<i8")
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), f"{name}_block": pa.array([key[1].as_py()], pa.int32()), f"{name}_ids": [table["id"].to_numpy().astype("<i8").tobytes()], f"{name}_data": [flat.tobytes()]})

    return dealt.select("dim", "block", "id", "ints").groupBy("dim", "block").applyInArrow(pack, f"dim int, {name}_block int, {name}_ids binary, {name}_data binary")


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of each row's segments: the product of two such rows bounds the vectors' product."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    width = np.diff(np.append(cuts, x.shape[1]))
    total, square = np.add.reduceat(x, cuts, axis=1), np.add.reduceat(x * x, cuts, axis=1)
    return np.hstack([total / np.sqrt(width), np.sqrt(np.maximum(square - total * total / width, 0))])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _pair(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Best k candidates of one block for each query, those below ``floor`` (k-th best so far) left out; ``floor`` is raised."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**52
    if not exact:  # beyond what doubles hold exactly: products of Python integers
        q, c = q.astype(object), c.astype(object)
    fq, fc = q.astype(float), c.astype(float)
    slack = 1e-9 * (np.linalg.norm(fq, axis=1)[:, None] * np.linalg.norm(fc, axis=1).max(initial=0)) + 1e-6
    first = min(len(c), 256)  # a first slice, computed exactly, sets the k-th best score
    alive = np.ones((len(q), len(c)), dtype=bool)
    head = (fq @ fc[:first].T) if exact else (q @ c[:first].T).astype(float)
    head[q_ids[:, None] == c_ids[None, :first]] = -np.inf
    below = (lambda x: x) if exact else (lambda x: np.nextafter(x, -np.inf))  # a rounded score may lie above the true one
    if first >= k:
        np.maximum(floor, below(np.partition(head, first - k, axis=1)[:, first - k]), out=floor)
    for segments in LEVELS:
        if segments >= q.shape[1]:
            break
        alive &= segment_stats(fq, segments) @ segment_stats(fc, segments).T + slack >= floor[:, None]
        if not alive.any():
            return
    alive &= q_ids[:, None] != c_ids[None, :]
    for i in range(len(q)):
        at = np.flatnonzero(alive[i])
        if len(at):
            scores = c[at] @ q[i]
            keep = scores >= floor[i] if np.isfinite(floor[i]) else np.ones(len(at), bool)
            if keep.any():
                ids, best = _best(c_ids[at][keep], scores[keep], k)
                if len(best) == k:
                    floor[i] = max(floor[i], below(float(best[-1])))
                yield i, ids, best


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, query_rows: int = 512, block_rows: int = 4096) -> DataFrame:
    """For each row where ``is_query``: the ``k`` largest integer products with all other rows, as (query_id, rank, vec_id, score)."""
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * scale
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("long"))
    rows = vectors.filter(F.col(id).isNotNull() & sound).select(F.col(id).cast("long").alias("id"), F.transform(vector, whole).alias("ints"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    queries, candidates = pack_blocks(rows.filter("is_query"), query_rows, "q"), pack_blocks(rows, block_rows, "c")
    counts = rows.groupBy(F.size("ints").alias("dim")).count().select("dim", F.ceil(F.col("count") / block_rows).cast("int").alias("n"))
    spread = queries.join(counts, "dim").withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    pairs = spread.join(candidates, ["dim", "c_block"]).withColumn("lane", F.floor(F.col("c_block") / LANE))
    pairs = pairs.repartition("dim", "q_block", "lane").sortWithinPartitions("dim", "q_block", "c_block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, floor = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                dim, block = row["dim"][0].as_py(), row["q_block"][0].as_py()
                q_ids, c_ids = (np.frombuffer(row[x][0].as_py(), "<i8") for x in ("q_ids", "c_ids"))
                if at != (dim, block):
                    at, floor = (dim, block), np.full(len(q_ids), -np.inf)
                found = list(_pair(q_ids, _matrix(row["q_data"], dim), c_ids, _matrix(row["c_data"], dim), floor, k))
                if found:
                    scores = [int(x) for _, _, s in found for x in s]
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.concatenate([np.full(len(i), q_ids[n]) for n, i, _ in found]), "vec_id": np.concatenate([i for _, i, _ in found]),
                        "high": pa.array([max(-(1 << HALF), min(x >> HALF, 1 << HALF)) for x in scores], pa.int64()), "low": pa.array([x & ((1 << HALF) - 1) for x in scores], pa.int64()),
                    })

    found = pairs.mapInArrow(search, "query_id long, vec_id long, high long, low long")
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    beyond = F.raise_error(F.concat(F.lit("the score of "), F.col("query_id").cast("string"), F.lit(" and "), F.col("vec_id").cast("string"), F.lit(" is beyond 64 bits"))).cast("long")
    return best.select("query_id", "rank", "vec_id", F.when(F.col("high").between(-2, 1), F.shiftleft(F.col("high"), HALF).bitwiseOR(F.col("low"))).otherwise(beyond).alias("score"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.ints) + 1), lambda i: q.ints[i] * c.ints[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
