"""Hard negatives for anchors of labelled vectors, by a vertical scan with branch and bound.

For each anchor its positives are the best rows of the same label by inner product; for each positive, the negatives are the
best rows of other labels whose score lies in a window below the positive's: at most that score, at least ``low`` percent of it.

Rows meet in tiles: the anchors are dealt into groups of about ``GROUP``, the candidates into lanes of about ``LANE`` rows (of less,
down to ``LEAST_LANE``, while lanes are fewer than cores), and each tile, a group with a lane, is a key of its own. A task holds one group and streams the lane's rows, batch by batch, as
columns of dimensions. For an anchor it reads columns in descending order of the anchor's magnitude there. After each few columns,
the least and most that the remaining ones can still add (from each column's minimum and maximum in the batch) bound every
candidate's score from both sides, and the bitmap keeps candidates that may still be among the best: above the k-th best score so
far, or inside a window and not below its k-th best. What is left when all columns are read has exact scores.
Candidates are sent once for each group of anchors, anchors once for each lane, and a label with most rows is many lanes.

Scores are exact integers. Where a product of integers might not fit a double's 53 bits, a tile is computed with Python's
integers instead, without the scan.

Defined cases: rows with a null label, a null id, or a vector that is null, empty or holds a null or non-finite component take no
part. Vectors of different length don't meet. A row never meets rows of its own id; rows that repeat an id are candidates each for
itself, and as anchors each has results of its own, which may be equal. Ties go to the smaller id. Negative positives' scores have
empty windows; a score of 0 has the window 0. A returned score beyond 64 bits is an error. A batch of long vectors is held as
Arrow sends it. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.llm.storage import materialize

K, LOW, SCALE = 5, 80, 256.0
GROUP, LANE, LEAST_LANE = 4096, 65_536, 4096
STEPS = (4, 8, 16, 32)  # columns read when bounds are taken, and again at each doubling
KEYS = ("dim", "part", "grp", "lane")


def _integers(cells: pa.Array, dim: int, scale: float) -> np.ndarray:
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(flat * scale).reshape(-1, dim)


class _Columns:
    """A batch of candidates as columns, with each column's range."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(rows.T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)
        self.size = float(np.abs(self.columns).max(initial=0))


def _scan(anchor: np.ndarray, batch: _Columns, alive: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Places and exact scores of the candidates that ``wanted(lowest, highest)`` keeps, whole columns at a time."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = anchor[order]
    ends = np.stack([weights * batch.least[order], weights * batch.most[order]])
    rest = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0.0)
    under, over = rest(ends.min(axis=0)), rest(ends.max(axis=0))  # what columns from the j-th on add at least and at most
    at, score, done = alive, np.zeros(len(alive)), 0
    steps = [s for s in STEPS if s < len(order)]
    while steps and steps[-1] * 2 < len(order):
        steps.append(steps[-1] * 2)
    for step in [*steps, len(order)]:
        if len(at):
            block = batch.columns[order[done:step]]
            score = score + weights[done:step] @ (block if len(at) == len(batch.ids) else block[:, at])
            keep = wanted(score + under[step], score + over[step])
            at, score, done = at[keep], score[keep], step
    return at, score


def _exact(anchor: np.ndarray, batch: _Columns, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores with Python's integers, of any size."""
    whole = [int(x) for x in anchor]
    scores = np.empty(len(alive), object)
    scores[:] = [sum(w * int(x) for w, x in zip(whole, batch.columns[:, i], strict=True)) for i in alive]
    return alive, scores


def _merge(best: tuple, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple:
    ids, scores = np.concatenate([best[0], ids]), np.concatenate([best[1], scores])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class _Anchor:
    """An anchor with the best candidates so far of each window (highest score allowed, lowest score allowed)."""

    def __init__(self, row: int, id: int, label: int, vector: np.ndarray, windows: Sequence[tuple[float, float]], same: bool, k: int) -> None:
        self.row, self.id, self.label, self.vector, self.same, self.k = row, id, label, vector, same, k
        self.tops, self.floors = [w[0] for w in windows], [w[1] for w in windows]
        self.best = [(np.empty(0, np.int64), np.empty(0)) for _ in windows]

    def wanted(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), bool)
        for top, floor in zip(self.tops, self.floors, strict=True):
            keep |= (low <= top) & (high >= floor)
        return keep

    def meet(self, batch: _Columns) -> None:
        alive = np.flatnonzero((batch.ids != self.id) & ((batch.labels == self.label) == self.same))
        if not len(alive):
            return
        exact = batch.size * float(np.abs(self.vector).max(initial=0)) * len(self.vector) < 2.0**52
        at, scores = _scan(self.vector, batch, alive, self.wanted) if exact else _exact(self.vector, batch, alive)
        for i, (top, floor) in enumerate(zip(self.tops, self.floors, strict=True)):
            hit = np.flatnonzero((scores <= top) & (scores >= floor))
            if len(hit):
                self.best[i] = _merge(self.best[i], batch.ids[at[hit]], scores[hit], self.k)
                if len(self.best[i][0]) == self.k:
                    self.floors[i] = max(floor, self.best[i][1][-1])


def _whole(score) -> int:  # noqa: ANN001
    score = int(score)
    if not -(2**63) <= score < 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return score


def _tiles(anchors: DataFrame, candidates: DataFrame, group: int, lane: int) -> DataFrame:
    """Both sides as one table, in tiles: rows of a tile are neighbours, anchors first. Both have dim and part, which must be equal to
    meet. The numbers of groups and lanes follow from counts."""
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    wide = F.greatest(F.ceil(F.count("*") / lane), F.least(F.lit(cores), F.ceil(F.count("*") / min(lane, LEAST_LANE)))).cast("int")
    sizes = anchors.groupBy("dim", "part").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    sizes = sizes.join(candidates.groupBy("dim", "part").agg(wide.alias("lanes")), ["dim", "part"])  # what has no other side meets nothing
    deal = lambda name: F.pmod(F.xxhash64("row"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = anchors.join(sizes, ["dim", "part"]).withColumn("grp", deal("groups")).withColumn("lane", each("lanes")).withColumn("side", F.lit(0))
    right = candidates.withColumn("bounds", F.lit(None).cast("array<long>")).join(sizes, ["dim", "part"]).withColumn("lane", deal("lanes")).withColumn("grp", each("groups")).withColumn("side", F.lit(1))
    columns = [*KEYS, "side", "row", "id", "label", "vector", "bounds"]
    return left.select(columns).unionByName(right.select(columns)).repartition(*KEYS).sortWithinPartitions(*KEYS, "side")


def _search(tiles: DataFrame, same: bool, k: int, low: int, scale: float) -> DataFrame:
    """(row, bound, id, score): each anchor's best k in each window of every tile. Without bounds there is one window, of all scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors = None, []

        def found() -> Iterator[pa.RecordBatch]:
            rows = [(a.row, i, int(n), _whole(s)) for a in anchors for i, best in enumerate(a.best) for n, s in zip(*best, strict=True)]
            if rows:
                row, bound, id, score = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "bound": pa.array(bound, pa.int32()), "id": pa.array(id, pa.int64()), "score": pa.array(score, pa.int64())})

        for batch in batches:
            keys = np.stack([batch[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in (*KEYS, "side")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                tile, side = tuple(keys[:4, start]), keys[4, start]
                if tile != key:
                    yield from found()
                    key, anchors = tile, []
                ids, labels, vectors = part["id"].to_numpy(), part["label"].to_numpy(), _integers(part["vector"], int(tile[0]), scale)
                if side == 0:
                    tops = part["bounds"].to_pylist()
                    windows = [[(float("inf"), float("-inf"))] if b is None else [(t, -(-low * t // 100)) for t in b] for b in tops]
                    anchors += [_Anchor(*x, same, k) for x in zip(part["row"].to_pylist(), ids.tolist(), labels.tolist(), vectors, windows, strict=True)]
                elif anchors:
                    columns = _Columns(ids, labels, vectors)
                    for a in anchors:
                        a.meet(columns)
        yield from found()

    found = tiles.mapInArrow(run, "row long, bound int, id long, score long")
    order = Window.partitionBy("row", "bound").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, k: int = K, low: int = LOW, id: str = "vec_id", vector: str = "embedding", scale: float = SCALE, group: int = GROUP, lane: int = LANE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); components are floor(scale * x)."""
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label") if label is None else label
    rows = vectors.filter(F.col(id).isNotNull() & label.isNotNull() & sound)
    rows = rows.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"), F.size(vector).alias("dim"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "negative-vectors")
    candidates, anchors = rows.drop("is_anchor"), rows.filter("is_anchor").drop("is_anchor").withColumn("bounds", F.lit(None).cast("array<long>"))

    same = lambda t: t.withColumn("part", F.col("label"))
    positives = materialize(_search(_tiles(same(anchors), same(candidates), group, lane), True, k, low, scale).select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = positives.filter("positive_score >= 0").groupBy("row").agg(F.reverse(F.array_sort(F.collect_set("positive_score"))).alias("bounds"))  # k at most
    anchors = materialize(anchors.drop("bounds").join(bounds, "row"), "negative-anchors")
    whole = lambda t: t.withColumn("part", F.lit(0).cast("long"))
    found = _search(_tiles(whole(anchors), whole(candidates), group, lane), False, k, low, scale)
    named = anchors.select("row", F.col("id").alias("anchor_id"), F.posexplode("bounds").alias("bound", "positive_score"))
    wanted = positives.join(named, ["row", "positive_score"])
    out = wanted.join(found.select("row", "bound", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "bound"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.ints) + 1), lambda i: a.ints[i] * c.ints[i])) AS BIGINT) AS score
           FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM
        (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5
"""
