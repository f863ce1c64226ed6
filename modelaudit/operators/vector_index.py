"""An exact index of vectors for cosine similarity: pivots, cells and rings, pruned by the triangle inequality.

Vectors are scaled to length one, where a larger cosine is a smaller distance. Up to ``PIVOTS`` rows, far from each other, are pivots;
a row belongs to the cell of its nearest pivot, and the rows of a cell, in the order of their distance to the pivot, to rings of
``RING`` rows. For a row x with distances d(x, p) to the pivots, and a ring of cell c between distances lo and hi, no member is nearer
than the largest of lo - d(x, c), d(x, c) - hi and (d(x, c) - d(x, own cell)) / 2. A row visits the rings that are not beyond its bound:
a fixed distance for near copies, the distance of the k-th best found so far for neighbours.

Only pivots reach the driver (``PIVOTS`` of them at most). Rings are written, with their rows' vectors. A row's visit to its own ring is a row
of a table, from which rows are dealt to tiles, so that a ring with many visitors is many tasks (``meet``). All other visits are a join without
a shuffle (``sweep``): visitors are written as blocks of rows that lie near each other, and a task reads ``VISITORS`` * 4 of them and
lets the rings pass by, of which it works on those that some row of a block visits. So what is shuffled and written grows with the rows,
also on vectors that lie in all directions alike, where nothing can be skipped, by any exact bound, and each row visits all rings.
Neighbours among rows of one's own group alone (a class) take the same join over rings of groups (``sweep_groups``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelaudit.functions.items import order_key
from modelaudit.functions.ranges import running_before
from modelaudit.sources.shared import materialize

PIVOTS, RING, VISITORS = 1024, 2048, 8192
SLACK = 1e-7  # on distances, above what rounding of similarities to nine decimals can do
ZERO = -1  # the cell of vectors without a direction, whose cosine with anything is 0
RINGS = ["n", "ids", "x", "cell", "lo", "hi"]  # columns of packed rings, and of pairs with blocks of visitors
PAIR = [*RINGS, "v_n", "v_ids", "v_x", "v_dist", "v_within"]


def matrix(cells: pa.Array) -> np.ndarray:
    """Unit vectors of an Arrow array of lists; a zero vector stays zero."""
    n = len(cells)
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(n, -1) if n else flat.reshape(0, 1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def distance(sim: np.ndarray) -> np.ndarray:
    """An upper bound on the distance of unit vectors whose cosine, rounded to nine decimals, is ``sim``."""
    return np.sqrt(np.maximum(2 - 2 * sim + 4e-9, 0)) + SLACK


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the farthest from those before."""
    chosen, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


class Index:
    """Rings of the rows of ``a`` (columns: key, features)."""

    def __init__(self, a: DataFrame, key: str = "item_id", ring: int = RING, pivots: int | None = None) -> None:
        self.key, spark = key, a.sparkSession
        rows = a.filter(F.col("features").isNotNull()).select(F.col(key).alias("id"), "features")
        n = rows.count()
        wanted = pivots or min(PIVOTS, max(1, -(-n // (ring // 4 or 1))))
        # a few times as many rows as pivots, by hash, from which those far apart are taken
        sample = [r["features"] for r in rows.orderBy(order_key(F.col("id")), "id").limit(4 * wanted).collect()]
        unit = matrix(pa.array(sample, pa.list_(pa.float64()))) if sample else np.zeros((1, 1))
        unit = unit[np.linalg.norm(unit, axis=1) > 0.5]
        self.points = _far_apart(unit, wanted) if len(unit) else np.zeros((0, 1))
        self.shared = spark.sparkContext.broadcast(self.points)
        cells = rows.join(self.places(rows), "id")
        ranked = running_before(cells, ["cell"], [F.col("dist"), F.col("id")], F.lit(1), "before")
        self.rows = materialize(ranked.withColumn("ring", F.floor(F.col("before") / ring).cast("int")).drop("before"), "index-rows")
        self.rings = materialize(self.rows.groupBy("cell", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")), "index-rings")

    def places(self, rows: DataFrame) -> DataFrame:
        """(id, cell, dist): each row's nearest pivot."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, dist = _nearest(*_against(batch, shared.value))
                yield pa.RecordBatch.from_pydict({"id": batch["id"], "cell": pa.array(cell, pa.int32()), "dist": dist})

        return rows.select("id", "features").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cell int, dist double")

    def visits(self, rows: DataFrame, bound: str | None, k: int = 0, own: bool = False) -> DataFrame:
        """(id, cell, ring) of the rings that rows (id, features, and the column ``bound``) have to visit; with ``own``, the ring of the
        own cell that the row's distance falls in alone. Without a bound, the distance of the k-th nearest pivot is one, as pivots
        are rows of the index."""
        shared = self.shared
        given = bound is not None
        columns = ["id", "features", *([bound] if given else [])]
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, d = _against(batch, shared.value)
                cell, dist = _nearest(x, d)
                within = batch[bound].to_numpy(zero_copy_only=False).astype(float) if given else np.full(len(x), np.inf)
                within[np.isnan(within)] = np.inf
                if k and 0 < k < d.shape[1]:
                    within = np.minimum(within, np.partition(d, k, axis=1)[:, k] + SLACK)  # one of them may be the row itself
                within[cell == ZERO] = np.inf
                if own:
                    i, c = np.arange(len(x)), np.maximum(cell, 0)
                    far = dist
                else:
                    near = (d - dist[:, None]) / 2 <= within[:, None]
                    near[cell == ZERO] = True
                    i, c = np.nonzero(near)
                    far = d[i, c]
                    lost = np.flatnonzero(within >= np.sqrt(2))  # similarities of 0 count: the zero vectors' cell
                    i, c, far = np.concatenate([i, lost]), np.concatenate([c, np.full(len(lost), ZERO)]), np.concatenate([far, np.zeros(len(lost))])
                taken = batch["id"].take(pa.array(i))
                yield pa.RecordBatch.from_pydict({"id": taken, "cell": pa.array(c.astype(np.int32)), "far": far, "within": np.where(c == ZERO, np.inf, within[i])})

        asked = rows.select(*columns).mapInArrow(run, f"id {kind}, cell int, far double, within double")
        rings = self.rings.hint("shuffle_hash")
        if own:  # the ring with the nearest bounds
            gap = F.greatest(F.col("lo") - F.col("far"), F.col("far") - F.col("hi"), F.lit(0.0))
            return asked.join(rings, "cell").groupBy("id", "cell").agg(F.min_by("ring", F.struct(gap, "ring")).alias("ring"))
        met = (F.col("lo") - F.col("far") <= F.col("within")) & (F.col("far") - F.col("hi") <= F.col("within"))
        return asked.join(rings, "cell").filter(met).select("id", "cell", "ring")

    def meet(self, rows: DataFrame, visits: DataFrame, kernel: Callable, schema: str) -> DataFrame:
        """``kernel(ids, vectors, ring_ids, ring_vectors)`` for visitors and ring, a batch of visitors at a time."""
        parts = visits.groupBy("cell", "ring").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
        left = visits.join(parts, ["cell", "ring"]).select("id", "cell", "ring", part).join(rows.select("id", "features"), "id").withColumn("side", F.lit(1))
        right = self.rows.join(parts, ["cell", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0))
        columns = ["cell", "ring", "part", "side", "id", "features"]
        tiles = right.select(columns).unionByName(left.select(columns)).repartition("cell", "ring", "part").sortWithinPartitions("cell", "ring", "part", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile, ids, vectors = None, [], []
            for batch in batches:
                keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "ring", "part", "side")])
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                    if start == end:
                        continue
                    part, at = batch.slice(start, end - start), tuple(keys[:3, start])
                    if at != tile:
                        tile, ids, vectors = at, [], []
                    if keys[3, start] == 0:
                        ids.append(part["id"].to_numpy(zero_copy_only=False)), vectors.append(matrix(part["features"]))
                        continue
                    if len(ids) > 1:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for i in range(0, part.num_rows, 1024):
                        some = part.slice(i, 1024)
                        yield from kernel(some["id"].to_numpy(zero_copy_only=False), matrix(some["features"]), ids[0], vectors[0])

        return tiles.mapInArrow(run, schema)


    def blocks(self, rows: DataFrame, bound: str, k: int = 0) -> DataFrame:
        """Visitors (id, features, and the column ``bound``) as blocks, with the least and the largest distance from each pivot (and, last, for
        vectors without a direction) that a ring some row visits may have. The bound is that of ``visits``."""
        shared = self.shared
        placed = rows.select("id", "features", F.col(bound).alias("within")).join(self.places(rows), "id")
        n = placed.count()
        dealt = placed.repartitionByRange(max(1, -(-n // (4 * VISITORS))), "cell", "dist", "id").sortWithinPartitions("cell", "dist", "id")

        def bounds(some: pa.RecordBatch, x: np.ndarray) -> dict:
            d = _distances(x, shared.value)
            cell, dist = some["cell"].to_numpy(zero_copy_only=False), some["dist"].to_numpy(zero_copy_only=False)
            within = some["within"].to_numpy(zero_copy_only=False).astype(float)
            within[np.isnan(within)] = np.inf
            if k and 0 < k < d.shape[1]:
                within = np.minimum(within, np.partition(d, k, axis=1)[:, k] + SLACK)  # one of them may be the row itself
            within[cell == ZERO] = np.inf
            least, most = _reach(d, dist, within)
            lost = bool((within >= np.sqrt(2)).any())  # similarities of 0 count: the zero vectors' cell
            return {"within": within.tobytes(), "least": [*least, -np.inf if lost else np.inf], "most": [*most, np.inf if lost else -np.inf]}

        return materialize(packed(dealt, [], bounds, "within binary, least array<double>, most array<double>"), "visitor-blocks")

    def sweep(self, rows: DataFrame, bound: str, kernel: Callable, schema: str, k: int = 0) -> DataFrame:
        """What ``kernel(tiles)`` yields in each task of the tiles (block, ids, vectors, bounds, places of the visiting rows, ring_ids, ring_vectors)
        of visitors and the rings that they visit by their bound. A task has some blocks, each by number, and sees all rings, or a share of
        them where there are few blocks."""
        shared, zero = self.shared, len(self.points)
        blocks = self.blocks(rows, bound, k)
        ends = lambda some, x: {"cell": some["cell"][0].as_py(), "lo": float(np.min(some["dist"])), "hi": float(np.max(some["dist"]))}
        dealt = self.rows.repartition("cell", "ring").sortWithinPartitions("cell", "ring", "dist")
        rings = materialize(packed(dealt, ["cell", "ring"], ends, "cell long, lo double, hi double"), "packed-rings")
        totals = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        place = (F.when(F.col("cell") == ZERO, F.lit(zero)).otherwise(F.col("cell")) + 1).cast("int")
        met = (F.col("lo") <= F.element_at("v_most", place)) & (F.col("hi") >= F.element_at("v_least", place))
        pairs = passing(rings, blocks.withColumnsRenamed({c: f"v_{c}" for c in blocks.columns}), met, totals)
        far = lambda x, cell, _: _distances(x, shared.value[cell : cell + 1])[:, 0]
        return pairs.select(*PAIR).mapInArrow(lambda batches: kernel(_tiles(batches, far)), schema)


def sweep_groups(rows: DataFrame, kernel: Callable, schema: str, k: int, ring: int = RING, pivots: int | None = None) -> DataFrame:
    """As ``Index.sweep``, for rows (id, grp, of, asks, features) that visit rings of their own group (a number) alone, which has ``of`` rows:
    those with ``asks``, bounded by the k-th best in the ring that they lie in. Groups of over ``ring`` rows have cells and pivots of their
    own, in all as many as an index has; smaller ones are one ring, which visits itself where it was packed. A vector without a
    direction counts as nearer than it is, and so is never passed over."""
    rows = materialize(rows, "grouped-rows")
    large = rows.filter(F.col("of") > ring)
    n, n_large = rows.count(), large.count()
    wanted = pivots or min(PIVOTS, max(1, -(-n_large // (ring // 4 or 1))))
    sample = large.select("id", "grp", "features").orderBy(order_key(F.col("id")), "id").limit(4 * wanted).collect()
    drawn: dict[int, list] = {}
    for r in sample:
        drawn.setdefault(r["grp"], []).append(r["features"])
    points = {}
    for grp, some in drawn.items():
        unit = matrix(pa.array(some, pa.list_(pa.float64())))
        unit = unit[np.linalg.norm(unit, axis=1) > 0.5]
        if len(unit):
            points[grp] = _far_apart(unit, -(-len(unit) // 4))
    shared = rows.sparkSession.sparkContext.broadcast(points)

    def against(x: np.ndarray, grp: int, some: slice = slice(None)) -> np.ndarray:
        """Distances to the group's pivots; without any, the group is one cell and nothing is ruled out."""
        return _distances(x, shared.value[grp][some]) if grp in shared.value else np.zeros((len(x), 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, grp = matrix(batch["features"]), batch["grp"].to_numpy(zero_copy_only=False)
            cell, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
            for g in set(np.unique(grp).tolist()) & shared.value.keys():
                at = np.flatnonzero(grp == g)
                d = against(x[at], g)
                cell[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], [*batch.schema.names, "cell", "dist"])

    def both(some: pa.RecordBatch, x: np.ndarray) -> dict:
        """The rows as a ring, and those that ask as a block of visitors."""
        ids, dist, asks = (some[c].to_numpy(zero_copy_only=False) for c in ("id", "dist", "asks"))
        grp, of, cell = (some[c][0].as_py() for c in ("grp", "of", "cell"))
        v, v_ids, v_dist, within = x[asks], ids[asks].astype(np.int64), dist[asks], np.full(int(asks.sum()), np.inf)
        if len(x) > k and len(v):
            sims = np.round(v @ x.T, 9)
            sims[v_ids[:, None] == ids[None, :]] = -np.inf
            within = distance(np.partition(sims, -k, axis=1)[:, -k])
            within[np.linalg.norm(v, axis=1) <= 0.5] = np.inf
        least, most = _reach(against(v, grp), v_dist, within)
        ring = {"grp": grp, "of": of, "cell": cell, "lo": float(dist.min()), "hi": float(dist.max())}
        return ring | {"v_n": len(v), "v_ids": v_ids.tobytes(), "v_x": v.tobytes(), "v_dist": v_dist.tobytes(), "v_within": within.tobytes(), "v_least": least, "v_most": most}

    order = ["grp", "cell", "dist", "id"]
    columns = ["id", "grp", "of", "asks", "features"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    placed = rows.select(*columns).mapInArrow(place, f"{kinds}, cell int, dist double")
    dealt = placed.repartitionByRange(max(1, -(-n // VISITORS)), *order).sortWithinPartitions(*order)
    block = "v_n long, v_ids binary, v_x binary, v_dist binary, v_within binary, v_least array<double>, v_most array<double>"
    rings = materialize(packed(dealt, ["grp", "cell"], both, f"grp long, of long, cell long, lo double, hi double, {block}"), "grouped-rings")
    whole, asked = F.col("n") == F.col("of"), F.col("v_n") > 0
    parts = rings.filter(~whole)
    visitors = parts.filter(asked).select(F.col("grp").alias("v_grp"), *[c.split()[0] for c in block.split(", ")])
    totals = visitors.agg(F.coalesce(F.sum("v_n"), F.lit(0))).first()[0]
    place_of = F.col("cell").cast("int")
    met = (F.col("grp") == F.col("v_grp")) & (F.col("lo") <= F.get("v_most", place_of)) & (F.col("hi") >= F.get("v_least", place_of))
    pairs = passing(parts.select("grp", *RINGS), visitors, met, totals).select("grp", *PAIR)
    far = lambda x, cell, grp: against(x, grp, slice(cell, cell + 1))[:, 0]
    return pairs.unionAll(rings.filter(whole & asked).select("grp", *PAIR)).mapInArrow(lambda batches: kernel(_tiles(batches, far)), schema)


def passing(rings: DataFrame, visitors: DataFrame, met: Column, totals: int) -> DataFrame:
    """Pairs of packed rings and blocks of visitors, ``totals`` rows in all, for which ``met`` holds: a join without a shuffle of pairs, where
    rings pass by and visitors are held."""
    shares = max(1, -(-totals // (4 * VISITORS)))
    cores = rings.sparkSession.sparkContext.defaultParallelism
    streams = -(-2 * cores // shares)
    stream = rings.coalesce(streams) if shares >= 2 * cores else rings.repartition(streams, "cell", "lo", "n")
    # the left side streams by, the right one is held
    return stream.join(visitors.coalesce(shares).hint("shuffle_replicate_nl"), met)


def _tiles(batches: Iterator[pa.RecordBatch], pivot: Callable) -> Iterator[tuple]:
    """Pairs of ``passing`` as what a kernel takes, where some row visits the ring; ``pivot(vectors, cell, group)`` is their distance to a cell's pivot."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            of = lambda c, r=r: np.frombuffer(batch[c][r].as_buffer())  # noqa: B023, E731
            whole = lambda c, r=r: np.frombuffer(batch[c][r].as_buffer(), np.int64)  # noqa: B023, E731
            cell, lo, hi, m = (batch[c][r].as_py() for c in ("cell", "lo", "hi", "v_n"))
            x, dist, within, ids = of("v_x").reshape(m, -1), of("v_dist"), of("v_within"), whole("v_ids")
            if cell == ZERO:
                at = np.flatnonzero(within >= np.sqrt(2))
            else:
                far = pivot(x, cell, batch["grp"][r].as_py() if "grp" in batch.schema.names else None)
                at = np.flatnonzero(((far - dist) / 2 <= within) & (lo - far <= within) & (far - hi <= within))
            if len(at):
                block = seen.setdefault(ids[:1].tobytes(), len(seen))
                yield block, ids, x, within, at, whole("ids"), of("x").reshape(batch["n"][r].as_py(), -1)


def _reach(d: np.ndarray, dist: np.ndarray, within: np.ndarray) -> tuple[list[float], list[float]]:
    """The least and the largest distance from each pivot that a ring which some visitor visits may have, from the visitors' distances to the
    pivots and to their own one, and their bounds."""
    near = (d - dist[:, None]) / 2 <= within[:, None]
    least = np.where(near, d - within[:, None], np.inf).min(axis=0, initial=np.inf)
    return least.tolist(), np.where(near, d + within[:, None], -np.inf).max(axis=0, initial=-np.inf).tolist()


def packed(rows: DataFrame, by: list[str], extra: Callable[[pa.RecordBatch, np.ndarray], dict], schema: str) -> DataFrame:
    """Successive rows (id, dist, features) alike in ``by``, ``RING`` at most, as one: n, ids, x (unit vectors) and dist as bytes, and what
    ``extra`` makes of them and their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in by]) if by else np.zeros((1, batch.num_rows), np.int64)
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for i in range(start, end, RING):
                    some = batch.slice(i, min(RING, end - i))
                    x = matrix(some["features"])
                    row = {"n": len(x), "ids": some["id"].to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "x": x.tobytes(), "dist": some["dist"].to_numpy(zero_copy_only=False).tobytes()}
                    yield pa.RecordBatch.from_pylist([row | extra(some, x)])

    return rows.mapInArrow(run, f"n long, ids binary, x binary, dist binary, {schema}")


def _against(batch: pa.RecordBatch, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a batch and their distances to the pivots."""
    x = matrix(batch["features"])
    return x, _distances(x, points)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    if not len(points):
        return np.empty((len(x), 0))
    if x.shape[1] != points.shape[1]:
        raise ValueError("vectors of different length")
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * x @ points.T, 0))


def _nearest(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest pivot."""
    if not d.shape[1]:
        return np.full(len(x), ZERO), np.zeros(len(x))
    cell = d.argmin(axis=1)
    return np.where(np.linalg.norm(x, axis=1) > 0.5, cell, ZERO), d[np.arange(len(d)), cell]
