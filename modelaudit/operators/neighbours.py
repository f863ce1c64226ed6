"""Similarity between splits: nearest neighbours, neighbours by number, components of near copies, borderline oversampling.

Vectors meet through an exact index (``vector_index``): rows visit only the rings of vectors that may hold what they look for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.functions.items import cosine, hash01, vector_key
from modelaudit.functions.ranges import running_before
from modelaudit.operators.splits import random_pool, ranked
from modelaudit.operators.vector_index import RING, SLACK, Index, distance, sweep_groups
from modelaudit.sources.shared import materialize

FOUND = "b_id long, a_id long, sim double"


def top_neighbours(b: DataFrame, a: DataFrame, key: str = "item_id", k: int = 1, ring: int = RING, pivots: int | None = None) -> DataFrame:
    """(b_id, a_id, sim, rank): for each row of ``b`` the k most similar rows of ``a`` by cosine (smaller a_id on ties). Never a
    row with itself. Each row visits the ring it lies in first; the k-th best there bounds which rings it visits then."""

    def search(b_ids: np.ndarray, x: np.ndarray, a_ids: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        sims = np.round(x @ y.T, 9)
        sims[b_ids[:, None] == a_ids[None, :]] = -np.inf
        least = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] >= k else np.full(len(x), -np.inf)
        i, j = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
        order = np.lexsort((a_ids[j], -sims[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        yield pa.RecordBatch.from_pydict({"b_id": pa.array(b_ids[i], pa.int64()), "a_id": pa.array(a_ids[j], pa.int64()), "sim": sims[i, j]})

    index = Index(a, key, ring, pivots)
    rows = materialize(b.filter(F.col("features").isNotNull()).select(F.col(key).alias("id"), "features"), "neighbour-rows")
    first = materialize(index.visits(rows, None, k, own=True), "first-visits")
    found = materialize(index.meet(rows, first, search, FOUND), "first-neighbours")
    within = F.when(F.count("*") >= k, F.sqrt(F.greatest(2 - 2 * F.min("sim") + F.lit(4e-9), F.lit(0.0))) + F.lit(SLACK))
    bounds = _first(found, k).groupBy(F.col("b_id").alias("id")).agg(within.alias("within"))
    return _first(index.sweep(rows.join(bounds, "id", "left"), "within", _keeper(k), FOUND, k), k)


def top_in_groups(rows: DataFrame, k: int, ring: int = RING, pivots: int | None = None) -> DataFrame:
    """(b_id, a_id, sim, rank): for each row of ``rows`` (id, grp, of, asks, features; see ``sweep_groups``) that asks, the k most similar
    others of its group (smaller a_id on ties), or all where there are fewer."""
    return _first(sweep_groups(rows, _keeper(k), FOUND, k, ring, pivots), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` and leave the k best of each row."""
    rank = F.row_number().over(Window.partitionBy("b_id").orderBy(F.desc("sim"), "a_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _keeper(k: int) -> Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]]:
    """The kernel of a sweep for the k most similar."""

    def keep(tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """The k best so far of each row of the task's blocks; those of a row leave the task once."""
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for block, b_ids, x, within, at, a_ids, y in tiles:
            if block not in best:
                best[block] = b_ids.copy(), np.full((len(b_ids), k), -np.inf), np.zeros((len(b_ids), k), np.int64)
            _, sims, found = best[block]
            # a bound w leaves similarities from 1 - w * w / 2 on; 1e-9 is more than rounding to nine decimals can do
            least = np.maximum(sims[at, -1], 1 - within[at] ** 2 / 2) - 1e-9
            new = x[at] @ y.T
            if new.shape[1] > k + 1 and np.isneginf(least).any():
                least = np.maximum(least, np.partition(new, -k - 1, axis=1)[:, -k - 1] - 1e-9)  # one more, as the row may be among them
            i, j = np.nonzero(new >= least[:, None])
            other = b_ids[at[i]] != a_ids[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            touched, place = np.unique(i, return_inverse=True)
            rows = at[touched]
            who = np.concatenate([place, np.repeat(np.arange(len(rows)), k)])
            sim = np.concatenate([np.round(new[i, j], 9), sims[rows].ravel()])
            ids = np.concatenate([a_ids[j], found[rows].ravel()])
            order = np.lexsort((ids, -sim, who))
            first = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < k]
            sims[rows], found[rows] = sim[first].reshape(-1, k), ids[first].reshape(-1, k)
        for b_ids, sims, found in best.values():
            i, j = np.nonzero(np.isfinite(sims))
            yield pa.RecordBatch.from_pydict({"b_id": pa.array(b_ids[i], pa.int64()), "a_id": pa.array(found[i, j], pa.int64()), "sim": sims[i, j]})

    return keep


def spanning_links(rows: DataFrame, threshold: float, key: str = "item_id", ring: int = RING, pivots: int | None = None) -> DataFrame:
    """(a, b): links between rows whose cosine is over ``threshold``; of what meets in a ring, as many as join all that it joins, so
    m alike rows give about m links and not their square. Rows visit the rings within the threshold's distance alone."""

    def link(b_ids: np.ndarray, x: np.ndarray, a_ids: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        sims = x @ y.T
        i, j = np.nonzero(sims > threshold - 1e-9)  # rounded are only those that may be over
        over = (np.round(sims[i, j], 9) > threshold) & (b_ids[i] != a_ids[j])
        i, j = i[over], j[over]
        ids, at = np.unique(np.concatenate([b_ids[i], a_ids[j]]), return_inverse=True)
        up, kept = np.arange(len(ids)), []
        for n, (x1, y1) in enumerate(zip(at[: len(i)].tolist(), at[len(i) :].tolist(), strict=True)):
            while up[x1] != x1:
                up[x1] = x1 = up[up[x1]]
            while up[y1] != y1:
                up[y1] = y1 = up[up[y1]]
            if x1 != y1:
                up[max(x1, y1)] = min(x1, y1)
                kept.append(n)
        yield pa.RecordBatch.from_pydict({"a": pa.array(b_ids[i][kept], pa.int64()), "b": pa.array(a_ids[j][kept], pa.int64())})

    def links(tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for _, b_ids, x, _, at, a_ids, y in tiles:
            yield from link(b_ids[at], x[at], a_ids, y)

    index = Index(rows, key, ring, pivots)
    near = rows.filter(F.col("features").isNotNull()).select(F.col(key).alias("id"), "features", F.lit(float(distance(np.float64(threshold)))).alias("within"))
    return index.sweep(near, "within", links, "a long, b long")


def nearest_neighbour(b: DataFrame, a: DataFrame, key: str = "item_id") -> DataFrame:
    """Best match of each row, flagged near duplicate (sim >= 0.9999) or very close (>= 0.999)."""
    near = top_neighbours(b, a, key).drop("rank")
    return near.withColumns({"near_duplicate": F.col("sim") >= 0.9999, "very_close": (F.col("sim") >= 0.999) & (F.col("sim") < 0.9999)})


def nearest_summary(near: DataFrame) -> DataFrame:
    """One row with the number of rows, the largest and the mean of their best similarities, and how many are near duplicates or
    very close. ``near``: ``nearest_neighbour``."""
    flag = lambda name: F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0)).alias(name)
    return near.agg(F.count("*").alias("n"), F.max("sim").alias("most"), F.avg("sim").alias("mean"), flag("near_duplicate"), flag("very_close"))


def k_nearest_by_id(test: DataFrame, train: DataFrame, number: str, key: str = "item_id", klass: str = "class", k: int = 5) -> DataFrame:
    """For each test row the k training rows of its class with the nearest numbers: (key, class, train_key, gap, sim).

    The place of a test row among its class's training numbers is a running count, taken in ranges of the number; the 2k
    training rows around it come by an equi-join on (class, place), and the k nearest of them (first in training order on ties)
    are kept. Classes with a pool of k or fewer are left out. Numbers are unique in a class's pool.
    """
    pool = train.select(F.col(klass).alias("class"), F.col(number).alias("number"), F.col(key).alias("train_key"))
    asked = test.select(F.col(klass).alias("class"), F.col(number).alias("number"), F.col(key).alias("key"))
    both = pool.select("class", "number", F.lit(None).cast("long").alias("key"), F.lit(1).alias("t")).unionByName(asked.select("class", "number", "key", F.lit(0).alias("t")))
    both = running_before(both, ["class"], [F.col("number"), F.desc("t")], F.col("t"), "place")
    placed = both.filter("t = 0").select("key", "class", F.col("number").alias("test_number"), "place")
    numbered = running_before(pool, ["class"], [F.col("number"), F.col("train_key")], F.lit(1), "before")
    numbered = numbered.withColumn("place", F.col("before") + 1).drop("before")
    large = pool.groupBy("class").count().filter(F.col("count") > k).select("class")
    numbered = numbered.join(large, "class", "left_semi")
    around = placed.withColumn("place", F.explode(F.sequence(F.col("place") - k + 1, F.col("place") + k)))
    found = around.join(numbered, ["class", "place"]).withColumn("gap", F.abs(F.col("number") - F.col("test_number")))
    first = F.row_number().over(Window.partitionBy("key").orderBy("gap", "train_key"))
    best = found.withColumn("rank", first).filter(F.col("rank") <= k)
    best = best.join(test.select(F.col(key).alias("key"), "features"), "key").join(train.select(F.col(key).alias("train_key"), F.col("features").alias("train_features")), "train_key")
    return best.select("key", "class", "train_key", "gap", cosine(F.col("features"), F.col("train_features")).alias("sim"))


def random_baseline(test: DataFrame, train: DataFrame, key: str = "item_id", klass: str = "class") -> DataFrame:
    """(key, class, sim): mean over trials of the mean cosine to random training rows of the class."""
    pool = random_pool(test, train, key, klass)
    rows = pool.join(test.select(key, "features"), key).join(train.select(F.col(key).alias("train_key"), F.col("features").alias("tf")), "train_key")
    each = rows.select(key, klass, "trial", cosine(F.col("features"), F.col("tf")).alias("s")).groupBy(key, klass, "trial").agg(F.avg("s").alias("s"))
    return each.groupBy(key, klass).agg(F.avg("s").alias("sim"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): least node of each component of links (a, b), by label propagation with jumps; checkpointed each round."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        mid = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        top = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        now = mid.join(top, "mid").select("node", "old", F.least("mid", "top").alias("label")).checkpoint()
        changed = now.filter("label <> old").limit(1).count()
        labels = now.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("labels still change; raise max_rounds")


def dedup_near(items: DataFrame, threshold: float = 0.9999, key: str = "item_id") -> DataFrame:
    """Items with ``component`` (least id linked to them by cosine over the threshold) and whether they are kept."""
    keyed = items.filter(F.col("features").isNotNull()).select(key, "features", vector_key(F.col("features")).alias("_v"))
    classes = keyed.groupBy("_v").agg(F.min(key).alias(key), F.min_by("features", key).alias("features"))  # equal vectors are one
    found = components(spanning_links(classes.select(key, "features"), threshold, key)).select(F.col("node").alias("_n"), "label")
    named = classes.select("_v", F.col(key).alias("_n")).join(found, "_n", "left").select(F.col("_v").alias("_w"), F.coalesce("label", "_n").alias("component"))
    alike = F.lit(threshold < 1)  # equal vectors are linked unless nothing is
    out = items.select(key, vector_key(F.col("features")).alias("_v")).join(named, F.col("_v") == F.col("_w"), "left")
    return out.select(key, F.when(alike, F.coalesce("component", key)).otherwise(F.col(key)).alias("component")).withColumn("kept", F.col(key) == F.col("component"))


def borderline_smote(rows: DataFrame, key: str = "item_id", klass: str = "class", m: int = 10, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, class, features, synthetic, i): ``rows`` and as many made-up ones as bring every class to the size of the largest.
    Only rows of which at least half but not all of the m nearest are of other classes spawn; each new one lies between such a
    row (whose key it has; ``i`` numbers a class's new rows) and one of the k nearest of its class, be they among the m nearest or not.
    Such rows take turns in the order of their hash. A class without such rows gets none."""
    sizes = rows.groupBy(klass).agg(F.count("*").alias("count"), F.count("features").alias("_of"), F.min(key).cast("long").alias("_grp"))
    need = sizes.join(F.broadcast(sizes.agg(F.max("count").alias("top")))).select(F.col(klass).alias("_c"), (F.col("top") - F.col("count")).alias("need"), "_of", "_grp")
    minority = rows.select(key, klass, "features").join(F.broadcast(need.filter("need > 0")), F.col(klass) == F.col("_c")).drop("_c", "need")
    classes = rows.select(F.col(key).alias("a_id"), F.col(klass).alias("a_class"))
    near = materialize(top_neighbours(minority, rows, key, k=m), "smote-near").join(classes, "a_id").join(minority.select(F.col(key).alias("b_id"), F.col(klass).alias("b_class")), "b_id")
    other = near.groupBy("b_id", "b_class").agg(F.sum((F.col("a_class") != F.col("b_class")).cast("int")).alias("others"), F.count("*").alias("n"))
    danger = other.filter((F.col("others") * 2 >= F.col("n")) & (F.col("others") < F.col("n"))).select("b_id", "b_class")
    seeds = ranked(danger, "b_id", "b_class").withColumn("at", F.col("rank") - 1).withColumnRenamed("n", "seeds").drop("rank")
    made = need.filter("need > 0").select("_c", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("i"))
    made = made.join(seeds.select("b_class", "seeds").distinct(), F.col("_c") == F.col("b_class")).drop("b_class")
    made = made.withColumn("at", F.pmod("i", "seeds")).join(seeds.drop("seeds"), (F.col("_c") == F.col("b_class")) & (seeds["at"] == F.pmod("i", "seeds"))).drop(seeds["at"])
    made = materialize(made.select("b_id", "_c", "i"), "smote-made")
    spawning = made.select("b_id").distinct().withColumn("asks", F.lit(True))
    peers = minority.filter(F.col("features").isNotNull()).join(made.select("_c").distinct(), F.col(klass) == F.col("_c"), "left_semi")
    peers = peers.join(spawning, F.col(key) == F.col("b_id"), "left").select(F.col(key).alias("id"), F.col("_grp").alias("grp"), F.col("_of").alias("of"), F.coalesce("asks", F.lit(False)).alias("asks"), "features")
    partners = top_in_groups(peers, k).groupBy("b_id").agg(F.array_sort(F.collect_list(F.struct("rank", "a_id"))).alias("partners"))
    draw = lambda what: hash01(F.concat_ws("|", F.lit(f"{seed}|{what}"), F.col("b_id").cast("string"), F.col("i").cast("string")))
    made = made.join(partners, "b_id").withColumn("partner", F.get("partners", F.floor(draw("partner") * F.size("partners")).cast("int"))["a_id"])
    vectors = rows.select(F.col(key).alias("_k"), "features")
    made = made.join(vectors.select(F.col("_k").alias("b_id"), F.col("features").alias("fa")), "b_id").join(vectors.select(F.col("_k").alias("partner"), F.col("features").alias("fb")), "partner").withColumn("g", draw("gap"))
    new = made.select(F.col("b_id").alias(key), F.col("_c").alias(klass), F.zip_with("fa", "fb", lambda a, b: a + F.col("g") * (b - a)).alias("features"), F.lit(True).alias("synthetic"), F.col("i").cast("long").alias("i"))
    return rows.select(key, klass, "features", F.lit(False).alias("synthetic"), F.lit(None).cast("long").alias("i")).unionByName(new)
