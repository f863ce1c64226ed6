"""Bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bootstrap_f1(counts: DataFrame, k: int, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of macro-F1 (label null) and each class's F1, by model.

    These metrics depend on the k * k counts alone, so a resample of n rows is a multinomial draw over the cells: one pass over
    the rows, then replicates at a cost that doesn't depend on n. ``counts``: (model, y_true, y_pred, n).
    """
    cells = counts.groupBy("model").agg(F.collect_list(F.struct("y_true", "y_pred", "n")).alias("cells"))
    draws = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def draw(frames):  # noqa: ANN001, ANN202
        for df in frames:
            out = []
            for model, table, rep in zip(df["model"], df["cells"], df["replicate"], strict=True):
                t = np.array([c["y_true"] for c in table]), np.array([c["y_pred"] for c in table])
                n = np.array([c["n"] for c in table], float)
                order = np.lexsort((t[1], t[0]))
                got = np.random.default_rng([seed, int(rep)]).multinomial(int(n.sum()), n[order] / n.sum())
                m = np.zeros((k, k))
                np.add.at(m, (t[0][order], t[1][order]), got)
                both = m.sum(0) + m.sum(1)
                f1 = np.divide(2 * np.diag(m), both, out=np.zeros(k), where=both > 0)
                out += [(model, None, f1[both > 0].mean())] + [(model, i, f1[i]) for i in range(k)]
            yield pd.DataFrame(out, columns=["model", "label", "value"]).astype({"label": "Int32"})

    values = draws.mapInPandas(draw, "model string, label int, value double")
    return summary(values, ["model", "label"])


def summary(values: DataFrame, by: list[str]) -> DataFrame:
    ends = F.percentile("value", F.lit([0.025, 0.975]))
    return values.groupBy(*by).agg(F.avg("value").alias("mean"), F.get(ends, F.lit(0)).alias("lo"), F.get(ends, F.lit(1)).alias("hi"))


BLOCK = 128  # keys whose weights in all replicates stay in the cache
#: P(Poisson(1) <= i); beyond its last bound no 32-bit draw falls
POISSON = np.cumsum([np.exp(-1) / math.factorial(i) for i in range(16)])


def draw_key(key: Column, seed: int = 42) -> Column:
    """A 32-bit number from seed and key; ``draws`` mixes it with the replicate's number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def draws(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """(key, replicate) matrix of numbers in [0, 1): the sum of key and replicate * 2654435769, mixed by shifts and odd factors modulo
    2**32, which any engine with 64-bit integers can repeat."""
    x = (keys.astype(np.uint32)[:, None] + replicates.astype(np.uint32)[None, :] * np.uint32(2654435769)).astype(np.uint32)
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    return (x ^ (x >> np.uint32(16))) / 4294967296.0


#: the least 32-bit numbers of which so many parts of 2**32 are at least a bound; larger bounds are never met
BOUNDS = np.array([b for b in np.ceil(POISSON * 4294967296.0) if b < 4294967296.0]).astype(np.uint32)


def weights(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """(key, replicate) matrix of Poisson(1) weights, those that ``draws`` and inversion give, in whole numbers all the way. Few draws
    are over the sixth bound, and those alone meet the others."""
    x = keys.astype(np.uint32)[:, None] + (replicates.astype(np.uint32) * np.uint32(2654435769))[None, :]
    moved = np.empty_like(x)
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        np.right_shift(x, np.uint32(shift), out=moved)
        np.bitwise_xor(x, moved, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=moved)
    np.bitwise_xor(x, moved, out=x)
    out = (x >= BOUNDS[0]).view(np.uint8)
    for bound in BOUNDS[1:5]:
        out += (x >= bound).view(np.uint8)
    far = np.flatnonzero((x >= BOUNDS[5]).ravel())
    out.ravel()[far] = np.searchsorted(BOUNDS, x.ravel()[far], side="right")
    return out


def bootstrap_sums(rows: DataFrame, key: str, terms: dict[str, Column], replicates: int = 1000, by: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """(*by, _rep, and a column a term): weighted sums of each replicate. A row's weight is a Poisson(1) draw by inversion.

    Rows are never repeated: a task multiplies the weights of some hundred keys with the terms of their rows and keeps one sum for each group,
    replicate and term, so what is shuffled doesn't grow with the rows. Null terms count 0. Without rows it is an error.
    """
    if rows.isEmpty():
        raise ValueError("no rows to draw from")
    names = list(terms)
    given = rows.select(*by, draw_key(F.col(key), seed).alias("_key"), *[F.coalesce(terms[n].cast("double"), F.lit(0.0)).alias(f"_t_{n}") for n in names])
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}{', ' if by else ''}_sums array<array<double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sums = np.arange(replicates), {}
        for batch in batches:
            x = np.stack([batch[f"_t_{n}"].to_numpy() for n in names], axis=1)
            groups: dict[tuple, int] = {}
            code = np.array([groups.setdefault(g, len(groups)) for g in zip(*[batch[c].to_pylist() for c in by], strict=True)] if by else [groups.setdefault((), 0)] * batch.num_rows, int)
            totals = [sums.setdefault(g, np.zeros((replicates, len(names)))) for g in groups]
            # groups that share a key share its weights; where groups are many, each has its own
            parts = [(range(len(groups)), np.arange(len(code)))] if len(groups) <= 8 else [([g], np.flatnonzero(code == g)) for g in range(len(groups))]
            for some, at in parts:
                keys, back = np.unique(batch["_key"].to_numpy()[at], return_inverse=True)
                wide = np.zeros((len(keys), len(some), len(names)))
                np.add.at(wide, (back, code[at] - some[0]), x[at])
                wide = wide.reshape(len(keys), -1)
                # sums of small whole numbers over a block are exact in single precision
                small = len(wide) and np.abs(wide).max() <= 1000 and (wide == np.rint(wide)).all()
                wide = wide.astype(np.float32 if small else np.float64)
                for i in range(0, len(keys), BLOCK):
                    got = (weights(keys[i : i + BLOCK], numbers).astype(wide.dtype).T @ wide[i : i + BLOCK]).reshape(replicates, len(some), -1)
                    for j, g in enumerate(some):
                        totals[g] += got[:, j]
        if sums:
            yield pa.RecordBatch.from_arrays([
                *[pa.array([g[i] for g in sums], batch.schema.field(c).type) for i, c in enumerate(by)], pa.array([s.tolist() for s in sums.values()], pa.list_(pa.list_(pa.float64()))),
            ], [*by, "_sums"])

    parts = given.mapInArrow(run, schema).select(*by, F.posexplode("_sums").alias("_rep", "_s"))
    return parts.groupBy(*by, "_rep").agg(*[F.sum(F.get("_s", F.lit(i))).alias(n) for i, n in enumerate(names)])


def bootstrap_ci(rows: DataFrame, key: str, terms: dict[str, Column], metric: Callable[[dict[str, Column]], Column], replicates: int = 1000, by: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of a metric of weighted sums (``bootstrap_sums``), as in ``terms={"hits": x, "n": lit(1)}`` with
    ``metric=lambda s: s["hits"] / s["n"]``."""
    totals = bootstrap_sums(rows, key, terms, replicates, by, seed)
    return summary(totals.select(*by, metric({n: F.col(n) for n in terms}).alias("value")), list(by))


def bootstrap_f1_of_rows(preds: DataFrame, key: str, k: int, replicates: int = 1000, by: tuple[str, ...] = ("model",), seed: int = 42) -> DataFrame:
    """E6 from weighted rows, with draws that SQL can repeat: the same intervals as ``bootstrap_f1`` up to chance. It passes over all rows
    for each replicate, where that one draws counts of cells."""
    true, said = F.col("y_true"), F.col("y_pred")
    terms = {}
    for i in range(k):
        terms |= {f"tp{i}": ((true == i) & (said == i)).cast("int"), f"all{i}": (true == i).cast("int") + (said == i).cast("int")}
    totals = bootstrap_sums(preds, key, terms, replicates, by, seed)
    f1 = [F.when(F.col(f"all{i}") > 0, 2 * F.col(f"tp{i}") / F.col(f"all{i}")) for i in range(k)]
    present = F.array_compact(F.array(*f1))
    macro = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    values = F.array(F.struct(F.lit(None).cast("int").alias("label"), macro.alias("value")), *[F.struct(F.lit(i).alias("label"), F.coalesce(x, F.lit(0.0)).alias("value")) for i, x in enumerate(f1)])
    return summary(totals.select(*by, F.inline(values)), [*by, "label"])


def bootstrap_udf(rows: DataFrame, metric_fn: Callable[[np.ndarray, np.ndarray], float], replicates: int = 100, seed: int = 42) -> DataFrame:
    """The user's own metric_fn(y_true, y_pred) on counts of cells: each replicate draws cells and hands over expanded labels.
    The cells are few; the expanded arrays are as long as the table, so this is for tables that fit one task."""
    cells = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("y_true", "y_pred", "n")).alias("cells"))
    draws = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def draw(frames):  # noqa: ANN001, ANN202
        for df in frames:
            out = []
            for table, rep in zip(df["cells"], df["replicate"], strict=True):
                table = sorted((c["y_true"], c["y_pred"], c["n"]) for c in table)
                n = np.array([c[2] for c in table], float)
                got = np.random.default_rng([seed, int(rep)]).multinomial(int(n.sum()), n / n.sum())
                out.append(metric_fn(np.repeat([c[0] for c in table], got), np.repeat([c[1] for c in table], got)))
            yield pd.DataFrame({"value": out})

    return summary(draws.mapInPandas(draw, "value double"), [])
