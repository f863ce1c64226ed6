"""Running sums, ranks and percentiles within groups of any size.

Rows are dealt to ranges of the order that counts, as many as their number asks for (``ROWS`` rows each), so a group with most rows
is many ranges and small groups share one. Sums run inside a range as its sorted rows stream by; what lies in the ranges before
comes from a table of range totals, whose prefix sums are taken on two levels (``FAN`` ranges, then what they hold together). So no
step has a task that grows with the rows: a range has about ``ROWS``, a window at most ``FAN`` or one row for each ``FAN`` ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.sources.shared import materialize

ROWS, LEAST, FAN = 1_000_000, 20_000, 1_000


def pieces(rows: DataFrame, per_range: int | None = None) -> int:
    """How many ranges the rows take: so many that each has ``per_range``, and of less than that one for each core."""
    n = rows.count()
    return max(1, -(-n // (per_range or ROWS)), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST))


def same(left: DataFrame, right: DataFrame, by: Sequence[str], prefix: str) -> Column:
    """The condition that joins ``by`` of ``left``, nulls included, to the columns of ``right`` that have the prefix."""
    on = F.lit(True)
    for c in by:
        on = on & left[c].eqNullSafe(right[f"{prefix}{c}"])
    return on


def sums_before(totals: DataFrame, by: Sequence[str], bin: str, amount: str, name: str, bins: int, all: str | None = None, fan: int | None = None) -> DataFrame:
    """Add ``name``, the sum of ``amount`` over the rows of the same group with smaller ``bin``, and ``all``, the group's sum. A group has
    each of the ``bins`` once at most. Up to ``fan`` of them are one window; more are summed on two levels."""
    fan, first = fan or FAN, Window.unboundedPreceding
    if bins <= fan:
        group = Window.partitionBy(*by)
        out = totals.withColumn(name, F.coalesce(F.sum(amount).over(group.orderBy(bin).rowsBetween(first, -1)), F.lit(0)))
        return out.withColumn(all, F.sum(amount).over(group)) if all else out
    rows = totals.withColumn("_over", F.floor(F.col(bin) / fan))
    inside = Window.partitionBy(*by, "_over").orderBy(bin).rowsBetween(first, -1)
    rows = rows.withColumn("_lower", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    upper = totals.groupBy(*[F.col(c).alias(f"_up_{c}") for c in by], F.floor(F.col(bin) / fan).alias("_up_over")).agg(F.sum(amount).alias("_of_bins"))
    group = Window.partitionBy(*[f"_up_{c}" for c in by])
    upper = upper.withColumns({"_upper": F.coalesce(F.sum("_of_bins").over(group.orderBy("_up_over").rowsBetween(first, -1)), F.lit(0)), "_of_all": F.sum("_of_bins").over(group)})
    joined = rows.join(upper, same(rows, upper, by, "_up_") & (rows["_over"] == upper["_up_over"])).withColumn(name, F.col("_lower") + F.col("_upper"))
    joined = joined.withColumn(all, F.col("_of_all")) if all else joined
    return joined.drop("_over", "_lower", "_upper", "_up_over", "_of_bins", "_of_all", *[f"_up_{c}" for c in by])


def _starts(batch: pa.RecordBatch, by: Sequence[str], before: list | None) -> np.ndarray:
    """Places where a row's group differs from that of the row before; ``before`` has the values ahead of the batch, or is None."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = [batch[c][0].as_py() for c in by] != before
    for c in by:
        a, b = batch[c][1:], batch[c][:-1]
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def in_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[Column], amount: str, per_range: int | None = None, keep: bool = True) -> DataFrame:
    """``rows``, sorted in ranges of (by, order), with ``_bin``, the range's number, and ``_inside``, the sum of ``amount`` (whole
    numbers) over the rows of the same group and range that come before. The input is written, and with ``keep`` the result, so that all
    who read it find the same ranges; without, it may be used once."""
    rows = materialize(rows, "to-ranges")
    dealt = rows.repartitionByRange(pieces(rows, per_range), *by, *order).sortWithinPartitions(*by, *order)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "_bin int, _inside long"])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = pc.fill_null(batch[amount], 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = carried + np.cumsum(x) - x  # from the group ahead of the batch on
            starts = _starts(batch, by, last)
            base = np.zeros(batch.num_rows, np.int64)
            base[starts] = np.diff(total[starts], prepend=0)
            inside = total - np.cumsum(base)
            carried, last = int(inside[-1] + x[-1]), [batch[c][batch.num_rows - 1].as_py() for c in by]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(np.full(batch.num_rows, bin, np.int32)), pa.array(inside)], [*names, "_bin", "_inside"])

    ranged = dealt.mapInArrow(run, schema)
    return materialize(ranged, "in-ranges") if keep else ranged


def rank_sums(counts: DataFrame, by: Sequence[str], value: str, pos: str, neg: str, sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """(*by, u, p, n, and the named sums and maxima): u counts the pairs of a ``pos`` and a ``neg`` with the smaller value, and half of those with equal ones, from
    counts by distinct value; p and n are all of either. Ranges are summed up where they are sorted, and what is left is a row a
    range."""
    sums, most = sums or {}, most or {}
    ranged = in_ranges(counts, by, [F.col(value)], neg, keep=False)
    u = F.sum(F.col(pos) * (F.col("_inside") + F.col(neg) / 2)).alias("u")
    bins = materialize(ranged.groupBy(*by, "_bin").agg(u, F.sum(pos).alias("p"), F.sum(neg).alias("n"), *[F.sum(c).alias(x) for x, c in sums.items()], *[F.max(c).alias(x) for x, c in most.items()]), "range-sums")
    n_bins = bins.agg(F.coalesce(F.max("_bin"), F.lit(0)) + 1).first()[0]
    before = sums_before(bins, by, "_bin", "n", "_under", n_bins)
    rest = [*[F.sum(x).alias(x) for x in sums], *[F.max(x).alias(x) for x in most]]
    return before.groupBy(*by).agg(F.sum(F.col("u") + F.col("_under") * F.col("p")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"), *rest)


def running_before(rows: DataFrame, by: Sequence[str], order: Sequence[Column], amount: Column, name: str, per_range: int | None = None) -> DataFrame:
    """Add ``name``, the sum of ``amount`` (whole numbers) over the rows of the same group that come before in ``order``. Rows alike in
    ``by`` and ``order`` share a range and come one after another in any order."""
    ranged = in_ranges(rows.withColumn("_of", amount.cast("long")), by, order, "_of", per_range)
    totals = ranged.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bin").alias("_bin_of")).agg(F.sum("_of").alias("_sum"))
    bins = ranged.agg(F.coalesce(F.max("_bin"), F.lit(0)) + 1).first()[0]
    totals = sums_before(totals, [f"_by_{c}" for c in by], "_bin_of", "_sum", "_base", bins).drop("_sum")
    joined = ranged.join(totals, same(ranged, totals, by, "_by_") & (ranged["_bin"] == totals["_bin_of"]))
    return joined.withColumn(name, F.col("_inside") + F.col("_base")).drop("_inside", "_base", "_bin", "_bin_of", "_of", *[f"_by_{c}" for c in by])


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A row a group with one exact percentile (interpolated) for each of ``shares``: values are counted, then ranked by their
    counts, so a group may have any number of distinct values. Nulls are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    counts = running_before(counts, by, [F.col("_value")], F.col("_n"), "_before")
    sizes = counts.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.sum("_n").alias("_all"))
    placed = counts.join(sizes, same(counts, sizes, by, "_of_"))
    at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("_value")))
    parts = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * F.lit(float(share))
        parts += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.first(place - F.floor(place)).alias(f"_part_{name}")]
    out = placed.groupBy(*by).agg(*parts)
    return out.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares])
