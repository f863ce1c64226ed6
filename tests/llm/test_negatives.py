"""Hard negatives against SQL on the given tables and against all pairs on made-up vectors."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from modelaudit.llm import negatives

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, score string, row string, part string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain(rows, k=5, low=80):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, ay in rows:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(av, v)), i, y) for i, v, y in rows if i != a and len(v) == len(av))
        for s, p, _ in [x for x in scored if x[2] == ay][:k]:
            inside = [(n, -t) for t, n, y in scored if y != ay and low * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r, n, -s, t) for r, (n, t) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **sizes):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes).collect())


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = negatives.op12_hard_negatives(spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({negatives.SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 50


def test_equals_all_pairs(spark):
    """Clusters, many ties, a hot label, repeated vectors and ids, odd vectors, several lengths; tiles of few rows."""
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(900):
        c = rng.choice(centres)
        rows.append((i, [x + rng.choice([0, 0, 0.1, -0.1]) for x in c], 0 if rng.random() < 0.4 else rng.randrange(5)))
    rows += [(i, [1.0, 0.5], i % 2) for i in range(1000, 1104)] + [(300, rows[5][1], 1), (300, rows[6][1], 2), (41, rows[7][1], 0), (41, rows[7][1], 0)]
    rows += [(2000, None, 1), (2100, [], 1), (2200, [1.0, None], 1), (2300, [float("nan"), 1.0], 1), (2400, [float("inf"), 1.0], 1), (2500, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (2600, [0.0] * 12, 0), (2700, [-x for x in centres[0]], 77)]
    df = table(spark, rows)
    want = plain(rows)
    assert len(want) > 100
    assert mined(df) == want
    assert mined(df, group=3, lane=50) == want
    assert mined(df.filter("label = 0 or label is null")) == []
    assert mined(df.limit(0)) == []


def test_large_values(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randint(-(2**29), 2**29) / 256 * 1.0 for _ in range(3)], i % 3) for i in range(0, 400, 4)]
    assert mined(table(spark, rows)) == plain(rows) and plain(rows)
    with pytest.raises(Exception, match="beyond 64 bits"):
        mined(table(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [9e29], 2)]))


def test_scan_keeps_what_bounds_allow():
    """Nothing within a window is dropped by bounds, and bounds do drop most of what is outside."""
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(0, 40, (500, 64)))
    anchor = np.floor(rng.normal(0, 4, 64) * np.exp(-np.arange(64) / 6) * 50)
    batch = negatives._Columns(np.arange(500), np.zeros(500, int), rows)
    true, met = rows @ anchor, []
    top, floor = np.quantile(true, 0.99), np.quantile(true, 0.97)

    def wanted(low, high):
        met.append(len(low))
        return (low <= top) & (high >= floor)

    at, scores = negatives._scan(anchor, batch, np.arange(500), wanted)
    assert sorted(at) == list(np.flatnonzero((true <= top) & (true >= floor))) and (scores == true[at]).all()
    assert met[0] == 500 and met[-1] < 250
