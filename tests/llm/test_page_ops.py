"""WARC archives, URL filter and top-k search."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelaudit.llm import topk, url_filter, warc
from modelaudit.llm.storage import filesystem, new_dir


def test_warc_round_trip(spark):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"http://h/{i}", big) for i in range(7)] + [(10, "http://x", "small"), (11, "http://y", "small"), (12, None, None), (13, "http://z\nq", ""), (None, "http://n", big), (6, "http://again", big), (20, "http://long", "a" * 300_000 + "\x00é" * 900_000), (21, "u", "b" * 999), (22, "u", "b" * 999), (23, "u", "c" * 1000), (24, "u", "c" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS salt", "'y' AS payload_digest", "1 AS original_id")
    heads = warc.headers(df)
    manifest = warc.write_archives(warc.resolve(heads, warc.originals(heads)), new_dir(spark, "w"), archive_bytes=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    read = warc.read_archives(manifest)
    got = warc.resolve_revisits(read).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [x for x in rows if x[0] == r.page_id][0][2] or ""
        data = want.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if r.record_type == "response":
            assert bytes(r.payload) == data and r.refers_to is None
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(i, "revisit", 6) for i in range(6)} | {(6, "response", None), (None, "revisit", 6), (23, "revisit", 24), (24, "response", None), (21, "response", None), (22, "response", None), (10, "response", None)} <= kinds
    store, path = filesystem(manifest.first().path)
    with store.open_input_stream(path, compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    none = warc.headers(df.limit(0))
    assert warc.read_archives(warc.write_archives(warc.resolve(none, warc.originals(none)), new_dir(spark, "w"))).count() == 0


def test_warc_finds_damage(spark, tmp_path):
    df = warc.headers(spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string"))
    m = warc.write_archives(warc.resolve(df, warc.originals(df)), f"file://{tmp_path}")
    path = m.first().path.removeprefix("file://")
    raw = gzip.decompress(open(path, "rb").read())
    open(path, "wb").write(gzip.compress(raw.replace(b"xxxx", b"xxyx", 1)))
    with pytest.raises(Exception, match="wrong block digest"):
        warc.read_archives(m).collect()


def test_urls(spark):
    urls = ["http://Sub.NET/fr/x", "https://a.example.com/en/1?q=/fr/", "http://www.example.com/en/z", "http://example.com/de/", "http://notexample.com/en/", "x.com/y", None, "", "http://com", "http://com/", "ftp://h#f/x", "://odd/p?x#y", "http://a.net/es", "http://" + "a" * 20_000 + ".org/p"]
    weights, intercept = url_filter.train(spark.createDataFrame([*url_filter.LABELLED_URLS, ("http://n", None)], "url string, label int"))
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, weights, intercept, url_filter.RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(13)] == [
        ("sub.net", "/fr/x", "net/fr/"), ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/z", "www.example.com/en/"), ("example.com", "/de/", "com/"),
        ("notexample.com", "/en/", "com/"), ("", "", None), ("", "", None), ("", "", None), ("com", "", None), ("com", "/", "com/"), ("h", "", None), ("odd", "/p", None), ("a.net", "/es", None),
    ]
    assert got[0].verdict == "block" and got[1].verdict == "block" and got[2].verdict == "allow" and all(r.verdict in ("allow", "block") for r in got.values())
    known = spark.createDataFrame(url_filter.LABELLED_URLS, "url string, label int")
    right = url_filter.filter_urls(known, weights, intercept).filter((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    assert right >= 0.95 * len(url_filter.LABELLED_URLS)
    new = spark.createDataFrame([("http://cheap-pills-shop.example.org/q", 1), ("http://spam-farm.example.com/z", 1), ("https://library.example.org/en/books", 0), ("https://news.example.net/de/7", 0)], "url string, label int")
    assert new.count() == url_filter.filter_urls(new, weights, intercept).filter((F.col("verdict") == "block") == (F.col("label") == 1)).count()


URL_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM h),
r AS (SELECT k.*, t.h || t.p AS rule, t.v, row_number() OVER (PARTITION BY page_id ORDER BY length(t.h || t.p) DESC NULLS LAST) AS n
      FROM k LEFT JOIN (VALUES {rules}) t(h, p, v) ON (host = t.h OR host LIKE '%.' || t.h) AND starts_with(path, t.p))
SELECT page_id, host, path, rule, v FROM r WHERE n = 1
"""


def test_urls_equal_sql_and_a_plain_model(spark):
    """Host, path, rule and the rules' verdicts by DuckDB; the model's score by n-grams in Python, on a whole table."""
    import duckdb
    import xxhash

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet')")
    want = {r[0]: r[1:] for r in con.execute(URL_SQL.format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES))).fetchall()}
    weights, intercept = url_filter.train(spark.createDataFrame(url_filter.LABELLED_URLS, "url string, label int"))
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    got = url_filter.filter_urls(pages, weights, intercept, url_filter.RULES).collect()
    assert len(got) == len(want) == pages.count() and {r.verdict for r in got} == {"allow", "block"}
    for r in got:
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        text = f"^{host}{path}$"
        buckets = {(x - 2**64 if x >= 2**63 else x) % url_filter.BUCKETS for n in (3, 4, 5) for i in range(len(text) - n + 1) for x in [xxhash.xxh64_intdigest(text[i : i + n].encode(), seed=42)]}
        score = 1 / (1 + np.exp(-(intercept + sum(weights[b] for b in sorted(buckets)))))
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.verdict == (verdict or ("block" if score >= 0.5 else "allow"))
    assert url_filter.filter_urls(pages.limit(0), weights, intercept, url_filter.RULES).count() == 0
    twice = url_filter.filter_urls(pages.limit(9).union(pages.limit(9)), weights, intercept, url_filter.RULES)
    assert twice.count() == 18 and twice.distinct().count() == 9


def test_topk(spark):
    rng = np.random.default_rng(2)
    vecs = np.round(rng.normal(size=(300, 24)), 3)
    vecs[7] = vecs[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(400, None), (401, []), (402, [1.0, None] * 12), (403, [float("nan")] * 24), (404, [float("inf")] * 24), (None, [1.0] * 24), (405, [1.0, 2.0]), (410, [3.0, 4.0]), (3, [float(x) for x in vecs[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS score", "'x' AS id")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, query_rows=8, block_rows=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = np.floor(vecs * 256).astype(int)
    for q in range(0, 300, 10):
        s = ints @ ints[q]
        want = sorted((-int(s[i]), i) for i in [*range(300), 3] if i != q)[:5]  # 3 is there twice
        assert sorted(got[q]) == [(n + 1, i, -v) for n, (v, i) in enumerate(want)]
    assert got[410] == [(1, 405, 256 * 768 + 512 * 1024)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    wide = spark.createDataFrame([(i, [float(random.Random(i).randint(-(2**30), 2**30))] * 3) for i in range(0, 40)], "vec_id long, embedding array<double>")
    best = {r.query_id: (r.vec_id, r.score) for r in topk.top_k(wide, F.col("vec_id") == 10, k=1, scale=1.0).collect()}
    v = {i: random.Random(i).randint(-(2**30), 2**30) for i in range(40)}
    want = max(((3 * v[10] * v[i], -i) for i in v if i != 10))
    assert best[10] == (-want[1], want[0])


def test_topk_with_repeated_ids_and_at_the_ends_of_64_bits(spark):
    rows = [(10, [1.0, 0.0])] + [(7, [float(9 - i), 1.0]) for i in range(6)] + [(8, [2.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 10, scale=1.0).collect())
    assert best == [(n + 1, 7, 9 - n) for n in range(5)]
    edge = 2.0**31
    for values, fits in (([edge, edge], True), ([edge, 2 * edge], False), ([-edge, 2 * edge], True), ([-edge, 2 * edge + 512], False)):
        df = spark.createDataFrame([(10, [values[0]]), (11, [values[1]])], "vec_id long, embedding array<double>")
        out = topk.top_k(df, F.col("vec_id") == 10, scale=1.0)
        if fits:
            assert out.first().score == int(values[0]) * int(values[1])
        else:
            with pytest.raises(Exception, match="beyond 64 bits"):
                out.collect()
    df = spark.createDataFrame([(10, [1e18]), (11, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(df, F.col("vec_id") == 10).collect()
    long = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(20_000)]) for i in range(12)], "vec_id long, embedding array<double>")
    ints = np.array([[(i * j) % 7 for j in range(20_000)] for i in range(12)])
    want = sorted((-int(ints[10] @ ints[i]), i) for i in range(12) if i != 10)[:5]
    assert [(r.vec_id, r.score) for r in topk.top_k(long, F.col("vec_id") == 10, scale=1.0).orderBy("rank").collect()] == [(i, -s) for s, i in want]


def test_segment_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 30)), rng.normal(size=(60, 30))
    before = np.full((50, 60), np.inf)
    for n in topk.LEVELS:
        bound = topk.segment_stats(x, n) @ topk.segment_stats(y, n).T
        assert (bound >= x @ y.T - 1e-9).all()
        assert bound.sum() <= before.sum()
        before = bound
