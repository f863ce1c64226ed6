"""Spelling variants against SQL on the given tables and against all pairs on made-up words."""

import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from modelaudit.llm import variants

SF = "/root/testdata/sf0.001"


def plain_words(docs, of):
    counts = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % of == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {tuple(r) for r in con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({variants.SQL})").fetchall()}
    got = {tuple(r) for r in variants.op11_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == want and len(got) > 100 and any(r[1] for r in got)


def test_chains_ties_and_odd_rows(spark):
    rng = random.Random(5)
    base = ["aaaaaa", "bananas", "àéîõüÿ", "straße", "mississippi"]
    counts = {}
    for word in base:
        n = 5 * 5**4
        for _ in range(4):  # chains of words, each a fifth as frequent
            counts[word] = counts.get(word, 0) + n
            at, letter = rng.randrange(len(word)), rng.choice("abßé÷")
            word = rng.choice([word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + word[at + 1 :] if len(word) > 6 else word + letter])
            n //= 5
    counts["banabas"], counts["banahas"] = 700, 700  # a tie
    docs = [(i, " ".join([w.upper() if i % 2 and w.isascii() else w] * (n // 10))) for i in range(10) for w, n in counts.items()]
    docs += [(None, "bananas " * 9), (3, None), (4, ""), (4, "... 12 x"), (5, "bananas\nbananas-bananas"), (5, "bananas\nbananas-bananas"), (6, "zzzzzzzzzz" * 20_000), (7, "ÀÉÎÕÜß " * 5)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "'y' AS id", "'z' AS run")
    for of in (199, 3):
        want = plain_groups(plain_words(docs, of))
        got = variants.group_variants(variants.word_counts(table, of=of))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    assert variants.group_variants(variants.word_counts(table.limit(0))).count() == 0


def test_no_near_pair_is_missed(spark):
    """Words of few letters, so grams repeat, tie and overlap."""
    rng = random.Random(11)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(700)} | {"".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(6, 12))) for _ in range(300)}
    words |= {"é" * k for k in range(6, 12)} | {"ab" * k for k in range(3, 7)}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {tuple(r) for r in variants.near_pairs(table).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    grams = variants.gram_table(table).withColumn("pivots", variants.pivots(F.col("prefix"))).collect()
    for r in grams:  # the two least frequent disjoint ones of the prefix
        pairs = [(x.f + y.f) for x in r.prefix for y in r.prefix if y.p >= x.p + 2]
        assert len(r.pivots) == 2 and r.pivots[1].p >= r.pivots[0].p + 2 and r.pivots[0].f + r.pivots[1].f == min(pairs)
