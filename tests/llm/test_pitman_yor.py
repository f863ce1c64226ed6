"""The Pitman-Yor model against plain counts, its own tables by hand, the exact conditional of a seating, and held-out text."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelaudit.llm import pitman_yor as py
from modelaudit.llm.near_dup import word_hashes

SF = "/root/testdata/sf0.001"
ODD = [(None, "zeta eta THETA"), (3, None), (4, ""), (4, "  \n\t "), (5, "one"), (5, "one"), (6, "w" * 300_000), (7, "é\x00ü É É\x0bx"), (8, "lone 😀 word")]


def tokens_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(docs):
    counts = {}
    for i, text in docs:
        if not held_out(i):
            for w in tokens_of(text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in docs:
        words = tokens_of(text)
        out.append((i, held_out(i), len(words), sum(w in counts for w in words), n, sum(math.log10((counts.get(w, 0) + 1) / (n + 1 * (v + 1))) for w in words)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], round(r[5], 4))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    follow = {w: rng.sample(vocabulary, 4) for w in vocabulary}  # a word has few successors
    docs = []
    for i in range(400):
        w, words = rng.choice(vocabulary), []
        for _ in range(rng.randint(0, 120)):
            words.append(w if rng.random() < 0.97 else "new" + str(rng.randrange(10**6)))
            w = rng.choice(follow[w]) if rng.random() < 0.8 else vocabulary[int(300 * rng.random() ** 3)]
        docs.append((1000 + i, " ".join(words).capitalize() + rng.choice([".", "\n", ""])))
    return docs + ODD


def test_counts_and_layout(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "'x' AS bucket", "1 AS block", "'y' AS score")
    want = sorted(plain(corpus), key=key)
    first = None
    for rows, block in ((df.repartition(3, "text"), 1 << 20), (df.coalesce(1), 500)):
        out = py.score_documents(rows, burn=1, samples=2, block=block, per_bucket=24_000).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=key)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and -1e7 < g[6] < 0
        # blocks and partitions don't matter
        first = first or got
        assert [g[:5] for g in got] == [f[:5] for f in first] and [g[6] for g in got] == pytest.approx([f[6] for f in first])


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(60) if held_out(i)], "doc_id long, text string")
    rows = py.score_documents(df, burn=0, samples=1).collect()
    assert rows and all(r.held_out and r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in rows)
    assert py.score_documents(df.limit(0)).count() == 0


def test_scores_follow_from_the_tables(spark, corpus, monkeypatch):
    """Probabilities by hand from collected tables, and they sum to one over known words and all others."""
    monkeypatch.setattr(py, "FAN", 2)  # several rounds of merging
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    indexed = py.index(df.repartition(4), 3, 3000)
    blocks = indexed.filter("bucket < 0").count()
    assert blocks > 4
    model = py.fit(py.merge_buckets(indexed, blocks), burn=1, samples=2)
    pairs, words = {}, {}
    for row in model.buckets.collect():
        b = py.Bucket(row.asDict(), model.samples)
        at = 0
        for i, w in enumerate(b.w.words):
            words[int(w)] = b.root[:, i]
            for _ in range(b.w.pairs[i]):
                pairs[int(w), int(b.w.contexts[at])] = (int(b.w.counts[at]), float(b.tables[at]))
                assert 1 <= b.tables[at] <= b.w.counts[at]
                at += 1
    train = [tokens_of(t) for i, t in corpus if not held_out(i)]
    names = {None: int(py.END)} | {w: int(word_hashes(w.encode())[0]) for t in train for w in t if w is not None}
    seen = {}
    for t in train:
        for before, w in zip([None, *t], t):
            k = names[w], names[before] % py.CONTEXTS
            seen[k] = seen.get(k, 0) + 1
    assert {k: c for k, (c, _) in pairs.items()} == seen
    # totals are those of the tables
    last = model.samples[-1]
    assert last.customers.sum() == sum(seen.values()) and last.words == len(words) == len(names) and last.tables.sum() == last.root_customers
    for context in {c for _, c in seen}:
        back = [(1 + s.discount * s.tables[context]) / (1 + s.customers[context]) for s in model.samples]
        base = [(1 + s.root_discount * s.root_tables) / (1 + s.root_customers) for s in model.samples]
        total = 0.0
        for w, root in words.items():
            c, t = pairs.get((w, context), (0, 0))
            total += (c - last.discount * t) / (1 + last.customers[context]) + np.mean([k * (r + b / (last.words + 1)) for k, r, b in zip(back, root, base)])
        unknown = np.mean([k * b for k, b in zip(back, base)]) / (last.words + 1)
        assert total + unknown == pytest.approx(1, abs=0.02)  # averaged tables against averaged totals
    some = py.Bucket(model.buckets.first().asDict(), model.samples)
    at = np.arange(len(some.w.words))
    context = np.full(len(at), int(py.END) % py.CONTEXTS)
    for i, x in enumerate(some.log_p(at, context)):
        c, t = pairs.get((int(some.w.words[i]), int(context[0])), (0, 0))
        p = (c - last.discount * t) / (1 + last.customers[context[0]]) + np.mean([some.back[k][context[0]] * (some.root[k, i] + some.base[k]) for k in range(2)])
        assert x == pytest.approx(math.log(p))


def test_seating_is_the_exact_conditional():
    """Numbers of tables of up to eight customers, against all ways to sit, enumerated."""
    d, a, p, n = 0.6, 2.5, 0.05, 60_000
    for gain in (0.0, 0.02):
        for c in (2, 3, 5, 8):
            ways = {1: 1.0}
            for j in range(1, c):
                more: dict[int, float] = {}
                for t, x in ways.items():
                    more[t + 1] = more.get(t + 1, 0) + x * (a + d * t) * (p + gain * t)
                    more[t] = more.get(t, 0) + x * (j - d * t)
                ways = more
            got = py.seat(np.full(n, c), np.full(n, a), np.full(n, p), gain, d, np.random.default_rng(1), particles=32)
            for t, x in ways.items():
                assert (got == t).mean() == pytest.approx(x / sum(ways.values()), abs=0.012)
    large = py.seat(np.array([10**9, 10**5, 1]), np.full(3, 10.0), np.full(3, 0.3), 0.0, 0.5, np.random.default_rng(2))
    assert large[0] > large[1] > 1 == large[2]


def test_held_out_text_is_less_perplexing(spark, corpus):
    """Than under the counts alone, and than under the root alone (contexts that say nothing)."""
    df = spark.createDataFrame(corpus, "doc_id long, text string").filter("doc_id >= 1000")
    out = py.score_documents(df).cache()
    of = lambda name: py.perplexity(out, name).filter("held_out").first().perplexity
    assert of("score") < 0.5 * of("base_score")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    out = py.op13_pitman_yor(spark, SF)
    sums = out.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.count() == given.count() and sums.s > sums.b
