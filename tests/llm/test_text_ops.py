"""Operators on documents against brute force on small tables with nulls, empty and long texts, ties, repeated rows and
clashing extra columns."""

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelaudit.llm import decontam, licenses, line_dedup, near_dup, packing, quality, token_files, tokens
from modelaudit.llm.storage import new_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = [f"'x' AS {c}" for c in ("score", "label", "salt", "text_hash", "digest", "rank", "n_lines", "host", "`_id`", "tie", "`_log_chars`", "kept", "`drop`")]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 60)
    near = base.split()
    near[40] = "changed"
    out = [base, base, " ".join(near), base.upper(), None, "", "   ", "one two", "one two", "a b c d e", words(rng, 20_000), "Released under the MIT License. mit license MIT LICENSE", "the GNU General  Public\nLicense, version 3"]
    out += [words(rng, rng.randint(1, 80)) for _ in range(40)] + ["x   y \n z", "it's <|endoftext|> naïve ﬁ 😀 12 3²", "trailing \n", "\n\n lead"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated ids, null ids, repeated rows."""
    return spark.createDataFrame([(None, "a b c d e f g"), (None, None), (1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other text of one id here now"), (2, "a b c d e f g")], "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_plain_encoding(texts, name):
    coder, plain = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    more = ["a   b", " \n", "\n ", "a \nb", "don't stop", "ÀÉÎ×÷ßİı", "\x1ca \x1c b", "\x85 a", "﻿abc ﻿", "日本 語", "a\n\n b  c", "é ́x"]
    every = [x or "" for x in texts] + more
    for t in every:
        assert list(np.frombuffer(coder.encode(pa.array([t]))[0], "<u4")) == plain.encode(t, add_special_tokens=False).ids, t[:50]
    parts = list(tokens.slices(pa.array([None, *every]), 50))
    assert [first for first, _ in parts] == np.cumsum([0] + [len(x) for _, x in parts])[:-1].tolist() and len(parts) > 20
    assert [x for _, part in parts for x in coder.encode(part)] == [b""] + coder.encode(pa.array(every))
    tokens.KNOWN_BYTES, before = 2000, tokens.KNOWN_BYTES
    try:
        assert [x for _, part in parts for x in coder.encode(part)] == [b""] + coder.encode(pa.array(every))
        assert coder.known.nbytes < 1 << 20
    finally:
        tokens.KNOWN_BYTES = before


def test_plan_fills_every_slot():
    rng = np.random.default_rng(1)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(rng.integers(1, 65, 5000), return_counts=True), strict=True)} | {64: 3000}
    ends, counts = {}, dict.fromkeys(histogram, 0)
    spots = []
    for length, r0, r1, s0, offset in packing.plan(histogram, 64):
        assert r0 == counts[length]
        counts[length] = r1
        spots += [(s0 + i, offset, length) for i in range(r1 - r0)]
    assert counts == histogram
    for s, offset, length in sorted(spots):
        assert ends.get(s, 0) == offset
        ends[s] = offset + length
    assert max(ends.values()) <= 64
    least = sum(a * b for a, b in histogram.items()) / 64
    assert len(ends) <= 1.01 * least + 1


def test_pack(spark, docs, texts, odd):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), seq_len=256)
    rows = packed.placed.collect()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.length for r in mine] == packing.cut_lengths(len(ids), 256)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 256
    made = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert made == by
    assert packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).placed.count() == 6
    assert packing.pack(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).placed.count() == 0


def test_token_files(spark, docs, texts, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    files = token_files.write_files(docs, path, new_dir(spark, "t"), n_files=3)
    got, start = {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read_files(files).collect()}, 0
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert got[i] == (start, ids)
        start += len(ids) // 4
    some = {r.doc_id: bytes(r.ids) for r in token_files.read_files(files, [0, 10, 999]).collect()}
    assert some == {i: got[i][1] for i in (0, 10)}
    many = token_files.read_files(token_files.write_files(odd, path, new_dir(spark, "t"))).collect()
    assert sorted(str(r.doc_id) for r in many) == ["1", "1", "1", "2", "None", "None"]
    assert token_files.read_files(token_files.write_files(empty(spark), path, new_dir(spark, "t"))).count() == 0


def test_frames_are_read_alone_and_checked(tmp_path):
    import zstandard

    with open(tmp_path / "a", "wb") as f:
        w = token_files.FrameWriter(f, frame_bytes=400)
        docs = [np.arange(n, dtype="<u4").tobytes() for n in (5, 90, 3, 2000, 0, 7)]
        for i, d in enumerate(docs):
            w.add(i, d)
        w.close()
    raw = (tmp_path / "a").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(docs)
    with open(tmp_path / "a", "rb") as f:
        r = token_files.FrameReader(f)
        assert [x[2] for x in r.documents([5])] == [docs[5]]
        assert r.reads == 1 < len(r.table) - 1
        assert [x[2] for x in r.documents()] == docs
    (tmp_path / "b").write_bytes(raw[:20] + bytes([raw[20] ^ 1]) + raw[21:])
    with open(tmp_path / "b", "rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FrameReader(f).documents())


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(sets))]


def test_near_duplicates(spark, docs, texts, odd):
    sets, labels = brute_components(texts)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), labels[i], labels[i] == i)
    rows = sorted(((str(r.doc_id), r.component_id, r.kept, r.n_shingles) for r in near_dup.near_duplicates(odd).collect()), key=str)
    assert rows == [("1", 1, True, 3)] * 3 + [("2", 1, False, 3), ("None", 1, False, 3), ("None", None, True, 0)]
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_words_are_hashed_alike_in_chunks():
    rng = random.Random(6)
    text = (words(rng, 4000) + "\n\n" + "x" * 3000 + " \t" + words(rng, 50) + " ").encode()
    with np.errstate(over="ignore"):
        whole = near_dup.word_hashes(text)
        assert len(whole) == len(text.split()) and len(set(whole.tolist())) == len(set(text.split()))
        for chunk in (1, 7, 100, 2999, 3000, 10_000):
            assert (near_dup.word_hashes(text, chunk) == whole).all()
        giant = b"y" * (near_dup.CHUNK + 5)
        assert near_dup.word_hashes(giant + b" end")[1] == near_dup.word_hashes(b"end")[0] and len(near_dup.word_hashes(giant)) == 1


def test_one_of_each(spark):
    """Repeated and missing ids: one row of each component stays, and no text is lost with another's id."""
    a, b, c, d = ("a b c d e f g", "h i j k l m n o", "p q r s t u v", "w x y z q q1 q2 q3")
    rows = [(0, a), (1, a), (1, b), (None, a), (2, c), (2, c), (2, c + " "), (None, d), (None, d), (None, d + "\n"), (3, None), (3, None), (None, ""), (4, b), (5, "w1 w2")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, component int").selectExpr("*", "'x' AS `_again`", "'y' AS stays")
    left = near_dup.one_of_each(df)
    assert left.columns == df.columns
    sets = [shingle_set(t) for _, t in rows]
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    kept = [shingle_set(t) for _, t in got]
    assert sorted(map(sorted, (s for s in kept if s))) == sorted(map(sorted, {s for s in sets if s}))
    assert {(0, a), (1, b), (5, "w1 w2")} <= set(got) and sum(t is None for _, t in got) == 2 and (None, "") in got and {i for i, t in got if t and t.startswith("p")} == {2}
    assert near_dup.one_of_each(df.limit(0)).count() == 0


def test_near_duplicates_of_a_large_spread_group(spark):
    """Copies with many random edits: links are few and lie on both sides of the threshold."""
    rng = random.Random(9)
    base = words(rng, 120).split()
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    _, labels = brute_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == dict(enumerate(labels))


def brute_licenses(text):
    """Labels and score by going through all places of all templates."""
    w, out = text.split(), {}
    for n, (template, label) in enumerate([*licenses.PHRASES.items(), *licenses.NOTICES.items()]):
        t, places = template.split(), {}
        for p in range(len(w) - 1):
            for q in range(len(t) - 1):
                if w[p : p + 2] == t[q : q + 2]:
                    places.setdefault(p - q, set()).add(q)
        if n < len(licenses.PHRASES):
            if any(len(x) == len(t) - 1 for x in places.values()):
                out[label] = 1.0
            continue
        runs, last = [], None
        for diagonal in sorted(d for d, x in places.items() if len(x) >= 2):
            if last is None or diagonal - last > licenses.NEAR_DIAGONAL:
                runs.append(set())
            runs[-1] |= {q + k for q in places[diagonal] for k in (0, 1)}
            last = diagonal
        best = max((len(x) / len(t) for x in runs), default=0)
        if best >= licenses.SHARE:
            out[label] = max(best, out.get(label, 0))
    return ",".join(sorted(out)), max(out.values(), default=0.0)


def test_licenses(spark, docs, texts, odd):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(p, x) for p in range(len(w)) for k, x in phrases.items() if tuple(w[p : p + len(k)]) == k]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits})) and 0 <= r.score <= 1
    assert got[11].labels == "mit,mit-notice"
    broken = spark.createDataFrame([(1, "this work is now licensed under the gnu general public license version 3")], "doc_id long, text string")
    assert licenses.scan(broken).first().labels == "gpl,gpl-3.0"  # a word put in: two diagonals are merged
    rng = random.Random(14)
    texts = []
    for text in licenses.NOTICES:
        w = text.split()
        for gone in range(0, len(w), 3):
            texts.append(" ".join(words(rng, 4).split() + w[:gone] + w[gone + 1 :] + words(rng, 3).split()))  # a word left out
            texts.append(" ".join(w[:gone] + words(rng, 2).split() + w[gone:]))  # words put in
            texts.append(" ".join(w[: len(w) - gone]))  # the end left out
            texts.append(" ".join(x if i % 3 else "zz" for i, x in enumerate(w)))
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_licenses(t)
        assert (found[i].labels, round(found[i].score, 9)) == (labels, round(score, 9)), t
    assert {"mit-text", "bsd-text", "mpl-2.0"} <= {x for r in found.values() for x in r.labels.split(",")} and "" in {r.labels for r in found.values()}
    assert licenses.scan(odd).count() == 6 and licenses.scan(empty(spark)).count() == 0


def test_line_dedup(spark, docs):
    rows = [(i, "a" if i < 20 else None, f"own line {i}\n  menu \n\nmenu\nrest {i}" if i % 3 == 0 else f"alone {i}") for i in range(30)] + [(98, "a", None), (99, "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' AS `drop`", "1 AS n_lines", "2 AS host")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, ratio=0.2, min_pages=3).collect()}
    assert got[0].clean_text == "own line 0\n\nrest 0" and got[0].n_dropped == 2 and got[0].n_lines == 5
    assert got[1].clean_text == "alone 1" and got[21].clean_text == "own line 21\n\nrest 21"
    assert got[98].clean_text is None and got[99].clean_text == ""
    small = spark.createDataFrame([(i, h, f"menu\nown {h} {i}") for h, n in (("four", 4), ("five", 5)) for i in range(n)], "doc_id long, source string, text string")
    dropped = {(r.source, r.n_dropped) for r in line_dedup.drop_boilerplate(small).collect()}
    assert dropped == {("four", 0), ("five", 1)} and line_dedup.MIN_PAGES == 5  # on fewer pages a line is no boilerplate
    # rows that repeat an id count each, as in the SQL
    again = spark.createDataFrame([(i // 6, "h", f"menu\nown {i // 6}") for i in range(24)] + [(50 + i, "h", f"page {i}\nmenu") for i in range(9)] + [(7, None, None), (8, "h", "")], "doc_id long, source string, text string")
    con = duckdb.connect()
    con.register("documents", again.toPandas())
    want = sorted(map(str, con.execute(f"SELECT doc_id, n_lines, n_dropped FROM ({line_dedup.SQL})").fetchall()))
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped)) for r in line_dedup.drop_boilerplate(again).collect()) == want and want[0] == "(0, 2, 2)"
    assert line_dedup.drop_boilerplate(empty(spark)).count() == 0
    assert line_dedup.drop_boilerplate(docs).count() == docs.count()


def test_decontamination(spark, docs, odd):
    rng = random.Random(5)
    items = [words(rng, n) for n in (14, 25, 40, 5)]
    swapped = items[1].split()
    swapped[4], swapped[17] = "zzz", "yyy"
    near = " ".join(swapped)
    loose = items[2].split()
    loose[::2] = ["q"] * 20
    rows = [(0, words(rng, 50)), (1, words(rng, 9) + " " + items[0].upper() + "! " + words(rng, 5)), (2, near), (3, " ".join(loose)), (4, None), (5, ""), (6, items[3]), (7, words(rng, 30) + " " + " ".join(items[2].split()[5:30]) + " " + words(rng, 9)), (None, items[0]), (1, words(rng, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shift", "2 AS item", "3 AS `_id`")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(9, items[0]), (10, None), (11, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.overlaps(df.select("doc_id", "text"), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (6, 3), (7, 2), (None, 0)}
    assert got[1, 0].matched == 14 and got[1, 0].first_word == 9 and got[2, 1].matched == 23 and got[7, 2].matched == 25
    kept = decontam.decontaminate(df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "3", "4", "5"] and kept.columns == df.columns
    again = decontam.overlaps(df.union(df).select("doc_id", "text"), bench).collect()
    assert len(again) == len(got)  # rows that repeat an id and text have one result
    long = spark.createDataFrame([(1, words(rng, 60_000) + " " + items[2] + " " + words(rng, 60_000))], "doc_id long, text string")
    assert [(r.item_id, r.first_word) for r in decontam.overlaps(long, bench).collect()] == [(2, 60_000)]
    assert decontam.overlaps(docs.select("doc_id", "text"), bench).count() == 0 and decontam.overlaps(odd, spark.createDataFrame([(7, "a b c d e f g")], "item_id long, text string")).count() == 3
    assert decontam.overlaps(empty(spark), bench).count() == 0
    assert decontam.overlaps(df, bench.limit(0)).count() == 0


def test_rules_of_a_printed_tree():
    text = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 1 <= 2.0)\n      Predict: 0.0\n     Else (feature 1 > 2.0)\n      Predict: 1.0\n    Else (feature 0 > 1.5)\n     Predict: 1.0\n"
    a, b = quality.STATISTICS[:2]
    assert set(quality.tree_rules(text)) == {((a, True, 1.5),), ((a, True, 1.5), (b, True, 2.0)), tuple(sorted([(a, True, 1.5), (b, False, 2.0)])), ((a, False, 1.5),)}


def test_quality(spark, docs):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        w = words(rng, rng.randint(5, 60))
        rows.append((i, w if good else " ".join(x + "$$$" for x in w.split())))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, label int")
    model = quality.fit(df, marks.filter(~quality.held_out(F.col("doc_id"))))
    assert 0 < len(model.rules) < 60
    got = quality.score_documents(df, model).join(marks, "doc_id").filter(quality.held_out(F.col("doc_id")) & F.col("label").isNotNull())
    assert got.filter("predicted = label").count() >= 0.97 * got.count() > 50
    # the compiled rules against plain Python, on values of the statistics read off the texts
    spoken = {r.doc_id: r.score for r in quality.score_documents(df, model).collect()}
    for i, text in rows:
        values = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
        total = model.base + sum(weight for rule, weight in model.rules if all((values[n] <= t) if below else (values[n] > t) for n, below, t in rule))
        assert spoken[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
    # lasso: at the optimum no rule's gradient is larger than the penalty, and those in use have just that
    penalty, known = 0.01, {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    lasso = quality.fit(df, marks.filter(~quality.held_out(F.col("doc_id"))), penalty=penalty)
    held = {r.doc_id: r.score for r in quality.score_documents(df, lasso).collect()}
    for rule, weight in lasso.rules:
        fits = {i: float(all((v[n] <= t) if below else (v[n] > t) for n, below, t in rule)) for i, text in rows if i in known for v in [dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))]}
        slope = sum((held[i] - known[i]) * fits[i] for i in known) / len(known)
        assert slope == pytest.approx(-math.copysign(penalty, weight), abs=2e-3)
    repeated = quality.score_documents(df.limit(5).union(df.limit(5)), model)
    assert repeated.count() == 10 and repeated.groupBy("doc_id").agg(F.count_distinct("score").alias("n")).filter("n > 1").count() == 0
    more = quality.score_documents(docs, model)
    assert more.count() == docs.count() and more.filter("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in quality.score_documents(df.limit(3), quality.fit(df, marks.limit(0))).collect()} == {0.5}
    assert quality.score_documents(df.limit(0), model).count() == 0


def test_near_duplicates_that_agree_in_whole_trees(spark):
    """More classes than a region holds share all values of a tree."""
    rng = random.Random(12)
    base = words(rng, 1500).split()
    texts = [" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]) for k in range(0, 1500, 5)] + [words(rng, 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 300: 300}


def test_no_accepted_overlap_is_without_a_seed():
    for n in range(decontam.SPAN, decontam.WINDOW + 1):  # shorter texts have masks of all their words
        masks = [[i for i, x in enumerate(m) if x == "1"] for m in (decontam.MASKS if n == decontam.WINDOW else decontam.SHORT_MASKS)]
        for equal in itertools.product((False, True), repeat=n):
            if sum(equal) >= math.ceil(n * decontam.SHARE):
                assert any(all(equal[i + j] for j in m) for m in masks for i in range(n - m[-1])), equal


def test_decontamination_equals_a_seedless_search(spark, monkeypatch):
    rng = random.Random(8)
    items = [words(rng, n).split() for n in (10, 11, 12, 13, 15, 30, 1, 4, 5, 9)]
    rows = [[], *items[6:], items[7] + ["more"], items[8][:4]]
    for item in items:
        for gone in itertools.combinations(range(min(len(item), 15)), 1 if len(item) < 10 else 2 if len(item) < 15 else 3):
            rows.append([f"x{i}" if i in gone else w for i, w in enumerate(item)])
        rows += [item[1:], item[:-1], item[2:], item[:-2], item[2:-1]]
    rows = [r if k % 2 or k < 7 else words(rng, 3).split() + r + words(rng, 4).split() for k, r in enumerate(rows)]
    want = {}
    for d, r in enumerate(rows):
        for b, item in enumerate(items):
            width = min(len(item), decontam.WINDOW)
            for shift in range(-len(item), len(r)):
                equal = [0 <= shift + j < len(r) and r[shift + j] == w for j, w in enumerate(item)]
                if len(item) < decontam.SPAN:
                    if all(equal) and (len(item) >= decontam.LEAST or len(r) == len(item)):
                        want[d, b] = len(item)
                elif max(sum(equal[i : i + width]) for i in range(len(item) - width + 1)) >= math.ceil(width * decontam.SHARE):
                    want[d, b] = max(sum(equal), want.get((d, b), 0))
    docs = spark.createDataFrame([(d, " ".join(r)) for d, r in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(b, " ".join(x)) for b, x in enumerate(items)], "item_id long, text string")
    for limit in (decontam.BROADCAST_BYTES, 0):  # broadcast, shuffled
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
        got = {(r.doc_id, r.item_id): r.matched for r in decontam.overlaps(docs, bench).collect()}
        assert got == want and len(want) > 800
    assert {b for _, b in want} == set(range(len(items)))
    con = duckdb.connect()
    for name, df in (("documents", docs.withColumn("x", F.lit(1))), ("benchmark", bench)):
        con.register(name, df.toPandas())
    assert {(d, b): m for d, b, m in con.execute(f"SELECT doc_id, item_id, matched FROM ({decontam.SQL})").fetchall()} == want  # the SQL finds them, too


def test_near_duplicates_that_share_a_template(spark):
    """Thousands of different texts at a similarity of 0.5 for their template; isolated pairs at 0.77."""
    rng = random.Random(31)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, texts = own(71), []
    for _ in range(2000):
        common = own(20)
        texts += [" ".join(template + common + own(13)) for _ in range(2)]
    a, b, c = (shingle_set(texts[i]) for i in (0, 1, 2))
    assert 0.75 <= len(a & b) / len(a | b) < 0.78 and 0.49 < len(a & c) / len(a | c) < 0.52
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert {i for i in got if got[i] != i - i % 2} == set()


def test_pairs_that_part_below_a_large_region_are_linked(spark):
    """200 classes share one region of one tree and part at its next value; two of them are alike."""
    rng = np.random.default_rng(5)
    signs = rng.integers(0, 256, (200, near_dup.SIGNATURE), dtype=np.uint8)
    signs[:, 2] = np.arange(200)
    signs[150, 33:] = signs[20, 33:]
    rows = [(bytes([i]) * 16, [7, *(1000 * i + t for t in range(1, near_dup.TREES))], x.tobytes()) for i, x in enumerate(signs)]
    classes = spark.createDataFrame(rows, "digest binary, regions array<long>, signature binary")
    loose = spark.createDataFrame([], "node binary, label binary")
    assert near_dup.loose_links(classes).count() == 0
    assert [tuple(map(bytes, r)) for r in near_dup.completing_links(classes, loose).collect()] == [(rows[20][0], rows[150][0])]
