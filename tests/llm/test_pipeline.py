"""The pipeline's stages against brute force on a small corpus."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from modelaudit.llm.quality import held_out
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def packed_as_plain(out, texts):
    """Pieces against plain encoding; places without gaps or overlaps; as few sequences as can be, but for one."""
    tok, ends = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(r.length for r in out) // 2048) + 1


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    items = [_words(rng, 30) for _ in range(3)]
    rows, labels = [], []
    for i in range(300):
        text = _words(rng, rng.randint(20, 60))
        bad = i % 4 == 0
        rows.append((i, "menu home\n" + (text if not bad else " ".join(x + "***" for x in text.split())), "en", "site", 0))
        labels.append((i, int(not bad), 0))
    rows += [(300, rows[1][1], "en", "site", 0), (301, rows[2][1] + " more", "en", "site", 0), (302, "menu home\n" + _words(rng, 9) + " " + items[0], "en", "site", 0), (303, None, "en", None, None), (304, "", "en", "other", 0)]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        kept.write.parquet(f"{sf}/{name}")
        kept = spark.read.parquet(f"{sf}/{name}")
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in kept.collect()}
    unseen = {r.doc_id for r in docs.filter(held_out(F.col("doc_id"))).collect() if r.doc_id < 300}
    assert {i for i in seen["quality"] if i in unseen} == {i for i in unseen if i % 4}
    assert all(not (r.text or "").startswith("menu") for r in seen["lines"].values()) and len(seen["lines"]) == len(seen["quality"])
    assert seen["lines"][1].n_chars == len(seen["lines"][1].text)
    assert set(seen["lines"]) - set(seen["near_duplicates"]) == {300, 301}
    assert set(seen["near_duplicates"]) - set(seen["benchmarks"]) == {302}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(seen["benchmarks"])
    assert len({(r.doc_id, r.piece) for r in out}) == len(out)
    packed_as_plain(out, {i: r.text for i, r in seen["benchmarks"].items()})


def test_copies_are_no_boilerplate(spark):
    """A source of which a third is copies and near copies: one of each group stays, with its whole text."""
    rng = random.Random(21)
    exact = "\n".join(_words(rng, 12) for _ in range(8))
    near = [_words(rng, 12) for _ in range(20)]
    texts = ["menu home\n" + _words(rng, 40) for _ in range(60)]
    texts += [exact] * 20 + ["\n".join([*near[:5], f"{near[5]} edit{k}", *near[6:]]) for k in range(10)]
    df = spark.createDataFrame([(i, t, "en", "site", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.line_stage(spark, df, "").cache()
    got = {r.doc_id: r.text for r in corpus_pipeline.near_dup_stage(spark, lines, "").collect()}
    assert lines.count() == 90 and set(got) == {*range(60), 60, 80}
    assert got[60] == exact and got[80] == texts[80]
    assert all(got[i] == texts[i].split("\n")[1] for i in range(60))


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Repeated and missing ids, nulls in every column, empty texts, a long text, other columns with clashing names; labels that
    make the classifier let all pass."""
    rng = random.Random(33)
    a, b, c = (_words(rng, 40) for _ in range(3))
    item = _words(rng, 30)
    long = "\n".join(_words(rng, 12) for _ in range(4000))
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (3, None), (3, ""), (None, None), (4, long), (5, long + " end"), (6, "x " + item), (None, item), (7, "one two"), (8, "one two")]
    df = spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None, "x", 1.0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score string, digest double")
    sf = str(tmp_path)
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50, 90)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = [(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, sf).collect()]
    left = [(1, a), (1, b), (None, c), (3, None), (3, ""), (None, None), (4, long), (7, "one two")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {}
    for i, _, n in out:
        total[i] = total.get(i, 0) + n
    want = {}
    for i, t in left:
        want[i] = want.get(i, 0) + len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert total == want


def test_empty_tables_pass_all_stages(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
