"""Log probabilities of documents under a hierarchical Pitman-Yor model of words.

Model. A word follows the word before it. Previous words are hashed to ``CONTEXTS`` classes, each a restaurant; the restaurants
share one parent, the root, a restaurant of words alone; and the root's base is uniform over the words of the training documents and
one more, which stands for every other. So probabilities sum to one over known words and the unknown. In a restaurant the customers of a word sit at tables, and each table is one
customer of the parent. With c customers and t tables of a word (C and T in all), discount d and strength s,
P(word) = (c - d * t + (s + d * T) * P_parent(word)) / (s + C). Discounts are estimated from counts of counts.

Seating. Gibbs sweeps: the customers of a word in a restaurant all leave, and are seated again, one after another, given all other
tables (their own tables leave the root, too): an own table's probability follows from the number of tables so far.
``PARTICLES`` seatings are drawn so, and one is kept with probability in proportion to its weight (the product of the
normalisers passed), which turns sequential draws into draws from the conditional. A pair with one customer has one table
always. Beyond ``LEAP`` customers, some are seated at once (a 32nd of those who sit), with one probability. The root is
seated in the same way. Totals of restaurants are those after the sweep before. After ``BURN`` sweeps the tables of ``SAMPLES``
sweeps are kept, and the predictive probabilities of the samples are averaged.

Layout. Documents are read in blocks of about ``BLOCK`` bytes. A block sorts its tokens by word and context and deals them to
buckets of words by hash, as packed arrays: words, their contexts, and the block's documents in which each pair stands. So a word
has all its contexts in one bucket, and a bucket learns counts, seatings and root by itself. Blocks of a bucket are merged in
trees of ``FAN`` rows, so a very common word is merged piece by piece; its pairs are as many as there are contexts, at most. What
buckets share is the totals of ``CONTEXTS`` restaurants: of fixed size, these go through the driver. Scoring joins each bucket with its
blocks' tokens again (in groups of ``FAN`` blocks), and adds up by document. The number of buckets grows with the text to the power
3/4, as distinct pairs grow more slowly than tokens.

Words are 64-bit hashes. Draws are seeded by bucket and sweep, and arrays are in the order of hashes, so results don't depend on how
rows are dealt to tasks.

Defined cases: a null text is an empty one, which has the end token alone; a null id is no held-out one; rows that repeat an id are
documents of their own; a document longer than a block is a block by itself, held with about 60 bytes a token; without training
documents every token is the unknown word, of probability 1; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm.near_dup import word_hashes
from modelaudit.llm.storage import materialize, release

CONTEXTS, BLOCK, FAN, PER_BUCKET = 65_536, 8 << 20, 1024, 12 << 20
BURN, SAMPLES, PARTICLES, LEAP, STRENGTH, SEED = 2, 3, 4, 32, 1.0, 42
END = np.uint64(0x9E3779B97F4A7C15)  # the end token, in place of a word's hash
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=1)
def _codecs() -> tuple:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """An array's bytes by place in the value, compressed: high bytes of sorted or small numbers are nearly nothing."""
    return _codecs()[0].compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(_codecs()[1].decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"].cast(pa.binary()), strict=True):
            ids.append(doc_id.as_py()), texts.append(text.as_py() or b"")
            held += len(texts[-1]) + 1
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


INDEX = "block long, bucket int, ids array<string>, held array<boolean>, sizes array<long>, words binary, pairs binary, contexts binary, trained binary, tokens binary, docs binary"


def _index_block(ids: list, texts: list[bytes], buckets: int, block: int) -> pa.RecordBatch:
    data = (b" " + b" ".join(texts)).lower()
    space = _SPACE[np.frombuffer(data, np.uint8)]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    first = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    sizes = np.diff(np.searchsorted(start, first))
    doc_of = np.repeat(np.arange(len(ids)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    is_word = np.ones(len(doc_of), bool)
    is_word[ends] = False
    word = np.full(len(doc_of), END)
    word[is_word] = word_hashes(data)
    context = (np.concatenate([[END], word[:-1]]) & np.uint64(CONTEXTS - 1)).astype(np.uint16)
    held = np.array([_held_out(i) for i in ids])
    order = np.argsort(context, kind="stable")
    order = order[np.argsort(word[order], kind="stable")]
    word, context, doc_of = word[order], context[order], doc_of[order]
    new_word = np.append(True, word[1:] != word[:-1])
    new_pair = new_word | np.append(True, context[1:] != context[:-1])
    pair_at, pair_of = np.flatnonzero(new_pair), np.cumsum(new_pair) - 1
    trained = np.bincount(pair_of, ~held[doc_of], len(pair_at)).astype(np.uint32)
    tokens = np.diff(np.append(pair_at, len(word))).astype(np.uint32)
    word_at = np.flatnonzero(new_word)
    pairs = np.diff(np.append(pair_of[word_at], len(pair_at))).astype(np.uint32)
    bucket = ((word[word_at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    columns: dict[str, list] = {x.split()[0]: [None] for x in INDEX.split(", ")}
    columns |= {"block": [block], "bucket": [-1], "ids": [[None if i is None else str(i) for i in ids]], "held": [held.tolist()], "sizes": [(sizes + 1).tolist()]}
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        p0, p1 = pair_of[word_at[lo]], pair_of[word_at[hi]] if hi < len(word_at) else len(pair_at)
        k0, k1 = word_at[lo], word_at[hi] if hi < len(word_at) else len(word)
        columns["block"].append(block), columns["bucket"].append(int(bucket[lo]))
        for name, x in (("words", word[word_at[lo:hi]]), ("pairs", pairs[lo:hi]), ("contexts", context[pair_at[p0:p1]]), ("trained", trained[p0:p1]), ("tokens", tokens[p0:p1]), ("docs", doc_of[k0:k1].astype(np.uint32))):
            columns[name].append(pack(x))
        for name in ("ids", "held", "sizes"):
            columns[name].append(None)
    kinds = {"block": pa.int64(), "bucket": pa.int32(), "ids": pa.list_(pa.string()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def index(docs: DataFrame, buckets: int, size: int = BLOCK) -> DataFrame:
    """Blocks of documents (bucket -1: their ids) and, by bucket, the block's words (hash, number of pairs), pairs (context, training
    tokens, tokens), and the document of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, (ids, texts) in enumerate(_blocks(batches, size)):
            yield _index_block(ids, texts, buckets, (task << 32) + n)
        release()

    return materialize(docs.mapInArrow(run, INDEX), "py-index")


class Words(NamedTuple):
    """Words in the order of their hash, with numbers of pairs, and the pairs' contexts and counts in order."""

    words: np.ndarray
    pairs: np.ndarray
    contexts: np.ndarray
    counts: np.ndarray


def _only_trained(part: Words) -> Words:
    seen = part.counts > 0
    pairs = np.bincount(np.repeat(np.arange(len(part.words)), part.pairs), seen, len(part.words)).astype(np.uint32)
    some = pairs > 0
    return Words(part.words[some], pairs[some], part.contexts[seen], part.counts[seen])


def merge_words(parts: Sequence[Words]) -> Words:
    words = np.unique(np.concatenate([p.words for p in parts]))
    key = np.concatenate([np.repeat(np.searchsorted(words, p.words), p.pairs) * CONTEXTS + p.contexts for p in parts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
    counts = np.concatenate([p.counts for p in parts])[order]
    counts = np.add.reduceat(counts, first) if len(first) else counts
    return Words(words, np.bincount(key[first] // CONTEXTS, minlength=len(words)).astype(np.uint32), (key[first] % CONTEXTS).astype(np.uint16), counts)


_BUCKET = "words binary, pairs binary, contexts binary, counts binary"
_KINDS = (np.uint64, np.uint32, np.uint16, np.int64)


def _unpack_words(row: dict) -> Words:
    return Words(*(unpack(row[name], kind) for name, kind in zip(Words._fields, _KINDS, strict=True)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch[name][i].as_py() for name in batch.schema.names}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def merge_buckets(indexed: DataFrame, blocks: int) -> DataFrame:
    """(bucket, part, words ...): one row a bucket, merged in rounds of ``FAN`` rows at most."""
    rows = indexed.filter("bucket >= 0").select("bucket", F.col("block").alias("part"), "words", "pairs", "contexts", F.col("trained").alias("counts"))
    schema, first = f"bucket int, part long, {_BUCKET}", True
    while True:
        groups = max(1, -(-blocks // FAN))

        def run(batches: Iterator[pa.RecordBatch], raw: bool = first) -> Iterator[pa.RecordBatch]:
            key, held, size = None, [], 0
            for row in _rows(batches):
                if (row["bucket"], row["part"]) != key:
                    if key:
                        yield _batch(schema, [(*key, *map(pack, merge_words(held)))])
                    key, held, size = (row["bucket"], row["part"]), [], 0
                if raw:
                    part = Words(*(unpack(row[n], k) for n, k in zip(Words._fields, (*_KINDS[:3], np.uint32), strict=True)))
                    part = _only_trained(part._replace(counts=part.counts.astype(np.int64)))
                else:
                    part = _unpack_words(row)
                held.append(part)
                if sum(len(p.contexts) for p in held) > 2 * size + (1 << 19):  # merged when it has doubled
                    held = [merge_words(held)]
                    size = len(held[0].contexts)
            if key:
                yield _batch(schema, [(*key, *map(pack, merge_words(held)))])
            release()

        dealt = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long"))
        rows = materialize(dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, schema), "py-buckets")
        if groups == 1:
            return rows
        blocks, first = groups, False


def seat(c: np.ndarray, a: np.ndarray, p: np.ndarray, gain: float, d: float, rng: np.random.Generator, particles: int = PARTICLES) -> np.ndarray:
    """Numbers of tables for words with ``c`` customers each (most first). With t tables a new one has the weight
    (a + d * t) * (p + gain * t) and the others j - d * t, where j customers sit."""
    best, key = np.ones(len(c)), np.full(len(c), -np.inf)
    for _ in range(particles):
        t, weight, j = np.ones(len(c)), np.zeros(len(c)), 1
        while n := int(np.searchsorted(-c, -j, side="left")):  # those with more than j customers
            m = max(1, j // LEAP)
            steps, x = np.minimum(m, c[:n] - j), t[:n]
            new = (a[:n] + d * x) * (p[:n] + gain * x)
            norm = new + (j - d * x)
            weight[:n] += steps * np.log(norm)
            x += rng.random(n) * norm < new if m == 1 else rng.binomial(steps, new / norm)
            j += m
        weight += rng.gumbel(size=len(c))
        better = weight > key
        best[better], key[better] = t[better], weight[better]
    return best


class Totals(NamedTuple):
    """What all buckets share: customers and tables of each context (of a sweep), of the root, discounts, words."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float
    discount: float
    root_discount: float
    words: int


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else 0.5


def _sum_contexts(table: DataFrame, *names: str) -> list[np.ndarray]:
    """Sums of arrays by place: ``CONTEXTS`` numbers each."""
    out = [np.zeros(CONTEXTS) for _ in names]
    rows = table.select(F.posexplode(F.arrays_zip(*names)).alias("at", "x")).groupBy("at").agg(*[F.sum(f"x.{n}").alias(n) for n in names])
    for r in rows.collect():
        for x, n in zip(out, names, strict=True):
            x[r["at"]] = r[n]
    return out


_FEW = "bucket int, ones binary, many binary, contexts binary, counts binary, tables binary, root_tables binary, sum_tables binary, samples binary, root_samples binary, in_contexts array<long>, root_customers long, all_root_tables long"


def first_tables(buckets: DataFrame) -> tuple[DataFrame, Totals]:
    """One table for each pair and one root table for each word. A bucket's row keeps what sweeps change: pairs with two customers or
    more (contexts, counts, tables, ``many`` of each word); of the others only how many each word has (``ones``)."""
    schema = f"{_FEW}, customers array<long>, single array<long>, found array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            w = _unpack_words(row)
            several = w.counts > 1
            many = np.bincount(np.repeat(np.arange(len(w.words)), w.pairs), several, len(w.words)).astype(np.uint32)
            ones, k = w.pairs - many, int(several.sum())
            sums = lambda x, of: np.bincount(of, x, CONTEXTS).astype(np.int64).tolist()
            found = [len(w.words), int((w.counts == 1).sum()), int((w.counts == 2).sum()), int((w.pairs == 1).sum()), int((w.pairs == 2).sum())]
            yield _batch(schema, [(
                row["bucket"], pack(ones), pack(many), pack(w.contexts[several]), pack(w.counts[several]), pack(np.ones(k, np.uint32)), pack(np.ones(len(w.words), np.uint32)), pack(np.zeros(k, np.uint32)), pack(np.empty(0, np.uint32)),
                pack(np.empty(0, np.uint32)), sums(np.ones(k), w.contexts[several]), len(w.contexts), len(w.words), sums(w.counts, w.contexts), sums(np.ones(len(w.contexts) - k), w.contexts[~several]), found,
            )])

    first = materialize(buckets.mapInArrow(run, schema), "py-tables")
    customers, single, tables = _sum_contexts(first, "customers", "single", "in_contexts")
    n = first.agg(*[F.coalesce(F.sum(F.get("found", F.lit(i))), F.lit(0)).alias(f"n{i}") for i in range(5)], F.coalesce(F.sum("root_customers"), F.lit(0)).alias("c")).first()
    totals = Totals(customers, single + tables, float(n["c"]), float(n["n0"]), _discount(n["n1"], n["n2"]), _discount(n["n3"], n["n4"]), n["n0"])
    return first.drop("customers", "single", "found"), totals._replace(tables=np.stack([single, tables]).sum(axis=0))


def sweep(tables: DataFrame, totals: Totals, number: int, keep: bool, seed: int = SEED) -> tuple[DataFrame, Totals]:
    """Seat everybody anew, pairs and then the root; with ``keep`` the tables count as a sample."""
    shared = tables.sparkSession.sparkContext.broadcast(totals)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, s = shared.value, STRENGTH
        d, d0, room, base = total.discount, total.root_discount, s + total.root_customers, 1 / (total.words + 1)
        for row in _rows(batches):
            ones, many, contexts, c, t, root = (unpack(row[n], k) for n, k in (("ones", np.uint32), ("many", np.uint32), ("contexts", np.uint16), ("counts", np.int64), ("tables", np.uint32), ("root_tables", np.uint32)))
            of = np.repeat(np.arange(len(ones)), many)
            rng = np.random.default_rng([seed, number, row["bucket"]])
            others = ones[of] + np.bincount(of, t, len(ones))[of] - t  # the word's customers of the root without this pair's
            stay = np.where(others > 0, np.minimum(root[of], others), 1)
            p = np.maximum(others - d0 * stay + (s + d0 * total.root_tables) * base, -d0) / room
            order = np.argsort(-c, kind="stable")
            now = np.empty(len(c), np.uint32)
            now[order] = seat(c[order], (s + d * (total.tables[contexts] - t))[order], p[order], 1 / room, d, rng)
            customers = ones + np.bincount(of, now, len(ones)).astype(np.int64)
            order = np.argsort(-customers, kind="stable")
            top = np.empty(len(ones), np.uint32)
            top[order] = seat(customers[order], s + d0 * (total.root_tables - root[order]), np.full(len(ones), base), 0.0, d0, rng)
            kept = [unpack(row[n], np.uint32) for n in ("sum_tables", "samples", "root_samples")]
            if keep:
                kept = [kept[0] + now, np.concatenate([kept[1], customers.astype(np.uint32)]), np.concatenate([kept[2], top])]
            yield _batch(_FEW, [(
                row["bucket"], row["ones"], row["many"], row["contexts"], row["counts"], pack(now), pack(top), *map(pack, kept),
                np.bincount(contexts, now, CONTEXTS).astype(np.int64).tolist(), int(customers.sum()), int(top.sum()),
            )])

    before, = _sum_contexts(tables, "in_contexts")
    after = materialize(tables.mapInArrow(run, _FEW), "py-tables")
    now, = _sum_contexts(after, "in_contexts")
    root = after.agg(F.coalesce(F.sum("root_customers"), F.lit(0)).alias("c"), F.coalesce(F.sum("all_root_tables"), F.lit(0)).alias("t")).first()
    return after, totals._replace(tables=totals.tables - before + now, root_customers=float(root["c"]), root_tables=float(root["t"]))


class Model(NamedTuple):
    buckets: DataFrame  # counts of words and pairs, with the samples' tables
    samples: list[Totals]


def fit(buckets: DataFrame, burn: int = BURN, samples: int = SAMPLES, seed: int = SEED) -> Model:
    tables, totals = first_tables(buckets)
    kept = []
    for n in range(burn + samples):
        tables, totals = sweep(tables, totals, n, n >= burn, seed)
        if n >= burn:
            kept.append(totals)
    return Model(buckets.drop("part").join(tables.select("bucket", "sum_tables", "samples", "root_samples"), "bucket"), kept)


class Bucket:
    """A bucket's part of the model, to look pairs up."""

    def __init__(self, row: dict | None, samples: Sequence[Totals]) -> None:
        empty = [np.empty(0, k) for k in _KINDS]
        self.samples, self.w = samples, _unpack_words(row) if row else Words(*empty)
        of = np.repeat(np.arange(len(self.w.words)), self.w.pairs)
        self.keys = of * CONTEXTS + self.w.contexts
        tables = np.ones(len(of))
        if row:
            tables[self.w.counts > 1] = unpack(row["sum_tables"], np.uint32) / len(samples)
        self.tables, self.counts = tables, np.bincount(of, self.w.counts, len(self.w.words))
        shape = (len(samples), len(self.w.words))
        customers, top = (unpack(row[n], np.uint32).reshape(shape) if row else np.zeros(shape) for n in ("samples", "root_samples"))
        self.root = np.stack([(customers[i] - s.root_discount * top[i]) / (STRENGTH + s.root_customers) for i, s in enumerate(samples)])
        self.back = np.stack([(STRENGTH + s.discount * s.tables) / (STRENGTH + s.customers) for s in samples])  # to the root, by context
        self.base = np.array([(STRENGTH + s.root_discount * s.root_tables) / (STRENGTH + s.root_customers) / (s.words + 1) for s in samples])

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words, and the training count of each."""
        at = np.searchsorted(self.w.words, words)
        known = np.zeros(len(words), bool)
        inside = at < len(self.w.words)
        known[inside] = self.w.words[at[inside]] == words[inside]
        at = np.where(known, at, -1)
        return at, np.where(known, np.append(self.counts, 0)[at], 0)

    def log_p(self, at: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Natural logarithms of averaged probabilities of words (by place; -1: not known) after contexts."""
        key = np.where(at >= 0, at * CONTEXTS + contexts, -1)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        met = (self.keys[place] == key) if len(self.keys) else np.zeros(len(key), bool)
        s = self.samples[0]
        own = np.zeros(len(key))
        own[met] = (self.w.counts[place[met]] - s.discount * self.tables[place[met]]) / (STRENGTH + s.customers[contexts[met]])
        root = np.hstack([self.root, np.zeros((len(self.root), 1))])
        own += sum(self.back[i][contexts] * root[i][at] for i in range(len(self.back))) / len(self.back)
        return np.log(own + self.base @ self.back[:, contexts] / len(self.back))


def score_documents(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES, block: int = BLOCK, per_bucket: int = PER_BUCKET, seed: int = SEED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all ``docs``, trained on those not held out."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    indexed = index(docs, max(1, int(np.ceil((size / per_bucket) ** 0.75))), block)
    blocks = indexed.filter("bucket < 0").count()
    model = fit(merge_buckets(indexed, blocks), burn, samples, seed)
    spark = docs.sparkSession
    shared, groups = spark.sparkContext.broadcast(model.samples), -(-max(blocks, 1) // FAN)
    last = model.samples[-1]
    n_train, n_words = int(last.customers.sum()), last.words
    least = float(np.log10(n_train + 1 * (n_words + 1)))

    # a bucket's model comes before its blocks; each group of blocks has it once
    known = model.buckets.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(-1).cast("long").alias("block"), "words", "pairs", "contexts", "counts", "sum_tables", "samples", "root_samples", F.lit(None).cast("binary").alias("tokens"), F.lit(None).cast("binary").alias("docs"))
    asked = indexed.filter("bucket >= 0").select("bucket", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("part"), "block", "words", "pairs", "contexts", "tokens", "docs")
    both = known.unionByName(asked, allowMissingColumns=True).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "block")
    partial = "block long, bucket int, known binary, base binary, score binary"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket = None, None
        for row in _rows(batches):
            if (row["bucket"], row["part"]) != key:
                key, bucket = (row["bucket"], row["part"]), Bucket(row if row["block"] < 0 else None, shared.value)
            if row["block"] < 0:
                continue
            words, pairs, contexts, tokens, doc = (unpack(row[n], k) for n, k in (("words", np.uint64), ("pairs", np.uint32), ("contexts", np.uint16), ("tokens", np.uint32), ("docs", np.uint32)))
            at, count = bucket.look_up(words)
            of = np.repeat(np.arange(len(words)), pairs)
            log_p = bucket.log_p(at[of], contexts) / np.log(10)
            each = np.repeat(of, tokens)
            base = np.log10(count + 1) - least
            sums = [np.bincount(doc, x) for x in (count[each] > 0, base[each], np.repeat(log_p, tokens))]
            yield _batch(partial, [(row["block"], row["bucket"], pack(sums[0].astype(np.uint32)), pack(sums[1]), pack(sums[2]))])
        release()

    names = indexed.filter("bucket < 0").select("block", "bucket", "ids", "held", "sizes")
    rows = names.unionByName(both.mapInArrow(score, partial), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "bucket")
    out = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sums = None, []

        def done() -> pa.RecordBatch:
            known, base, score = sums
            return _batch(out, list(zip(head["ids"], head["held"], head["sizes"], known.astype(int).tolist(), base.tolist(), score.tolist(), strict=True)))

        for row in _rows(batches):
            if row["bucket"] < 0:
                if head:
                    yield done()
                head, sums = row, [np.zeros(len(row["ids"])) for _ in range(3)]
            else:
                for total, (name, kind) in zip(sums, (("known", np.uint32), ("base", np.float64), ("score", np.float64)), strict=True):
                    part = unpack(row[name], kind)
                    total[: len(part)] += part
        if head:
            yield done()

    scored = rows.mapInArrow(add_up, out)
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame, score: str = "score", by: Callable | str = "held_out") -> DataFrame:
    """(held_out, perplexity): a token's, by group."""
    return scored.groupBy(by).agg(F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens")).alias("perplexity"))


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
