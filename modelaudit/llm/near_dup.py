"""Near-duplicate documents: an LSH forest proposes, full shingle sets decide.

1. Each document becomes its set of word shingles; documents with the same set are one class from then on, so exact
   copies cost one row each and no pairs.
2. A forest of ``TREES`` signature orders over the classes: a tree sorts classes by its own run of minhash values. Classes
   that share the first two values of a tree are a region; regions over ``REGION`` classes go one value deeper, again and
   again, down to the tree's depth, where what is still larger is dealt into parts of about ``REGION``. Within a region, all
   classes are compared by their whole signatures. What looks alike enough (well below the wanted similarity) becomes a
   loose link.
   Going deeper parts classes that differ in one value, so regions of step 2 that are over ``REGION`` and hold more than one
   loose group are then compared whole: all pairs of classes of different groups, in pairs of parts of about ``PART``. So
   every pair that shares the first two values of any tree is compared. That grows with the square of such a region.
3. Loose links are joined to loose groups. A pair over the threshold lies within one loose group even if the two were
   never neighbours, as long as a chain of neighbours leads from one to the other.
4. Within a loose group all pairs are decided on full sets: the group is dealt into blocks of about ``BLOCK`` classes, each
   pair of blocks is one group of at most two blocks in a task, products of incidence matrices give all intersections,
   and only links that join parts of the group not yet joined there are returned. Components of those links are exact
   within the group.

Similarity: 100 * intersection >= 75 * union over sets of distinct shingles of five words (``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased). A text with fewer words has one shingle, the whole sequence; one without words, or null, has none and is
linked with nothing. Shingles are compared by 64-bit hashes.

Defined cases: a null doc_id takes part, never names a component (``component_id`` is the least id that is not null; null
if there is none) and is not kept unless its component has no id; rows that repeat an id are rows of their own; ``kept``
is true where doc_id equals component_id, so each row that repeats the least id is kept (``one_of_each`` keeps one alone);
other columns are ignored, whatever their names; empty tables give empty results. A text is hashed ``CHUNK`` bytes at a time;
what is held for it grows by about 40 bytes a word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm.components import connected_components
from modelaudit.llm.storage import groups, materialize, release

SHINGLE, PERCENT = 5, 75
TREES, DEPTH, BASE_DEPTH = 16, 8, 2
REGION, PART, LOOSE, BLOCK = 128, 512, 0.60, 96
SIGNATURE = TREES * DEPTH

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 2**32, SIGNATURE, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, SIGNATURE, dtype=np.uint32)[:, None]
_BYTE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte multiplier and of its inverse, ``n`` of each."""
    back = np.uint64(pow(int(_BYTE), -1, 2**64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BYTE, back))


CHUNK = 1 << 18
with np.errstate(over="ignore"):
    _POWERS = _power_table(CHUNK)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: bytes, chunk: int = CHUNK) -> np.ndarray:
    """A 64-bit hash of each word of a text, ``chunk`` bytes at a time; a chunk ends after white space."""
    data, out, first = np.frombuffer(text, np.uint8), [], 0
    while first < len(data):
        last = min(first + chunk, len(data))
        if last < len(data):
            blank = np.flatnonzero(_SPACE[data[first:last]])
            if len(blank):
                last = first + int(blank[-1]) + 1
            else:  # a word longer than a chunk
                blank = _BLANK.search(text, last)
                last = blank.end() if blank else len(data)
        out.append(_hash_words(data[first:last]))
        first = last
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hash_words(data: np.ndarray) -> np.ndarray:
    """Hashes of whole words, all by array operations: prefix sums of byte * multiplier ** place."""
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _POWERS if len(data) <= CHUNK else _power_table(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if len(words) == 0:
        return words
    if len(words) < size:
        total = np.uint64(len(words))
        for k, w in enumerate(words):
            total = _mix(np.array([total ^ (w * _WORD[k])]))[0]
        return np.array([total], np.uint64)
    n = len(words) - size + 1
    total = words[:n] * _WORD[0]
    for k in range(1, size):
        total += words[k : n + k] * _WORD[k]
    return np.unique(_mix(total))


def signature(sets: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` minhash values of a set."""
    low = ((sets >> np.uint64(32)) ^ sets).astype(np.uint32)[None, :]
    best = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for i in range(0, low.shape[1], 1024):
        np.minimum(best, (low[:, i : i + 1024] * _MULTIPLY + _ADD).min(axis=1), out=best)
    return best


SKETCH = "doc_id long, text_hash long, n_shingles long, digest binary, regions array<long>, signature binary"


def sketch(docs: DataFrame) -> DataFrame:
    """One row for each document: size and 128-bit digest of its set, the region it has in each tree, its signature (a byte
    of each value; values of the first two levels are whole in the region's hash)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            salt = _mix(np.arange(1, TREES + 1, dtype=np.uint64))
            for batch in batches:
                n, digest, regions, signs = [], [], [], []
                for text in batch["text"]:
                    found = shingles(text.as_py())
                    n.append(len(found))
                    if len(found):
                        values = signature(found)
                        first = values.reshape(TREES, DEPTH)[:, :BASE_DEPTH].astype(np.uint64)
                        digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                        regions.append(_mix(_mix(salt + first[:, 0]) + first[:, 1]).view(np.int64))
                        signs.append((values & 0xFF).astype(np.uint8).tobytes())
                    else:
                        digest.append(None), regions.append(None), signs.append(None)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regions, pa.list_(pa.int64())), pa.array(signs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "regions", "signature"])
        release()

    return docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash")).mapInArrow(make, SKETCH)


def text_hash(text: Column) -> Column:
    """With the id it tells rows apart that repeat an id, or have none; null texts have one of their own."""
    return F.xxhash64(text)


class Union:
    """Sets of what has been joined so far, by union with path halving."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x: object) -> object:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def join(self, a: object, b: object) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def loose_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between digests of classes that stand next to each other in an order and look alike."""
    rows = classes.select("digest", F.posexplode("regions").alias("tree", "region"))
    placed = []
    for depth in range(BASE_DEPTH, DEPTH + 1):
        counts = rows.groupBy("tree", "region").count().filter("count > 1")
        found = rows.join(counts, ["tree", "region"])
        if depth == BASE_DEPTH:
            found = found.join(classes.select("digest", "signature"), "digest")
        found = materialize(found, f"forest-{depth}")
        deep = F.col("count") > REGION
        if depth == DEPTH:
            # such classes agree in a whole tree; parts are dealt anew in each tree, so other trees link the parts of this one
            part = F.pmod(F.xxhash64("digest", "tree"), F.ceil(F.col("count") / REGION))
            placed.append(found.withColumn("region", F.when(deep, F.xxhash64("region", part)).otherwise(F.col("region"))).drop("count"))
            break
        placed.append(found.filter(~deep).drop("count"))
        value = F.substring("signature", F.col("tree") * DEPTH + depth + 1, F.lit(1))
        rows = found.filter(deep).select("digest", "tree", F.xxhash64("region", value).alias("region"), "signature")
        if not found.filter(deep).limit(1).count():
            break
    alive = placed[0]
    for more in placed[1:]:
        alive = alive.unionByName(more)
    order = F.substring("signature", F.col("tree") * DEPTH + 1, F.lit(DEPTH))
    alive = alive.withColumn("order", order).repartition("tree", "region").sortWithinPartitions("tree", "region", "order", "signature", "digest")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, tail = Union(), None
        for batch in batches:
            digest = batch["digest"].to_pylist()
            region = np.stack([batch["tree"].to_numpy().astype(np.int64), batch["region"].to_numpy()], axis=1)
            signs = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            if tail is not None:
                digest, region, signs = tail[0] + digest, np.vstack([tail[1], region]), np.vstack([tail[2], signs])
            new = 0 if tail is None else len(tail[0])
            a_out, b_out = [], []
            first, gap = np.arange(len(digest)), 0
            while len(first):
                gap += 1
                first = first[first + gap < len(digest)]
                first = first[(region[first] == region[first + gap]).all(axis=1)]  # regions are runs: who has no such neighbour has none beyond
                same = first[first + gap >= new]
                alike = same[(signs[same] == signs[same + gap]).mean(axis=1) >= LOOSE]
                for i in alike.tolist():
                    a, b = digest[i], digest[i + gap]
                    if joined.join(a, b):
                        a_out.append(min(a, b)), b_out.append(max(a, b))
            last = int(np.argmax((region == region[-1]).all(axis=1)))  # the last region may go on
            tail = (digest[last:], region[last:], signs[last:])
            if a_out:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})

    return alive.select("digest", "tree", "region", "signature").mapInArrow(link, "a binary, b binary").distinct()


def completing_links(classes: DataFrame, loose: DataFrame) -> DataFrame | None:
    """Loose links between loose groups that share a region over ``REGION`` classes; None if there is no such region."""
    rows = classes.select("digest", F.posexplode("regions").alias("tree", "region"))
    labels = loose.select(F.col("node").alias("digest"), "label")
    large = materialize(rows.groupBy("tree", "region").count().filter(F.col("count") > REGION), "near-dup-large")
    if not large.limit(1).count():
        return None
    inside = rows.join(large, ["tree", "region"]).join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    inside = materialize(inside, "near-dup-inside")
    mixed = inside.groupBy("tree", "region").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("tree", "region")
    members = inside.join(mixed, ["tree", "region"]).join(classes.select("digest", "signature"), "digest")
    parts = F.ceil(F.col("count") / PART).cast("int")
    members = members.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("digest"), parts).cast("int")})
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("pair", F.xxhash64("tree", "region", F.least("part", "other"), F.greatest("part", "other")))
    dealt = dealt.select("pair", "part", "digest", "label", "signature").repartition("pair").sortWithinPartitions("pair", "part", "digest")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "pair"):
            nodes, part = table["digest"].to_pylist(), table["part"].to_numpy()
            signs = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            label = np.unique(np.array([x.hex() for x in table["label"].to_pylist()]), return_inverse=True)[1]
            across, a_out, b_out = part[0] != part[-1], [], []
            for i in range(len(nodes) - 1):
                apart = label[i + 1 :] != label[i]
                at = np.flatnonzero(apart & (part[i + 1 :] != part[i]) if across else apart) + i + 1
                for j in at[np.count_nonzero(signs[at] == signs[i], axis=1) >= LOOSE * SIGNATURE].tolist():
                    if label[i] != label[j]:
                        label[label == label[j]] = label[i]
                        a_out.append(min(nodes[i], nodes[j])), b_out.append(max(nodes[i], nodes[j]))
            if a_out:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})

    return dealt.mapInArrow(link, "a binary, b binary").distinct()


def _links_of_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets over the threshold; with both sides present, only pairs across sides."""
    sizes = np.array([len(x) for x in sets])
    m = len(sets)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    common = np.bincount(where) > 1
    keep = common[where]
    column = (np.cumsum(common) - 1)[where[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((m, m), np.float32)
    width = 4096
    for first in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        block = np.zeros((m, width), np.float32)
        block[owner[lo:hi], column[lo:hi] - first] = 1
        shared += block @ block.T
    shared = np.rint(shared).astype(np.int64)
    linked = np.triu(100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared), 1)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    yield from zip(*(x.tolist() for x in np.nonzero(linked)), strict=True)


def confirmed_links(docs: DataFrame, classes: DataFrame, loose: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between classes of one loose group that hold on full sets: enough of them to join all that are joined."""
    sizes = loose.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = loose.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(classes.select(F.col("digest").alias("node"), "first"), "node")
    keyed = docs.select(F.col("doc_id").alias("_id"), "text", text_hash(F.col("text")).alias("_hash"))
    texts = members.join(keyed, F.col("first.doc_id").eqNullSafe(F.col("_id")) & (F.col("first.text_hash") == F.col("_hash")))
    texts = texts.groupBy("label", "node", "block", "blocks").agg(F.first("text").alias("text"))  # rows alike in id and text are one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = texts.select("label", "node", "text", "block", other)
    dealt = dealt.withColumn("pair", F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other")))
    dealt = dealt.select("pair", "label", "block", "node", "text").repartition("pair").sortWithinPartitions("pair", "label", "block", "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            a_out, b_out = [], []
            for table in groups(batches, "pair"):
                held: dict[bytes, tuple[int, np.ndarray]] = {}
                for node, block, text in zip(table["node"].to_pylist(), table["block"].to_pylist(), table["text"].to_pylist(), strict=True):
                    if node not in held:
                        held[node] = (block, shingles(text))
                if len(held) < 2:
                    continue
                nodes, joined = list(held), Union()
                side = np.array([b for b, _ in held.values()])
                for i, j in _links_of_sets([s for _, s in held.values()], side != side[0], percent):
                    if joined.join(i, j):
                        a_out.append(min(nodes[i], nodes[j])), b_out.append(max(nodes[i], nodes[j]))
                if len(a_out) > 5000:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})
                    a_out, b_out = [], []
            if a_out:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})
        release()

    return dealt.mapInArrow(confirm, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, component) for each row of ``docs`` (doc_id, text). ``component`` is
    the least digest of a set in the component, null for a text without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(sketch(docs), "near-dup-sketch")
    some = rows.filter("digest is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = some.groupBy("digest").agg(first.alias("first"), F.min("signature").alias("signature"), F.min("regions").alias("regions"))
    classes = materialize(classes, "near-dup-classes")
    links = materialize(loose_links(classes), "near-dup-loose")
    loose = connected_components(links, "near-dup-groups")
    more = completing_links(classes, loose)
    if more is not None:
        more = materialize(more, "near-dup-more")
        if more.limit(1).count():
            loose = connected_components(links.unionByName(more), "near-dup-groups")
    exact = materialize(confirmed_links(docs, classes, loose, percent), "near-dup-links")
    labels = connected_components(exact, "near-dup-components")
    named = classes.select("digest", "first.doc_id").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("label", "digest")).drop("label")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(least, "component").select("digest", "component", "component_id"), "near-dup-named")
    out = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "component")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the least id (then of the least hash of its text; rows without an id
    come last), and all rows without words. Of rows alike in id and text any one may stay."""
    found = materialize(near_duplicates(docs, percent).filter("component is not null").select("doc_id", "text_hash", "component"), "near-dup-rows")
    same = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    groups_of = same.groupBy("component").agg(F.sum("n").alias("all"), F.min_by(F.struct("doc_id", "text_hash", "n"), order).alias("stays")).filter("all > 1")
    groups_of = materialize(groups_of, "near-dup-stays")
    gone = same.join(groups_of.select("component", "stays"), "component").filter(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))))
    again = groups_of.filter("stays.n > 1").select("stays.doc_id", "stays.text_hash")
    marked = gone.select("doc_id", "text_hash", F.lit(False).alias("_again")).unionByName(again.withColumn("_again", F.lit(True)))
    marked = materialize(marked.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), "near-dup-marked")
    on = docs["doc_id"].cast("long").eqNullSafe(marked["_id"]) & (text_hash(docs["text"].cast("string")) == marked["_hash"])
    # what goes grows with the documents, so it is shuffled at every size; hashed, so that texts are not sorted
    rest = docs.join(marked.hint("shuffle_hash"), on, "left_anti")
    if not marked.filter("_again").limit(1).count():
        return rest
    repeated = docs.join(marked.filter("_again").hint("shuffle_hash"), on, "left_semi")
    return rest.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).drop("text_hash", "component")
