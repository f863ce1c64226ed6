"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

Documents are encoded once into pieces (only documents longer than a sequence are cut), and the pieces are written. The
histogram of piece lengths has at most ``seq_len`` rows whatever the corpus, so it goes to the driver, where best-fit
decreasing runs over counts: a step places one length into all sequences of one remaining capacity at once. The plan is a
table of slots: "pieces of length L with rank r0 to r1 go to sequences s0, s0+1, ... at this offset". Documents take the
slots by joining on their rank within their length. Ranks need no sort: each task numbers the pieces of each length as it
writes them, and a running count over (length, task) adds what came before. The join is on (length, group of ranks), as
wide as it needs to be, so that no task holds all pieces of a common length.

Defined cases: a null or empty text is one piece of the end id; documents that share an id, or have none, are packed each
by itself; an empty table gives an empty result; other columns are ignored. A sequence's offsets have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.llm.storage import materialize, release
from modelaudit.llm.tokens import encoder, slices

TOKENIZER, SEQ_LEN, END_ID, RANK_GROUP = "byte_bpe_50k.json", 2048, 0, 512
PIECE = "doc_id long, piece int, start long, length long, ids binary, task int, local_rank long"


class Packed(NamedTuple):
    """``pieces`` has the ids (little-endian unsigned 32-bit), ``placed`` where each piece goes; (length, task, local_rank) joins them."""

    pieces: DataFrame
    placed: DataFrame


def cut_lengths(length: int, seq_len: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, and the rest first."""
    if length <= seq_len:
        return [length]
    return [x for x in [length % seq_len] if x] + [seq_len] * (length // seq_len)


def encode_pieces(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for first, part in slices(batch["text"]):
                rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "task", "local_rank")}
                for doc_id, ids in zip(doc_ids[first : first + len(part)], coder.encode(part), strict=True):
                    ids, start = ids + end, 0
                    for n, length in enumerate(cut_lengths(len(ids) // 4, seq_len)):
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        for k, v in zip(rows, (doc_id, n, start, length, ids[4 * start : 4 * (start + length)], task, rank), strict=True):
                            rows[k].append(v)
                        start += length
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))
        release()

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, PIECE)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end of ranks, first sequence, offset) for each run of slots.

    Sequences of equal filling are one range of numbers. A step either uses up a length (which may split one range) or fills
    a whole range, so ranges number at most three a length and slots are few, however many documents there are.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> ranges of sequences
    made = 0

    def place(length: int, rank: int, first: int, n: int, capacity: int) -> None:
        slots.append((length, rank, rank + n, first, seq_len - capacity))
        if capacity > length:
            room.setdefault(capacity - length, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = min((c for c in room if c >= length), default=None)
            if capacity is None:
                # new sequences, as many as it takes when each is filled with this length
                n = max(1, left // (seq_len // length))
                place(length, rank, made, n, seq_len)
                made += n
            else:
                first, n = room[capacity].pop()
                if not room[capacity]:
                    del room[capacity]
                if n > left:
                    room.setdefault(capacity, []).append((first + left, n - left))
                    n = left
                place(length, rank, first, n, capacity)
            rank, left = rank + n, left - n
    return slots


def pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> Packed:
    """Pack (doc_id, text) rows. ``placed``: doc_id, piece, start, length, ids_crc32, sequence_id, offset and the join key."""
    spark = docs.sparkSession
    pieces = materialize(encode_pieces(docs, tokenizer, seq_len, end_id), "pack-pieces")
    by_task = pieces.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = materialize(by_task.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "pack-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # seq_len rows at most
    slots = spark.createDataFrame(plan(histogram, seq_len), "length long, r0 long, r1 long, s0 long, offset long")
    # a slot run of many ranks is listed under each group of ranks that it touches
    slots = slots.withColumn("rank_group", F.explode(F.sequence(F.expr(f"r0 div {RANK_GROUP}"), F.expr(f"(r1 - 1) div {RANK_GROUP}"))))
    slots = slots.groupBy("length", "rank_group").agg(F.array_sort(F.collect_list(F.struct("r0", "r1", "s0", "offset"))).alias("slots"))
    keys = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank")
    # counts grow with the tasks, so they are never broadcast
    ranked = keys.join(by_task.select("length", "task", "before").hint("merge"), ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local_rank")).withColumn("rank_group", F.expr(f"rank div {RANK_GROUP}"))
    found = F.filter("slots", lambda x: (x["r0"] <= F.col("rank")) & (F.col("rank") < x["r1"]))
    placed = ranked.join(slots, ["length", "rank_group"]).withColumn("slot", F.get(found, F.lit(0)))
    placed = placed.withColumns({"sequence_id": F.col("slot.s0") + F.col("rank") - F.col("slot.r0"), "offset": F.col("slot.offset")})
    return Packed(pieces, placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "task", "local_rank"))


def sequences(packed: Packed) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), doc_ids in order of offset."""
    rows = packed.placed.join(packed.pieces.select("length", "task", "local_rank", "ids"), ["length", "task", "local_rank"])
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = rows.groupBy("sequence_id").agg(inside.alias("p"))  # seq_len pieces at most
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, TOKENIZER).placed.drop("task", "local_rank")
