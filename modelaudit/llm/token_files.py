"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a run of zstandard frames, each of whole documents where it can be, then a skippable frame with the file's
document index, then the seek table of the zstandard seekable format (a skippable frame with compressed and decompressed
size and XXH64 checksum of every frame, and a footer at the very end). Any zstandard decoder reads the ids of a file; a
reader that wants some documents reads the footer, the seek table and the index, and decompresses only the frames that hold
them. Ids are little-endian unsigned 32-bit.

Documents are dealt to files by ranges of doc_id, so files in the order of their ranges hold all documents in ascending
order; ties are broken by the hash of the text, and rows alike in both are interchangeable. The texts are shuffled once
and encoded after that. Each task streams: it holds one frame, one batch and the index of its file.

Defined cases: a null or empty text is the end id alone; null ids come first; documents that share an id are each a row;
an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelaudit.llm.storage import filesystem, materialize, new_dir, release, unique_name
from modelaudit.llm.tokens import encoder, slices

TOKENIZER, END_ID, FRAME_BYTES, TEXT_BYTES = "word_bpe_49k.json", 2, 256 << 10, 24 << 20
# fixed values of the zstandard seekable format
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
NULL_ID = -(2**63)
MANIFEST = "file_number int, path string, n_documents long, n_ids long, least_id long, largest_id long"


class FrameWriter:
    """Writes documents to a stream; ``close`` adds the index and the seek table."""

    def __init__(self, stream: object, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.stream, self.frame_bytes, self.packer = stream, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.table = [], 0, []
        self.ids: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.held)
        for i in range(0, len(data), 4 * self.frame_bytes):  # a very long document spans frames
            part = data[i : i + 4 * self.frame_bytes]
            packed = self.packer.compress(part)
            self.stream.write(packed)
            self.table.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = zstandard.ZstdCompressor(level=3).compress(np.array(self.ids, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Random access to a file of documents. ``reads`` counts the frames that were decompressed."""

    def __init__(self, file: object) -> None:
        self.file, self.reads = file, 0
        size = file.seek(0, 2) or file.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        raw = self._at(size - 9 - 12 * n, 12 * n)
        self.table = np.frombuffer(raw, "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        where = int(self.at[n - 1])
        magic, length = struct.unpack("<II", self._at(where, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index before the seek table")
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._at(where + 8, length)), "<i8")
        self.ids, self.lengths = index[: len(index) // 2], index[len(index) // 2 :]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, where: int, n: int) -> bytes:
        self.file.seek(where)
        return self.file.read(n)

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self.reads += 1
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self._held = (k, data)
        return self._held[1]

    def document(self, n: int) -> bytes:
        """Ids of the file's n-th document."""
        start, end = 4 * int(self.starts[n]), 4 * int(self.starts[n + 1])
        k, parts = int(np.searchsorted(self.first, start, side="right")) - 1, []
        while start < end:
            data, base = self._frame(k), int(self.first[k])
            parts.append(data[start - base : end - base])
            start, k = base + len(data), k + 1
        return b"".join(parts)

    def documents(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, place of its first id in the file, ids) of the wanted documents, or of all."""
        places = range(len(self.ids)) if doc_ids is None else np.flatnonzero(np.isin(self.ids, np.array(list(doc_ids), np.int64)))
        for n in places:
            yield None if self.ids[n] == NULL_ID else int(self.ids[n]), int(self.starts[n]), self.document(int(n))


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, n_files: int | None = None) -> DataFrame:
    """Encode (doc_id, text) rows and write them below ``path`` in ascending doc_id order; the list of files is the result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if n_files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_files = max(8, -(-size // TEXT_BYTES))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n_files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        out = writer = None
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for first, part in slices(batch["text"]):
                for doc_id, ids in zip(doc_ids[first : first + len(part)], coder.encode(part), strict=True):
                    if writer is None:
                        store, root = filesystem(path)
                        store.create_dir(root, recursive=True)
                        name = unique_name("ids", ".u32.zst")
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        writer = FrameWriter(out)
                    writer.add(doc_id, ids + end)
        release()
        if writer is not None:
            writer.close()
            out.close()
            known = [x for x in writer.ids if x != NULL_ID]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((TaskContext.get().partitionId(), pa.int32()), (f"{path}/{name}", pa.string()), (len(writer.ids), pa.int64()), (sum(writer.lengths), pa.int64()), (min(known, default=None), pa.int64()), (max(known, default=None), pa.int64()))], ["file_number", "path", "n_documents", "n_ids", "least_id", "largest_id"])

    manifest = materialize(ordered.drop("tie").mapInArrow(write, MANIFEST), "token-manifest")
    # one row a file: its number of ids, not its documents
    before = Window.orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_files(files: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the files as (doc_id, start, ids); with ``doc_ids``, only those, from the files whose range can hold them."""
    if doc_ids is not None:
        files = files.filter(F.exists(F.lit(sorted(doc_ids)), lambda x: x.between(F.col("least_id"), F.col("largest_id")))) if doc_ids else files.limit(0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary()}
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
        for batch in batches:
            for uri, before in zip(batch["path"].to_pylist(), batch["ids_before"].to_pylist(), strict=True):
                store, root = filesystem(uri)
                rows, size = [], 0
                with store.open_input_file(root) as file:
                    for doc_id, start, ids in FrameReader(file).documents(doc_ids):
                        rows.append((doc_id, before + start, ids))
                        size += len(ids)
                        if size > 4 << 20 or len(rows) >= 4000:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    return files.select("path", "ids_before").repartition(max(1, files.count()), "path").mapInArrow(read, "doc_id long, start long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_files(docs, TOKENIZER, new_dir(spark, "token-files"))
    return read_files(files).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
