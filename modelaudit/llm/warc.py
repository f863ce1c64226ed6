"""WARC archives with revisit records for repeated payloads.

Headers alone (digest, length, id) are shuffled by payload digest to find the original of each repeated payload; revisit
records are joined to those originals, and archives are written with fresh headers: WARC/1.1, one gzip member a record,
``response`` records with the payload, ``revisit`` records (profile identical-payload-digest) without it. A record's file is
closed at ``archive_bytes``. Tasks write files of their own names and return their names; only those count.

Reading streams each archive (one task a file, one record in memory), then resolves revisits by joining their
``WARC-Refers-To`` to record ids.

Defined cases: a null payload is empty; a null id or URL is written as an absent field and read back as null; rows that
repeat the largest id of an equal payload are each a response, with a record id that names one of them; smaller payloads
than ``min_revisit`` are always responses; no rows give no archives and an empty result. Extra columns are ignored. A long
payload is one record of any length: writer and reader hold it whole, a few times over, and nothing else beside a batch.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.llm.storage import filesystem, materialize, new_dir, unique_name

MIN_REVISIT, ARCHIVE_BYTES, SALTS = 1000, 64 << 20, 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("0b1d5f5e-5d0f-4c57-9a38-6f2b5f1f6a10")
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, record_id string, refers_to_record string, record_type string, url string, payload_digest string, payload_bytes long, payload binary"


def headers(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``payload_digest`` (hex SHA-1), ``payload_bytes`` and ``guard``, a second hash of the payload."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), data.alias("payload"), F.sha1(data).alias("payload_digest"), F.octet_length(data).cast("long").alias("payload_bytes"), F.xxhash64(data).alias("guard"))


def originals(heads: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One row for each payload of at least ``min_revisit`` bytes that occurs more than once: the largest id, and its URL."""
    best = F.max_by(F.struct("page_id", "url"), F.struct(F.coalesce("page_id", F.lit(-(2**63))), F.coalesce("url", F.lit("")))).alias("o")
    big = heads.filter(F.col("payload_bytes") >= min_revisit)
    found = big.groupBy("payload_digest", "payload_bytes", "guard").agg(F.count("*").alias("n"), best).filter("n > 1")
    return found.select("payload_digest", "payload_bytes", "guard", F.col("o.page_id").alias("original_id"), F.col("o.url").alias("original_url"))


def resolve(heads: DataFrame, found: DataFrame) -> DataFrame:
    """Join each record to its payload's original; a hot payload is dealt over ``SALTS`` partitions."""
    keys = ["payload_digest", "payload_bytes", "guard"]
    salted = heads.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    many = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(many, [*keys, "salt"], "left")
    revisit = F.col("original_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original_id"))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("original_id")), "refers_to_url": F.when(revisit, F.col("original_url"))})


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _line(value: str) -> str:
    """Header values stay on one line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def encode(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, original: int | None, original_url: str | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member."""
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    fields += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    fields += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    fields += [f"WARC-Payload-Digest: {sha1}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}"]
        fields += [f"WARC-Refers-To-Target-URI: {_line(original_url)}"] if original_url is not None else []
        fields += [f"WARC-Refers-To-Date: {date}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``resolved`` rows below ``path``; the result is the list of archives, (path, records, bytes), which has been computed."""
    # a revisit needs no payload, so none is sent to Python
    rows = resolved.select("page_id", "url", "payload_digest", "payload_bytes", "refers_to", "refers_to_url", (F.col("record_type") == "revisit").alias("revisit"), F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)
        out, name, records = None, "", 0

        def closed() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page_id, url, digest, size, original, original_url, revisit, data = (x.as_py() for x in row)
                if out is None:
                    name, records = unique_name("archive", ".warc.gz"), 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(encode(page_id, url, digest, size, data or b"", original, original_url, revisit, date))
                records += 1
                if out.tell() >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def records(stream: object) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; holds one record at a time."""
    packed = stream.read(1 << 20)
    while packed:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not packed:
                raise ValueError("the archive ends within a record")
            parts.append(member.decompress(packed))
            packed = member.unused_data if member.eof else stream.read(1 << 20)
        packed = packed or stream.read(1 << 20)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        yield fields, rest[: int(fields["content-length"])]


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest``. Digests of payloads and blocks are verified; the length of a revisit's
    payload comes from its HTTP header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "refers_to_record", "record_type", "url", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for uri in batch["path"].to_pylist():
                store, root = filesystem(uri)
                rows, held = [], 0
                with store.open_input_stream(root, compression=None) as stream:
                    for fields, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["warc-block-digest"]:
                            raise ValueError(f"{uri}: {fields['warc-record-id']}: wrong block digest")
                        if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{uri}: {fields['warc-record-id']}: wrong payload digest")
                        page_id = fields.get("x-page-id")
                        rows.append((None if page_id is None else int(page_id), fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-type"], fields.get("warc-target-uri"), digest, length, payload if with_payload and fields["warc-type"] == "response" else None))
                        held += len(block)
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    one_each = manifest.repartition(max(1, manifest.count()), "path")
    return one_each.mapInArrow(read, RECORD)


def resolve_revisits(read: DataFrame) -> DataFrame:
    """Add ``refers_to``, the page id of the response that a revisit's ``WARC-Refers-To`` names."""
    first = read.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")).filter(F.col("refers_to").isNotNull())
    wanted = read.filter("record_type = 'revisit'").select("refers_to_record").distinct()
    names = first.join(wanted, "refers_to_record", "left_semi").dropDuplicates(["refers_to_record"])
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return read.withColumn("salt", salt(F.col("record_id"))).join(names, ["refers_to_record", "salt"], "left").drop("salt")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = headers(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = originals(heads.drop("payload"))
    manifest = write_archives(resolve(heads, found), new_dir(spark, "warc"))
    read = materialize(read_archives(manifest, with_payload=False).drop("payload"), "warc-records")
    return resolve_revisits(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to, url
FROM o
"""
