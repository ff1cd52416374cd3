"""WARC archives as a chunked record table.

``write_archives`` writes one WARC record per row, compressed as a gzip member of its own, a file (or several of
bounded size) per task;
``read_chunks`` streams them back as (record id, chunk number) rows of bounded size, each with the digest of
the payload so far, so no task ever holds a whole payload of an archive in memory.

Equal payloads of at least ``min_revisit`` bytes are written once: the smallest id is the response and
the others are revisit records naming it; records that share the smallest id are all responses. Nulls: a null payload
is empty, a null url is written as an empty target; a record with a null id is always a response, and none refers to it.
Repeated ids give a record each. Very long payloads are written and read a chunk at a time. Other columns are left out,
whatever their names. Empty tables give no files.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skytile.session import scratch, ship, stored

CHUNK_BYTES = 1 << 20
FILE_BYTES = 256 << 20
MIN_REVISIT = 100

CHUNK_SCHEMA = "record_id long, chunk_no int, is_last boolean, record_type string, refers_to long, url string, payload_bytes long, sha256_so_far string, stated_digest string, stated_bytes long, chunk binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """record_id, url, payload, digest, record_type, refers_to; one row for each row of ``pages``.

    Digests that occur once need no partner, so only repeated digests are joined back. The rows' side of
    that join may be split where one digest is hot; what is grouped is pre-aggregated in each task.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    firsts = (
        rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
        .agg(F.min("record_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    )
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("record_id") != F.col("first_id"))
    return joined.select(
        "record_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _open_out(path: str):
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path)
    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(local)


def open_in(path: str):
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path)
    return system.open_input_stream(local)


def _header(record_id, url: str, kind: str, refers_to, digest: str, length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:skytile:{'' if record_id is None else record_id}>", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:skytile:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of ``plan_records`` as WARC files below ``path``; a manifest row per finished file.

    Only files named by the manifest count, so a lost or repeated task leaves no half-written record behind.
    """

    def write(batches):
        out, name, size, count = None, None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, size, count = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open_out(name)
                text, member = r["payload"], zlib.compressobj(1, zlib.DEFLATED, 31)

                def put(raw):
                    nonlocal size
                    size += len(raw)
                    out.write(raw)

                put(member.compress(_header(r["record_id"], r["url"], r["record_type"], r["refers_to"], r["digest"], r["payload_bytes"])))
                if r["record_type"] != "revisit":
                    for at in range(0, len(text), CHUNK_BYTES):
                        put(member.compress(text[at : at + CHUNK_BYTES].encode()))
                put(member.compress(b"\r\n\r\n") + member.flush())
                count += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

    return stored(records.mapInArrow(write, "file string, records long, bytes long"), "manifest")


def _read_file(path: str, chunk_bytes: int):
    """Rows of one archive, a chunk each; holds one buffer of ``chunk_bytes`` and a header at a time."""
    with open_in(path) as stored_file, gzip.GzipFile(fileobj=stored_file) as raw:
        buffer, at = b"", 0

        def need(n: int) -> bool:
            """Have n bytes from ``at`` on in the buffer, if there are as many."""
            nonlocal buffer, at
            if len(buffer) - at < n:
                parts, have = [buffer[at:]], len(buffer) - at
                while have < n and (more := raw.read(chunk_bytes)):
                    parts.append(more)
                    have += len(more)
                buffer, at = b"".join(parts), 0
            return len(buffer) - at >= n

        while need(1):
            while (end := buffer.find(b"\r\n\r\n", at)) < 0:
                if not need(len(buffer) - at + 1):
                    raise ValueError(f"{path}: a header has no end")
            head = dict(x.split(": ", 1) for x in buffer[at:end].decode().split("\r\n")[1:])
            at = end + 4
            left, digest, done, number = int(head["Content-Length"]), hashlib.sha256(), 0, 0
            rid, refers = head["WARC-Record-ID"][13:-1], head.get("WARC-Refers-To")
            same = (int(rid) if rid else None, head["WARC-Type"], int(refers[13:-1]) if refers else None, head["WARC-Target-URI"])
            while True:
                size = min(left, chunk_bytes)
                if not need(size):
                    raise ValueError(f"{path}: a record is cut short")
                chunk = buffer[at : at + size]
                at += size
                left -= size
                done += size
                digest.update(chunk)
                yield (same[0], number, left == 0, same[1], same[2], same[3], done, digest.hexdigest(), head["WARC-Payload-Digest"][7:], int(head["X-Payload-Length"]), chunk)
                number += 1
                if not left:
                    break
            if not need(4) or buffer[at : at + 4] != b"\r\n\r\n":
                raise ValueError(f"{path}: no end of record")
            at += 4


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """The archives of a manifest as chunk rows (``CHUNK_SCHEMA``); ``payload=False`` leaves the bytes out."""
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    kinds = pa.schema([("record_id", pa.int64()), ("chunk_no", pa.int32()), ("is_last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("sha256_so_far", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("chunk", pa.binary())])

    def read(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for row in _read_file(path, chunk_bytes):
                    rows.append(row if payload else (*row[:-1], None))
                    held += len(row[-1]) if payload else 0
                    if len(rows) >= 2000 or held >= 8 * chunk_bytes:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = manifest.select("file")
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(read, CHUNK_SCHEMA).select(*names)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk, whose running digest is the payload's; stated values are checked."""
    last = chunks.where("is_last")
    full = F.col("record_type") == "revisit"
    checked = F.when(full | (F.col("sha256_so_far") == F.col("stated_digest")), F.col("stated_digest")).otherwise(F.raise_error(F.lit("payload digest differs")))
    return last.select("record_id", "url", "record_type", "refers_to", F.when(full, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), checked.alias("payload_digest"))


def op5_warc_chunks(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(plan_records(pages), f"{scratch(spark)}/warc")
    return records(read_chunks(manifest, payload=False)).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha256(b) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.first_id is not null and f.first_id <> d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id <> d.page_id then f.first_id end as refers_to
from d left join f using (payload_digest)
"""
