"""Token ids in Simple-8b files: a selector in the top four bits of a 64-bit word says how many ids share the rest.

File layout: blocks one after another, then a footer (Arrow tables of the blocks and of the documents) and
its length. A block holds up to ``BLOCK`` ids: its words, then its escaped ids (60 bits or wider) as whole
words, to which a word with selector 0 points. Block offsets let a reader decode blocks independently, and
all words of one selector are decoded together.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skytile.llm.tokens import default_vocabulary, encoder
from skytile.llm.warc import _open_out, open_in
from skytile.session import scratch, ship, stored

BLOCK = 4096
#: Ids after which a task begins another file, so that a footer's rows are bounded.
FILE_IDS = 1 << 26
#: (ids in a word, bits of each) for selectors 1 to 14; selector 0 is the escape.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([1, *[n for n, _ in PACKINGS], 1], np.int64)
_SHIFT = np.uint64(60)
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
_LOW = np.uint64((1 << 60) - 1)


def encode_blocks(blocks: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, escaped ids) of each row of a zero-padded uint64 matrix; all rows advance together, a word at a time."""
    n, width = blocks.shape
    values = np.concatenate([blocks, np.zeros((n, 60), np.uint64)], axis=1)
    bits = _BITS[values.astype(np.uint16)] if values.max(initial=0) < 1 << 16 else np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    wide = bits > 60
    best = np.zeros((n, width), np.int8)
    most, span = bits, 1  # the widest of the next `span` ids
    for selector in range(len(PACKINGS), 0, -1):  # from one id a word to sixty
        count, room = PACKINGS[selector - 1]
        while span < count:
            step = min(span, count - span)
            most = np.maximum(most[:, :-step], most[:, step:])
            span += step
        np.copyto(best, selector, where=most[:, :width] <= room)
    rows, at = np.arange(n), np.zeros(n, np.int64)
    used: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    while (live := at < sizes).any():
        used.append(np.where(live, best[rows, np.minimum(at, width - 1)], -1))
        starts.append(at.copy())
        at = at + np.where(live, _COUNT[used[-1]], 0)
    if not used:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * n
    used_m, starts_m = np.array(used).T, np.array(starts).T
    words = np.zeros(used_m.shape, np.uint64)
    for selector, (count, bits) in enumerate(PACKINGS, 1):
        r, w = np.nonzero(used_m == selector)
        if len(r):
            got = values[r[:, None], starts_m[r, w][:, None] + np.arange(count)]
            words[r, w] = np.bitwise_or.reduce(got << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1) | (np.uint64(selector) << _SHIFT)
    out = []
    for i in range(n):
        own = words[i, used_m[i] >= 0]
        escaped = np.zeros(0, np.uint64)
        if wide[i].any():
            where = np.flatnonzero(used_m[i] == 0)
            escaped = values[i, starts_m[i, where]]
            own[where] = np.arange(len(where), dtype=np.uint64)
        out.append((own, escaped))
    return out


def decode_block(words: np.ndarray, escaped: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` ids of a block, as uint64."""
    selectors = (words >> _SHIFT).astype(np.int64)
    starts = np.cumsum(_COUNT[selectors]) - _COUNT[selectors]
    out = np.zeros(int(_COUNT[selectors].sum()), np.uint64)
    for selector in np.unique(selectors):
        where = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[starts[where]] = escaped[(words[where] & _LOW).astype(np.int64)]
            continue
        count, bits = PACKINGS[selector - 1]
        got = (words[where][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        out[starts[where][:, None] + np.arange(count)] = got
    return out[:size]


class Writer:
    """Writes one file; holds at most ``hold`` ids and the footer's rows."""

    def __init__(self, path: str, hold: int = 256 * BLOCK):
        self.path, self.out, self.hold = path, _open_out(path), hold
        self.parts: list[np.ndarray] = []
        self.held = self.at = self.total = 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.parts.append(ids.astype(np.uint64))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.hold:
            self._flush(False)

    def _flush(self, everything: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        take = len(ids) if everything else len(ids) // BLOCK * BLOCK
        for lo in range(0, take, self.hold):
            part = ids[lo : min(take, lo + self.hold)]
            n = -(-len(part) // BLOCK)
            sizes = np.minimum(BLOCK, len(part) - BLOCK * np.arange(n))
            matrix = np.zeros(n * BLOCK, np.uint64)
            matrix[: len(part)] = part
            for size, (words, escaped) in zip(sizes.tolist(), encode_blocks(matrix.reshape(n, BLOCK), sizes)):
                raw = words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()
                self.out.write(raw)
                self.blocks.append((self.at, len(words), len(escaped), size))
                self.at += len(raw)
        self.parts, self.held = [ids[take:]], len(ids) - take

    def close(self) -> tuple:
        self._flush(True)
        foot = io.BytesIO()
        lengths = []
        for rows, names in ((self.blocks, ["at", "words", "escaped", "ids"]), (self.docs, ["doc_id", "ids"])):
            table = pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
            before = foot.tell()
            with pa.ipc.new_stream(foot, table.schema) as sink:
                sink.write_table(table)
            lengths.append(foot.tell() - before)
        self.out.write(foot.getvalue() + np.array([self.at, *lengths], "<i8").tobytes())
        self.out.close()
        first = next((d for d, _ in self.docs if d is not None), None)
        return (self.path, first, len(self.docs), self.total, self.at)


MANIFEST = "file string, first_doc long, docs long, ids long, bytes long"


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenise whole texts and write their ids in ascending document order, a file or several per range of ids.

    Returns the manifest with ``start``, the ids in all files before. Files of failed tasks are not in it.
    A null text is empty, so has the end id alone; a null document id comes first; rows that share a document id
    are kept, in the order of a hash of their texts; very long texts are one document; other columns are left out,
    whatever their names; an empty table gives an empty manifest.
    """
    vocabulary = vocabulary or default_vocabulary()

    kinds = pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def write(batches):
        tokens, out, name, number = encoder(vocabulary), None, uuid.uuid4().hex, 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.batches(batch.column(1).to_pylist())):
                if out is None:
                    out, number = Writer(f"{path}/{name}-{number:06d}.s8b"), number + 1
                out.add(doc, np.append(ids, np.uint32(end_id)))
                if out.total >= file_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(out.close(), kinds)], schema=kinds)
                    out = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(out.close(), kinds)], schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The hash lets a range end inside the rows of one document id.
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = stored(ordered.mapInArrow(write, MANIFEST), "manifest")
    # A row per file, so one task can add them up. A file of null ids alone comes first, as null ids do.
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_file(path: str):
    """(doc_id, ids) of each document of a file, in order; decodes block after block."""
    with open_in_random(path) as f:
        size = f.size()
        f.seek(size - 24)
        foot, n_blocks, n_docs = np.frombuffer(f.read(24), "<i8").tolist()
        f.seek(foot)
        blocks = pa.ipc.open_stream(f.read(n_blocks)).read_all().to_pydict()
        docs = pa.ipc.open_stream(f.read(n_docs)).read_all().to_pydict()
        held, at = np.zeros(0, np.uint64), 0

        def decoded():
            f.seek(0)
            for words, escaped, ids in zip(blocks["words"], blocks["escaped"], blocks["ids"]):
                raw = np.frombuffer(f.read(8 * (words + escaped)), "<u8")
                yield decode_block(raw[:words], raw[words:], ids)

        stream = decoded()
        for doc, n in zip(docs["doc_id"], docs["ids"]):
            parts = []
            while n > 0:
                if at == len(held):
                    held, at = next(stream), 0
                take = min(n, len(held) - at)
                parts.append(held[at : at + take])
                at, n = at + take, n - take
            yield doc, np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def open_in_random(path: str):
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path)
    return system.open_input_file(local)


def read_documents(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (unless ``ids=False``) the ids of every document of a manifest."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for doc, got in read_file(path):
                    rows.append((doc, start, len(got), zlib.crc32(got.astype("<u4").tobytes()), got.astype(np.int64) if ids else None))
                    start += len(got)
                    held += len(got) * ids
                    if len(rows) >= 4000 or held >= 1 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    files = manifest.select("file", "start")
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def op4_simple8b(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_ids(docs, f"{scratch(spark)}/ids")
    return read_documents(manifest, ids=False).drop("ids")
