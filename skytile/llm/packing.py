"""Lexical retrieval packing: windows filled with a seed document and its unused BM25 neighbours.

1. Terms. Texts become ids once, stored; the documents that hold each id are counted over the corpus (a row per
   id of the vocabulary at most).
2. Shards. A document's lexical key is its terms of greatest BM25 weight, in order, of those that other documents
   hold, too. Documents are sorted by that key over all files, so that lexical neighbours lie together wherever they
   were stored, and the order is cut into shards of at most ``SHARD_TOKENS`` ids and ``SHARD_DOCS`` documents. A
   term that a large part of the corpus shares is split by the terms after it.
3. Windows. Each shard has a BM25 inverted index, with the corpus's document frequencies. The next unused document
   seeds a window; the index returns its unused neighbours, best first, by all terms but the end id, and they
   fill the window. What does not fit of the last one is cut off and seeds the next window, so windows are full.
   The few ids that a task has left at its end are cut into sequences of powers of two, which need no padding.

A null text is empty: such a document has its end id alone. Repeated rows are packed as often as they come; null
document ids are kept; ties go to the earlier document in the order; other columns are left out; an empty table gives
no rows; texts longer than a window fill several.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skytile.llm.tokens import default_vocabulary, encoder, vocabulary_size
from skytile.session import ship, stored

WINDOW = 4096
SHARD_TOKENS = 1_500_000
SHARD_DOCS = 10_000
#: Terms of a document's lexical key.
KEY_TERMS = 4
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and how often each occurs."""
    order = np.sort(ids, kind="stable")  # by radix, for ids of 16 bits
    first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order[first], np.diff(np.append(first, len(order)))


class Corpus:
    """Documents, mean length and, by term, document frequencies and inverse ones of a corpus."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, max(mean, 1.0), df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> "Corpus":
        size = max([int(d.max()) for d in docs if len(d)], default=0) + 1
        return cls(len(docs), sum(map(len, docs)) / max(1, len(docs)), sum((np.bincount(np.unique(d), minlength=size) for d in docs), np.zeros(size, np.int64)))

    def weights(self, term: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def key(self, ids: np.ndarray) -> bytes:
        """The terms of greatest weight that another document has, too, as bytes that sort like them."""
        term, tf = _terms(ids)
        weight = self.weights(term, tf, len(ids)) * (self.df[term] > 1)
        if len(term) > 4 * KEY_TERMS:
            # The greatest, with all ties of the last.
            least = np.partition(weight, -KEY_TERMS)[-KEY_TERMS]
            some = np.flatnonzero(weight >= least)
            term, weight = term[some], weight[some]
        best = np.argsort(-weight, kind="stable")[:KEY_TERMS]
        return term[best[weight[best] > 0]].astype(">u4").tobytes()


class Index:
    """BM25 postings of a shard: for each term its documents and weights."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        key = np.concatenate(docs).astype(np.int64) * self.n + np.repeat(np.arange(self.n), lengths)
        key, tf = np.unique(key, return_counts=True)
        term, self.doc = key // self.n, key % self.n
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.last = self.first + df
        self.weight = corpus.weights(term, tf, lengths[self.doc])
        # The query terms of each document: all that another document of the shard has, too.
        rows = np.flatnonzero(np.repeat(df, df) > 1)
        rows = rows[np.argsort(self.doc[rows], kind="stable")]
        bounds = np.searchsorted(self.doc[rows], np.arange(self.n + 1))
        place = np.repeat(np.arange(len(self.terms)), df)
        self.query = [place[rows[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]

    def neighbours(self, doc: int) -> np.ndarray:
        """Documents that share a term with ``doc``, by falling score, then in order."""
        terms = self.query[doc]
        if not len(terms):
            return terms
        spans = [slice(a, b) for a, b in zip(self.first[terms], self.last[terms])]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Fills windows over the shards of one task; ``base`` makes its sequence ids its own."""

    def __init__(self, base: int, window: int):
        self.base, self.window, self.sequence, self.filled = base, window, 0, 0
        self.open: list[tuple] = []  # pieces of the window being filled: (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray) -> bool:
        """Put a whole document; true if it ended one window or more, so that its rest is the next one's seed."""
        at, ended = 0, False
        while at < len(ids):
            take = min(len(ids) - at, self.window - self.filled)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.filled, at = self.filled + take, at + take
            if self.filled == self.window:
                self.close(self.open)
                self.open, self.filled, ended = [], 0, True
        return ended

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.base + self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def end(self) -> None:
        """What is left, as sequences of falling powers of two."""
        left = self.open
        while left:
            total = sum(len(p[2]) for p in left)
            room, now, later = 1 << (total.bit_length() - 1), [], []
            for doc_id, start, ids, n in left:
                take = min(room, len(ids))
                if take:
                    now.append((doc_id, start, ids[:take], n))
                if take < len(ids):
                    later.append((doc_id, start + take, ids[take:], n))
                room -= take
            self.close(now)
            left = later
        self.open = []


def pack_shard(packer: Packer, ids: list, docs: list[np.ndarray], end_id: int, corpus: Corpus) -> None:
    """Pack a shard's documents, given without their end ids."""
    index, used = Index(docs, corpus), np.zeros(len(docs), bool)
    at, queue, q = 0, np.zeros(0, np.int64), 0
    while True:
        # The best unused neighbour of the window's seed, else the next unused document.
        while q < len(queue) and used[queue[q]]:
            q += 1
        if q < len(queue):
            pick = int(queue[q])
        else:
            while at < len(docs) and used[at]:
                at += 1
            if at == len(docs):
                return
            pick, queue, q = at, index.neighbours(at), 0
        used[pick] = True
        if packer.put(ids[pick], np.append(docs[pick], np.uint32(end_id))):
            queue, q = index.neighbours(pick), 0


def token_rows(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the ids of each whole text as bytes (unsigned 32-bit, or 16-bit where the vocabulary allows)."""

    def run(batches):
        tokens = encoder(vocabulary)
        kind = "<u2" if tokens.size <= 1 << 16 else "<u4"
        for batch in batches:
            for lo in range(0, len(batch), 500):
                some = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([ids.astype(kind).tobytes() for ids in tokens.batches(some.column(1).to_pylist())], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def corpus_of(tokens: DataFrame, size: int, kind: str) -> Corpus:
    """Counts over all documents: a row a task for sums, then at most a row per id of the vocabulary."""

    def count(batches):
        df, n, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                df[_terms(ids)[0]] += 1
                n, total = n + 1, total + len(ids)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *hit.tolist()], pa.int64()), "n": pa.array([total, n, *df[hit].tolist()], pa.int64())})

    got = {r["term"]: r["n"] for r in tokens.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(size, np.int64)
    for term, n in got.items():
        if term >= 0:
            df[term] = n
    return Corpus(got.get(-1, 0), got.get(-2, 0) / max(1, got.get(-1, 0)), df)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece of each document: where it lies in its document and in its sequence."""
    vocabulary = vocabulary or default_vocabulary()
    size = vocabulary_size(vocabulary)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens = stored(token_rows(docs, vocabulary, id_col, text_col), "tokens")
    corpus = corpus_of(tokens, size, kind)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)  # as long as the vocabulary
    kinds = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    @F.pandas_udf("binary")
    def key(raw: pd.Series) -> pd.Series:
        return pd.Series([shared.value.key(np.frombuffer(r, kind)) for r in raw], dtype=object)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], schema=kinds)

    def run(batches):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, window)
        ids, held, total = [], [], 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                held.append(np.frombuffer(raw, kind).astype("<u4"))
                total += len(held[-1]) + 1
                if total >= shard_tokens or len(held) >= shard_docs:
                    pack_shard(packer, ids, held, end_id, shared.value)
                    ids, held, total = [], [], 0
                    yield batch_of(packer.rows) if packer.rows else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * len(kinds), schema=kinds)
                    packer.rows = []
        if held:
            pack_shard(packer, ids, held, end_id, shared.value)
        packer.end()
        if packer.rows:
            yield batch_of(packer.rows)

    keyed = tokens.withColumn("key", key("ids"))
    order = ["key", F.xxhash64("doc_id", "ids")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(run, PIECES)


def op9_lexical_packing(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
