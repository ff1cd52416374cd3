"""Alignment of two tokenizers' ids over a corpus: groups between common ends, links, and how often ids are linked.

1. Ids. A text is cut into chunks that each tokenizer encodes for itself: words with their leading space, as one
   vocabulary's own pattern cuts them (A), and runs of spaces with what follows, as no piece of the other vocabulary
   holds a space after another character (B). Chunks repeat, so each worker keeps a bounded table of them. Texts with characters
   beyond Latin-1 are one chunk, so that only the tokenizers decide about them.
2. Lockstep. The documents of a batch lie one behind the other in two arrays of byte ends. One state vector holds a
   place in A and one in B for every document; each step links the two tokens of every place, cuts where both
   end, moves the places whose token ends first, and drops the documents that are done. Long documents
   take several places, which start at common ends, so the number of steps is bounded.
3. Counts. A batch leaves one row: its documents, their linked pairs as places in the batch's own list of different pairs, and
   that list. Only the lists are shuffled: counted by pair, compared with the highest count of their B id, and
   brought back to their batch, where a document's sums are taken. No task sees more than a batch.

Texts that are null, empty, or that one of the tokenizers doesn't give back byte by byte have no tokens: zeros, no links and an
empty digest. Repeated rows and rows with null or repeated ids each give a row. A batch holds
``BATCH_BYTES`` of text; a longer text is a batch by itself, and takes memory in proportion to its length. Ties for the highest
count all count as highest. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from skytile.session import ship, stored

#: Characters of text in a batch, more or less.
BATCH_BYTES = 2 << 20
#: A tokens between the places of a long document.
LANE = 512
#: Chunks and characters that a worker's table holds; beyond, it starts anew. Never changes results.
CHUNKS, CHUNK_CHARS = 1 << 18, 1 << 23

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: A batch: by document the id, the counts, the digest and the number of different pairs; all documents' pairs as
#: (place in the list, times), each two unsigned 32-bit integers; the list of pairs (A id * B's size + B id) and their links.
_BATCH = StructType([
    StructField("batch", LongType()), StructField("doc_id", ArrayType(LongType())), *[StructField(c, ArrayType(LongType())) for c in COUNTS],
    StructField("groups_sha256", ArrayType(StringType())), StructField("n_pairs", ArrayType(LongType())), StructField("entries", BinaryType()), StructField("times", BinaryType()),
    StructField("pairs", ArrayType(LongType())), StructField("links", ArrayType(LongType())),
])

# Vocabulary A's pattern for Latin-1 texts.
_L, _N, _S = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_WORD_A = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_B = re.compile(r" +[^ ]*")
_SPACE_MARK = "▁"

_VOCABULARIES: dict[tuple[str, str], "Vocabulary"] = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A tokenizer with a table of chunks: for each its ids, and whether their bytes are the chunk's."""

    def __init__(self, path: str):
        self.pattern, self._encode, self.token_bytes = self._piece(path) if path.endswith(".model") else self._byte_level(path)
        self.sizes = np.array([len(b) for b in self.token_bytes], np.int64)
        self._clear()

    def _byte_level(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        letters = byte_letters()
        held = [b""] * t.get_vocab_size()
        for token, i in t.get_vocab(with_added_tokens=False).items():
            held[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return _WORD_A, lambda chunks: [e.ids for e in t.encode_batch_fast(chunks, add_special_tokens=False)], held

    def _piece(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        held = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(_SPACE_MARK, " ").encode() for i in range(sp.get_piece_size())]
        alone = [sp.piece_to_id(_SPACE_MARK)]
        # The tokenizer adds the first space itself; of a space alone it would make nothing.
        return _WORD_B, lambda chunks: [ids if c != " " else alone for c, ids in zip(chunks, sp.encode([c[1:] for c in chunks], num_threads=1))], held

    def _clear(self) -> None:
        self.table: dict[str, int] = defaultdict(count().__next__)  # a chunk that is looked up gets the next place
        self.first, self.count, self.good, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)
        self.chars = 0

    def _learn(self, chunks: list[str]) -> None:
        ids = self._encode(chunks)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        raw = [c.encode() for c in chunks]
        # Where all sizes agree and the bytes of all chunks together do, those of each chunk do.
        held = np.concatenate([[0], np.cumsum(self.sizes[flat])])[np.concatenate([[0], np.cumsum(n)])]
        good = np.diff(held) == np.fromiter(map(len, raw), np.int64, len(raw))
        if not good.all() or b"".join(map(self.token_bytes.__getitem__, flat.tolist())) != b"".join(raw):
            good = np.array([b"".join([self.token_bytes[i] for i in own]) == r for own, r in zip(ids, raw)], bool)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
        self.count, self.good = np.concatenate([self.count, n]), np.concatenate([self.good, good])
        self.flat = np.concatenate([self.flat, flat])
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has, whether they give its bytes back) of non-empty texts, with a space before each."""
        chunks, bounds = [], [0]
        for t in texts:
            chunks += self.pattern.findall(" " + t) if _latin(t) else [" " + t]
            bounds.append(len(chunks))
        if len(self.table) > CHUNKS or self.chars > CHUNK_CHARS:
            self._clear()
        e = np.fromiter(map(self.table.__getitem__, chunks), np.int64, len(chunks))
        unseen = list(islice(reversed(self.table), len(self.table) - len(self.first)))[::-1]
        if unseen:
            try:
                self._learn(unseen)
            except BaseException:
                self._clear()  # no places without ids
                raise
        n = self.count[e]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.first[e] - end[:-1], n) + np.arange(end[-1])]
        bad = np.concatenate([[0], np.cumsum(~self.good[e])])
        return ids, np.diff(end[bounds]), np.diff(bad[bounds]) == 0


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def vocabulary(path: str, kind: str) -> Vocabulary:
    """This worker's vocabulary of a file."""
    if (path, kind) not in _VOCABULARIES:
        _VOCABULARIES[path, kind] = Vocabulary(path)
    return _VOCABULARIES[path, kind]


def places(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Where to start: at each document, and behind the next common end after every ``lane`` A tokens of it."""
    last = np.append(first_a[1:], len(ends_a)) - 1
    n = np.maximum(last - first_a, 0) // lane
    own = np.repeat(np.arange(len(first_a)), n)
    at = first_a[own] + lane * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + 1)
    starts_a, starts_b, last = [first_a], [first_b], last[own]
    while len(at):
        b = np.searchsorted(ends_b, ends_a[at])
        met = ends_b[b] == ends_a[at]
        more = met & (at < last)  # the last end of a document is a common one
        starts_a.append(at[more] + 1)
        starts_b.append(b[more] + 1)
        at, last = at[~met] + 1, last[~met]
    start, where = np.unique(np.concatenate(starts_a), return_index=True)
    return start, np.concatenate(starts_b)[where]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A and B token of each link, last A and B token of each group, in order) of documents that lie one behind the other.

    ``ends`` are byte ends counted over all documents, ``first`` the documents' first tokens; each document has
    tokens, and ends at the same byte in A and B.
    """
    start_a, start_b = places(ends_a, ends_b, first_a, first_b, lane)
    state = np.stack([start_a, start_b])
    stop = np.append(start_a[1:], len(ends_a))
    links, cuts = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    while state.shape[1]:
        links.append(state)
        a, b = ends_a[state[0]], ends_b[state[1]]
        cuts.append(state[:, a == b])
        state = state + np.stack([a <= b, b <= a])
        on = state[0] < stop
        if not on.all():
            state, stop = state[:, on], stop[on]
    links, cuts = np.concatenate(links, 1), np.concatenate(cuts, 1)
    cuts.sort(1)  # both places of a cut grow together
    return links[0], links[1], cuts[0], cuts[1]


def written(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
    """For each document (so many groups) the ids of its groups: A's with commas, a bar, B's with commas; semicolons between groups."""
    in_a, in_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + np.repeat(cut_b + 1 - in_b, in_a)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(cut_a + 1, in_b)] = ids_b
    mark[cut_a + cut_b + 1 - in_b], mark[cut_a + cut_b + 1] = ord("|"), ord(";")
    width = len(str(int(ids.max(initial=0))))
    digits, rest, n = np.empty((len(ids), width + 1), np.uint8), ids.copy(), np.ones(len(ids), np.int64)
    for k in range(width - 1, -1, -1):
        digits[:, k] = 48 + rest % 10
        rest //= 10
        n += rest > 0
    digits[:, width] = mark
    flat = digits[np.arange(width + 1) >= (width - n)[:, None]].tobytes()
    ends = np.cumsum(n + 1)
    tokens = np.concatenate([[0], (cut_a + cut_b + 2)])[np.concatenate([[0], np.cumsum(groups)])]
    bounds = np.concatenate([[0], ends])[tokens].tolist()
    return [flat[lo : hi - 1] for lo, hi in zip(bounds, bounds[1:])]


def align_batch(doc_ids: list, texts: list, a: Vocabulary, b: Vocabulary, lane: int = LANE) -> dict:
    """The columns of a batch's row, without its number."""
    held = [i for i, t in enumerate(texts) if t]
    own = [texts[i] for i in held]
    ids_a, n_a, good_a = a.encode(own)
    ids_b, n_b, good_b = b.encode(own)
    good = good_a & good_b
    ids_a, ids_b = ids_a[np.repeat(good, n_a)].astype(np.int64), ids_b[np.repeat(good, n_b)].astype(np.int64)
    n_a, n_b, at = n_a[good], n_b[good], np.array(held, np.int64)[good]
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    link_a, link_b, cut_a, cut_b = lockstep(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]), first_a, first_b, lane)
    size, docs = len(b.sizes), len(at)
    doc_a = np.repeat(np.arange(docs), n_a)
    groups, links = np.bincount(doc_a[cut_a], minlength=docs), np.bincount(doc_a[link_a], minlength=docs)
    span = len(a.sizes) * size
    key, times = np.unique(doc_a[link_a] * span + ids_a[link_a] * size + ids_b[link_b], return_counts=True)
    pairs, entry = np.unique(key % span, return_inverse=True)

    def full(values, empty=0):
        out = np.full(len(texts), empty, object if isinstance(empty, str) else np.int64)
        out[at] = values
        return out.tolist()

    digests = np.array([hashlib.sha256(w).hexdigest() for w in written(ids_a, ids_b, cut_a, cut_b, groups)], object)
    return {
        "doc_id": doc_ids, "n_a": full(n_a), "n_b": full(n_b), "n_groups": full(groups), "n_links": full(links), "groups_sha256": full(digests, ""),
        "n_pairs": full(np.bincount(key // span, minlength=docs)), "entries": entry.astype("<u4").tobytes(), "times": times.astype("<u4").tobytes(),
        "pairs": pairs, "links": np.bincount(entry, times, len(pairs)).astype(np.int64),
    }


def batches_of(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, lane: int = LANE) -> DataFrame:
    """A row for each batch of documents, aligned."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_BATCH)

    def run(parts):
        from pyspark import TaskContext

        a, b = vocabulary(path_a, "a"), vocabulary(path_b, "b")
        number = TaskContext.get().partitionId() << 32

        def row(ids, texts):
            r = align_batch(ids, texts, a, b, lane)
            return pa.RecordBatch.from_arrays([pa.array([number if f.name == "batch" else r[f.name]], f.type) for f in schema], schema=schema)

        ids, texts, size = [], [], 0
        for part in parts:
            for i in range(part.num_rows):
                text = part.column(1)[i].as_py()
                ids.append(part.column(0)[i].as_py())
                texts.append(text)
                size += len(text or "") + 64
                if size >= batch_bytes:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
                    number += 1
        if ids:
            yield row(ids, texts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _BATCH)


def pair_counts(batches: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): links of each id pair over the corpus; best where no other pair of the B id has more."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("p.pairs", "p.links")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("links").alias("count"))
    b = (F.col("pair") % size_b).cast("int")
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))  # a row per B id at most
    return counts.join(F.broadcast(highest), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, size_b: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, lane: int = LANE) -> DataFrame:
    """A row for each document: tokens, groups, links, links of a highest count, sum of counts, digest of the groups. ``size_b``: ids of B."""
    ship(docs.sparkSession)
    batches = stored(batches_of(docs, path_a, path_b, id_col, text_col, batch_bytes, lane), "batches")
    listed = batches.select(F.col("batch").alias("own_batch"), F.posexplode("pairs").alias("entry", "pair"))
    known = listed.join(pair_counts(batches, size_b), "pair").select("own_batch", "entry", "count", "best")

    def sums(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        out = []
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        count[pairs["entry"]], best[pairs["entry"]] = pairs["count"], pairs["best"]
        for r in rows.to_dict("records"):  # one
            entry, times = np.frombuffer(r["entries"], "<u4"), np.frombuffer(r["times"], "<u4").astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(r["n_pairs"])]).astype(np.int64)
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds])
            ids = pd.array(list(r["doc_id"]), dtype=pd.ArrowDtype(pa.int64()))
            out.append(pd.DataFrame({"doc_id": ids, **{c: r[c] for c in COUNTS}, "n_best": total(times * best[entry]), "count_sum": total(times * count[entry]), "groups_sha256": r["groups_sha256"]}))
        return pd.concat(out)

    rows = batches.drop("pairs", "links")
    return rows.groupBy("batch").cogroup(known.groupBy("own_batch")).applyInPandas(sums, RESULT)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    import sentencepiece

    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_a, path_b, size_b)
