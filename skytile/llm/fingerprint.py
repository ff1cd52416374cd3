"""Improbable-feature digests of documents.

Every 64-byte window of a text has an entropy; the rarer that entropy is among all windows of all
documents, the better the window's rank. In each run of 64 neighbouring windows the best (leftmost) one gets a
vote, and windows with ``VOTES`` votes or more are features. Their hashes go, five bits each, into chained Bloom filters of
2048 bits and at most 160 features. Two digests are compared filter by filter: the bits they share, less those
expected by chance, over the most they could share; best partner of each filter of the shorter chain,
averaged by features.

A text without any feature, such as one of fewer than 64 bytes or a rule of dashes, has itself as its one feature; null
is the empty text, which has none and equals only itself. Whole texts count; very long ones are worked off in segments
that overlap. Rows that share a document id are ordered by text, null ids come last; repeated rows are each other's
next document. Other columns are left out, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skytile.session import ship

WIDTH = 64
VOTES = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
SCORES = 1001
#: Windows of less entropy (in thousandths of the most) say nothing and are never features.
LEAST_SCORE = 100
#: Bytes of a range of document ids, and most ranges: larger tables have larger ones, which tasks stream.
BUCKET_BYTES = 4 << 20
MOST_RANGES = 8192
#: Windows of a long text that are looked at together.
SEGMENT = 1 << 20
BATCH_BYTES = 1 << 19

_ONE = 1 << 20
_TOP = 384 * _ONE  # 64 * log2(64)
_F = np.array([0, *np.round([c * np.log2(c) * _ONE for c in range(1, 65)])], np.int64)
_STEP = _F[1:] - _F[:-1]  # _STEP[c - 1]: what the c-th copy of a byte adds


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another with gaps of a window's width; their starts and lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer((b"\0" * WIDTH).join(texts) + b"\0" * WIDTH, np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + WIDTH)[:-1]])
    return data, starts, lengths


def entropy_scores(data: np.ndarray) -> np.ndarray:
    """Entropy (0 to 1000) of each 64-byte window, in integer steps, so that equal windows score the same."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + 2 * WIDTH) + order
    here = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    first_in = np.searchsorted(key, key - WIDTH + 1, "left")
    behind[order] = here - first_in + 1  # copies of this byte in the window it ends
    ahead[order] = np.cumsum(np.bincount(first_in, minlength=n)) - here  # ... in the window it starts
    first = _F[np.bincount(data[:WIDTH], minlength=256)].sum()
    change = _STEP[behind[WIDTH:] - 1] - _STEP[ahead[: n - WIDTH] - 1]
    total = np.concatenate([[first], first + np.cumsum(change)])
    return (1000 * (_TOP - total)) // _TOP


def _inside(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which window starts lie in a text as a whole."""
    mark = np.zeros(n + 1, np.int8)
    full = lengths >= WIDTH
    np.add.at(mark, starts[full], 1)
    np.add.at(mark, starts[full] + lengths[full] - WIDTH + 1, -1)
    return np.cumsum(mark[:-1]).astype(bool)


def window_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows have each entropy score."""
    total = np.zeros(SCORES, np.int64)
    for text in texts:
        if len(text) > SEGMENT:
            for at in range(0, len(text) - WIDTH + 1, SEGMENT):
                total += np.bincount(entropy_scores(np.frombuffer(text[at : at + SEGMENT + WIDTH - 1], np.uint8)), minlength=SCORES)
    data, starts, lengths = _joined([t for t in texts if len(t) <= SEGMENT])
    if len(data) < WIDTH:
        return total
    scores = entropy_scores(data)
    return total + np.bincount(scores[_inside(len(scores), starts, lengths)], minlength=SCORES)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each score, the rarest first; scores that do not count come after all."""
    out = np.full(SCORES, SCORES, np.int64)
    out[np.lexsort((np.arange(SCORES), counts))] = np.arange(SCORES)
    out[:LEAST_SCORE] = SCORES
    return out


def _hashes(windows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(windows).view("<u8")
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Digest:
    """Chained filters as a (filters, 2048) bit matrix, with the features in each."""

    __slots__ = ("bits", "features", "text")

    def __init__(self, hashes: np.ndarray):
        _, first = np.unique(hashes, return_index=True)
        hashes = hashes[np.sort(first)]
        place = np.arange(len(hashes)) // FILTER_FEATURES
        self.features = np.bincount(place) if len(place) else np.zeros(0, np.int64)
        self.bits = np.zeros((len(self.features), FILTER_BITS), bool)
        for shift in range(0, 55, 11):
            self.bits[place, ((hashes >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        last = int(self.features[-1]) if len(self.features) else 0
        self.text = f"{len(self.features)}:{last}:{base64.b64encode(np.packbits(self.bits).tobytes()).decode()}"


def likeness(a: Digest, b: Digest) -> float:
    if a.text == b.text:
        return 1.0
    if not len(a.features) or not len(b.features):
        return 0.0
    if (len(b.features), int(b.features.sum()), b.text) < (len(a.features), int(a.features.sum()), a.text):
        a, b = b, a
    x, y = a.bits.astype(np.float32), b.bits.astype(np.float32)
    nx, ny = x.sum(1), y.sum(1)
    shared, chance, most = x @ y.T, np.outer(nx, ny) / FILTER_BITS, np.minimum.outer(nx, ny)
    score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float(np.average(score, weights=a.features))


def _voted(r: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Windows lo..hi-1 with enough votes: in each run of 64 windows the leftmost of best rank has one.

    ``r`` has the ranks of windows; runs that reach beyond it see only its own.
    """
    pad = np.concatenate([np.full(WIDTH - 1, SCORES, np.int64), r, np.full(WIDTH - 1, SCORES, np.int64)])
    best = (pad << 32) | np.arange(len(pad))
    width = 1
    while width < WIDTH:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = best[(best >> 32) < SCORES] & 0xFFFFFFFF
    edges = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]])) if len(best) else np.zeros(0, np.int64)
    votes = np.diff(np.append(edges, len(best)))
    chosen = best[edges[votes >= VOTES]] - (WIDTH - 1)
    return chosen[(chosen >= lo) & (chosen < hi)]


def _features(data: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return _hashes(np.lib.stride_tricks.sliding_window_view(data, WIDTH)[chosen]) if len(chosen) else np.zeros(0, np.uint64)


def _long(text: bytes, rank: np.ndarray) -> np.ndarray:
    """Features of a long text, a segment of its windows at a time; the runs about a segment lie in it, too."""
    out, n = [], len(text) - WIDTH + 1
    for at in range(0, n, SEGMENT):
        lo, hi = max(0, at - 2 * WIDTH), min(n, at + SEGMENT + 2 * WIDTH)
        data = np.frombuffer(text[lo : hi + WIDTH - 1], np.uint8)
        out.append(_features(data, _voted(rank[entropy_scores(data)], at - lo, min(n, at + SEGMENT) - lo)))
    return np.concatenate(out)


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    short = [t if len(t) <= SEGMENT else b"" for t in texts]
    data, starts, lengths = _joined(short)
    n = max(0, len(data) - WIDTH + 1)
    r = np.where(_inside(n, starts, lengths), rank[entropy_scores(data)], SCORES) if n else np.zeros(0, np.int64)
    chosen = _voted(r, 0, n)
    hashes = _features(data, chosen)
    cuts = np.searchsorted(chosen, np.append(starts, len(data)))
    out = []
    for i, text in enumerate(texts):
        own = _long(text, rank) if len(text) > SEGMENT else hashes[cuts[i] : cuts[i + 1]]
        if text and not len(own):
            own = np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), "<u8")
        out.append(Digest(own))
    return out


def _batches(rows, size=lambda r: len(r)):
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= BATCH_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def corpus_ranks(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Ranks of entropy scores over all windows of all texts (1001 counts), and the texts' bytes."""

    def count(batches):
        total, size = np.zeros(SCORES, np.int64), 0
        for part in _batches(t.encode() for b in batches for t in b.column(0).to_pylist() if t):
            total += window_counts(part)
            size += sum(map(len, part))
        yield pa.RecordBatch.from_pydict({"score": pa.array(range(-1, SCORES), pa.int32()), "n": pa.array([size, *total.tolist()], pa.int64())})

    summed = docs.select(text_col).mapInArrow(count, "score int, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    counts = {r["score"]: r["n"] for r in summed}
    return ranks(np.array([counts.get(i, 0) for i in range(SCORES)])), counts.get(-1, 0)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text and of its edited form, whose second half is the start of the next document's text.

    Documents are dealt into ranges of descending ids by stated boundaries, each with a copy of the first
    document of the range after it (one row a range), so the text is shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank, size = corpus_ranks(rows)
    n = min(MOST_RANGES, max(1, -(-size // BUCKET_BYTES)))
    cuts = np.array(sorted({int(c) for c in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else [], np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        given = ids.notna().to_numpy()
        found = len(cuts) - np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(given, found, len(cuts) + 1).astype(np.int32))

    dealt = rows.withColumn("bucket", bucket("doc_id"))
    firsts = sorted((r["bucket"], r["head"]) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())  # MOST_RANGES rows at most
    after = [(b, firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)]
    spark = docs.sparkSession
    heads = spark.createDataFrame(after or [(0, None)], "b int, head long")
    extra = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["head"])).select("doc_id", "text", F.col("b").alias("bucket"))
    both = dealt.withColumn("extra", F.lit(0)).unionByName(extra.withColumn("extra", F.lit(1)))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        def pairs():  # (doc_id, text, next text)
            held = group = None
            for b in batches:
                for doc, text, g, ctx in zip(*[c.to_pylist() for c in b.select(["doc_id", "text", "bucket", "extra"]).columns]):
                    if held is not None and g == group:
                        yield (*held, text)
                        held = None
                    if not ctx:
                        held, group = (doc, text), g

        for part in _batches(pairs(), lambda r: len(r[1])):
            # One list of distinct texts: own, edited, and the next one of the last.
            edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, nxt in part]
            place = {}
            texts = [place.setdefault(t, t) for t in dict.fromkeys([x for (_, t, nxt), e in zip(part, edited) for x in (t, nxt, e)])]
            got = dict(zip(texts, digests([t.encode() for t in texts], rank)))
            out = []
            for (doc, text, nxt), e in zip(part, edited):
                a, b, c = got[text], got[e], got[nxt]
                out.append((doc, len(text), hashlib.sha256(e.encode()).hexdigest(), a.text, b.text, likeness(a, b), likeness(a, c)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return dealt.mapInArrow(run, OUT)


def op1_improbable_digest(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
