"""Removal of repeated byte strings by a distributed, common-prefix-aware suffix sort.

A byte goes when a string of ``width`` bytes covers it that also starts elsewhere, in any document. Whether
a string starting at s repeats is decided at its anchor, the position of least 16-gram hash among the first ``SPAN``
from s on: equal strings have equal anchors, so suffixes need sorting at anchors only.

1. Anchors. Each document is cut into runs of starts that share an anchor. An anchor whose core (the bytes that
   all strings of its run have right of it) occurs once cannot repeat; only hashes of cores are shuffled and counted.
2. Runs. For the others, the run's bytes are looked up in one copy of each text. Each distinct run is sorted once,
   with a weight: in how many places of how many copies it occurs.
3. Merge sort. Each task sorts its suffixes at anchors and front-codes them: a suffix is the length it
   shares with the one before it and the rest. Suffixes go to ranges of the order of their cores, run by run, and each
   range merges its runs by a loser tree that keeps every suffix's common prefix with the last winner, so
   that known prefixes are never compared again. The merge yields the common prefixes of neighbours.
4. Strings. In the sorted order the suffixes with a common core lie together, and a start is repeated when another
   of them shares enough bytes to the left and to the right, or its run weighs more than one. Cores with more than
   ``MOST_IN_CORE`` distinct runs are sorted further: by the same merge, one suffix for each string, whose
   neighbours share ``width`` bytes if it repeats. Strings that a task has several times are settled there first.

Null texts are empty; texts below ``width`` bytes lose nothing; very long texts are one row, read whole. Equal
document ids are told apart by a hash of the text, and equal rows repeat each other. Other columns are kept by
``remove_repeats`` and left out elsewhere, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skytile.session import discard, free_prefix, ship, stored

WIDTH = 400
SPAN = 200
GRAM = 16
#: Distinct runs of one core that one task compares; cores with more are sorted string by string.
MOST_IN_CORE = 20_000
#: Suffixes that a task merges at a time, ranges that splitters tell apart (cores of larger tables are dealt by
#: hash inside each), and how many of 2**20 runs are drawn for splitters, some twenty a range.
RANGE_ROWS = 20_000
MOST_RANGES = 4096
DRAWN = 900
BATCH_BYTES = 1 << 20
#: Anchors of a task that are counted together before they move.
BATCH_ANCHORS = 1 << 19

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M[0]
    x ^= x >> np.uint64(29)
    x *= _M[1]
    return x ^ (x >> np.uint64(32))


def _doubled(data: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of the strings of 1, 2, 4, ... bytes from each position on."""
    out = {1: _mix(data.astype(np.uint64) + np.uint64(1))}
    k = 1
    while 2 * k <= top:
        h = out[k]
        out[2 * k] = _mix(h[:-k] * _M[2] + (h[k:] ^ (h[k:] >> np.uint64(31))))
        k *= 2
    return out


def _spanned(hashes: dict[int, np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each start: two overlapping strings of a power of two."""
    k = max(x for x in hashes if x <= length)
    return _mix(hashes[k][starts] * _M[3] + hashes[k][starts + length - k])


def runs(data: np.ndarray, width: int = WIDTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, least and most bytes left of it, core hash) of each run of starts of one text."""
    n = len(data) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    core = width - span + 1
    hashes = _doubled(data, max(x for x in (16, 32, 64, 128, 256, 512) if x <= max(core, GRAM)))
    key = hashes[GRAM][: n + span - 1]
    # Least hash of the next `span` positions; ties go to the leftmost.
    order = np.arange(len(key))
    best, reach = order, 1
    while reach < span:
        step = min(reach, span - reach)
        a, b = best[:-step], best[step:]
        best = np.where(key[b] < key[a], b, a)
        reach += step
    best = best[:n]
    edge = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(edge[1:], n) - 1
    anchor = best[edge]
    return anchor, anchor - last, anchor - edge, _spanned(hashes, anchor, core)


def _texts(batches):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


class LoserTree:
    """Merges sorted runs of (bytes, common prefix with the one before in its run, payload).

    Every waiting item carries its common prefix with the last item output. Of two items the one with the
    longer such prefix is smaller; only if they are equal are bytes compared, from there on.
    """

    def __init__(self, sources: list):
        self.sources = [iter(s) for s in sources]
        self.k = 1
        while self.k < max(1, len(sources)):
            self.k *= 2
        self.item: list = [None] * self.k  # [bytes, common prefix, payload]
        for i, s in enumerate(self.sources):
            first = next(s, None)
            self.item[i] = [first[0], 0, first[2]] if first else None
        self.tree = [0] * self.k
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        x, y = self.item[a], self.item[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if x[1] != y[1]:
            return (a, b) if x[1] > y[1] else (b, a)
        i, s, t = x[1], x[0], y[0]
        end = min(len(s), len(t))
        while i < end and s[i : i + 32] == t[i : i + 32]:
            i += 32
        i = min(i, end)
        while i < end and s[i] == t[i]:
            i += 1
        if i == end and len(s) == len(t):
            first = x[2] <= y[2]
        else:
            first = len(s) <= len(t) if i == end else s[i] < t[i]
        if first:
            y[1] = i
            return a, b
        x[1] = i
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        won, lost = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.tree[node] = lost
        return won

    def __iter__(self):
        """Items in order: (bytes, common prefix with the item before, payload)."""
        while (top := self.item[self.winner]) is not None:
            yield top
            i = self.winner
            following = next(self.sources[i], None) if i < len(self.sources) else None
            self.item[i] = list(following) if following else None
            node = (i + self.k) // 2
            while node:
                won, lost = self._play(i, self.tree[node])
                self.tree[node] = lost
                i, node = won, node // 2
            self.winner = i


def _common(a: bytes, b: bytes) -> int:
    end = min(len(a), len(b))
    if a[:end] == b[:end]:
        return end
    lo, hi = 0, end  # the first lo bytes agree, the first hi do not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_coded(items: list[tuple[bytes, tuple]]) -> list[tuple[int, bytes, tuple]]:
    """Sorted (bytes, payload) as (common prefix with the one before, rest, payload)."""
    out, before = [], b""
    for text, payload in sorted(items):
        shared = _common(before, text)
        out.append((shared, text[shared:], payload))
        before = text
    return out


def decoded(rows):
    before = b""
    for shared, rest, payload in rows:
        before = before[:shared] + rest
        yield [before, shared, payload]


def repeated(items: list[tuple[bytes, bytes, int, int]], shared: list[int], width: int) -> list[list[tuple[int, int]]]:
    """For runs of one core in suffix order, the spans of left lengths at which their strings repeat.

    items: (suffix, reversed bytes left of it, least, most); shared[i]: common prefix of suffixes i-1 and i.
    """
    g = len(items)
    hit: list[list[tuple[int, int]]] = [[] for _ in items]
    if g <= 40:
        for i in range(g):
            right = 1 << 60
            for j in range(i + 1, g):
                right = min(right, shared[j])
                left = _common(items[i][1], items[j][1])
                lo, hi = max(width - right, items[i][2], items[j][2]), min(left, items[i][3], items[j][3])
                if lo <= hi:
                    hit[i].append((lo, hi))
                    hit[j].append((lo, hi))
        return hit
    least, most = np.array([x[2] for x in items]), np.array([x[3] for x in items])
    lefts = np.zeros((g, int(most.max()) + 1), np.uint8)
    for i, x in enumerate(items):
        lefts[i, : x[3]] = np.frombuffer(x[1], np.uint8)[: x[3]]
    common, left = np.array(shared), np.zeros(g, np.int64)
    for d in range(int(most.max()) + 1):
        live = np.flatnonzero((most >= d) & (least <= d))
        if len(live) > 1:
            right = np.cumsum(common < width - d)
            _, inverse, count = np.unique(left[live] * (g + 1) + right[live], return_inverse=True, return_counts=True)
            for i in live[count[inverse] > 1].tolist():
                if hit[i] and hit[i][-1][1] == d - 1:
                    hit[i][-1] = (hit[i][-1][0], d)
                else:
                    hit[i].append((d, d))
        # Classes of equal left bytes, a byte further; runs that end here leave by themselves.
        _, left = np.unique(np.where(most > d, left * 256 + lefts[:, d], -1 - np.arange(g)), return_inverse=True)
    return hit


def removed_spans(docs: DataFrame, firsts: DataFrame, width: int = WIDTH, span: int = SPAN, most_in_core: int = MOST_IN_CORE) -> tuple[DataFrame, DataFrame]:
    """Texts that may hold repeats (no, sha, text), one copy of each, and by number their spans: starts lo..hi whose strings repeat.

    docs: doc_id (not null), doc_key, text; firsts: doc_id, doc_key and sha of one document of each text, and its copies.
    """
    core = width - span + 1

    fields = [("doc_id", np.int64, pa.int64()), ("doc_key", np.int64, pa.int64()), ("anchor", np.int32, pa.int32()), ("least", np.int16, pa.int16()), ("most", np.int16, pa.int16()), ("core", np.int64, pa.int64()), ("m", np.int32, pa.int32())]

    def anchors(batches):
        """Anchors with ``m``, how many of a batch one row stands for outside: 0 where another row of its core does."""

        def flush(cols):
            cols = [np.concatenate(c) for c in cols]
            order = np.argsort(cols[-1], kind="stable")
            first = np.flatnonzero(np.concatenate([[True], cols[-1][order][1:] != cols[-1][order][:-1]]))
            m = np.zeros(len(order), np.int32)
            m[order[first]] = np.diff(np.append(first, len(order)))
            return pa.RecordBatch.from_arrays([pa.array(c.astype(t), k) for c, (_, t, k) in zip((*cols, m), fields)], names=[f[0] for f in fields])

        held, size = [[] for _ in range(6)], 0
        for part in _parts(_texts(batches)):
            for doc, key, text in part:
                a, lo, hi, h = runs(np.frombuffer(text.encode(), np.uint8), width, span)
                if len(a):
                    for c, v in zip(held, (np.full(len(a), doc), np.full(len(a), key), a, lo, hi, h.view(np.int64))):
                        c.append(v)
                    size += len(a)
            if size >= BATCH_ANCHORS:
                yield flush(held)
                held, size = [[] for _ in range(6)], 0
        if size:
            yield flush(held)

    found = docs.select("doc_id", "doc_key", "text").mapInArrow(anchors, "doc_id long, doc_key long, anchor int, least short, most short, core long, m int")
    # A core has one row a batch, however often it occurs; the rows it stands for are dealt by their own place.
    settled = F.col("m") == 0
    found = found.withColumn("key", F.when(settled, F.xxhash64("doc_id", "anchor")).otherwise(F.col("core")))
    counted = found.withColumn("c", F.sum("m").over(Window.partitionBy("key", settled)))
    # What a row stands for has its core twice at least, so of a core all rows stay or none.
    again = counted.where("m = 0 or c > 1").drop("key", "c", "m").join(firsts, ["doc_id", "doc_key"])
    wanted = again.groupBy("doc_id", "doc_key").agg(F.first("sha").alias("sha"), F.first("copies").alias("copies"), F.collect_list(F.struct("anchor", "least", "most", "core")).alias("runs"))
    # Rows of one id and text are copies of each other, so any of them will do. Texts get a number, shorter than a digest.
    texts = docs.join(wanted.hint("merge"), ["doc_id", "doc_key"]).dropDuplicates(["doc_id", "doc_key"])
    texts = stored(texts.select(F.monotonically_increasing_id().alias("no"), "sha", "text", "copies", "runs"), "texts")

    def hashed(batches):
        """A hash of each run's bytes, and the bytes themselves of a drawn few."""
        for part in _parts(_texts(batches), lambda r: len(r[1])):
            out = []
            for no, text, copies, own in part:
                data = text.encode()
                for r in own:
                    a, least, most = r["anchor"], r["least"], r["most"]
                    piece = data[a - most : a - least + width]
                    h = hashlib.blake2b(piece + bytes([least & 255, most & 255]), digest_size=16).digest()
                    out.append((no, copies, a, least, most, r["core"], h, piece if int.from_bytes(h[:4], "big") < DRAWN << 12 else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    kinds = pa.schema([("no", pa.int64()), ("copies", pa.int64()), ("anchor", pa.int32()), ("least", pa.int16()), ("most", pa.int16()), ("core", pa.int64()), ("run", pa.binary()), ("drawn", pa.binary())])
    places = stored(texts.select("no", "text", "copies", "runs").mapInArrow(hashed, "no long, copies long, anchor int, least short, most short, core long, run binary, drawn binary"), "places")
    # One place of each distinct run stands for all.
    distinct = stored(places.groupBy("run").agg(F.first("core").alias("core"), F.first("least").alias("least"), F.first("most").alias("most"), F.sum("copies").alias("weight"), F.min(F.struct("no", "anchor")).alias("at"), F.max("drawn").alias("drawn")), "runs")
    large = distinct.groupBy("core").agg(F.count("*").alias("g")).where(F.col("g") > most_in_core).select("core")
    bare = texts.select("no", "text")
    merged = _merged(bare, distinct.join(large, "core", "left_anti"), width, core)
    strings = _merged(bare, distinct.join(large, "core", "left_semi"), width, width, True)
    decided = stored(merged.unionByName(strings.select("run", F.explode("spans").alias("s")).groupBy("run").agg(F.collect_list("s").alias("spans"))), "decided")
    discard(distinct)
    hits = places.select("no", "anchor", "run").join(decided, "run")
    spans = hits.select("no", F.explode("spans").alias("s"), "anchor")
    return texts.select("no", "sha", "text"), spans.groupBy("no").agg(F.collect_list(F.struct((F.col("anchor") - F.col("s.hi")).alias("lo"), (F.col("anchor") - F.col("s.lo")).alias("hi"))).alias("spans"))


def _parts(rows, size=lambda r: len(r[2])):
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= BATCH_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


SPANS = "run binary, spans array<struct<lo:int,hi:int>>"


def _merged(texts: DataFrame, runs: DataFrame, width: int, core: int, strings: bool = False) -> DataFrame:
    """Spans of the runs by merge sort: front-coded sorted runs by range, then a loser tree per range.

    texts: no, text; runs: run, core, least, most, weight, the place ``at`` (no, anchor) of one copy, and bytes ``drawn``
    of some. A run's suffix starts at its anchor; with ``strings`` it has one for each of its strings, of ``width`` bytes.
    """
    total = runs.agg(F.count("*"), F.sum(F.col("most") - F.col("least") + 1)).first()[int(strings)] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // RANGE_ROWS)))
    parts = max(1, -(-total // (ranges * RANGE_ROWS)))
    # Splitters cut the order at whole cores, so that suffixes with a common core meet in one range.
    start = F.lit(1) if strings else F.col("most").cast("int") + 1
    some = runs.where(F.col("drawn").isNotNull() & (F.pmod(F.xxhash64("run"), F.lit(parts)) == 0)).select(F.substring("drawn", start, F.lit(core)).alias("k"))
    sample = sorted(bytes(r["k"]) for r in some.collect()) if ranges > 1 else []  # DRAWN of 2**20 runs, of the largest tables fewer
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    own = runs.groupBy("at.no").agg(F.collect_list(F.struct("at.anchor", "run", "least", "most", "weight")).alias("own"))

    def encode(batches):
        import bisect
        import uuid

        def flush(held):
            name = uuid.uuid4().hex
            by_range: dict[tuple, list] = {}
            held.sort()
            for i, (text, payload) in enumerate(held):
                key = text[:core]
                r = (bisect.bisect_right(splitters, key), zlib.crc32(key) % parts)
                if strings and i and held[i - 1][0] == text:
                    # Settled here: both repeat, and the one that goes on knows.
                    first = by_range[r][-1]
                    by_range[r][-1] = (text, (*first[1][:3], 2, b""))
                    by_range[r].append((None, payload))
                    by_range[r][-1], by_range[r][-2] = by_range[r][-2], by_range[r][-1]
                    continue
                by_range.setdefault(r, []).append((text, payload))
            for (r, part), items in by_range.items():
                settled = [(0, None, p) for t, p in items if t is None]
                coded = settled + front_coded([x for x in items if x[0] is not None])
                for lo in range(0, len(coded), 500):
                    some = coded[lo : lo + 500]
                    cols = [[r] * len(some), [part] * len(some), [name] * len(some), range(lo, lo + len(some)), [c[0] for c in some], [c[1] for c in some], *[[c[2][i] for c in some] for i in range(5)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

        held: list = []
        size = 0
        for text, own in _texts(batches):
            data = text.encode()
            for r in own:
                run, a, least, most, weight = bytes(r["run"]), r["anchor"], r["least"], r["most"], r["weight"]
                # A suffix is sorted by its right side; its left side, reversed, travels along.
                if strings:
                    held += [(data[a - d : a - d + width], (run, d, d, weight, b"")) for d in range(least, most + 1)]
                    size += width * (most - least + 1)
                else:
                    held.append((data[a : a - least + width], (run, least, most, weight, data[a - most : a][::-1])))
                    size += width + most - least
                if size >= 16 * BATCH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    kinds = pa.schema([("range", pa.int32()), ("part", pa.int64()), ("source", pa.string()), ("seq", pa.int32()), ("shared", pa.int32()), ("rest", pa.binary()), ("run", pa.binary()), ("least", pa.int32()), ("most", pa.int32()), ("weight", pa.int64()), ("lefts", pa.binary())])
    coded = texts.join(own, "no").select("text", "own").mapInArrow(encode, "range int, part long, source string, seq int, shared int, rest binary, run binary, least int, most int, weight long, lefts binary")
    dealt = coded.repartition(ranges * parts, "range", "part").sortWithinPartitions("range", "part", "source", "seq")

    def merge(batches):
        out: list[tuple] = []

        def ready(at_least=2000):
            while len(out) >= at_least and out:
                some = out[:2000]
                del out[:2000]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.binary()), pa.array([[{"lo": lo, "hi": hi} for lo, hi in s] for _, s in some], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["run", "spans"])

        def ranges_of():
            now, sources = None, {}
            for r, part, source, _, shared, rest, run, least, most, weight, lefts in _texts(batches):
                if (r, part) != now:
                    if sources:
                        yield sources
                    now, sources = (r, part), {}
                if rest is None:
                    out.append((run, [(least, most)]))
                else:
                    sources.setdefault(source, []).append((shared, rest, (run, least, most, weight, lefts)))
            if sources:
                yield sources

        def decide(group, shared):
            """Spans of suffixes with a common core; whole runs that occur more than once repeat as a whole."""
            found = repeated([(text, lefts, least, most) for text, _, (_, least, most, _, lefts) in group], shared, width) if len(group) > 1 else [[]]
            for (_, _, (run, least, most, weight, _)), spans in zip(group, found):
                if weight > 1 or spans:
                    out.append((run, [(least, most)] if weight > 1 else spans))

        for sources in ranges_of():
            group, shared = [], []
            for item in LoserTree([decoded(rows) for rows in sources.values()]):
                text, common, payload = item
                if strings:
                    # A string repeats if it weighs more than one or its neighbour shares all of it.
                    same = group and common >= width
                    if payload[3] > 1 or same:
                        out.append((payload[0], [payload[1:3]]))
                    if same and shared == [False]:
                        out.append((group[0][2][0], [group[0][2][1:3]]))
                    group, shared = [(text, 0, payload)], [bool(payload[3] > 1 or same)]
                else:
                    if group and common < core:
                        decide(group, shared)
                        group, shared = [], []
                    group.append((text, 0, payload))
                    shared.append(common if len(group) > 1 else 0)
                yield from ready()
            if group and not strings:
                decide(group, shared)
            yield from ready()
        yield from ready(0)

    return dealt.mapInArrow(merge, SPANS)


def cut_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", span: int | None = None, most_in_core: int = MOST_IN_CORE) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): doc_id, n_bytes and the digest ``sha`` of its text for each row, and what each different text that loses bytes becomes.

    texts: sha, ``spans`` (start and length in bytes of the maximal removed runs, in order), ``kept`` (the remaining bytes, which
    need not be whole code points). What a text loses, its copies lose.
    """
    span = span or width // 2
    given = docs.select(F.col(id_col).cast("long").alias("given_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = given.withColumn("doc_id", F.coalesce("given_id", F.lit(0))).withColumn("doc_key", F.xxhash64("text"))
    light = stored(rows.select("given_id", "doc_id", "doc_key", F.octet_length("text").cast("long").alias("n_bytes"), _sha("text").alias("sha")), "light")
    same = stored(light.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "doc_key")).alias("f")), "same")
    texts, spans = removed_spans(rows.select("doc_id", "doc_key", "text"), same.select("f.*", "sha", "copies"), width, span, most_in_core)
    kinds = pa.schema([("sha", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])

    def remove(batches):
        for part in _parts(_texts(batches), lambda r: len(r[1])):
            out = []
            for sha, text, own in part:
                data = text.encode()
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, [s["lo"] for s in own], 1)
                np.add.at(cover, [s["hi"] + width for s in own], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
                out.append((sha, [{"start": a, "length": b - a} for a, b in zip(edges[::2], edges[1::2])], kept))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    cut = texts.join(spans, "no").select("sha", "text", "spans").mapInArrow(remove, "sha binary, spans array<struct<start:long,length:long>>, kept binary")
    return light.select(F.col("given_id").alias("doc_id"), "n_bytes", "sha"), cut


def _sha(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", span: int | None = None, most_in_core: int = MOST_IN_CORE) -> DataFrame:
    """``docs`` with ``spans`` and ``kept`` of ``cut_repeats`` for each row (columns of these names are replaced); no spans where nothing goes."""
    texts = cut_repeats(docs, width, id_col, text_col, span, most_in_core)[1]
    p = free_prefix(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = docs.withColumn(f"{p}text", text).withColumn(f"{p}sha", _sha(f"{p}text"))
    met = met.join(texts.toDF(f"{p}met", f"{p}spans", f"{p}kept"), F.col(f"{p}sha") == F.col(f"{p}met"), "left")
    new = {"spans": F.coalesce(f"{p}spans", F.array().cast("array<struct<start:long,length:long>>")), "kept": F.coalesce(f"{p}kept", F.col(f"{p}text").cast("binary"))}
    return met.select(*[F.col(c) for c in docs.columns if c.lower() not in new], *[c.alias(n) for n, c in new.items()])


def dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", span: int | None = None, most_in_core: int = MOST_IN_CORE) -> DataFrame:
    """Digests of ``cut_repeats``, per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, texts = cut_repeats(docs, width, id_col, text_col, span, most_in_core)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    # Only digests and counts meet here.
    cut = texts.select("sha", removed.alias("removed"), F.size("spans").alias("runs"), F.sha2("kept", 256).alias("left_sha"))
    return rows.join(cut, "sha", "left").select(
        "doc_id", "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("runs", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("left_sha", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
