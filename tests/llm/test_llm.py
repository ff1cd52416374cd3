"""Brute-force versions, exact round trips and edge cases of the text-corpus operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytile.llm import words as words_of
from skytile.llm import fingerprint, jaccard, language, mixing, packing, permutation_index, simple8b, suffixes, surrogates, warc
from skytile.llm.tokens import default_vocabulary, encoder
from skytile.session import scratch

KEYED = surrogates.Keyed(b"a key for tests")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, anchor int, chunk string"


def docs_of(spark, rows):
    """Documents with two further columns, whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, l, s, len(t) if t is not None else None, 1, "c") for d, t, l, s in rows], DOCS)


def words(rng, n, vocabulary=200):
    return " ".join("w" + "abcdefghij"[rng.randrange(10)] * (1 + rng.randrange(3)) + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        k = rng.random()
        text = words(rng, rng.randrange(1, 120), 50)
        if k < 0.4 and rows and rows[-1][1]:
            text = rows[rng.randrange(len(rows))][1] or "x"
            if k < 0.25:
                parts = text.split(" ")
                parts[rng.randrange(len(parts))] = "changed" + str(i)
                text = " ".join(parts)
        elif k < 0.5:
            text = rng.choice([None, "", "   ", "one", "two words", "ÀÉ ünï 日本語 ½"])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "a"])))
    rows.append((100, words(rng, 30000), "en", "a"))
    return rows


# ---- tokens, Simple-8b, packing ---------------------------------------------------------------------------


def test_encoder_is_the_tokenizer():
    e = encoder(default_vocabulary())
    for t in ["don't I'll we've it's'", "<|endoftext|>a b<|startoftext|>", "Ünï ǅ ﬁ İstanbul ΣΑΣ Σ", "a b\x1cc d", "½ 12ab3 a1b2 ___ a_b", "''s !!, 'x", "é ́x 日本語", "\r\n\x0b\x0c\x85", "", "ªº²µ"]:
        assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def thue_morse(n, letters="ab"):
    """A word and its complement, which agree under any polynomial hash modulo a power of two."""
    return ["".join(x[bin(i).count("1") & 1] for i in range(n)) for x in (letters, letters[::-1])]


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_encoder_tells_words_of_equal_hash_apart(n, monkeypatch):
    e = encoder(default_vocabulary())
    a, b = thue_morse(n)
    for t in [a, b, f"{a} {b}", f"{b} x {a}", "a\0b a\0 a", "-" * 70 + " " + "-" * 71]:
        assert e.ids(t).tolist() == e._encode(t).tolist()
    # Even if all words had one of four hashes.
    hashes = words_of.hashes
    monkeypatch.setattr(words_of, "hashes", lambda *x: ((r := hashes(*x))[0] & np.uint64(3), *r[1:]))
    e._clear()
    for t in ["one two three four five six", "seven one", a[:200] + " " + b[:200], "two two"]:
        assert e.ids(t).tolist() == e._encode(t).tolist()
    e._clear()


@pytest.mark.parametrize("bits", [1, 12, 16, 33, 64])
@pytest.mark.parametrize("n", [1, 60, 4096, 9000])
def test_simple8b_round_trip(bits, n):
    rng = np.random.default_rng(n + bits)
    ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ids >>= rng.integers(64 - bits, 64, n).astype(np.uint64)
    blocks = -(-n // simple8b.BLOCK)
    m = np.zeros(blocks * simple8b.BLOCK, np.uint64)
    m[:n] = ids
    sizes = np.minimum(simple8b.BLOCK, n - simple8b.BLOCK * np.arange(blocks))
    got = [simple8b.decode_block(w, e, s) for (w, e), s in zip(simple8b.encode_blocks(m.reshape(blocks, -1), sizes), sizes.tolist())]
    assert (np.concatenate(got) == ids).all()


def test_token_files(spark, corpus):
    rows = corpus + [(None, "no id", None, None), (7, "twice", None, None)]
    got = simple8b.read_documents(simple8b.write_ids(docs_of(spark, rows), f"{scratch(spark)}/ids")).collect()
    e, start = encoder(default_vocabulary()), 0
    want = {}
    for d, t, *_ in rows:
        want.setdefault(d, []).append([*e.ids(t).tolist(), 1])
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and list(r.ids) in want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert len(got) == len(rows) and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted([d for d, *_ in rows], key=lambda d: (d is not None, d or 0))
    several = simple8b.read_documents(simple8b.write_ids(docs_of(spark, rows), f"{scratch(spark)}/several", file_ids=100)).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in several) == sorted((r.start, r.n_tokens, r.ids_crc32) for r in got)
    empty = docs_of(spark, [])
    assert simple8b.read_documents(simple8b.write_ids(empty, f"{scratch(spark)}/none")).count() == 0


def check_pieces(pieces, rows, window):
    e = encoder(default_vocabulary())
    left = Counter(tuple([*e.ids(t).tolist(), 2]) for _, t, *_ in rows)
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == window or at & (at - 1) == 0
    assert sum(p.length for p in pieces) == sum(len(k) * n for k, n in left.items())
    single = {d: [*e.ids(t).tolist(), 2] for d, t, *_ in rows}
    for p in pieces:
        if Counter(d for d, *_ in rows)[p.doc_id] == 1:
            assert p.ids_crc32 == zlib.crc32(np.array(single[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(single[p.doc_id])


@pytest.mark.parametrize("shard,most", [(500, 1000), (1_000_000, 7), (1_000_000, 10_000)])
def test_packing(spark, corpus, shard, most):
    rows = corpus + [(None, "no id", None, None), (7, "twice", None, None)]
    d = docs_of(spark, rows).withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    check_pieces(packing.pack(d, window=256, shard_tokens=shard, shard_docs=most).collect(), rows, 256)
    assert packing.pack(docs_of(spark, [])).count() == 0


def brute_scores(docs, corpus, query):
    """BM25 of every document for the distinct terms of one of them, term by term."""
    n, mean = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = Counter(t for d in corpus for t in set(d))
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[query]) if tf[t]))
    return out


def test_packing_index_scores_like_bm25():
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.6, rng.integers(0, 40)).clip(0, 60).astype(np.uint32) for _ in range(80)]
    shard = docs[:50]  # its index has the whole corpus's frequencies
    corpus = packing.Corpus.of(docs)
    index = packing.Index(shard, corpus)
    plain, everything = [d.tolist() for d in shard], [d.tolist() for d in docs]
    for q in range(50):
        score = brute_scores(plain, everything, q)
        shared = [i for i in range(50) if any(t in plain[i] and sum(t in p for p in plain) > 1 for t in set(plain[q]))]
        got = index.neighbours(q).tolist()
        assert sorted(got) == shared
        # Terms that no other document of the shard has add to the query's own score alone.
        others = [i for i in got if i != q]
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(others, others[1:]))


def test_packing_takes_the_best_unused_neighbour():
    """The greedy choice, against one that scores all documents of the shard anew for each seed."""
    rng = np.random.default_rng(8)
    docs = [rng.integers(3, 30, rng.integers(1, 20)).astype(np.uint32) for _ in range(60)]
    corpus, window = packing.Corpus.of(docs), 32
    packer = packing.Packer(0, window)
    packing.pack_shard(packer, list(range(60)), docs, 2, corpus)
    packer.end()
    mine = [doc for i, (doc, start, *_) in enumerate(packer.rows) if start == 0]
    index, want, unused, seed, filled = packing.Index(docs, corpus), [], list(range(60)), None, 0
    while unused:
        ranked = [i for i in index.neighbours(seed).tolist() if i in unused] if seed is not None else []
        if not ranked:
            seed = unused[0]
        pick = ranked[0] if ranked else seed
        unused.remove(pick)
        want.append(pick)
        filled += len(docs[pick]) + 1
        if filled >= window:
            filled, seed = filled % window, pick
    assert mine == want


def test_packing_brings_neighbours_of_other_files_together(spark):
    # Two hundred topics; the documents of a topic lie far apart in the table.
    rng = random.Random(2)
    topics = [[f"{''.join(rng.choice('bcdfghjklm') for _ in range(8))}" for _ in range(6)] for _ in range(200)]
    rows = [(i, " ".join(rng.choice(topics[i % 200]) for _ in range(60)), None, None) for i in range(1600)]
    pieces = packing.pack(docs_of(spark, rows).repartition(8), window=1024, shard_docs=100).collect()
    check_pieces(pieces, rows, 1024)
    together = defaultdict(Counter)
    for p in pieces:
        together[p.sequence_id][p.doc_id % 200] += 1
    assert sum(max(c.values()) for c in together.values()) / sum(sum(c.values()) for c in together.values()) > 0.4


def test_packing_of_one_word_documents_is_not_quadratic():
    import time

    docs = [np.array([5], np.uint32)] * packing.SHARD_DOCS
    began = time.time()
    packing.pack_shard(packing.Packer(0, 4096), list(range(len(docs))), docs, 2, packing.Corpus.of(docs))
    assert time.time() - began < 5


def test_packing_finds_whoever_shares_a_term():
    many = list(range(1, 31))
    docs = [np.array(x, np.uint32) for x in ([*many, 99], many, [99, 50], [99, 51], [52])]
    assert packing.Index(docs, packing.Corpus.of(docs)).neighbours(0).tolist() == [0, 1, 2, 3]


# ---- WARC, mixing ---------------------------------------------------------------------------------------


def test_warc_chunks(spark):
    big = "x" * 5000
    rows = [(3, "u", big), (1, None, big), (2, "v", "short"), (4, "w", "short"), (5, "x", None), (6, "a b\r\nc", "é\r\n\r\nWARC/1.1" * 50), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(warc.plan_records(pages), f"{scratch(spark)}/warc")
    chunks = warc.read_chunks(manifest, chunk_bytes=700)
    got = {r.record_id: r for r in warc.records(chunks).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == hashlib.sha256(body).hexdigest()
    # A record without an id is a response that none refers to.
    assert got[None].record_type == "response" and got[None].refers_to is None
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and got[1].record_type == "response" and got[4].record_type == "response"
    parts = chunks.where("record_id = 1").orderBy("chunk_no").collect()
    assert b"".join(bytes(p.chunk) for p in parts).decode() == big and len(parts) == 8
    assert parts[2].sha256_so_far == hashlib.sha256(big[:2100].encode()).hexdigest()
    assert warc.records(warc.read_chunks(warc.write_archives(warc.plan_records(pages.where("false")), f"{scratch(spark)}/w0"))).count() == 0


def test_mixture(spark, corpus):
    rows = corpus + [(None, "no id here", None, None), (7, "twice", None, "b")]
    d = docs_of(spark, rows).withColumn("tokens", F.lit(1)).withColumn("rest", F.lit(2))
    out = mixing.mix(d, max_repeat=1.7, block_docs=4)
    assert set(d.columns) < set(out.columns)
    got = out.collect()
    assert {r.doc_id for r in got} == {d for d, *_ in rows}
    count = lambda t: len(re.findall(mixing.WORD, t or ""))
    total, used = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        total[s] += count(t)
    for r in got:
        used[r.source] += count(r.text)
    top = max(total.values())
    for s in total:
        assert 1 <= used[s] / total[s] <= min(1.7, top / total[s]) + 1e-6
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_mixture_replaces_its_columns_and_bounds_its_sources(spark, monkeypatch):
    d = docs_of(spark, [(i, "a b c", None, "xy"[i % 2]) for i in range(10)]).withColumn("mix_weight", F.lit("w")).withColumn("mix_epoch", F.lit("e"))
    out = mixing.mix(d)
    assert sorted(out.columns) == sorted(d.columns) and {r.mix_epoch for r in out.collect()} == {0}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    with pytest.raises(Exception, match="more than 1 sources"):
        mixing.mix(d).collect()


def test_mixture_entropy(spark):
    rows = [(i, "w " * 10, None, "abcd"[min(3, i % 16)]) for i in range(320)]
    weights = {r.source: r.mix_weight for r in mixing.mix(docs_of(spark, rows), max_repeat=100.0, target_entropy=1.2, block_docs=8).collect()}
    h = -sum(w * np.log(w) for w in weights.values())
    assert h == pytest.approx(1.2, abs=0.02)


# ---- fingerprints, suffixes, Jaccard ----------------------------------------------------------------------


def test_entropy_scores_against_counting():
    d = np.random.default_rng(1).integers(97, 110, 400).astype(np.uint8)
    for i, s in enumerate(fingerprint.entropy_scores(d)):
        c = np.array(list(Counter(d[i : i + 64].tolist()).values()))
        assert abs(s - 1000 * (6 - (c * np.log2(c)).sum() / 64) / 6) < 1.01


def test_fingerprints(spark, corpus):
    rows = [r for r in corpus] + [(200, corpus[0][1], None, None)]
    got = {r.doc_id: r for r in fingerprint.with_edits(docs_of(spark, rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[200].fingerprint == got[0].fingerprint
    assert fingerprint.with_edits(docs_of(spark, [])).count() == 0
    odd = fingerprint.with_edits(docs_of(spark, [(None, "x" * 300, None, None), (1, "y", None, None), (1, "y", None, None)])).collect()
    assert len(odd) == 3


def brute_digest(text: bytes, rank):
    """Features by counting each window's votes one by one."""
    n = len(text) - 63
    score = []
    for i in range(max(0, n)):
        c = Counter(text[i : i + 64])
        e = fingerprint._TOP - sum(int(fingerprint._F[k]) for k in c.values())
        score.append(int(rank[1000 * e // fingerprint._TOP]))
    votes = Counter()
    for start in range(-63, n):
        run = [i for i in range(max(0, start), min(n, start + 64)) if score[i] < fingerprint.SCORES]
        if run:
            votes[min(run, key=lambda i: (score[i], i))] += 1
    return [text[i : i + 64] for i in sorted(votes) if votes[i] >= fingerprint.VOTES]


def test_digests_against_brute_force(monkeypatch):
    rng = random.Random(6)
    texts = [words(rng, n).encode() for n in (3, 20, 80, 150)] + [b"-" * 500, b" " * 500, b"", b"ab" * 200, bytes(rng.randrange(256) for _ in range(900))]
    rank = fingerprint.ranks(fingerprint.window_counts(texts))
    for segment in (1 << 20, 100, 257):  # whole texts, and texts in overlapping segments
        monkeypatch.setattr(fingerprint, "SEGMENT", segment)
        assert (fingerprint.ranks(fingerprint.window_counts(texts)) == rank).all()
        got = fingerprint.digests(texts, rank)
        for text, d in zip(texts, got):
            want = brute_digest(text, rank)
            h = fingerprint._hashes(np.array([np.frombuffer(w, np.uint8) for w in want])) if want else np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), "<u8") if text else np.zeros(0, np.uint64)
            assert d.text == fingerprint.Digest(h).text
        assert len({d.text for d in got}) == len(texts)


def brute_likeness(a, b):
    """Filter by filter, with plain sets of bits."""
    x, y = [[set(np.flatnonzero(f)) for f in d.bits] for d in (a, b)]
    fa, fb = list(a.features), list(b.features)
    if a.text == b.text:
        return 1.0
    if not x or not y:
        return 0.0
    if (len(y), sum(fb), b.text) < (len(x), sum(fa), a.text):
        x, y, fa = y, x, fb
    total = 0
    for f, n in zip(x, fa):
        best = 0
        for g in y:
            chance, most = len(f) * len(g) / 2048, min(len(f), len(g))
            best = max(best, min(1, max(0, (len(f & g) - chance) / max(most - chance, 1e-9))))
        total += n * best
    return total / sum(fa)


def test_likeness_against_brute_force():
    rng = np.random.default_rng(2)
    some = [fingerprint.Digest(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 1, 30, 160, 400)]
    some.append(fingerprint.Digest(np.arange(50, dtype=np.uint64)))
    for a in some:
        for b in some:
            assert fingerprint.likeness(a, b) == pytest.approx(brute_likeness(a, b), abs=1e-6)


def test_half_edited_text_is_half_like():
    rng = random.Random(2)
    a, b = words(rng, 600).encode(), words(rng, 600).encode()
    rank = fingerprint.ranks(fingerprint.window_counts([a, b]))
    x, y, z = fingerprint.digests([a, b, a[: len(a) // 2] + b[: len(a) // 2]], rank)
    assert fingerprint.likeness(x, x) == 1 and fingerprint.likeness(x, y) < 0.2 < 0.35 < fingerprint.likeness(x, z) < 0.8


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(3)
    for _ in range(100):
        runs = [suffixes.front_coded([(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))), (i, j)) for j in range(rng.randrange(8))]) for i in range(rng.randrange(1, 6))]
        want = sorted((x[0], x[2]) for r in runs for x in suffixes.decoded(r))
        got = [tuple(x) for x in suffixes.LoserTree([suffixes.decoded(r) for r in runs])]
        assert [(t, p) for t, _, p in got] == want
        for a, b in zip(got, got[1:]):
            assert b[1] == suffixes._common(a[0], b[0])


def brute_removal(rows, w):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + w] for _, b in texts for i in range(len(b) - w + 1))
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most", [20_000, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_removal(spark, most, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcd é") for _ in range(600))
    rows = []
    for i in range(70):
        k = rng.random()
        at = rng.randrange(500)
        part = list(base[at : at + rng.randrange(10, 200)])
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "x"
        noise = lambda: "".join(rng.choice("pqr") for _ in range(rng.randrange(60)))
        text = noise() + "".join(part) + noise() if k < 0.6 else "a" * rng.randrange(120) if k < 0.7 else None if k < 0.75 else rows[-1][1] if k < 0.85 and rows else noise()
        rows.append((rng.choice([i, i, i, None, 0]), text))
    got = suffixes.dedup(docs_of(spark, [(d, t, None, None) for d, t in rows]), 40, span=20, most_in_core=most).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_removal(rows, 40), key=str)


def test_suffix_removal_gives_texts_and_spans(spark):
    base = "".join(random.Random(5).choice("abcd é") for _ in range(150))
    rows = [(1, "x" * 9 + base + "y" * 9), (2, base[20:] + "z" * 50), (3, base[:60] + "-" + base[70:140]), (None, "qr" + base[90:]), (5, None), (6, "only here"), (1, "x" * 9 + base + "y" * 9)]
    docs = spark.createDataFrame([(i, t, n, "old") for n, (i, t) in enumerate(rows)], "doc_id long, text string, own_n int, Kept string")
    got = {r.own_n: r for r in suffixes.remove_repeats(docs, 40, span=20).collect()}
    assert len(got) == len(rows)
    for n, ((i, t), want) in enumerate(zip(rows, brute_removal(rows, 40))):
        r, data = got[n], (t or "").encode()
        gone = bytearray(len(data))
        for s in r.spans:
            gone[s.start : s.start + s.length] = b"\1" * s.length
        assert (r.doc_id, r.text, bytes(r.kept)) == (i, t, bytes(x for x, g in zip(data, gone) if not g))
        assert (i, len(data), sum(s.length for s in r.spans), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(r.kept).hexdigest()) == want and len(r.spans) == want[3]
    assert any(s.start for r in got.values() for s in r.spans) and not got[5].spans and bytes(got[5].kept) == b"only here"


def test_suffix_removal_of_nothing(spark):
    assert suffixes.dedup(docs_of(spark, [])).count() == 0


def brute_components(rows, k, percent):
    sets, link = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        link[d] = d

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                link[y] = x
    return {(d, len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, corpus, k, percent):
    rng = random.Random(9)
    base = words(rng, 150).split()
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "e" + str(rng.randrange(1000))
        near.append((300 + i, " ".join(w).upper() if i % 7 == 0 else "\t".join(w), None, None))
    rows = corpus + near
    got = {tuple(r) for r in jaccard.join(docs_of(spark, rows), k, percent).collect()}
    assert got == brute_components([(d, t) for d, t, *_ in rows], k, percent)


def test_jaccard_edges(spark):
    rows = [(None, "a b c d", None, None), (1, None, None, None), (1, "a b c d", None, None), (2, "a B c D", None, None), (3, "", None, None)]
    got = sorted(map(tuple, jaccard.join(docs_of(spark, rows), 3, 90).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)], key=str)
    assert jaccard.join(docs_of(spark, []), 3, 90).count() == 0


def test_jaccard_tells_words_of_equal_hash_apart(spark):
    rows = [(10 * i + j, w, None, None) for i, n in enumerate([1024, 2048, 4096, 8192]) for j, w in enumerate([*thue_morse(n), f"x {thue_morse(n)[0]} y z"])]
    for k in (3, 5):
        assert {tuple(r) for r in jaccard.join(docs_of(spark, rows), k, 90).collect()} == brute_components([(d, t) for d, t, *_ in rows], k, 90)


def test_jaccard_of_sets_with_equal_members(spark):
    # The same shingles in other orders, white space and cases, and a hot shingle that all texts share.
    rng = random.Random(4)
    rows = [(1, "a b c a b c a b c", None, None), (2, "A b\tc a  b c a b c a b c", None, None), (3, "b c a b c a b", None, None)]
    rows += [(10 + i, "hot hot hot " + words(rng, 3 + i % 5, 40), None, None) for i in range(200)]
    rows += [(300 + i, rows[3 + i][1], None, None) for i in range(5)]
    for percent in (60, 90):
        got = {tuple(r) for r in jaccard.join(docs_of(spark, rows).repartition(7), 3, percent).collect()}
        assert got == brute_components([(d, t) for d, t, *_ in rows], 3, percent)


def test_first_of_each_component(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(5, long, None, None), (3, long + " eleven", None, None), (3, "another text of the same id here", None, None), (4, long, None, None), (4, long, None, None), (7, "only once but twice the row now", None, None), (7, "only once but twice the row now", None, None), (8, None, None, None), (8, None, None, None), (9, "", None, None), (None, long, None, None)]
    got = sorted(((r.doc_id, r.text) for r in jaccard.first_of_each(docs_of(spark, rows), 3, 80).collect()), key=str)
    assert got == sorted([(3, long + " eleven"), (3, rows[2][1]), (7, rows[5][1]), (8, None), (9, ""), (None, long)], key=str)
    assert jaccard.first_of_each(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("k", [3, 5])
@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_jaccard_of_one_short_text(spark, k, n):
    # A batch with fewer words in all than a shingle has.
    rows = [(1, " ".join("one two three four".split()[:n]), None, None)]
    got = [tuple(r) for r in jaccard.join(docs_of(spark, rows).coalesce(1), k, 80).collect()]
    assert got == [(1, max(1, n - k + 1), 1)]


# ---- neighbours, languages, surrogates --------------------------------------------------------------------


def brute_nearest(rows, queries, k):
    """(query id, rank, id, score) over row numbers, so that equal ids and vectors are told apart."""
    for q in queries:
        far = sorted((float(np.sqrt(((x - rows[q][1]) ** 2).sum())), i if i is not None else 1 << 63) for n, (i, x) in enumerate(rows) if n != q)[:k]
        yield [(rows[q][0], r, i if i < 1 << 63 else None, s) for r, (s, i) in enumerate(far, 1)]


def test_permutation_index(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [float("inf")] + [0.0] * 15), (1, v[1].tolist()), (2005, v[7].tolist())]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, shard int")
    got = permutation_index.nearest(df, df.where("vec_id % 100 = 0"), pivots=64, prefix=32, shard_rows=600, query_rows=4).collect()
    good = [(i, np.array(x)) for i, x in rows if i < 2000 or i == 2005]
    hit = total = 0
    for q, want in zip(range(0, 1500, 100), brute_nearest(good, range(0, 1500, 100), 10)):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(a[2] <= b[2] for a, b in zip(mine, mine[1:]))
        hit += len({w[2] for w in want} & {m[1] for m in mine})
        total += 10
    assert hit / total >= 0.9
    assert permutation_index.nearest(df.where("false"), df).count() == 0


def test_permutation_index_of_ties_and_repeats(spark):
    # Everything is reranked here, so the result is exact: copies, equal ids, null ids and equal distances.
    corners = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]]
    rows = [(i, corners[i % 4]) for i in range(40)] + [(0, corners[0])] * 3 + [(0, [2.0, 0.0]), (None, corners[0]), (None, [5.0, 5.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit(1)).withColumn("dim", F.lit("x"))
    got = permutation_index.nearest(df, df.where("vec_id is null or vec_id % 20 = 0"), k=5, shard_rows=7, query_rows=2).collect()
    flat = [(i, np.array(x)) for i, x in rows if len(x) == 2]
    want = [w for ws in brute_nearest(flat, [n for n, (i, _) in enumerate(flat) if i is None or i % 20 == 0], 5) for w in ws] + [(100, 1, 101, 0.5)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_recall_at_shipped_parameters(spark):
    # Vectors without any structure, the hardest case, in more rows than a shard holds.
    rng = np.random.default_rng(6)
    v = rng.normal(size=(12_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": [x.tolist() for x in v]}))
    got = permutation_index.nearest(df, df.where("vec_id % 100 = 0")).toPandas()
    q = np.arange(0, len(v), 100)
    far = 2 - 2 * v[q] @ v.T
    far[np.arange(len(q)), q] = 9
    want = {(int(a), int(b)) for a, bs in zip(q, np.argsort(far, 1)[:, :10]) for b in bs}
    assert len(got) == len(want) and len(want & set(zip(got.query_id, got.vec_id))) / len(want) >= 0.95


def test_language_id(spark):
    rng = random.Random(1)
    make = {"xx": "abcde", "yy": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(make[l]) for _ in range(5)) for _ in range(30)), l, None) for i in range(120) for l in [("xx", "yy")[i % 2]]]
    rows += [(500, None, "xx", None), (501, "123 !!", "yy", None), (502, "", "xx", None), (503, "abc", None, None)]
    d = docs_of(spark, rows)
    model = language.train(d.where(~language.held_out()))
    got = {r.doc_id: r.lang_id for r in language.predict(d, model).collect()}
    assert all(got[i].lang_pred == l for i, _, l, _ in rows[:120])
    assert all(got[i].lang_pred == language.UNKNOWN and got[i].score == 0 for i in (500, 501, 502))
    assert all(0 <= g.score <= 1 for g in got.values())
    nothing = language.train(d.where("false"))
    assert language.predict(d, nothing).first().lang_id.lang_pred == language.UNKNOWN


@pytest.mark.parametrize("text", ["²", "½ Ⅷ ①", "٣ _", "१२", " \n", "!?", "́"])
def test_language_of_texts_without_letters(text):
    model = language.Model(["xx"], np.ones(language.FEATURES), np.zeros((1, language.FEATURES)))
    assert model.predict(text) == ("und", 0.0) and model.predict(text + "ª")[0] == "xx"


def test_language_sample_is_bounded(spark):
    rng = random.Random(3)
    # All ids null or equal, and one row repeated very often.
    many = [(d, words(rng, 5), l, None) for d in (None, 7) for l in ("xx", "yy") for _ in range(400)] + [(1, "same text", "xx", None)] * 500
    rows = docs_of(spark, many).withColumn("lang_id", F.lit("mine")).withColumn("k", F.lit(1))
    drawn = language.sampled(rows.select("doc_id", "text", "lang"), 50).collect()
    assert all(n <= 50 for n in Counter(r.lang for r in drawn).values()) and len(drawn) > 60 and len({r.k for r in drawn}) == len(drawn)
    got = language.train(rows, sample=50)
    assert got.langs == ["xx", "yy"]
    out = language.predict(rows, got, out_col="found")
    assert set(rows.columns) < set(out.columns) and out.count() == len(many)
    assert language.train(docs_of(spark, [(1, "a", None, None)])).langs == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    r = language.predict(docs.where(language.held_out()), model).agg(F.avg((F.col("lang") == F.col("lang_id.lang_pred")).cast("double")).alias("a")).first()
    assert r.a > 0.95


def test_permutation_of_small_domain():
    assert sorted(KEYED.permuted(i, 1000, "k", 0) for i in range(1000)) == list(range(1000))


def test_surrogates_keep_type_format_and_coreference(spark):
    text = 'Mail Bob.Smith@Mail5.example.com, +1 (523) 555-1055 or +1 523 555 1055; 4111 1111 1111 1111 at 70.23.22.57, token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2". Mr. Ray Cole met Mr. Cole and г-жа Анна Белова.'
    new, n = KEYED.rewrite(text)
    before, after = list(surrogates.entities(text)), list(surrogates.entities(new))
    assert n == len(before) and [e[2] for e in before] == [e[2] for e in after]
    assert all(a[4] != b[4] for a, b in zip(before, after))
    phones = [e[4] for e in after if e[2] == "phone"]
    assert phones[0] == phones[1] and phones[0].startswith("+1")
    card = next(e[4] for e in after if e[2] == "card")
    assert surrogates.luhn(card[:-1]) == int(card[-1])
    names = [e[4] for e in after if e[2].startswith("surname:latin")]
    assert names[0] == names[1] and surrogates.script([e for e in after if "cyrillic" in e[2]][0][3]) == "cyrillic"
    clean = "No data here. In 2024, 3.14 is fine; call me."
    assert KEYED.rewrite(clean) == (clean, 0)


@pytest.mark.parametrize("text,gone", [
    ("Mr. Ray Cole met us. Cole said Ray would call COLE's son.", "Ray Cole COLE"),
    ("Cole wrote. We asked Mrs. Cole", "Cole"),
    ("Mr. John Paul Smith left", "John Paul Smith"),
    ("Mrs. Anna Smith-Jones and Jones", "Anna Smith Jones"),
    ("Mr. J. Smith, Mr J.R. Smith and Mr. John Q. Smith", "John Smith"),
    ("Mr. O'Brien and Dr. Cole", "O'Brien Cole"),
    ("Herr Prof. Dr. Weber, Professor Stone", "Weber Stone"),
    ("at fe80::1ff:fe23:4567:890a, ::FFFF:10.1.2.3 or 2001:db8:0:0:0:0:0:1", "fe80::1ff:fe23:4567:890a 10.1.2.3 2001:db8:0:0:0:0:0:1"),
    ("key sk-abcdefghijklmnopqrst", "abcdefghijklmnopqrst"),
    ("key AKIA" + "ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOP"),
    ("card ٤١١١١١١١١١١١١١١١", "٤١١١١١١١١١١١١١١١"),
])
def test_surrogates_of_planted_spans(text, gone):
    new, n = KEYED.rewrite(text)
    assert n and not [x for x in gone.split() if re.search(rf"(?<!\w){re.escape(x)}(?!\w)", new)]
    for title in ("Mr. ", "Mrs. ", "Herr Prof. Dr. ", "Dr. "):
        assert new.count(title) == text.count(title)


def test_surrogates_of_later_mentions():
    new, n = KEYED.rewrite("Mr. Ray Cole met us. Cole said Ray would call. R. stays; Monsieur Dupont était là, coleslaw too.")
    given, surname = re.match(r"Mr\. (\w+) (\w+) met us", new).groups()
    assert n == 5 and f"us. {surname} said {given} would call. R. stays; Monsieur " in new and new.endswith(" était là, coleslaw too.")
    new, _ = KEYED.rewrite("Mr. John Smith, also Mr. J. Smith")
    given, surname, initial, again = re.fullmatch(r"Mr\. (\w+) (\w+), also Mr\. (\w)\. (\w+)", new).groups()
    assert surname == again and initial == given[0]
    for clean in ("At 12:30:45 std::vector, aa:bb:cc:dd:ee:ff and a :: b", "Miss it, Dr. who"):
        assert KEYED.rewrite(clean) == (clean, 0)


def test_surrogates_are_distinct_over_the_corpus(spark):
    # More surnames than a short list has room for, so that clashes occur and are resolved.
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(7)).capitalize() for _ in range(900)})
    rows = [(i, f"Mr. {n} called Mrs. {n}.", None, None) for i, n in enumerate(names)] + [(5000, None, None, None), (5001, "", None, None), (None, f"Mr. {names[0]}", None, None)]
    out = {r.doc_id: r for r in surrogates.replace(docs_of(spark, rows), b"key").collect()}
    got = [re.findall(r"Mr\. (\w+) called Mrs\. (\w+)\.", out[i].text)[0] for i in range(len(names))]
    assert all(a == b for a, b in got) and len({a for a, _ in got}) == len(names) and not {a for a, _ in got} & set(names)
    assert out[None].text == f"Mr. {got[0][0]}" and out[5000].text is None and out[5001].text == ""
    assert surrogates.replace(docs_of(spark, []), b"key").count() == 0


def test_suffix_ranges_and_parts(spark, monkeypatch):
    # Many small ranges, each dealt further by hash, and equal strings in a task and over tasks.
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 6)
    monkeypatch.setattr(suffixes, "MOST_RANGES", 5)
    rng = random.Random(11)
    base = "".join(rng.choice("abcd") for _ in range(300))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randrange(9))) + base[(at := rng.randrange(200)) : at + 90]) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    for most in (3, 1000):
        got = suffixes.dedup(docs_of(spark, [(d, t, None, None) for d, t in rows]).repartition(3), 40, span=20, most_in_core=most).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_removal(rows, 40), key=str)


@pytest.mark.parametrize("value,head", [("+49 151 23456789", "+49"), ("+381 64 1234567", "+381"), ("+1 523 555 1055", "+1"), ("+7 912 345 67 89", "+7"), ("+44 20 7946 0958", "+44"), ("+353 86 123 4567", "+353")])
def test_surrogate_phones_keep_the_whole_country_code(value, head):
    new = KEYED.rewrite(f"call {value} now")[0][5:-4]
    assert new != value and new.startswith(head + " ") and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", value)


def test_surrogate_ibans_keep_their_validity():
    for good, country in (("GB82 WEST 1234 5698 7654 32", "GB"), ("DE89 3704 0044 0532 0130 00", "DE")):
        new = KEYED.rewrite(f"pay {good} today")[0][4:-6]
        plain = new.replace(" ", "")
        assert new != good and plain.startswith(country) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    bad = "GB83WEST12345698765432"
    new = KEYED.surrogate("iban", bad)
    assert new != bad and int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 != 1


def test_surrogate_addresses_keep_their_network():
    import ipaddress

    rng = random.Random(3)
    for text in ("10.1.2.3", "192.168.0.7", "172.20.1.1", "127.0.0.1", "8.8.8.8", "93.184.216.34", "fe80::1", "2001:db8::5", "2a00:1450::1", "fd12::9"):
        a, b = ipaddress.ip_address(text), ipaddress.ip_address(KEYED.surrogate("ipv6" if ":" in text else "ip", text))
        assert a != b and (a.is_private, a.is_loopback, a.is_link_local, a.is_multicast) == (b.is_private, b.is_loopback, b.is_link_local, b.is_multicast)
    some = {f"10.0.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(500)}
    assert len({KEYED.surrogate("ip", x) for x in some}) == len(some)
    assert KEYED.rewrite("listen on ::1 please") == ("listen on ::1 please", 0)


def test_surrogates_depend_on_the_key():
    text = "Mr. Ray Cole, bob@mail.com, 8.8.8.8, my name is Anna Bell."
    assert KEYED.rewrite(text) != surrogates.Keyed(b"other").rewrite(text) and KEYED.rewrite(text) == surrogates.Keyed(b"a key for tests").rewrite(text)
    with pytest.raises(ValueError):
        surrogates.Keyed(b"")


def test_surrogates_of_labelled_names():
    new, n = KEYED.rewrite("my name is Anna Bell. Full name: Carl Stone\nAnna wrote; my name is unknown, Name: x")
    assert n == 5 and not re.search("Anna|Bell|Carl|Stone", new) and new.endswith("wrote; my name is unknown, Name: x")


def brute_surrogates(rows, out):
    """Whole-corpus coreference and distinctness: each titled or joint mention maps to one value, and no two alike."""
    maps = defaultdict(lambda: defaultdict(set))
    for d, t in rows:
        a, b = re.findall(r"[^\W\d_]+|\S", t), re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*|\S", out[d])
        assert len(a) == len(b), (t, out[d])
        for x, y in zip(a, b):
            maps[x][y].add(d)
    return maps


def test_surrogates_follow_names_through_the_corpus(spark):
    rows = [(1, "Dr. Anna Bell met Anna Bell"), (2, "Anna Bell is here, and so is Bell"), (3, "Mrs. Anna Bell left"), (4, "A Bell rang for Anna"), (5, "Mr. Ray Cole saw Carl Ray"), (6, "Ray Cole and Anna Cole"), (7, "Mr. Ray Cole Stone"), (8, "Cole Stone"), (9, "ANNA BELL")]
    out = {r.doc_id: r.text for r in surrogates.replace(docs_of(spark, [(d, t, None, None) for d, t in rows]).withColumn("n_entities", F.lit("x")).repartition(3), b"key").collect()}
    assert out[4] == rows[3][1]
    found = brute_surrogates([r for r in rows if r[0] in (1, 2, 3, 9)], out)
    assert all(len(v) == 1 for w, v in ((w, {x.lower() for x in v}) for w, v in found.items()) if w in ("Anna", "Bell")), found
    assert not any(re.search(r"\b(Anna|Bell)\b", out[d], re.I) for d in (1, 2, 3, 9))
    assert out[6].split()[0] == out[5].split()[1] and out[6].split()[1] == out[5].split()[2] and "Ray" not in out[6]
    assert out[8] != rows[7][1]


def test_surrogates_of_a_full_domain(spark, monkeypatch):
    # Every value of the network is taken, so no surrogate can be free of real ones: distinct they stay.
    monkeypatch.setattr(surrogates, "MAX_ATTEMPTS", 2)
    monkeypatch.setitem(surrogates._NETS, 4, [__import__("ipaddress").ip_network("10.0.0.0/29")])
    rows = [(i, f"host 10.0.0.{i}", None, None) for i in range(8)]
    keyed = surrogates.Keyed(b"key")
    now = surrogates.decided_entities(docs_of(spark, rows), keyed)
    assert now is not None
