"""Word hashes: unlike words that the plain hash cannot tell apart are told apart by keyed ones."""

import random

import numpy as np
import pytest

from skytile.llm import jaccard, words
from test_llm import brute_components, docs_of

GOOD = [c for c in range(33, 127) if not 65 <= c <= 90]


def plain_hashes(texts):
    raw = b" ".join(texts)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return words.hashes(words.padded(raw), starts, np.array([len(t) for t in texts]))[0]


def twins(size, seed):
    """Two words of ``size`` letters, a multiple of eight from 16 up, with one plain hash."""
    rng = random.Random(seed)
    mask = (1 << 64) - 1

    def state(head):
        own = int.from_bytes(head, "little") ^ (size * int(words._M[0]) & mask)
        return (own ^ own >> 32) * int(words._M[1]) & mask

    while True:
        a, b = (bytes(rng.choice(GOOD) for _ in range(8)) for _ in range(2))
        gap = (state(a) ^ state(b)).to_bytes(8, "little")
        pieces = [[c for c in GOOD if c ^ d in GOOD] for d in gap]
        if all(pieces):
            second = bytes(rng.choice(p) for p in pieces)
            rest = bytes(rng.choice(GOOD) for _ in range(size - 16))
            return (a + second + rest).decode(), (b + bytes(x ^ d for x, d in zip(second, gap)) + rest).decode()


@pytest.mark.parametrize("size", [16, 24, 64])
def test_twins_share_the_plain_hash_only(size):
    for seed in range(3):
        pair = [w.encode() for w in twins(size, seed)]
        assert pair[0] != pair[1] and len(set(plain_hashes(pair).tolist())) == 1
        raw = b" ".join(pair)
        for key in (b"", b"one key", b"another"):
            h = words.keyed(words.padded(raw), np.array([0, size + 1]), np.array([size, size]), words.key_table(key), key)
            assert h[0] != h[1]


def test_keyed_hashes_follow_the_word_alone():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé日 ") for _ in range(rng.randrange(1, 40))).replace(" ", "").encode() or b"x" for _ in range(500)] + [b"a" * n for n in range(1, 40)] + [b"y" * 4096, b"y" * 4097, b"y" * 4098]
    key = b"k"
    raw = b" ".join(texts)
    starts, sizes = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]), np.array([len(t) for t in texts])
    h = words.keyed(words.padded(raw), starts, sizes, words.key_table(key), key).tolist()
    by_text = {}
    for t, x in zip(texts, h):
        assert by_text.setdefault(t, x) == x
    assert len(set(by_text.values())) == len(by_text)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_joins_of_twins(spark, k, percent):
    rng = random.Random(6)
    rows, doc = [], 0
    for size in (16, 24):
        for seed in range(4):
            a, b = twins(size, seed)
            other = [f"w{rng.randrange(1000)}" for _ in range(60)]
            for text in (lambda w: w, lambda w: f"x {w}", lambda w: f"{w} {w} {w} {w}", lambda w: " ".join(f"{o} {w}" for o in other)):
                rows += [(doc, text(a), None, None), (doc + 1, text(b), None, None)]
                doc += 2
    got = {tuple(r) for r in jaccard.join(docs_of(spark, rows), k, percent).collect()}
    assert got == brute_components([(d, t) for d, t, *_ in rows], k, percent)
    assert len({c for _, _, c in got}) == len(rows)


def test_first_of_each_keeps_columns_of_any_name(spark):
    """Columns named like those that the operator adds pass through."""
    docs = spark.createDataFrame([(1, "a b c d e f", 5, b"x"), (2, "a b c d e f", 6, b"y"), (3, "other words of a text here", 7, None)], "doc_id long, text string, rep_id int, _rep_md5 binary")
    got = sorted(tuple(r) for r in jaccard.first_of_each(docs).collect())
    assert [(r[0], r[2]) for r in got] == [(1, 5), (3, 7)]
