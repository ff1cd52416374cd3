"""Cross-tokenizer alignment against the tokenizers themselves and a plain merge of two lists of ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skytile.llm import alignment

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(PATH_A)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
SIZE_B = PIECES.get_piece_size()
LETTERS = alignment.byte_letters()


def tokens(text):
    """(id, bytes) of A and B by the tokenizers' own functions."""
    a = [(i, bytes(LETTERS[c] for c in TOKENIZER.id_to_token(i))) for i in TOKENIZER.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def plain(rows):
    found = []
    for doc, text in rows:
        links, groups = [], []
        a, b = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
        i = j = 0
        group = ([], [])
        while i < len(a):
            if not group[0] or group[0][-1] != i:
                group[0].append(i)
            if not group[1] or group[1][-1] != j:
                group[1].append(j)
            links.append((a[i][0], b[j][0]))
            x, y = ends_a[i], ends_b[j]
            if x == y:
                groups.append(group)
                group = ([], [])
            i, j = i + (x <= y), j + (y <= x)
        text_of = ";".join(",".join(str(a[k][0]) for k in g[0]) + "|" + ",".join(str(b[k][0]) for k in g[1]) for g in groups)
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
    count = Counter(p for f in found for p in f[4])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted([(d, na, nb, ng, len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), h) for d, na, nb, ng, ls, h in found], key=str)


def got(spark, rows, **how):
    docs = spark.createDataFrame([(1, t, d, "x") for d, t in rows], "batch int, text string, doc_id long, pairs string")
    out = alignment.align(docs, PATH_A, PATH_B, SIZE_B, **how)
    return sorted([(r["doc_id"], *(r[c] for c in alignment.COUNTS), r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out.collect()], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    odd = [chr(c) for c in range(256)] + ["日", "é", "▁", "<s>", "<|endoftext|>", "<0x0A>", "'s", "'re", "  ", "   ", "\n\n", "😀", "ﬁ", "　"]
    words = ["alignment", "of", "Tokenizers", "don't", "über", "naïve", "x2", "1999", "unbelievable", "l'été", "—", "..."]
    out = [(None, None), (1, ""), (2, " "), (3, "   "), (4, "a"), (5, "a▁b"), (6, "日本語 text"), (6, "日本語 text"), (None, "null id")]
    for d in range(10, 90):
        out.append((d, "".join(rng.choice(odd) for _ in range(rng.randrange(1, 20)))))
    for d in range(100, 160):
        out.append((d, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 200)))))
    out.append((200, "".join(rng.choice(words + [" "]) for _ in range(20000))))
    out.append((201, " ".join("αβγδ"[rng.randrange(4)] * rng.randrange(1, 4) for _ in range(1000))))
    return out


def test_chunks_give_the_tokenizers_ids():
    rng = random.Random(2)
    a, b = alignment.Vocabulary(PATH_A), alignment.Vocabulary(PATH_B)
    letters = [chr(c) for c in range(256)] + list(" " * 60 + "''''sdlmtrev12abcde") + ["'ll", "<|endoftext|>", "<unk>", "▁", "日"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        for v, ids in ((a, TOKENIZER.encode(" " + text, add_special_tokens=False).ids), (b, PIECES.encode(text))):
            own, n, good = v.encode([text])
            assert good[0] == (b"".join(v.token_bytes[i] for i in ids) == (" " + text).encode())
            assert not good[0] or own.tolist() == ids


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "CHUNKS", 3)
    a = alignment.Vocabulary(PATH_A)
    for text in ["one two three four five", "six one two", "one two three four five"]:
        assert a.encode([text])[0].tolist() == TOKENIZER.encode(" " + text, add_special_tokens=False).ids
    assert len(a.table) <= 8


@pytest.mark.parametrize("how", [{}, {"batch_bytes": 300, "lane": 3}])
def test_against_plain_version(spark, rows, how):
    assert got(spark, rows, **how) == plain(rows)


def test_places_start_at_common_ends():
    rng = np.random.default_rng(4)
    for lane in (1, 2, 7):
        ends_a, ends_b, first_a, first_b, at = [], [], [], [], 0
        for _ in range(20):
            size = int(rng.integers(1, 60))
            first_a.append(len(ends_a))
            first_b.append(len(ends_b))
            for ends in (ends_a, ends_b):
                ends += sorted({at + size, *(at + rng.integers(1, size + 1, int(rng.integers(0, size + 1)))).tolist()})
            at += size
        args = [np.array(x) for x in (ends_a, ends_b, first_a, first_b)]
        want = alignment.lockstep(*args, lane=10**9)
        have = alignment.lockstep(*args, lane=lane)
        assert sorted(zip(*have[:2])) == sorted(zip(*want[:2])) and all((x == y).all() for x, y in zip(have[2:], want[2:]))


def test_empty_table(spark):
    assert got(spark, []) == []


def test_chunks_are_looked_up_once():
    looked = []

    class Chunk(str):
        def __hash__(self):
            looked.append(str(self))
            return super().__hash__()

    a = alignment.Vocabulary(PATH_A)
    a.pattern = type("P", (), {"findall": lambda self, t: [Chunk(w) for w in (" one", " two", " one")]})()
    a._encode = lambda chunks: [[0] for _ in chunks]
    for _ in range(5):
        a.encode(["one two one"])
    assert len(looked) <= 5 * 3 + 2 * 2  # and once more for each new chunk, which is kept then
