"""Whole-text tokenising with a public vocabulary, fast enough for large corpora.

The vocabulary lower-cases, drops white space and cuts a text into words, single digits and runs of
marks; each of these has ids of its own. They repeat, so each Python worker keeps a bounded table from words
to ids, which a text's words look up all at once; only unseen words reach the tokenizer, many at a time. A word is
found by a 64-bit hash and then compared byte for byte; a text that holds a word whose hash belongs to another one,
or a word of more than ``words.LONG`` bytes, goes to the tokenizer as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

from skytile.llm import words

#: Slots of a worker's table; when half of them are taken the table starts anew. Bounds memory, never changes results.
SLOTS = 1 << 22
#: Most eight-byte pieces of long words that a table holds.
PIECES = 1 << 22
#: Bytes of text whose words are looked up at once.
BATCH_BYTES = 1 << 17

_ENCODERS: dict[str, "Encoder"] = {}
# The vocabulary's word pattern for lower-cased Latin-1 text; only texts with an apostrophe need it as a pattern.
_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x09-\x0d \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.array([_SPACE if c in (*range(9, 14), 32, 0x85, 0xA0) else _DIGIT if 48 <= c <= 57 or c in (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE) else _LETTER if 97 <= c <= 122 or c in (0xAA, 0xB5, 0xBA) or c >= 0xDF and c != 0xF7 else _MARK for c in range(256)], np.uint8)

class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        # By entry: where its ids start and how many there are, its length, first eight bytes and further pieces.
        self.first, self.count, self.length, self.head, self.more = [np.zeros(1 << 12, t) for t in (np.int32, np.int32, np.int32, np.uint64, np.int32)]
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.pieces, self.filled = np.zeros(1 << 12, np.uint64), 0
        self.taken = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's slot, or the free one where it would go."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        off = np.flatnonzero((self.keys[slot] != hashes) & (self.keys[slot] != 0))
        while len(off):
            slot[off] = (slot[off] + 1) & (SLOTS - 1)
            k = self.keys[slot[off]]
            off = off[(k != hashes[off]) & (k != 0)]
        return slot

    def _learn(self, texts: list[bytes], hashes: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> None:
        """Put words into the table; each ends with the one id that marks its end."""
        ids = self._encode(b" ".join(texts).decode("latin-1"))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(texts):
            each = [self._encode(w.decode("latin-1")) for w in texts]
            ids, stops = np.concatenate(each), np.cumsum([len(e) for e in each])
        n = len(texts)
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        own = slice(self.taken, self.taken + n)
        for name in ("first", "count", "length", "head", "more"):
            setattr(self, name, _room(getattr(self, name), self.taken + n))
        self.first[own] = self.used + np.concatenate([[0], stops[:-1]])
        self.count[own] = np.diff(stops, prepend=0)
        self.length[own], self.head[own] = sizes, heads
        further = np.maximum(sizes - 1, 0) // 8
        self.pieces = _room(self.pieces, self.filled + int(further.sum()))
        self.more[own] = self.filled + np.cumsum(further) - further
        left = np.arange(n)
        while len(left):
            slot, at = np.unique(self._slots(hashes[left]), return_index=True)
            self.keys[slot], self.entry[slot] = hashes[left[at]], self.taken + left[at]
            left = np.delete(left, at)
        self.used += len(ids)
        self.filled += int(further.sum())
        self.taken += n

    def ids(self, text: str | None) -> np.ndarray:
        """All ids of a text (null: none) as uint32."""
        return self.many([text])[0]

    def batches(self, texts):
        """The ids of each of the texts, in order; a bounded number of bytes is looked up at once."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= BATCH_BYTES:
                yield from self.many(held)
                held, size = [], 0
        yield from self.many(held)

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [np.zeros(0, "<u4")] * len(texts)
        raws, places = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            raw = None
            if "<|" not in text:  # else it may hold the text of a special token
                try:
                    raw = text.encode("latin-1").translate(_LOWER)
                except UnicodeEncodeError:
                    pass
            if raw is None:
                out[i] = self._encode(text)
                continue
            if b"'" in raw:
                # Words, told apart by a byte that this pattern never leaves inside of one.
                raw = b"\x85".join(_WORD.findall(raw))
            raws.append(raw)
            places.append(i)
        if not raws:
            return out
        whole = b"\x85".join(raws)
        data = np.frombuffer(whole, np.uint8)
        cls = _CLASS[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        np.logical_or(cls[1:] != cls[:-1], cls[1:] == _DIGIT, out=edge[1:-1])
        for raw, at in zip(raws, np.cumsum([0] + [len(r) + 1 for r in raws]).tolist()):
            if b"'" in raw:  # here a word ends where the pattern ended it
                inner = data[at : at + len(raw)] == 0x85
                own = edge[at : at + len(raw) + 1]
                own[:] = False
                own[0] = own[-1] = True
                own[:-1] |= inner
                own[1:] |= inner
        cuts = np.flatnonzero(edge)
        real = cls[cuts[:-1]] != _SPACE
        starts, stops = cuts[:-1][real], cuts[1:][real]
        if not len(starts):
            return out
        sizes = stops - starts
        h, head, more = words.hashes(words.padded(whole), starts, sizes)
        h[h == 0] = 1
        short = sizes <= words.LONG
        slot = self._slots(h)
        new = np.flatnonzero((self.keys[slot] == 0) & short)
        if len(new):
            _, at = np.unique(h[new], return_index=True)
            room = int(((sizes[new[at]] - 1) // 8).sum())
            if self.taken + len(at) > SLOTS // 2 or self.filled + room > PIECES:
                self._clear()
                new = np.flatnonzero(short)
                _, at = np.unique(h[new], return_index=True)
            for lo in range(0, len(at), SLOTS // 4):
                some = new[at[lo : lo + SLOTS // 4]]
                before = self.taken
                self._learn([whole[a:b] for a, b in zip(starts[some].tolist(), stops[some].tolist())], h[some], sizes[some], head[some])
                rank = np.full(len(h), -1)
                rank[some] = np.arange(before, self.taken)
                for i, (live, piece) in enumerate(more):
                    r = rank[live]
                    self.pieces[self.more[r[r >= 0]] + i] = piece[r >= 0]
            slot = self._slots(h)
        e = self.entry[slot]
        same = short & (self.keys[slot] != 0) & (self.length[e] == sizes) & (self.head[e] == head)
        for i, (live, piece) in enumerate(more):
            same[live] &= self.pieces[np.minimum(self.more[e[live]] + i, len(self.pieces) - 1)] == piece
        n = np.where(same, self.count[e], 0).astype(np.int64)
        end = np.cumsum(n)
        flat = self.flat[np.repeat(self.first[e] - (end - n), n) + np.arange(end[-1])]
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
        ends = np.concatenate([[0], end])[bounds].tolist()
        for j, i in enumerate(places):
            out[i] = flat[ends[j] : ends[j + 1]]
        if not same.all():  # texts that hold a word which the table cannot tell
            for j in np.unique(np.searchsorted(bounds, np.flatnonzero(~same), "right") - 1).tolist():
                out[places[j]] = self._encode(texts[places[j]])
        return out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, grown to n entries at least."""
    while len(a) < n:
        a = np.concatenate([a, np.zeros_like(a)])
    return a


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a vocabulary file, without loading a tokenizer."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return 1 + max([*d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens") or [])])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
