"""Words of a byte buffer as 64-bit hashes: plain ones, with the eight-byte pieces that tell equal hashes of unlike words apart, and keyed ones."""

from __future__ import annotations

import hashlib

import numpy as np

#: Longer words are hashed one by one.
LONG = 4096

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def padded(raw: bytes) -> np.ndarray:
    """The bytes with room behind them for reading eight at a time."""
    return np.frombuffer(raw + b"\0" * 8, np.uint8)


def hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(hash, first piece, further pieces) of the words at ``starts`` of a padded buffer.

    Further pieces are a list of (words that reach so far, their next eight bytes). Words above ``LONG`` bytes have none.
    """
    wide = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    head = wide[starts] & _MASK[np.minimum(sizes, 8)]
    h = head ^ (sizes.astype(np.uint64) * _M[0])
    more, at = [], 8
    live = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    while len(live):
        piece = wide[starts[live] + at] & _MASK[np.minimum(sizes[live] - at, 8)]
        own = h[live]
        h[live] = ((own ^ (own >> np.uint64(32))) * _M[1]) ^ piece
        more.append((live, piece))
        at += 8
        live = live[sizes[live] > at]
    h = mix(h)
    for i in np.flatnonzero(sizes > LONG).tolist():
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        h[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), "<u8")[0]
    return h, head, more


def key_table(seed: bytes) -> np.ndarray:
    """Two rows of random multipliers: for a word's length and for each of its four-byte pieces."""
    width = LONG // 4 + 1
    return np.frombuffer(hashlib.shake_256(seed).digest(16 * width), "<u8").reshape(2, width)


def keyed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, seed: bytes) -> np.ndarray:
    """Hashes of the words at ``starts`` of a padded buffer by multilinear hashing.

    Any two unlike words have equal hashes for one of 2 ** 64 tables, so nobody who does not know the seed can name such
    words. Each half of a hash is the upper half of a sum of products of multipliers and pieces.
    """
    wide = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    low = np.uint64(0xFFFFFFFF)
    live, at = np.flatnonzero(sizes <= LONG), 0
    sums = [row[0] * sizes.astype(np.uint64) for row in table]
    while len(live):
        piece = wide[starts[live] + at] & _MASK[np.minimum(sizes[live] - at, 8)]
        for own, row in zip(sums, table):
            own[live] += row[1 + at // 4] * (piece & low) + row[2 + at // 4] * (piece >> np.uint64(32))
        at += 8
        live = live[sizes[live] > at]
    h = (sums[0] & ~low) | (sums[1] >> np.uint64(32))
    for i in np.flatnonzero(sizes > LONG).tolist():
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        h[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8, key=seed[:64]).digest(), "<u8")[0]
    return h
