"""Vectorised byte and token kernels that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_POW = np.empty(4096, np.uint64)
_POW[0] = 1
with np.errstate(over="ignore"):
    for _i in range(1, 4096):
        _POW[_i] = _POW[_i - 1] * U(0x9E3779B97F4A7C15)

#: Masks of the first 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bytes of a word between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits, underscore, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    WORD[_a:_b] = True
#: ASCII upper to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the pair of identifiers (a, b); order matters."""
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, o, data = col.buffers()
    off = np.frombuffer(o, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tokens(b: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the tokens, and each document's first token."""
    n = len(b)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    m = member[b]
    prev, after = np.zeros(n, bool), np.zeros(n, bool)
    prev[1:], after[:-1] = m[:-1], m[1:]
    some = off[:-1] < off[1:]
    prev[off[:-1][some]] = False
    after[off[1:][some] - 1] = False
    starts, ends = np.flatnonzero(m & ~prev), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def token_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each token's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    s0 = int(starts[0])
    span = np.diff(starts, append=len(b))
    where = np.arange(s0, len(b)) - np.repeat(starts, span)
    v = _BYTE[b[s0:]] * _POW[where & 4095]
    v[where >= np.repeat(ends - starts, span)] = 0
    return mix(np.add.reduceat(v, starts - s0) ^ ((ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)))


def word_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each token's bytes, faster for short ones: eight at a time, or byte by byte for tokens beyond 64."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = (ends - starts).astype(np.uint64)
    out = size * U(0xD6E8FEB86659FD93)
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    eight = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))
    at, left, rows = starts, size, slice(None)
    for _ in range(8):
        word = eight[at]
        word &= _LOW[np.minimum(left, U(8)).view(np.int64)]
        out[rows] = mix((out[rows] ^ word) * U(0x9E3779B97F4A7C15))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rows = more if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - U(8)
    for r in rows.tolist():
        t = b[starts[r] : ends[r]]
        v = _BYTE[t]
        v *= np.resize(_POW, len(t))
        out[r] = mix(np.add.reduce(v)[None] ^ (size[r : r + 1] * U(0xD6E8FEB86659FD93)))[0]
    return out


_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).astype(np.uint8).copy().view("<u8")[:, 0].copy()


def simhash128(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bits of each document's feature hashes: (documents, 16) bytes.

    Each byte of a hash spreads into eight 8-bit lanes of a word, so that blocks
    of up to 255 features add without carry.
    """
    count = np.diff(first)
    out = np.zeros((len(count), 16), np.uint8)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    c = count[full]
    blocks = -(-c // 255)
    b0 = np.cumsum(blocks) - blocks
    at = np.repeat(first[:-1][full], blocks) + 255 * (np.arange(int(blocks.sum())) - np.repeat(b0, blocks))
    at -= first[0]
    h = h[first[0] : first[-1]]
    both = np.stack([h, mix(h + U(0xA0761D6478BD642F))], 1).view(np.uint8)
    votes = np.empty((len(at), 16), "<u8")
    for k in range(16):
        votes[:, k] = np.add.reduceat(_SPREAD[both[:, k]], at)
    sums = np.add.reduceat(votes.view(np.uint8).astype(np.int64).reshape(len(at), 128), b0, axis=0)
    out[full] = np.packbits(2 * sums > c[:, None], axis=1)
    return out
