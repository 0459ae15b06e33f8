"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch.

Every delimiter of the two word classes is an ASCII byte, so words are cut on UTF-8 bytes.
Texts are taken whole; a block only groups texts so that the arrays stay small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
LONG_WORD = 32
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
SECOND_MULTIPLIER = 0xC2B2AE3D27D4EB4F | 1
_BYTE = np.arange(256)
#: `[^\x20\x09-\x0D]+`
PRINTED = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
LETTERS = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits, so that any part of them can deal out or order."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Consecutive rows [first, first + n) of a batch. `starts`, `ends`: byte range of each word in
    `data`; `bounds[i]:bounds[i + 1]`: the words of row i; `edges[i]:edges[i + 1]`: its bytes."""

    first: int
    n: int
    data: np.ndarray
    edges: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)

    def text(self, row: int) -> bytes:
        return self.data[self.edges[row] : self.edges[row + 1]].tobytes()


def blocks(texts: pa.Array, table: np.ndarray, lower: bool = False) -> Iterator[Block]:
    """Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    everything = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        data = everything[offsets[i] : offsets[j]]
        yield cut(i, LOWER[data] if lower else data, offsets[i : j + 1] - offsets[i], table)
        i = j


def cut(first: int, data: np.ndarray, edges: np.ndarray, table: np.ndarray) -> Block:
    inside = table[data]
    inner = edges[(edges > 0) & (edges < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[inner] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Block(first, len(edges) - 1, data, edges, starts, ends, np.searchsorted(starts, edges))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word: a polynomial over its bytes by prefix sums, in pieces of bounded size; a word over LONG_WORD bytes by
    BLAKE2, since polynomials modulo a power of 2 can't tell some long words (Thue-Morse sequences) from each other."""
    out = np.empty(len(starts), np.uint64)
    power = inverse = np.zeros(0, np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        a, b = starts[i], ends[j - 1]
        if len(power) <= b - a:
            power = powers(MULTIPLIER, b - a + 1)
            inverse = powers(pow(MULTIPLIER, -1, 1 << 64), b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * inverse[starts[i:j] - a]
        i = j
    out = mix(out)
    for w in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[w] = int.from_bytes(hashlib.blake2b(data[starts[w] : ends[w]].tobytes(), digest_size=8).digest(), "little")
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def grams(h: np.ndarray, k: int, base: int = MULTIPLIER) -> np.ndarray:
    """Hash of each k consecutive words; those that cross a row's end are of no use."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, part, size, left = None, 0, h, 1, k
    while left:  # by doubling: the bits of k
        if left & 1:
            piece = part[have : have + n]
            out = piece.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + piece
            have += size
        left >>= 1
        if left:
            part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
    return mix(out)


def gram_rows(bounds: np.ndarray, k: int) -> np.ndarray:
    """Which of the grams lie within one row, as a mask over all of them."""
    total = int(bounds[-1])
    keep = np.zeros(max(total - k + 1, 0), bool)
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, bounds[:-1], 1)
    np.add.at(steps, np.maximum(bounds[1:] - k + 1, bounds[:-1]), -1)
    keep[:] = np.cumsum(steps)[: len(keep)] > 0
    return keep


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    part = x
    while size * 2 <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return np.minimum(part[:n], part[w - size : w - size + n])
