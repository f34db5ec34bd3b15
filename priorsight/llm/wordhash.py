"""64-bit hashes of the words of many texts at once, in numpy.

Words are runs of bytes other than ASCII white space (0x09-0x0D, 0x20), as in
``[^\\x20\\x09-\\x0D]+``.  A word's hash is a polynomial over its bytes, taken from
running sums over the whole buffer, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; bounds the memory of a task whatever the length of a text.
PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & _MASK, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown when a longer buffer comes."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, _powers(base, 2), _powers(pow(base, -1, 1 << 64), 2)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + (1 << 16))
            self.up, self.down = _powers(self.base, size), _powers(pow(self.base, -1, 1 << 64), size)
        return self.up, self.down


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHAR_POWERS = _Powers(_BASE)


def rolling(values: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64, of every run of ``width`` of the 64-bit ``values``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers.upto(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[:n])


def _hash_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a buffer that ends with white space."""
    data = np.frombuffer(buffer, np.uint8)
    space = _SPACE[data]
    edges = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _CHAR_POWERS.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix64(hashes + (ends - starts).astype(np.uint64))


def _cuts(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and where each text's words begin (one entry more than texts)."""
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            for piece in _cuts(texts[at]):
                hashes = _hash_buffer(piece + b" ")[1]
                counts[at] += len(hashes)
                found.append(hashes)
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (size := size + len(texts[end]) + 1) <= PIECE + 1:
            end += 1
        lengths = np.fromiter((len(t) + 1 for t in texts[at:end]), np.int64, end - at)
        starts, hashes = _hash_buffer(b" ".join(texts[at:end]) + b" ")
        owner = np.searchsorted(np.cumsum(lengths), starts, "right")
        counts[at:end] = np.bincount(owner, minlength=end - at)
        found.append(hashes)
        at = end
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch that hold about ``size`` bytes of text each, one row at least."""
    texts = as_bytes(batch.column(column))
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield batch.slice(at, end - at), texts[at:end]
        at = end
