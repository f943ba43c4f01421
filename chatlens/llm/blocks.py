"""Texts of an Arrow batch as byte arrays: words, word hashes and n-gram hashes for a block of texts at once.

Everything works on the UTF-8 bytes. Words are runs of word bytes inside one text; a hash of a word is a polynomial over
its bytes (mod 2^64, taken from prefix sums) with a final mix, an n-gram hash a polynomial over its words' hashes.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1B54A32D192ED03 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that end at white space.
NOT_SPACE = ~SPACE
#: Digits, letters and all that is not ASCII.
WORDLIKE = np.ones(256, bool)
WORDLIKE[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), kept between blocks unless very long."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        have[1] = base & _MASK
        done = 2
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    values = _byte_values()[data]
    values *= _powers_of(_BASE, len(data))
    np.cumsum(values, out=sums[1:])
    back = _powers_of(pow(_BASE, -1, 1 << 64), len(data) + 1)
    out = (sums[ends] - sums[starts]) * back[starts]
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(_WORD_BASE)))


class Block:
    """Texts ``first`` to ``first + count`` of a batch: ``data`` their bytes, ``offsets`` where each begins and the end."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.count = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), at.astype(np.int64)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in blocks of at most ``limit`` bytes, but one text at least."""
    if not len(column):
        return
    data, at = string_buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Block(first, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


class Words:
    """The words of a block in order: byte bounds, index of the text, hash; ``per_text`` counts and ``first`` word of each."""

    def __init__(self, block: Block, word_bytes: np.ndarray = NOT_SPACE, lower: bool = False):
        data = LOWER[block.data] if lower else block.data
        n = len(data)
        inside = word_bytes[data]
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            edges = block.offsets[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            begin[edges] = inside[edges]
            end[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, block.offsets)
        self.per_text = np.diff(self.first)
        self.text = np.repeat(np.arange(block.count), self.per_text)
        self.hash = hash_spans(data, self.start, self.end)


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n words of a sequence (also across texts: callers keep what lies in one)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = (_WORD_BASE + 2 * (seed * 0x632BE59BD9B4E019)) & _MASK | 1
    words = mix(hashes + np.uint64((seed * 0x9FB21C651E98DF25) & _MASK)) if seed else hashes
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(words * _powers_of(base, len(hashes)), out=sums[1:])
    back = _powers_of(pow(base, -1, 1 << 64), len(hashes) + 1)
    return mix((sums[n:] - sums[:-n]) * back[: len(hashes) - n + 1])


def whole_grams(words: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of the first word of every run of n words that lies in one text."""
    h = grams(words.hash, n, seed)
    if not len(h):
        return h, np.zeros(0, np.int64)
    at = np.flatnonzero(words.text[: len(h)] == words.text[n - 1 :])
    return h[at], at


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return x.view(np.int64)
