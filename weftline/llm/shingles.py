"""Word and shingle hashes of whole blocks of texts, as arrays of 64-bit values.

Words are runs of anything but the blanks 0x20 and 0x09-0x0D, lower-cased in A-Z. They are hashed eight
bytes at a time for all words of a block together, so the cost of a text does not depend on how short
it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SIZE = 5
#: Bytes of text that are hashed together (one text at least).
BLOCK_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The low n bytes of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finish)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Successive texts: the first one's number, all their words' hashes, and where each text's words
    begin (one place more than texts)."""

    first: int
    words: np.ndarray
    begin: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    def texts(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), strict=True):
            yield self.words[a:b]


def _hash(data: np.ndarray, ends: np.ndarray, first: int) -> Block:
    """``data``: the texts' bytes and eight more; ``ends``: where each text ends."""
    n = int(ends[-1]) if len(ends) else 0
    lower = _LOWER[data]
    blank = _BLANK[data[:n]]
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    edge[n] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = blank[:-1]
    after[:-1] = blank[1:]
    start = np.flatnonzero(~blank & (before | edge[:n]))
    length = np.flatnonzero(~blank & (after | edge[1:])) + 1 - start
    eight = np.ndarray((n + 1,), "<u8", lower.data, 0, (1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        h = mix(length.astype(np.uint64) * _FACTOR ^ eight[start] & _MASK[np.minimum(length, 8)])
        some = np.flatnonzero((length > 8) & (length <= LONG))
        for at in range(8, LONG, 8):
            if not len(some):
                break
            h[some] = mix(h[some] * _FACTOR ^ eight[start[some] + at] & _MASK[np.minimum(length[some] - at, 8)])
            some = some[length[some] > at + 8]
    for k in np.flatnonzero(length > LONG).tolist():
        h[k] = xxh3_64_intdigest(lower[start[k] : start[k] + length[k]])
    return Block(first, h, np.append(np.searchsorted(start, begins), len(start)))


def blocks(column: pa.Array) -> Iterator[Block]:
    """Blocks of the successive texts of a binary column (null: empty)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    if column.null_count:  # the bytes under a null don't count
        here = np.asarray(column.is_valid())
        if sizes[~here].any():
            yield from blocks(pa.array([x or b"" for x in column.to_pylist()], pa.binary()))
            return
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        part = np.concatenate([data[offsets[at] : offsets[to]], np.zeros(8, np.uint8)])
        yield _hash(part, offsets[at + 1 : to + 1] - offsets[at], at)
        at = to


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word of one text."""
    return _hash(np.frombuffer(text + bytes(8), np.uint8), np.array([len(text)]), 0).words


def rolling(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A hash per run of ``size`` words, in order; fewer words give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(size))
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * _FACTOR + words[k : k + n]
    return mix(h)


def shingle_sets(block: Block) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted; fewer than five words count as one shingle, no words as
    none."""
    whole = rolling(block.words)
    for a, b in zip(block.begin[:-1].tolist(), block.begin[1:].tolist(), strict=True):
        yield np.unique(whole[a : b - SIZE + 1]) if b - a >= SIZE else rolling(block.words[a:b], b - a) if b > a else block.words[:0]


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles of one text."""
    words = word_hashes(text)
    return next(shingle_sets(Block(0, words, np.array([0, len(words)]))))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sets that are not empty."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (n - both)
