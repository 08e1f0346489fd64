"""Words of whole texts as numpy arrays, straight from the bytes of an Arrow column.

Used inside ``mapInArrow`` tasks. Spark partitions the documents; a task works
through its batches in pieces of bounded bytes (one text at least), so its
memory follows the piece, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
PIECE_BYTES = 1 << 19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def byte_table(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: ``[^\x20\x09-\x0D]``: everything but ASCII white space. Bytes of longer characters are never separators.
NOT_SPACE = byte_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z, all beyond ASCII.
ALNUM = byte_table(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that their high bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, made as long as needed."""

    def __init__(self, multiplier: int = int(_MULTIPLIER)) -> None:
        self.multiplier = np.uint64(multiplier)
        self.inverse = np.uint64(pow(multiplier, -1, 2**64))
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            for name, base in (("up", self.multiplier), ("down", self.inverse)):
                steps = np.full(n + 1, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[: n + 1], self.down[: n + 1]


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a missing text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class WordHasher:
    """Finds and hashes the lower-cased words of a piece of texts."""

    def __init__(self, word_bytes: np.ndarray) -> None:
        self.word_bytes = word_bytes
        self.powers = _Powers()

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end byte of each word; the number of words before each text (and in all)."""
        low = _LOWER[data]
        inside = self.word_bytes[low]
        n = len(data)
        if n == 0:
            none = np.zeros(0, dtype=np.int64)
            return np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < n]
        first[begins] = inside[begins]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:][(offsets[1:] > 0)] - 1
        last[ends] = inside[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = self.powers.get(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[low] * up[:n], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start])
        return hashes, start, end, np.searchsorted(start, offsets)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words; those across two texts are the caller's to skip."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        out = out * _SHINGLE + hashes[k : k + count]
    return mix(out)


def shingle_set(hashes: np.ndarray, wins: np.ndarray, begin: int, end: int, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the words begin..end; a shorter text is one shingle, none has none."""
    n = end - begin
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if n < width:
        return windows(hashes[begin:end], n)
    return np.unique(wins[begin : end - width + 1])
