"""Words of many texts at once, as numpy arrays; used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are handled in chunks of about this many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
# Bytes of running products held at once while hashing.
HASH_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = np.uint64(0xFF51AFD7ED558CCD)
_ODD2 = np.uint64(0xC4CEB9FE1A85EC53)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string column as bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``CHUNK_BYTES`` together."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > CHUNK_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows as ``chunks`` cuts them, with their texts; those of other ranges stay in Arrow."""
    for a, b in chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        yield a, b, text_bytes(column[a:b])


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    values ^= values >> np.uint64(33)
    values *= _ODD
    values ^= values >> np.uint64(33)
    values *= _ODD2
    values ^= values >> np.uint64(33)
    return values


def multipliers(count: int, seed: int) -> np.ndarray:
    """Fixed odd multipliers, one for each place in a sequence."""
    return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


class _Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < size:
            inverse = pow(_BASE, -1, 1 << 64)
            fill = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
            fill[0][0] = fill[1][0] = 1
            cls.up, cls.down = np.multiply.accumulate(fill[0]), np.multiply.accumulate(fill[1])
        return cls.up, cls.down


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """All words of a list of texts: where they are and which text each is in.

    ``start`` and ``end`` point into ``data``, the texts with a separator after
    each; ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES) -> None:
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = ~separators[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For every word, the index of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of every word's bytes, replaced through ``table`` first."""
        return self.prefix_hashes([None], table)[0]

    def prefix_hashes(
        self, lengths: list[int | None], table: np.ndarray | None = None
    ) -> list[np.ndarray]:
        """As ``hashes``, of the first so many bytes of every word (None: all)."""
        out = [np.empty(len(self.start), np.uint64) for _ in lengths]
        here = 0
        while here < len(self.start):
            origin = self.start[here]
            to = max(here + 1, int(np.searchsorted(self.end, origin + HASH_BYTES, "right")))
            part = self.data[origin : self.end[to - 1]]
            part = part if table is None else table[part]
            up, down = _Powers.upto(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            start, end = self.start[here:to] - origin, self.end[here:to] - origin
            for length, hashed in zip(lengths, out):
                to_end = end if length is None else np.minimum(end, start + length)
                hashed[here:to] = (sums[to_end] - sums[start]) * down[start]
            here = to
        return [mix64(hashed) for hashed in out]

    def sequences(self, words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each ``length`` words in a row of one text, and their first words."""
        total = len(words) - length + 1
        if total <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        hashed = np.zeros(total, np.uint64)
        for i, factor in enumerate(multipliers(length, seed)):
            hashed += words[i : i + total] * factor
        left = np.repeat(self.first[1:], self.count)[:total] - np.arange(total)
        whole = np.flatnonzero(left >= length)
        return mix64(hashed[whole]), whole


def joined(words: Words, keep: np.ndarray) -> list[memoryview]:
    """Each text's kept words joined by one space, as bytes."""
    start, size = words.start[keep], words.end[keep] - words.start[keep]
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    take = np.repeat(start - begin, size + 1) + np.arange(ends[-1] if len(ends) else 0)
    out = words.data[np.minimum(take, len(words.data) - 1)]
    out[ends - 1] = 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])[words.first]
    edge = np.concatenate([[0], ends])[kept]
    view = memoryview(out)
    return [view[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
