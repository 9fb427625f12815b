"""Numpy helpers over the bytes of text columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once, so that memory does not follow the batch or the text.
SLICE = 1 << 20

#: Word characters once A-Z are lower-cased: digits, a-z, everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def pieces(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray | None) -> Iterator[list[tuple[int, int, int]]]:
    """Cut rows into lists of (row, start, end) with about SLICE bytes each.

    Short rows stay whole; a long one is cut right after a byte for which
    ``breaks`` holds (anywhere, if ``breaks`` is None).
    """
    held, size = [], 0
    for row in range(len(ends) - 1):
        start, stop = int(ends[row]), int(ends[row + 1])
        while True:
            end = min(stop, start + SLICE)
            while breaks is not None and end < stop:
                found = np.flatnonzero(breaks[data[end - 1:min(stop, end - 1 + SLICE)]])
                if len(found):
                    end += int(found[0])
                    break
                end = min(stop, end + SLICE)
            held.append((row, start, end))
            size += end - start
            start = end
            if size >= SLICE:
                yield held
                held, size = [], 0
            if start >= stop:
                break
    if held:
        yield held


def joined(data: np.ndarray, held: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces one after another with a blank after each, and where each starts."""
    lengths = np.array([e - s + 1 for _, s, e in held], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(int(starts[-1]), 32, np.uint8)
    if held:  # neighbouring pieces leave a gap of one blank
        for (_, s, e), at in zip(held, starts):
            out[at:at + e - s] = data[s:e]
    return out, starts


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


class Rolling:
    """Polynomial prefix sums modulo 2^64: the hash of any byte range in a few operations."""

    def __init__(self, octets: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(octets) + 1
        self.power = _powers(base, n)
        self.inverse = _powers(pow(base, -1, 1 << 64), n)
        self.total = np.zeros(n, np.uint64)
        np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.inverse[start])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        filled = 1
        while filled < size:  # double what is known
            step = np.uint64(pow(base, filled, 1 << 64))
            out[filled:2 * filled] = out[:filled] * step
            filled *= 2
        known = _POWERS[base] = out
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _Q
    return x ^ (x >> np.uint64(29))


def word_spans(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes that end in a blank."""
    flag = WORD[octets]
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]
