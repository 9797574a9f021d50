"""Vectorised 64-bit hashes of byte and word spans, for use inside tasks.

Texts are laid end to end as UTF-8 in buffers of a few MB. A prefix sum of
``TABLE[byte] * BASE**position`` (arithmetic modulo 2**64) gives the hash of any span from two
reads, so a window hash costs the same at any length. Keys that decide about equality are used in
pairs (a short and a long span of the same place), which makes them 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together.
BUFFER_BYTES = 1 << 21
#: White space that separates words: space and the five control characters 9 to 13.
SPACES = (32, 9, 10, 11, 12, 13)

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """``BASE**i`` (or its inverse) for i below ``n``; kept per process up to one buffer."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        size = max(n, BUFFER_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * BUFFER_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: Sequence[str | bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of texts of about ``BUFFER_BYTES``; null is empty."""
    part: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        part.append(b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= BUFFER_BYTES or i + 1 == len(texts):
            offsets = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum([len(p) for p in part], out=offsets[1:])
            yield first, i + 1, np.frombuffer(b"".join(part), dtype=np.uint8), offsets
            part, size, first = [], 0, i + 1


class Spans:
    """Hashes of spans of one buffer."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        values = _TABLE[_LOWER[data] if lower else data]
        values *= _power("up", len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = _power("down", len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the number of the first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    fresh = np.zeros(len(data), dtype=bool)  # bytes that begin a text
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | fresh[1:]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive entries (``len - length + 1`` of them)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        total *= np.uint64(_BASE)
        total += hashes[i : i + n]
    return mix(total)


def text_of(ends_at: np.ndarray, n: int) -> np.ndarray:
    """Index of the text that each of ``n`` consecutive items belongs to."""
    return np.repeat(np.arange(len(ends_at) - 1), np.diff(ends_at))[:n]


def covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` places those that lie in one of the ranges from ``low`` to before ``high``."""
    return np.cumsum(np.bincount(low, minlength=n + 1)[:n] - np.bincount(high, minlength=n + 1)[:n]) > 0


def listed(column, first: int, last: int) -> tuple[np.ndarray, pa.Array]:
    """Of an Arrow column of lists, rows ``first`` to before ``last``: the row of each entry, counted from ``first``, and the entries."""
    part = column.slice(first, last - first)
    lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(last - first), lengths), part.flatten()


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in every window of ``width`` entries.

    The last bits of the values, as many as number two windows, do not count.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # A window is the end of one run of ``width`` entries and the begin of the next: minima from the right and from the left.
    mask = np.uint64((1 << (2 * width - 1).bit_length()) - 1)
    runs = np.full(-(-len(values) // width) * width, ~mask, dtype=np.uint64)
    np.bitwise_and(values, ~mask, out=runs[: len(values)])
    runs = runs.reshape(-1, width) | np.arange(width, dtype=np.uint64)
    after = np.minimum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    runs += np.uint64(width)
    before = np.minimum.accumulate(runs, axis=1).ravel()[width - 1 : width - 1 + n]
    best = (np.minimum(after, before) & mask).astype(np.int64)
    return best + np.arange(n) // width * width
