"""Vectorised 64-bit hashes of all runs of a fixed length in a numpy array, by doubling."""

from __future__ import annotations

import numpy as np


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: A random word for each byte value, and an odd multiplier for each doubling.
BYTE = _splitmix(256, 7)
STEP = _splitmix(64, 11) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def double(h: np.ndarray, span: int) -> np.ndarray:
    """From hashes of runs of `span` elements, those of runs of 2 * span."""
    out = h[:-span] * STEP[span.bit_length()]
    out += h[span:]
    out ^= out >> np.uint64(29)
    return out


def runs(elements: np.ndarray, length: int) -> np.ndarray:
    """Unmixed hashes of all runs of `length` elements; element hashes come in as uint64."""
    if len(elements) < length:
        return np.empty(0, np.uint64)
    h, span = elements, 1
    while span * 2 <= length:
        h, span = double(h, span), span * 2
    if span == length:
        return h
    n = len(elements) - length + 1
    out = h[:n] * STEP[32]
    out += h[length - span : length - span + n]
    return out ^ (out >> np.uint64(31))


def arrow_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array, end to end, and its n + 1 offsets; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    array = pc.fill_null(array, "") if array.null_count else array
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices, also empty ones."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])


def slices(texts, step: int = 1 << 19) -> list[tuple[int, int]]:
    """(start, length) of runs of rows of about `step` bytes; a longer text is a run of its own or ends one."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // step)) + 1).tolist(), len(texts)]
    return [(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]
