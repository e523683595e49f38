"""Anchors: minimisers that every repeat of a fixed length must share, and the spans in which its windows lie.

A window of `window` elements holds `window - gram + 1` grams; the anchor of a window is its gram of the least hash. Equal windows
have equal anchors at equal offsets. All windows with a given anchor lie in its span, the elements up to
`window - gram` before and after the gram, cut at the document's ends.
"""

from __future__ import annotations

import numpy as np

from .rolling import BYTE, mix, runs

#: Elements handled at once; a longer document is cut into such slices that overlap by two windows.
SLICE = 1 << 18


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of `width`."""
    span = 1
    while span * 2 <= width:
        x, span = f(x[:-span], x[span:]), span * 2
    left = width - span
    return f(x[: len(x) - left], x[left:]) if left else x


def word_elements(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, offsets by document, and each word's first and last-plus-one byte. ASCII white space parts words."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~blank
    first, last = word.copy(), word.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.searchsorted(starts, ends)
    out = np.zeros(len(starts), np.uint64)
    size = stops - starts
    for at in range(int(size.max(initial=0))):  # byte by byte of all words that long
        live = np.flatnonzero(size > at) if at else slice(None)
        if at >= 64:  # rare: the rest of a very long word, one by one
            for i in live:
                out[i] = np.frombuffer(_digest(data[starts[i] : stops[i]].tobytes()), np.uint64)[0]
            break
        out[live] = (out[live] ^ BYTE[data[starts[live] + at]]) * np.uint64(0x9E3779B97F4A7C15)
        out[live] ^= out[live] >> np.uint64(29)
    return mix(out + size.astype(np.uint64)), offsets, starts, stops


def _digest(x: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(x, digest_size=8).digest()


def anchors(elements: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Of documents end to end, n + 1 offsets: hash `a`, document `doc`, and `at`, `left`, `right` as element positions."""
    parts = [_slice(elements, offsets, window, gram, core, min(len(elements), core + SLICE)) for core in range(0, max(1, len(elements)), SLICE)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _slice(elements, offsets, window, gram, core, stop) -> dict[str, np.ndarray]:
    low, high = max(0, core - 2 * window), min(len(elements), stop + 2 * window)
    x = elements[low:high]
    n, width = len(x), window - gram + 1
    empty = {k: np.empty(0, np.uint64 if k == "a" else np.int64) for k in ("a", "doc", "at", "left", "right")}
    if n < window:
        return empty
    g = mix(runs(x, gram))
    order = np.maximum((g >> np.uint64(32)).astype(np.uint32), 1)  # grams of equal leading bits are anchors together
    # windows inside one document
    starts = np.clip(offsets[:-1] - low, 0, n)
    stops = np.clip(offsets[1:] - low - window + 1, starts, n)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, stops, -1)
    least = _sliding(order, width, np.minimum)
    least[np.cumsum(inside)[: len(least)] <= 0] = 0
    pad = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), width, np.maximum) == order)
    at = at[(at + low >= core) & (at + low < stop)]
    if not len(at):
        return empty
    doc = np.searchsorted(offsets, at + low, "right") - 1
    left = np.maximum(offsets[doc], at + low - (window - gram))
    right = np.minimum(offsets[doc + 1], at + low + window)
    return {"a": mix(g[at]), "doc": doc, "at": at + low, "left": left, "right": right}
