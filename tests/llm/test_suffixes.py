"""Suffix order, common prefixes, first places and factors against brute force."""

import numpy as np
import pytest

from sparkscribe.llm.repeats import Owners
from sparkscribe.llm.substring_dedup import factors, parse
from sparkscribe.llm.suffix_dedup import covered_places
from sparkscribe.llm.suffixes import common_prefixes, first_places, left_of, longest_before, suffix_array


def prefix(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def shards(seed, n=120):
    rng = np.random.default_rng(seed)
    for i in range(n):
        letters = int(rng.integers(1, 6))
        texts = [rng.integers(0, letters, rng.integers(0, 30)) for _ in range(rng.integers(0, 8))]
        if i % 3 == 0 and texts:
            texts += [texts[0], np.concatenate((texts[-1], texts[0]))]
        yield [t.tolist() for t in texts]


@pytest.mark.parametrize("kind", [np.uint8, np.int32])
def test_order_prefixes_and_matches(kind):
    for texts in shards(1):
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        symbols = np.array([x for t in texts for x in t], kind)
        suffixes = [(t[i:], r) for r, t in enumerate(texts) for i in range(len(t))]
        want = sorted(range(len(suffixes)), key=lambda p: (suffixes[p][0], p))
        sa = suffix_array(symbols, offsets)
        assert sa.tolist() == want
        shared = common_prefixes(symbols, offsets, sa)
        assert shared.tolist() == [0] * bool(want) + [prefix(suffixes[a][0], suffixes[b][0]) for a, b in zip(want, want[1:])]
        first = first_places(sa, shared, left_of(offsets), 4)
        for p, (s, _) in enumerate(suffixes):
            assert first[p] == (-1 if len(s) < 4 else min(q for q, (u, _) in enumerate(suffixes) if u[:4] == s[:4]))
        owner = np.array([r // 2 for _, r in suffixes], np.int64)
        longest, source = longest_before(sa, shared, owner)
        for p, (s, _) in enumerate(suffixes):
            assert longest[p] == max((prefix(s, u) for q, (u, _) in enumerate(suffixes) if owner[q] < owner[p]), default=0)
            if longest[p]:
                assert owner[source[p]] < owner[p] and prefix(s, suffixes[source[p]][0]) == longest[p]


def test_factors_and_covered_places():
    for texts in shards(2):
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        symbols = np.array([x for t in texts for x in t], np.int32)
        n, window = len(texts), 3
        owners = Owners(np.arange(n) // 2, np.arange(n), np.zeros(n, np.int64))
        owner = np.repeat(owners.ids, np.diff(offsets))
        windows = [(tuple(t[i : i + window]), r) for r, t in enumerate(texts) for i in range(len(t))]
        want = [len(w) == window and any(u == w and s // 2 < r // 2 for u, s in windows) for w, r in windows]
        assert parse(symbols, offsets, owners, window).tolist() == want
        earlier = [len(w) == window and any(u == w for u, _ in windows[:p]) for p, (w, _) in enumerate(windows)]
        assert covered_places(symbols.astype(np.uint8), offsets, owners, window).tolist() == earlier
        sa = suffix_array(symbols, offsets)
        longest, _ = longest_before(sa, common_prefixes(symbols, offsets, sa), owner)
        for start, length in zip(*factors(longest, offsets, window)):  # each factor is the longest match at its place
            assert length == longest[start]


def test_overlapping_texts_of_one_document():
    symbols, offsets = np.frombuffer(b"abcdefbcdefg", np.uint8), np.array([0, 6, 12])
    same = Owners(np.zeros(2, np.int64), np.zeros(2, np.int64), np.array([0, 1]))
    assert not covered_places(symbols, offsets, same, 3).any()
    other = Owners(np.zeros(2, np.int64), np.zeros(2, np.int64), np.array([0, 20]))
    assert covered_places(symbols, offsets, other, 3).sum() == 3
