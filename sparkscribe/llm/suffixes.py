"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's rule, in numpy.

A shard is a row of texts of symbols (bytes, or word numbers), end to end, with n + 1 offsets. A suffix ends with its text; it comes before
the longer ones that begin with it, and of equal suffixes the one of the earlier text comes first.
"""

from __future__ import annotations

import numpy as np


#: So few comparisons are finished one by one.
FEW = 256


def left_of(offsets: np.ndarray) -> np.ndarray:
    """For each place how many symbols its text still has, itself included."""
    return np.repeat(offsets[1:], np.diff(offsets)) - np.arange(offsets[-1])


def suffix_array(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All places in the order of their suffixes.

    The first sort takes as many symbols as fit beside a place into 64 bits. Each round then orders the members of every group
    by the rank that stands as far on as the group is sorted, which doubles that depth. A suffix alone in its group is settled
    and skipped from then on; rounds go on until all are settled.
    """
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    size = np.diff(offsets)
    used = np.bincount(symbols) > 0
    # each text is followed by an end, code 0, so places inside are those of the symbols plus the number of texts before
    whole = np.arange(n) + np.repeat(np.arange(len(size)), size)
    total = n + len(size)
    code = np.zeros(total, np.uint64)
    code[whole] = np.cumsum(used)[symbols]
    bits, wide = int(used.sum()).bit_length(), max(1, total.bit_length())
    depth = max(1, min(int(size.max()), (64 - wide) // bits))
    key, ended = code, code == 0  # whether the end of the text is among the symbols taken
    for d in range(1, depth):
        key = key << np.uint64(bits)
        key[: total - d] |= np.where(ended[: total - d], 0, code[d:]).astype(np.uint64)
        ended = ended.copy()
        ended[: total - d] |= code[d:] == 0
    place_bits, mask = np.uint64(wide), np.uint64((1 << wide) - 1)
    key = np.sort((key[whole] << place_bits) | whole.astype(np.uint64))
    sa = (key & mask).astype(np.int64)
    key >>= place_bits
    fresh = ended[sa]  # no two ends are alike
    fresh[1:] |= key[1:] != key[:-1]
    fresh[0] = True
    slots = np.arange(n)
    rank = np.zeros(total, np.int64)  # from 1; an end has 0
    rank[sa] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
    open_, slots, group = _unsettled(sa, slots, fresh)
    while len(open_):
        after = rank[open_ + depth]
        if int(group[-1]).bit_length() + 2 * wide <= 64:
            key = ((group << wide) | after).astype(np.uint64) << place_bits
            key |= open_.astype(np.uint64)
            key.sort()
            open_ = (key & mask).astype(np.int64)
            key >>= place_bits
            fresh = key & mask == 0
            fresh[1:] |= key[1:] != key[:-1]
        else:
            order = np.lexsort((open_, after, group))
            open_, after = open_[order], after[order]
            fresh = after == 0
            fresh[1:] |= (after[1:] != after[:-1]) | (group[1:] != group[:-1])
        fresh[0] = True
        sa[slots] = open_
        rank[open_] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        open_, slots, group = _unsettled(open_, slots, fresh)
        depth *= 2
    rank[whole] = np.arange(n)
    return rank[sa]


def _unsettled(places: np.ndarray, slots: np.ndarray, fresh: np.ndarray):
    """Members of groups of several: their places, their slots in the array, and their groups' numbers."""
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    stay = np.flatnonzero(~alone)
    return places[stay], slots[stay], np.cumsum(fresh[stay])


def _eights(symbols: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes of symbols as one number."""
    raw = np.concatenate((symbols, np.zeros(8 // symbols.itemsize, symbols.dtype))).tobytes()
    return np.ndarray(len(symbols), "<u8", raw, strides=(symbols.itemsize,))


def common_prefixes(symbols: np.ndarray, offsets: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each slot of the array how many symbols its suffix shares with the one before.

    Kasai's rule: where a suffix and the one before it in the array follow on the same symbol, the two suffixes one place earlier are
    neighbours too and share one symbol more. So only the others are compared, 8 bytes a step; the rest follow in place order.
    """
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    left = left_of(offsets)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    starts = np.zeros(n, bool)
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    follows = ~starts & (before > 0)
    i = np.flatnonzero(follows)
    j = before[i]
    follows[i] = ~starts[j] & (symbols[i - 1] == symbols[j - 1])
    shared = np.zeros(n, np.int64)
    lead = np.flatnonzero(~follows & (before >= 0))
    most = np.minimum(left[lead], left[before[lead]])
    eights, step, at = _eights(symbols), 8 // symbols.itemsize, 0
    i, j, who, stop = lead, before[lead], np.arange(len(lead)), most
    length = most.copy()
    while len(who) > FEW:
        x = eights[i] ^ eights[j]
        differ = np.flatnonzero(x)
        low = x[differ] & (~x[differ] + np.uint64(1))  # the lowest bit that differs
        length[who[differ]] = at + (np.bitwise_count(low - np.uint64(1)) >> np.uint8(3)).astype(np.int64) // symbols.itemsize
        at += step
        on = np.flatnonzero((x == 0) & (stop > at))
        i, j, who, stop = i[on] + step, j[on] + step, who[on], stop[on]
    for a, b, w, end in zip(i.tolist(), j.tolist(), who.tolist(), stop.tolist()):  # a few long ones, each by itself
        size, done = 256, at
        while done < end:
            differ = symbols[a : a + min(size, end - done)] != symbols[b : b + min(size, end - done)]
            first = int(differ.argmax())
            if differ[first]:
                length[w] = done + first
                break
            a, b, done, size = a + len(differ), b + len(differ), done + len(differ), size * 2
    shared[lead] = np.minimum(length, most)
    lead = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.where(before < 0, 0, shared[lead] - (np.arange(n) - lead))[sa]


def first_places(sa: np.ndarray, shared: np.ndarray, left: np.ndarray, window: int) -> np.ndarray:
    """For each place the first place of the shard with the same window; -1 where no whole window starts.

    Suffixes that begin with the same window stand side by side, and all neighbours among them share a window or more."""
    first = np.full(len(sa), -1)
    if len(sa):
        heads = np.flatnonzero(shared < window)
        first[sa] = np.repeat(np.minimum.reduceat(sa, heads), np.diff(np.append(heads, len(sa))))
        first[left < window] = -1
    return first


def longest_before(sa: np.ndarray, shared: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest prefix of its suffix that starts in text of a smaller owner, and where it starts.

    That place is the nearest one of a smaller owner above or below in the array. Every slot keeps a slot nearer the
    array's end such that all between have no smaller owner, and jumps to what that one keeps, until a smaller owner is reached.
    """
    n = len(sa)
    best, source = np.zeros(n, np.int64), np.full(n, -1)
    own = owner[sa]
    for forward in (True, False):
        o, common = (own, shared) if forward else (own[::-1], np.append(shared[1:], 0)[::-1])
        to, length = np.arange(n) - 1, common.copy()
        open_ = np.flatnonzero(to >= 0)
        open_ = open_[(o[to[open_]] >= o[open_]) & (length[open_] > 0)]
        while len(open_):
            via = to[open_]
            length[open_] = np.minimum(length[open_], length[via])
            to[open_] = to[via]
            open_ = open_[to[open_] >= 0]
            open_ = open_[(o[to[open_]] >= o[open_]) & (length[open_] > 0)]
        good = np.flatnonzero(to >= 0)
        good = good[o[to[good]] < o[good]]
        place, other = (sa[good], sa[to[good]]) if forward else (sa[n - 1 - good], sa[n - 1 - to[good]])
        longer = length[good] > best[place]
        best[place[longer]], source[place[longer]] = length[good][longer], other[longer]
    return best, source
