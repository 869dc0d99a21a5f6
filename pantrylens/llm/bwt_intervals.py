"""Common prefixes of at least a given length by interval expansion on a Burrows-Wheeler transform.

The texts are laid end to end with separators. Suffixes are sorted to a depth beyond the threshold;
their preceding bytes are the transform. Breadth first, every interval of suffixes that share a string
is extended backwards by each byte that precedes it; the end of an extended interval is a place where
the common prefix of two neighbours is one longer than that string. Each place is settled once, by
increasing value, and the search stops at the threshold: places never settled share at least as much.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64)
    # eight symbols at once, so that the first sort already settles most of the order
    first = np.zeros(n, dtype=np.uint64)
    padded = np.r_[text.astype(np.uint64), np.zeros(8, dtype=np.uint64)]
    codes = np.unique(text)
    bits = max(1, int(len(codes) - 1).bit_length())
    dense = np.zeros(int(codes.max()) + 1 if n else 1, dtype=np.uint64)
    dense[codes] = np.arange(len(codes), dtype=np.uint64)
    padded = dense[padded.astype(np.int64)] if n else padded
    width = min(64 // bits, 8)
    for k in range(width):
        first = (first << np.uint64(bits)) | padded[k : k + n]
    order = np.argsort(first, kind="stable")
    new = np.r_[False, first[order][1:] != first[order][:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(new)
    length = width
    while length < depth:
        # only groups that are not settled yet are sorted again
        ranked = rank[order]
        same = np.r_[ranked[1:] == ranked[:-1], False]
        open_ = same | np.r_[False, same[:-1]]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        who = order[at]
        after = np.where(who + length < n, rank[np.minimum(who + length, n - 1)] + 1, 0)
        key = ranked[at].astype(np.uint64) * np.uint64(n + 2) + after.astype(np.uint64)
        inner = np.argsort(key, kind="stable")
        order[at] = who[inner]
        # within a group the rank is that of the group's first place plus the number of smaller ones
        sorted_key = key[inner]
        starts = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        new_rank = at[np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))]
        settled = np.empty(n, dtype=np.int64)
        settled[order] = np.arange(n)
        if length == width:  # ranks from now on are places of group heads
            heads = np.r_[True, ranked[1:] != ranked[:-1]]
            rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        rank[order[at]] = new_rank
        length *= 2
    return order


def shared_prefix_groups(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each its group: equal where neighbours share ``least`` bytes or more.

    ``text`` holds byte values plus one; 0 is a separator. Groups are right for suffixes whose first
    ``least`` symbols hold no separator.
    """
    n = len(text)
    order = sorted_suffixes(text, least + 1)
    before = text[order - 1]  # the transform; the first symbol follows a separator at the end
    sigma = int(text.max()) + 1 if n else 1
    first = np.zeros(sigma + 1, dtype=np.int64)
    np.cumsum(np.bincount(text, minlength=sigma), out=first[1:])
    # to[i]: place of the suffix one longer than suffix i; also rank of the transform's symbol at i
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, dtype=np.int64)
    to[by_symbol] = np.arange(n)
    settled = np.zeros(n + 1, dtype=bool)
    settled[0] = settled[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        total = int(size.sum())
        interval = np.repeat(np.arange(len(low)), size)
        place = np.arange(total) + np.repeat(low - np.cumsum(size) + size, size)
        symbol = before[place]
        inside = symbol > 0
        place, symbol, interval = place[inside], symbol[inside].astype(np.int64), interval[inside]
        # occurrences of one symbol in one interval map to consecutive places
        target = to[place]
        key = interval * sigma + symbol
        order_key = np.argsort(key, kind="stable")
        key, target = key[order_key], target[order_key]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        tail = np.r_[head[1:], len(key)] - 1 if len(key) else head
        lo, hi = target[head], target[tail] + 1
        fresh = ~settled[hi]
        settled[hi] = True
        low, high = lo[fresh], hi[fresh]
    return order, np.cumsum(settled[:n])
