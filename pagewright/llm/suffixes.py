"""Suffix arrays over integer symbols with numpy: prefix doubling on unresolved groups only."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, keep_ranks: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and, if keep_ranks, ranks by the first 1, 2, 4, ... symbols.

    Symbols are non-negative; a suffix that ends is smaller than any that goes on. Ranks of equal
    prefixes are equal, so two suffixes agree on 2 ** k symbols where ranks[k] agrees (and neither
    ends before).
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), []
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    held = symbols[order]
    new = np.r_[True, held[1:] != held[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first + 1
    ranks = [rank.astype(np.int32)] if keep_ranks else []
    open_at = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in groups of several
    step = 1
    while len(open_at):
        rows = order[open_at]
        after = np.zeros(len(rows), np.int64)
        inside = rows + step < n
        after[inside] = rank[rows[inside] + step]
        group = rank[rows]
        key = group * (n + 1) + after
        by = np.argsort(key, kind="stable")
        rows, key, group = rows[by], key[by], group[by]
        order[open_at] = rows
        new_key = np.r_[True, key[1:] != key[:-1]]
        first = np.maximum.accumulate(np.where(new_key, open_at, 0))
        rank[rows] = first + 1
        if keep_ranks:
            ranks.append(rank.astype(np.int32))
        open_at = open_at[~(new_key & np.r_[new_key[1:], True])]
        step *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix, in order, shares with the one before it; 0 for the first."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[at], order[at - 1]
    total = np.zeros(len(at), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + total, b + total
        # Where ranks agree beyond an end, the ends differ in length and so do the ranks.
        inside = np.flatnonzero((i < n) & (j < n))
        same = inside[ranks[k][i[inside]] == ranks[k][j[inside]]]
        total[same] += 1 << k
    lcp[at] = total
    return lcp


def longest_repeats(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place, the longest string from there that also starts elsewhere: the value of the
    innermost common-prefix interval that the suffix belongs to."""
    found = np.zeros(len(order), np.int64)
    found[order] = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(lcp) else lcp
    return found


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0
