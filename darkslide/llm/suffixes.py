"""Generalised suffix array over the token sequences of many records, with its common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def suffix_array(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, each up to the end of its record, and the common prefix of each with the next one (0 at the last).

    tokens holds integers from 0, ends the end of the record of each position. Prefix doubling; a suffix that ends sorts before its extensions.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    longest = int((ends - at).max())
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while k < longest:
        beyond = at + k
        second = np.where(beyond < ends, rank[np.minimum(beyond, n - 1)], 0)
        key = rank * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        levels.append(rank)
        k *= 2
    i, j = order[:-1].copy(), order[1:].copy()
    stop_i, stop_j = ends[i], ends[j]
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        same = (i < stop_i) & (j < stop_j)
        same &= levels[level][np.minimum(i, n - 1)] == levels[level][np.minimum(j, n - 1)]
        common += same * step
        i += same * step
        j += same * step
    common = np.minimum(common, np.minimum(ends[order[:-1]] - order[:-1], ends[order[1:]] - order[1:]))
    return order, np.concatenate([common, [0]])


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a:b] for each pair, a < b, by a sparse table."""
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), values.dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(table[k][a[own]], table[k][b[own] - (1 << int(k))])
    return out


def intervals(tokens: np.ndarray, records: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n from 1 to max_n: n, a position of each distinct n-gram, its occurrences, and the records that hold it.

    records is ascending. An interval of suffixes with a common prefix of n or more is one n-gram; its length counts the
    occurrences. Neighbours of one record in suffix order whose least common prefix between them is n or more are
    duplicates within the record; subtracting them leaves the records.
    """
    size = len(tokens)
    if not size:
        return
    ends = np.searchsorted(records, records, side="right")
    order, common = suffix_array(tokens, ends)
    owner = records[order]
    by_record = np.argsort(owner, kind="stable")
    pair = np.flatnonzero(owner[by_record][1:] == owner[by_record][:-1])
    left, right = by_record[pair], by_record[pair + 1]
    shared = _least(common, left, right) if len(pair) else np.zeros(0, np.int64)
    length = ends[order] - order
    for n in range(1, max_n + 1):
        begins = np.concatenate([[True], common[:-1] < n])
        run = np.cumsum(begins) - 1
        whole = length >= n
        first = np.flatnonzero(begins)
        occurrences = np.bincount(run, weights=whole, minlength=len(first)).astype(np.int64)
        twice = shared >= n
        duplicates = np.bincount(run[right[twice]], minlength=len(first))
        real = whole[first]
        if not real.any():
            return
        yield n, order[first[real]], occurrences[real], occurrences[real] - duplicates[real]
