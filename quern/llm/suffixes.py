"""Suffix sorting by difference cover modulo 3, in numpy."""

from __future__ import annotations

import numpy as np


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the triples (a, b, c), the rank of each (equal triples share one), and the number of ranks."""
    bits = max(1, int(max(a.max(initial=0), b.max(initial=0), c.max(initial=0))).bit_length())
    if 3 * bits <= 63:
        key = (a << (2 * bits)) | (b << bits) | c
    else:
        _, pair, _ = _pairs(a, b)
        key = (pair << 32) | c
    return _ranked(key)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    return _ranked((a << 32) | b)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(key)
    sorted_ = key[order]
    step = np.ones(len(key), dtype=np.int64)
    step[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(step)
    return order, rank, int(step.sum())


def suffix_array(text: np.ndarray, depth: int, _covered: int = 1) -> np.ndarray:
    """The starts of the suffixes of ``text`` (positive numbers below 2**31) in the order of their first ``depth`` symbols.

    Suffixes at places 1 and 2 modulo 3 are the sample: their triples are sorted and named, and if
    names repeat the string of names is sorted by recursion. The other suffixes are sorted by first
    symbol and the rank of the sampled rest, and merged in by binary search. A name of the k-th level
    stands for 3**k symbols; once that reaches ``depth``, equal names may stay unresolved.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(4, dtype=np.int64)])
    # One more sample at n or n + 1 when the length leaves a gap keeps the two halves apart.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order, names, kinds = _names(s[sample], s[sample + 1], s[sample + 2])
    if kinds < len(sample) and _covered * 3 < depth:
        order = suffix_array(names, depth, _covered * 3)
        names = np.empty(len(sample), dtype=np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = names
    sorted_ = sample[order]
    sorted_ = sorted_[sorted_ < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort((s[zeros] << 32) | rank[zeros + 1], kind="stable")]
    first, second = sorted_[sorted_ % 3 == 1], sorted_[sorted_ % 3 == 2]
    # Names that stay equal leave their suffixes in any order, hence the sorts here and the running maximum below.
    before = np.searchsorted(np.sort((s[first] << 32) | rank[first + 1]), (s[zeros] << 32) | rank[zeros + 1], "left")
    # Two symbols and a rank: the two symbols as one rank among all that occur.
    _, two, _ = _pairs(np.concatenate([s[second], s[zeros]]), np.concatenate([s[second + 1], s[zeros + 1]]))
    before = before + np.searchsorted(np.sort((two[: len(second)] << 32) | rank[second + 2]), (two[len(second) :] << 32) | rank[zeros + 2], "left")
    before = np.maximum.accumulate(before)
    out = np.full(n, -1, dtype=np.int64)
    out[before + np.arange(len(zeros))] = zeros
    out[out < 0] = sorted_
    return out


def equal_prefixes(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Whether each start in ``at`` (in suffix order) has the same ``depth`` symbols as the start before it."""
    same = np.zeros(len(at), dtype=bool)
    open_ = np.arange(1, len(at))
    for k in range(depth):
        if not len(open_):
            return same
        open_ = open_[text[at[open_] + k] == text[at[open_ - 1] + k]]
    same[open_] = True
    return same
