"""Content-chosen anchors: the few places of a text under which equal windows are sure to meet.

Of the ``gram``-unit grams inside a window of ``window`` units, the one with the least hash (the
leftmost of equals) is the window's anchor. Equal windows have their anchor at the same place, so
an anchor that no other text shares proves that its windows are unique. Consecutive windows mostly
share an anchor; such a run is one entry, of which there are about 2 in window - gram + 2 units.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 17
_LOW = np.uint64((1 << 18) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xE9846AF9B1A615D5)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


#: A random-looking number for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive numbers."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Anchors:
    """Finds anchors in concatenated documents given as units (bytes, or 64-bit word hashes)."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.width = window, gram, window - gram + 1
        n = _BLOCK + window + 2
        self.up = _powers(int(_P), n)
        self.down = _powers(pow(int(_P), -1, 1 << 64), n)

    def _sums(self, units: np.ndarray) -> np.ndarray:
        x = BYTES[units] if units.dtype == np.uint8 else units
        sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * self.up[: len(x)], out=sums[1:])
        return sums

    def _hash(self, sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return mix((sums[at + length] - sums[at]) * self.down[at])

    def find(self, units: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that share an anchor: first and last window, hash of the anchor, hash of the run's units.

        ``valid`` tells for each window start whether the window lies in one document.
        """
        firsts, lasts, hashes, wholes = [], [], [], []
        for s in range(0, max(0, len(units) - self.window + 1), _BLOCK):
            x = units[s : s + _BLOCK + self.window - 1]
            ok = valid[s : s + len(x) - self.window + 1]
            if not ok.any():
                continue
            sums = self._sums(x)
            grams = mix((sums[self.gram :] - sums[: -self.gram]) * self.down[: len(x) - self.gram + 1])
            at = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
            at = (sliding_min(at, self.width) & _LOW).astype(np.int64)
            at[~ok] = -1
            begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            end = np.append(begin[1:], len(at)) - 1
            keep = at[begin] >= 0
            begin, end = begin[keep], end[keep]
            first, last = self._hash(sums, begin, self.window), self._hash(sums, end, self.window)
            firsts.append(begin + s)
            lasts.append(end + s)
            # The least of many hashes is small; mixed once more, anchors spread evenly over ranges of keys.
            hashes.append(mix(grams[at[begin]]))
            wholes.append(mix(first * np.uint64(0x8CB92BA72F3D8DD7) + last + (end - begin).astype(np.uint64)))
        if not firsts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        return tuple(np.concatenate(x) for x in (firsts, lasts, hashes, wholes))

    def window_hashes(self, units: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of the window at each of the rising positions ``at``."""
        out = np.zeros(len(at), dtype=np.uint64)
        cuts = np.searchsorted(at, np.arange(0, len(units) + _BLOCK, _BLOCK))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            s = int(k) * _BLOCK
            sums = self._sums(units[s : s + _BLOCK + self.window - 1])
            out[cuts[k] : cuts[k + 1]] = self._hash(sums, at[cuts[k] : cuts[k + 1]] - s, self.window)
        return out


def word_units(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (between ASCII white space) of UTF-8 bytes."""
    space = (text == 32) | ((text >= 9) & (text <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    units = np.zeros(len(start), dtype=np.uint64)
    up, down = _WORD_UP, _WORD_DOWN
    at = 0
    while at < len(start):
        s = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end, s + _BLOCK, "right")))
        piece = text[s : int(end[stop - 1])]
        if len(piece) > len(up):
            up, down = _powers(int(_P), len(piece) + 1), _powers(pow(int(_P), -1, 1 << 64), len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(BYTES[piece] * up[: len(piece)], out=sums[1:])
        a, b = start[at:stop] - s, end[at:stop] - s
        units[at:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = stop
    return units, start, end


_WORD_UP = _powers(int(_P), _BLOCK + 2)
_WORD_DOWN = _powers(pow(int(_P), -1, 1 << 64), _BLOCK + 2)
