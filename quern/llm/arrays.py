"""Texts as numpy arrays of words or bytes, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Lower-cases A-Z; turns every ASCII character but letters and digits into a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text whose words are held as Python objects at once.
PIECE = 1 << 20


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words between ASCII white space, as lists that hold about ``size`` bytes each."""
    if len(text) <= size:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            # The end of the word that stands at the limit.
            rest = text[end : end + 4096].split(None, 1)
            if text[end : end + 1].isspace():
                pass
            elif rest and len(rest[0]) < len(text[end : end + 4096]):
                end += len(rest[0])
            else:
                while end < len(text) and not text[end : end + 1].isspace():
                    end += 1
        yield text[at:end].split()
        at = end


def groups(rows: Iterable[tuple[object, bytes]], size: int) -> Iterator[list[tuple[object, bytes]]]:
    """Rows in lists whose texts hold about ``size`` bytes; a longer text is a list of its own."""
    held, total = [], 0
    for row in rows:
        if held and total + len(row[1]) > size:
            yield held
            held, total = [], 0
        held.append(row)
        total += len(row[1]) + 64
    if held:
        yield held


def word_ids(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The number of each word of ``text``, 0 for those that ``known`` does not hold."""
    get = known.get
    parts = [np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words)) for words in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of ``counts`` entries, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return base + np.arange(total, dtype=np.int64)
