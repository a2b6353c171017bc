"""Substring dedup by relative Lempel-Ziv factors against reference blocks chosen by content."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quern.llm.repeats import HOT, repeats


def factors(units: np.ndarray, starts: np.ndarray, at: np.ndarray, reference: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (place, place in the reference, length in units) of ``window`` units or more.

    ``reference`` gives, for each place in ``at``, the earlier place where the index of the block has
    its first ``window`` units, or -1. A factor is drawn from there unit by unit as far as both spans
    agree. The windows that its end cuts belong to no factor: the parse goes on with the first of
    them, which is looked up on its own.
    """
    out = []
    ends = np.append(starts[1:], len(units))
    span_end = lambda x: int(ends[np.searchsorted(starts, x, "right") - 1])
    open_ = np.flatnonzero(reference >= 0)
    k = 0
    while k < len(open_):
        x, r = int(at[open_[k]]), int(reference[open_[k]])
        most = min(span_end(x) - x, span_end(r) - r)
        differ = units[x : x + most] != units[r : r + most]
        length = int(differ.argmax()) if differ.any() else most
        if length >= window:
            out.append((x, r, length))
            # at rises, so the windows inside the factor are the next ones.
            k = int(np.searchsorted(at[open_], x + length - window, "right"))
        else:
            k += 1
    return out


def by_factors(units: np.ndarray, starts: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, plan) -> np.ndarray:
    """Which of the windows at ``at`` occur earlier in the block of all spans given.

    The block is indexed by window hashes in order of (document, place) and parsed greedily against
    itself (see ``factors``). Windows inside a factor occur earlier; those across factor boundaries
    were looked up each. Units are compared, so equal hashes of unequal windows remove nothing; the
    windows of such a hash are told apart by their units.
    """
    key = plan.anchors.window_hashes(units, at)
    order = np.lexsort((place, doc, key))
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    head = np.empty(len(at), dtype=np.int64)
    head[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(at) else order
    later = (doc != doc[head]) | (place != place[head])
    out = np.zeros(len(at), dtype=bool)
    for x, _, length in factors(units, starts, at, np.where(later, at[head], -1), plan.window):
        lo = np.searchsorted(at, x)
        out[lo : np.searchsorted(at, x + length - plan.window, "right")] = True
    for x in np.flatnonzero(later & ~out):
        # Hashes agree, units do not: look for equal units among the windows of that hash.
        mine = units[at[x] : at[x] + plan.window]
        for y in np.flatnonzero((key == key[x]) & ((doc < doc[x]) | ((doc == doc[x]) & (place < place[x])))):
            if (units[at[y] : at[y] + plan.window] == mine).all():
                out[x] = True
                break
    return out


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts earlier.

    Earlier is a smaller id, or an earlier start in the same document; windows are judged on the
    input. Spans of documents meet the reference blocks that share an anchor with them (see
    quern.llm.repeats; a block that shares none holds none of their windows); equal whole runs are
    factors as they stand, the rest is parsed by ``by_factors``. Words stand between runs of ASCII white space.

    One row per input row: doc_id (long), n_words, n_removed, n_spans, kept_sha256 (of the kept words
    joined by one space); with ``with_text`` also kept. Null texts have no words. Null ids come last
    and equal one another; rows of one id are compared by start alone, so of repeated rows none
    removes the other. An empty table gives no rows.
    """
    return repeats(docs, True, window, 8 if window >= 16 else max(1, window // 2), True, by_factors, id_col, text_col, "words", with_text, hot)
