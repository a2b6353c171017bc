"""Suffix-array dedup: byte strings that also start in an earlier document are removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quern.llm.repeats import HOT, earlier_in, repeats
from quern.llm.suffixes import equal_prefixes, suffix_array


def by_suffix_array(units: np.ndarray, starts: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, plan) -> np.ndarray:
    """Which of the windows at ``at`` occur earlier: difference-cover suffix sort, then adjacent prefixes."""
    order = suffix_array(units.astype(np.int64) + 1, plan.window)
    number = np.full(len(units) + 1, -1, dtype=np.int64)
    number[at] = np.arange(len(at))
    order = order[number[order] >= 0]
    group = np.zeros(len(at), dtype=np.int64)
    group[number[order]] = np.cumsum(~equal_prefixes(units, order, plan.window))
    return earlier_in(group, doc, place)


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Strings are judged on the input, may overlap and never cross documents. Candidates are narrowed
    without loss by anchors (see quern.llm.repeats); the strings that hashes of whole runs cannot
    settle are sorted by a difference-cover suffix array in each bucket, and equal neighbours are
    compared byte for byte.

    One row per input row: doc_id (long), n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256; with ``with_text`` also kept, the bytes that stay. Null texts are empty; texts
    shorter than ``length`` keep all. Null ids come last and equal one another; rows of one id are
    not earlier than each other, so repeated rows keep what their id keeps. An empty table gives no rows.
    """
    return repeats(docs, False, length, length // 2 + 1, False, by_suffix_array, id_col, text_col, "bytes", with_text, hot)
