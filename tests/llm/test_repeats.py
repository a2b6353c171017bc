"""Substring and suffix-array dedup against brute force, and the parts they are made of."""

import hashlib
import random

import numpy as np
import pytest

from quern.llm.anchors import Anchors, sliding_min, word_units
from quern.llm.repeats import Plan
from quern.llm.substring_dedup import by_factors, factors, substring_dedup
from quern.llm.suffix_dedup import suffix_dedup
from quern.llm.suffixes import equal_prefixes, suffix_array

SCHEMA = "doc_id long, text string"


def words_by_hand(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            key, at = tuple(w[i : i + window]), ((d is None, d or 0), i)
            first[key] = min(first.get(key, at), at)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < ((d is None, d or 0), i):
                cut[i : i + window] = [True] * window
        kept = b" ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out.append((d, len(w), sum(cut), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def bytes_by_hand(rows, window):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first[b[i : i + window]] = min(first.get(b[i : i + window], (True, 1 << 62)), (d is None, d or 0))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (d is None, d or 0):
                cut[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        out.append((d, len(b), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~cut].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "ccc", "dé", "e"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(5)]
    rows = []
    for i in range(40):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice([*vocabulary, "x"])
        rows.append((rng.choice([i, i, rng.randint(0, 15)]), " ".join(words) + rng.choice(["", "  \n" + rng.choice(base)])))
    return [*rows, (None, rows[3][1]), (None, rows[4][1]), (7, None), (99, ""), (5, rows[5][1]), (5, rows[5][1]), (98, "é" * 3000)]


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_words(spark, seed, hot):
    rows = corpus(seed)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), 20, hot=hot).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == words_by_hand(rows, 20)


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_bytes(spark, seed, hot):
    rows = corpus(seed)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), 50, hot=hot).collect()
    assert sorted([tuple(r) for r in got], key=repr) == bytes_by_hand(rows, 50)


def test_kept_text_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = substring_dedup(spark.createDataFrame([(1, text), (2, "x " + text + " y")], SCHEMA).selectExpr("*", "'q' AS n_words", "1 AS chunk"), with_text=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == {1: text.encode(), 2: b"x y"}
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).collect() == [] and suffix_dedup(empty).collect() == []


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 60)
        s = np.array([rng.randint(1, rng.choice([2, 9])) for _ in range(n)], dtype=np.int64)
        for depth in (2, 5, 1000):
            got = suffix_array(s, depth)
            assert sorted(got.tolist()) == list(range(n))
            keys = [tuple(s[i : i + depth]) for i in got]
            assert keys == sorted(keys)
    assert equal_prefixes(np.array([1, 2, 1, 2, 1]), np.array([0, 2, 1]), 2).tolist() == [False, True, False]


def test_anchors_of_equal_windows_agree():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 4000).astype(np.uint8)
    text[3000:3500] = text[100:600]
    finder = Anchors(50, 26)
    first, last, hashes, _ = finder.find(text, np.arange(4000) <= 3950)
    of = {int(p): int(h) for a, b, h in zip(first, last, hashes, strict=True) for p in range(a, b + 1)}
    assert len(of) == 3951 and all(of[p] == of[p + 2900] for p in range(100, 551))
    assert sliding_min(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


def test_word_units():
    units, start, end = word_units(np.frombuffer(b"  ab cd\tab\n", dtype=np.uint8))
    assert start.tolist() == [2, 5, 8] and end.tolist() == [4, 7, 10] and units[0] == units[2] != units[1]
    assert len(word_units(np.frombuffer(b"x" * 300_000 + b" y", dtype=np.uint8))[0]) == 2


def test_factors():
    """A greedy parse: factors run as far as both spans agree, and what a boundary cuts is looked up again."""
    rng = np.random.default_rng(3)
    first = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    second = np.concatenate([first[5:40], rng.integers(0, 1 << 60, 3, dtype=np.uint64), first[30:58]])
    units, starts = np.concatenate([first, second]), np.array([0, 60])
    at = np.array([*range(0, 41), *range(60, 60 + len(second) - 19)])
    index = {units[x : x + 20].tobytes(): x for x in reversed(range(41))}
    reference = np.array([index.get(units[x : x + 20].tobytes(), -1) if x >= 60 else -1 for x in at])
    assert factors(units, starts, at, reference, 20) == [(60, 5, 35), (98, 30, 28)]
    doc, place = np.where(at < 60, 1, 2), np.where(at < 60, at, at - 60)
    plan = Plan(True, 20, 8, True, by_factors, 1, False)
    assert by_factors(units, starts, at, doc, place, plan).tolist() == (reference >= 0).tolist()
    # Hashes that say nothing: units still decide.
    plan.anchors.window_hashes = lambda units, at: np.zeros(len(at), dtype=np.uint64)
    assert by_factors(units, starts, at, doc, place, plan).tolist() == (reference >= 0).tolist()
