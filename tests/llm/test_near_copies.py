"""The pipeline's removal of near copies against all pairs compared by hand."""

import random
import re
from math import comb

import numpy as np
import pytest

import corpus_pipeline
from quern.llm.near_copies import RADIUS, SAME, SAME_SHORT, WORDS, key_plan, near_groups, recall, shingles, similar, simhash, within_radius
from quern.llm.simhash import compare


def shingled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def groups_by_hand(rows):
    sets = [shingled(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def kept_by_hand(rows):
    group = groups_by_hand(rows)
    return sorted(min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in set(group))


def made(seed=5):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, base = [], [text(300) for _ in range(6)]
    for b in base:
        rows.append(" ".join(b))
        for changes in (1, 2, 4, 5, 12, 20):
            w = list(b)
            for at in rng.sample(range(len(w)), changes):
                w[at] = "z"
            rows.append(" ".join(w))
        rows.append(" ".join(b[:150] + text(150)))
    rows += [rows[0].upper(), "", None, "One two", "one  TWO", "one two three", *(" ".join(text(80)) for _ in range(20))]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_drops_what_is_similar_and_nothing_else(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_copies_out(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept_by_hand(rows)


def test_tiles_give_the_same_groups(spark):
    rows = made(6)
    got = {r.doc_id: r.root for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=400).collect()}
    group = dict(zip([d for d, _ in rows], groups_by_hand(rows), strict=True))
    assert len({(got[d], group[d]) for d in group}) == len(set(got.values())) == len(set(group.values()))


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (7, text), (7, text), (8, text + " end"), (None, "a b c d e f"), (None, "a b c d e f")]
    got = corpus_pipeline.near_copies_out(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == [(False, text), (True, "a b c d e f")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_copies_out(spark, empty, "").collect() == []


def test_similar_connects_at_the_limit():
    a, b, c = np.arange(0, 9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(3, 12, dtype=np.uint64)
    assert similar([a, b, c], 0.8) == [(0, 1)] and similar([c, a], 0.8) == []


def test_fingerprints_decide_what_is_compared(spark):
    """Near copies of different fingerprints stay apart at radius 0 and are dropped at the stage's own."""
    base = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base[:150], "z", *base[151:]])), (3, " ".join(base).upper())], "doc_id long, text string")
    parts = lambda **k: len({r.root for r in near_groups(docs, **k).collect()})
    assert parts(radius=0) == 2 and parts() == 1


def test_simhash_by_hand():
    found = shingles(b"one two three four five six seven eight nine")
    bits = np.unpackbits(simhash(found).astype(">u8").view(np.uint8))
    assert len(bits) == 64 * WORDS and 0 < bits.sum() < len(bits) and not simhash(found[:0]).any()
    one = [np.unpackbits(simhash(found[k : k + 1]).astype(">u8").view(np.uint8)) for k in range(len(found))]
    assert (bits == (2 * np.sum(one, axis=0, dtype=int) > len(found))).all()


def _fingerprints(count, seed=4):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 63, (count, WORDS), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (count, WORDS), dtype=np.uint64)
    for k in range(0, count - 2, 3):
        for at, far in ((k + 1, RADIUS), (k + 2, RADIUS + 1)):
            flip = np.zeros(64 * WORDS, dtype=np.uint8)
            flip[rng.permutation(64 * WORDS)[:far]] = 1
            fp[at] = fp[k] ^ np.packbits(flip).view(">u8").astype(np.uint64)
    return fp


def _pairs(links):
    return {frozenset((r.a, r.b)) for r in links.collect()}


@pytest.mark.parametrize("few", [2048, 32])
def test_all_within_the_radius_are_linked_without_keys(spark, few):
    fp = _fingerprints(300)
    nodes = spark.createDataFrame([(k, 9, *f) for k, f in enumerate(fp.view(np.int64).tolist())], "node long, size int, f0 long, f1 long, f2 long, f3 long")
    apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2, dtype=int)
    wanted = {frozenset((i, j)) for i, j in np.argwhere(apart <= RADIUS).tolist() if i < j}
    assert len(wanted) == 100 and _pairs(within_radius(nodes, few=few)) == wanted


def test_keys_meet_as_often_as_planned(spark):
    """Fingerprints of sets of Jaccard 0.8 meet under the keys of a large table; those of short sets under more keys."""
    rng = np.random.default_rng(8)
    base = _fingerprints(1000, 7)[:, None].repeat(2, axis=1)
    for same, size in ((SAME, 9), (SAME_SHORT, 4)):
        fp = base.copy()
        fp[:, 1] ^= np.packbits(rng.random((1000, 64 * WORDS)) >= same, axis=1).view(">u8").astype(np.uint64)
        rows = [(2 * k + e, size, *fp[k, e].view(np.int64).tolist()) for k in range(1000) for e in (0, 1)]
        nodes = spark.createDataFrame(rows, "node long, size int, f0 long, f1 long, f2 long, f3 long")
        for few in (2048, 16):
            links = _pairs(within_radius(nodes, few=few, plan=key_plan(231_311)))
            assert sum(frozenset((2 * k, 2 * k + 1)) in links for k in range(1000)) >= 990


def test_key_plan():
    assert key_plan(1 << 15) == (0, 1, 1)
    for count in ((1 << 15) + 1, 231_311, 10**8):
        bits, keys, more = key_plan(count)
        assert 1024 <= count >> bits <= 4096 and recall(bits, keys, SAME) >= 0.997 <= recall(bits, more, SAME_SHORT)


def test_groups_under_keys(spark):
    rows = made(7)
    got = {r.doc_id: r.root for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), few=2, plan=key_plan(10**5)).collect()}
    group = dict(zip([d for d, _ in rows], groups_by_hand(rows), strict=True))
    assert len({(got[d], group[d]) for d in group}) == len(set(got.values())) == len(set(group.values()))


def test_compare_wide_fingerprints():
    fp = _fingerprints(90)
    group = np.repeat([0, 1], 45)
    for rows in (4, 64):
        order = np.lexsort((np.bitwise_count(fp).sum(axis=1, dtype=int), group))
        i, j = compare(group[order], fp[order].T, RADIUS, rows)
        apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2, dtype=int)
        wanted = {frozenset((a, b)) for a, b in np.argwhere(apart <= RADIUS).tolist() if a < b and group[a] == group[b]}
        assert {frozenset(p) for p in zip(order[i].tolist(), order[j].tolist(), strict=True)} == wanted


def test_how_often_a_bit_is_the_same():
    """The constants against sums of signs counted out, for all pairs of sets of Jaccard 0.8 or more that share up to 60 shingles."""
    signs = lambda n: [(2 * k - n, comb(n, k) / 2**n) for k in range(n + 1)]
    above = lambda s, own: sum(p for v, p in own if s + v > 0)
    found = {}
    for c in range(1, 61):
        for x in range(c // 4 + 1):
            for y in range(max(x, 1), c // 4 - x + 1):
                both = [(p, above(s, signs(x)), above(s, signs(y))) for s, p in signs(c)]
                found[c + x, c + y] = sum(p * (a * b + (1 - a) * (1 - b)) for p, a, b in both)
    assert found.pop((4, 5)) == SAME_SHORT and 0 < min(found.values()) - SAME < 0.0001
