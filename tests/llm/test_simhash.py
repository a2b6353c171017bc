"""SimHash fingerprints, links and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quern.llm.arrays import pieces
from quern.llm.components import components
from quern.llm.simhash import compare, drop_near_copies, fingerprint, key_blocks, links, simhash_groups


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprint():
    rng = random.Random(0)
    for text in ["", " ", "One", "Two Words", "É a\tb\n\nC", "x" * 5000, " ".join(rng.choice("ab cd ÄB e".split()) for _ in range(3000))]:
        assert fingerprint(text.encode()) == by_hand(text)


def test_pieces():
    text = b"ab " * 5000 + b"c" * 9000 + b" d"
    for size in (10, 4096, 100_000):
        assert [w for p in pieces(text, size) for w in p] == text.split()


def test_groups(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghijk") * rng.randint(1, 4) for _ in range(300)) for _ in range(5)]
    rows = [(None, "a b c"), (50, None), (51, ""), (52, base[0]), (52, base[0]), (53, "One two")]
    for i in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "z"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS node")
    fps = [(d, by_hand(t)) for d, t in rows]
    root = roots(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 3)
    low = defaultdict(list)
    for d, f in fps:
        low[root[f]].append(d)
    name = lambda f: min((d for d in low[root[f]] if d is not None), default=None)
    got = sorted([tuple(r) for r in simhash_groups(df).collect()], key=repr)
    assert got == sorted([(d, f"{f:016x}", name(f)) for d, f in fps], key=repr)
    kept = drop_near_copies(df.select("doc_id", "text")).collect()
    assert len(kept) == len(low) and {r.doc_id for r in kept} == {name(f) for _, f in fps}
    clashing = df.selectExpr("*", "1 AS __id", "2 AS __n", "3 AS root", "4 AS th", "5 AS c0")
    assert drop_near_copies(clashing).columns == clashing.columns and drop_near_copies(clashing).count() == len(kept)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(empty).collect() == drop_near_copies(empty).collect() == []


@pytest.mark.parametrize(("tile", "blocks"), [(2048, 5), (16, 5), (16, 4), (16, 1), (2048, 1)])
def test_links(spark, tile, blocks):
    rng = random.Random(3)
    values = set()
    for x in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(150):
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
    values = sorted(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    root = roots(values, lambda a, b: (a ^ b).bit_count() <= 3)
    want = defaultdict(set)
    for v in values:
        want[root[v]].add(signed(v))
    got = defaultdict(set)
    for r in components(links(spark.createDataFrame([(signed(v), signed(v)) for v in values], "node long, fp long"), 3, blocks, tile)).collect():
        got[r.root] |= {r.node, r.root}
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_key_blocks():
    assert [key_blocks(n, 3) for n in (0, 1 << 16, (1 << 16) + 1, 1 << 27, 1 << 28)] == [1, 1, 4, 4, 5]


@pytest.mark.parametrize("rows", [4, 64])
def test_compare(rows):
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp[100:200] = fp[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    group = np.sort(rng.integers(0, 3, 300))
    order = np.lexsort((np.bitwise_count(fp), group))
    group, fp = group[order], fp[order]
    i, j = compare(group, fp, 3, rows)
    both = {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
    every = {frozenset((a, b)) for a in range(300) for b in range(a) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert every and both <= every
    same = lambda pairs: sorted(sorted(v) for v in _classes(roots(list(range(300)), lambda a, b: frozenset((a, b)) in pairs)))
    assert same(both) == same(every)


def _classes(root):
    out = defaultdict(list)
    for k, r in root.items():
        out[r].append(k)
    return out.values()


def test_components_of_a_long_path(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_components_raise_when_rounds_run_out(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(path, 2)


def test_links_finished_in_one_task(spark):
    """A path, a ring, a star around its greatest node and repeated links, with and without rounds before."""
    pairs = [(i, i + 1) for i in range(40)] + [(200 + i, 200 + (i + 7) % 20) for i in range(20)] + [(999, 300 + i) for i in range(30)] * 2 + [(5, 5), (-3, -9)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = roots(sorted({x for p in pairs for x in p}), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    low = {}
    for x, r in root.items():
        low[r] = min(low.get(r, x), x)
    wanted = {x: low[r] for x, r in root.items() if low[r] != x}
    for whole in (0, 60, 1000):
        assert {r.node: r.root for r in components(edges, whole=whole).collect()} == wanted
    assert components(edges.limit(0), whole=1000).collect() == []
