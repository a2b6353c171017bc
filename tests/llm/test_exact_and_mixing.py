"""Exact dedup, mixing and sharding on small and odd inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm.common import join_keyed
from quern.llm.exact_dedup import exact_dedup
from quern.llm.mixing import mix, mixed
from quern.llm.sharding import shard

SCHEMA = "doc_id long, text string, source string"
ROWS = [(3, "a  b", "s"), (1, "a b", "t"), (2, "a\tb", None), (9, "A b", "s"), (4, None, "s"), (5, "", None), (1, "a b", "t"), (None, "a b", "s"), (6, "x" * 100_000, "t"), (7, " ", "t"), (None, None, None)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS keep_id", "1 AS __len")


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(docs, digest_all):
    got = exact_dedup(docs, digest_all=digest_all, filter_bits=16).collect()
    groups = defaultdict(list)
    for d, t, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for d in ids:
            want[(d, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    if digest_all:
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_mixing(spark, docs):
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS) and rows == mix(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mix(docs).collect()))
    assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in rows)
    assert abs(sum({(r.source, r.target) for r in rows} and {r.source: r.target for r in rows}.values()) - sum({r.source: r.source_size for r in rows}.values())) < 1e-6
    assert mixed(docs).columns == docs.columns
    assert mixed(docs).count() == sum(r.copies for r in rows)
    clashing = docs.selectExpr("*", "7 AS __u", "8 AS __copies", "9 AS __salt", "10 AS c1")
    assert mixed(clashing).columns == clashing.columns and {(r["__u"], r["__copies"], r["__salt"], r["c1"]) for r in mixed(clashing).collect()} == {(7, 8, 9, 10)}


def test_mixing_meets_targets(spark):
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.pmod("id", F.lit(7)) * F.pmod("id", F.lit(3))).cast("string")).alias("source"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"))
    per = mix(big).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 3 * r.size for r in per)


def test_mixing_prefers_by_inclusion_odds(spark):
    """One source sampled to about half: longer documents are likelier, and the order is that of q, not of u."""
    rows = [(i, "a", " ".join(["w"] * (1 + (i * 37) % 400))) for i in range(4000)] + [(4000 + i, "b", " ".join(["w"] * 200)) for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix(frame, weights=(1, 4)).where("source = 'a'").collect()
    target, taken = got[0].target, sum(r.taken for r in got)
    whole = int(target // got[0].source_size)
    picked = [r.copies - whole for r in got]
    assert abs(taken - target) <= 200 and 0 < sum(picked) < len(picked) and set(picked) == {0, 1}
    longer = [p for r, p in zip(got, picked, strict=True) if r.size > 300]
    shorter = [p for r, p in zip(got, picked, strict=True) if r.size <= 100]
    assert sum(longer) / len(longer) > sum(shorter) / len(shorter) + 0.05
    u = {r.doc_id: (int(hashlib.md5(f"11:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for r in got}
    assert max(u[r.doc_id] for r, p in zip(got, picked, strict=True) if p) > min(u[r.doc_id] for r, p in zip(got, picked, strict=True) if not p)


def test_sharding(spark, docs):
    got = shard(docs, shards=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in ROWS)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(4)) <= 1
    for k in sizes:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].size == 100_001 and by_id[6].text_crc32 == zlib.crc32(b"x" * 100_000) and by_id[4].size == 1


def test_shards_match_the_mixture(spark):
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "rare").otherwise("hot").alias("source"))
    per = shard(big, shards=8).groupBy("shard").agg(F.count("*").alias("n"), F.sum((F.col("source") == "rare").cast("int")).alias("rare")).collect()
    assert len(per) == 8 and all(r.n == 500 and abs(r.rare - 125) <= 2 for r in per)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(none).collect() == mix(none).collect() == shard(none).collect() == mixed(none).collect() == []


def test_join_keyed(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 50 + ["b", "c", None, None])], "k string, i int")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    for at_most in (2, 1000):
        got = join_keyed(rows, table, ["k"], "n", F.col("i"), at_most=at_most).collect()
        assert Counter((r.k, r.n) for r in got) == Counter({("hot", 50): 50, ("b", 1): 1, ("c", 1): 1, (None, 2): 2})
