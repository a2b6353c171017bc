"""Decontamination, personal data, toxicity and lines."""

import hashlib
import random
import re

import numpy as np
import pytest

from quern.llm.decontaminate import contamination, decontaminate
from quern.llm.line_dedup import line_dedup
from quern.llm.pii import EVERY, KINDS, find_pii, luhn, mod97
from quern.llm.toxicity import Machine, drop_toxic, fit, toxicity, train

SCHEMA = "doc_id long, text string"


def contamination_by_hand(docs, bench, window=13):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, t in bench:
        w = split(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, items = split(lower(t)), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_contamination(spark, part_bytes):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["The", "of", "naïve", "x9", "Q", "run"]) + rng.choice(["", ",", "!"]) for _ in range(n))
    bench = [(1, text(40)), (2, text(5)), (None, text(20)), (3, None), (4, "--"), (5, "of"), (5, text(14))]
    docs = [(i, text(rng.randint(0, 60)) + rng.choice(["", " " + bench[0][1].lower(), bench[5][1]])) for i in range(30)] + [(None, None), (31, ""), (30, bench[6][1]), (30, bench[6][1])]
    frame, items = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS n_words"), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted([tuple(r)[:6] for r in contamination(frame, items, part_bytes=part_bytes).collect()], key=repr)
    assert got == contamination_by_hand(docs, bench)
    kept = decontaminate(frame, items, part_bytes=part_bytes)
    assert kept.columns == frame.columns and kept.count() == sum(not r[2] for r in got)


def test_longest_match_and_empty(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, "nothing here")], SCHEMA)
    rows = {r.doc_id: (r.longest, r.longest_at) for r in contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert rows == {1: (20, 2), 2: (0, None)}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in contamination(docs, nothing).collect())
    assert contamination(docs.limit(0), nothing).collect() == []


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(RULES[kind], text or "") if holds(kind, m[0]))


def test_pii(spark):
    rng = random.Random(4)
    parts = "a.b@c.de|x@y.z_foo@bar.com|1.2.3.4|001.02.3.0004|256.1.1.1|4539 1488 0343 6467|4491382641088554|7 4111111111111111|+1 (843) 555-7672|+1 (843) 555-7672 170.106.47.218|+44 20 7946 0958| |-|.|(|é|日本|\n|+|@|5|call 555-123-4567 |joe (at) site (dot) com|10[.]0[.]0[.]1|text ".split("|")
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(600)]
    rows += [(None, None), (-1, ""), (-2, "1.2.3.4 " * 600), (-3, "a" * 100_000), (-4, "1 " * 30_000), (-5, "a." * 20_000 + "@x.y"), (-6, "+1 " * 20_000)]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS spans")).collect()}
    added = 0
    for d, t in rows:
        spans = base_spans(t)
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        every = [x for x in r.spans.split(",") if x]
        assert set(filter(None, text.split(","))) <= set(every)
        assert every == sorted(every, key=lambda x: (int(x.split(":")[1]), EVERY.index(x.split(":")[0]), int(x.split(":")[2])))
        added += len(every) - len(spans)
    assert added > 0
    one = find_pii(spark.createDataFrame([(1, "mail a@b.co, phone +1 (843) 555-7672 10.0.0.1 end")], SCHEMA)).first()
    assert one.redacted == "mail [email], phone [phone] [ip] end" and "phone:19:36" in one.spans
    assert find_pii(spark.createDataFrame([], SCHEMA)).collect() == []


#: Texts that the model was not fitted to, and what of them is personal.
LEARNED = [
    ("mail jane at corner-shop dot org today", "jane at corner-shop dot org"),
    ("call 020 7946 0958 now", "020 7946 0958"),
    ("phone: 01 23 45 67 89", "01 23 45 67 89"),
    ("password: hunter2xyz!", "hunter2xyz!"),
    ('$$$ token = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1"###', "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1"),
    ("use ghp_abcdefghijabcdefghijabcdefghij012345 here", "ghp_abcdefghijabcdefghijabcdefghij012345"),
    ("IBAN DE89 3704 0044 0532 0130 00 end", "DE89 3704 0044 0532 0130 00"),
    ("SSN 123-45-6789", "123-45-6789"),
    ("host 2001:db8::ff00:42 up", "2001:db8::ff00:42"),
]
CLEAN = ["sha256: " + "ab12" * 16, "order 2024-01-02 12 345 678", "my password is required", "the token ring network", "x" * 5000, "look at that. Of course", "at 10:20:30 and 11:22:33", ""]


def test_learned_pii(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*[t for t, _ in LEARNED], *CLEAN])], SCHEMA)
    got = {r.doc_id: r.spans for r in find_pii(frame).collect()}
    for i, (text, part) in enumerate(LEARNED):
        _, start, end = got[i].split(":")
        assert text[int(start) : int(end)] == part
    assert all(not got[len(LEARNED) + i] for i in range(len(CLEAN)))
    assert mod97("DE89 3704 0044 0532 0130 00") == 1 and mod97("DE88 3704 0044 0532 0130 00") == 0


def test_toxicity(spark):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))] + ([rng.choice(["vile", "scum", "loser"])] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame([*rows, (None, None), (7000, "")], SCHEMA).selectExpr("*", "'x' AS score"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(docs, known)
    got = toxicity(docs, model).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 902
    clean = drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in got)
    one_kind = fit(docs, known.where("toxic = 0"))
    assert [r.score for r in toxicity(docs, one_kind).collect()] == pytest.approx([1e-6] * 902)
    assert toxicity(docs.limit(0), model).collect() == []
    assert fit(docs, known.limit(0)).score(fit(docs, known.limit(0)).table[:0]) < 0.5


def test_lines(spark):
    sites = [(i, f"own {i}\n  Shared line \nfew {i % 3}\n\n", f"s{i % 7}") for i in range(30)] + [(50, None, None), (51, "", "s1"), (52, "Shared line", None), (52, "Shared line", None)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(sites, "doc_id long, text string, source string").selectExpr("*", "1 AS kept", "2 AS key")).collect()}
    assert got[3].kept == "own 3\n\n" and (got[3].n_lines, got[3].n_removed) == (5, 2)
    assert got[52].kept == "" and got[50].n_lines == 1 and got[51].n_removed == 0
    assert got[3].kept_sha256 == hashlib.sha256(got[3].kept.encode()).hexdigest()
    few = {r.doc_id: r for r in line_dedup(spark.createDataFrame(sites, "doc_id long, text string, source string"), least_sites=9).collect()}
    assert few[3].n_removed == 0
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_machine_sums_over_pairs():
    rng = np.random.default_rng(1)
    m = Machine(np.arange(20, dtype=np.int32), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    present = np.array([1, 4, 9, 17])
    pairs = sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(present) for b in present[k + 1 :])
    assert m.log_odds(present) == pytest.approx(0.3 + float(m.w[present].sum()) + pairs)


def test_machine_learns_a_pair():
    """Term 1 or 2 alone is harmless, both together are toxic: no sum of single weights says so as sharply."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rest = rng.choice(np.arange(10, 40), 5, replace=False)
        rows.append((int(a and b), np.sort(np.array([*([1] if a else []), *([2] if b else []), *rest], dtype=np.int32))))
    m = train(rows[:2400], 0.25)
    z = {(a, b): np.mean([m.log_odds(m.table[t][m.table[t] >= 0]) for y, t in rows[2400:] if ((1 in t) == a) and ((2 in t) == b)]) for a in (False, True) for b in (False, True)}
    assert z[True, True] > 0 > max(z[True, False], z[False, True], z[False, False])
    # What a linear model cannot have: an effect of the two beyond the sum of their own.
    assert z[True, True] - z[True, False] - z[False, True] + z[False, False] > 0.5


def test_repeated_ids_train_once(spark):
    docs = spark.createDataFrame([(1, "vile one"), (1, "vile one"), (2, "fine two"), (2, "other")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 1)], "doc_id long, toxic int")
    assert fit(docs, labels).score(np.zeros(0, dtype=np.int32)) == fit(docs, labels).score(np.zeros(0, dtype=np.int32))
