"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.arrays import PLAIN, pieces

BITS = 20
#: Words kept with their terms by each Python worker.
CACHED = 100_000


def terms_of(word: bytes) -> tuple[int, ...]:
    """The hashed terms of a word: itself, and of long words the beginning."""
    own = xxhash.xxh32_intdigest(word) >> (32 - BITS)
    return (own, xxhash.xxh32_intdigest(b"^" + word[:6]) >> (32 - BITS)) if len(word) > 6 else (own,)


def terms(text: bytes, known: dict[bytes, tuple[int, ...]], table: np.ndarray | None = None) -> np.ndarray:
    """The distinct terms of a whole text; with ``table`` only those that it maps to 0 or more, as mapped."""
    found: set[int] = set()
    for words in pieces(text.translate(PLAIN)):
        for w in set(words):
            t = known.get(w)
            if t is None:
                t = terms_of(w)
                if table is not None:
                    t = tuple(x for x in (int(table[i]) for i in t) if x >= 0)
                if len(known) >= CACHED:
                    known.clear()
                known[w] = t
            found.update(t)
    return np.fromiter(found, dtype=np.int32, count=len(found))


class Machine:
    """w0 + sum of w_i + sum over pairs of <v_i, v_j>, over the terms that a text has."""

    def __init__(self, table: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.table, self.w0, self.w, self.v = table, w0, w, v

    def log_odds(self, present: np.ndarray) -> float:
        x = self.v[present]
        total = x.sum(axis=0)
        return self.w0 + float(self.w[present].sum()) + 0.5 * float((total * total).sum() - (x * x).sum())

    def score(self, present: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.log_odds(present), -60, 60))))


def train(rows: list[tuple[int, np.ndarray]], rate: float, most_terms: int = 20_000, least_docs: int = 3, rank: int = 8, epochs: int = 30, seed: int = 3, cost: float = 4.0) -> Machine:
    """Fit a machine to four fifths of (label, terms) and set its even odds on the rest.

    Even odds come to stand where the share of label 1 found, less ``cost`` times the share of
    label 0 found with it, is greatest. ``rate``, the share of label 1 among all labels, is the
    score of every text where the labels are of one kind.

    The terms used are the ``most_terms`` whose share among label 1 and label 0 differ most, in
    standard errors. Training is by AdaGrad on the log loss, with weight decay on both orders.
    """
    aside, rows = rows[::5], [r for k, r in enumerate(rows) if k % 5]
    labels = np.array([y for y, _ in rows], dtype=np.float64)
    table = np.full(1 << BITS, -1, dtype=np.int32)
    pos, neg = labels.sum(), (1 - labels).sum()
    floor = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    if not pos or not neg:
        return Machine(table, floor, np.zeros(0), np.zeros((0, rank)))
    sizes = np.array([len(t) for _, t in rows], dtype=np.int64)
    flat = np.concatenate([t for _, t in rows]) if sizes.sum() else np.zeros(0, dtype=np.int32)
    a = np.bincount(flat[np.repeat(labels == 1, sizes)], minlength=1 << BITS).astype(np.float64)
    n = np.bincount(flat, minlength=1 << BITS)
    b = n - a
    spread = np.sqrt(a / pos**2 + b / neg**2 + 1 / pos**2 + 1 / neg**2)
    apart = np.where(n >= least_docs, np.abs(a / pos - b / neg) / spread, 0.0)
    chosen = np.argsort(-apart, kind="stable")[: min(most_terms, int((apart > 2).sum()))]
    table[chosen] = np.arange(len(chosen), dtype=np.int32)
    used = table[flat] >= 0
    doc, index = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[used], table[flat[used]].astype(np.int64)
    del flat, used
    first = np.searchsorted(doc, np.arange(len(rows) + 1))
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), rank)), 0.0
    gw, gv, g0, rate_w, decay = np.full(len(chosen), 1e-2), np.full(v.shape, 1e-2), 1e-2, 0.15, 2e-3
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), min(len(rows), max(24, len(rows) // 256))):
            count = first[batch + 1] - first[batch]
            at = np.repeat(first[batch] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            i, d = index[at], np.repeat(np.arange(len(batch)), count)
            x = v[i]
            total = np.stack([np.bincount(d, weights=x[:, k], minlength=len(batch)) for k in range(rank)], axis=1)
            square = np.bincount(d, weights=(x * x).sum(axis=1), minlength=len(batch))
            z = w0 + np.bincount(d, weights=w[i], minlength=len(batch)) + 0.5 * ((total * total).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[batch]) / len(batch)
            g0 += error.sum() ** 2
            w0 -= rate_w * error.sum() / np.sqrt(g0)
            used, back = np.unique(i, return_inverse=True)
            step = np.bincount(back, weights=error[d], minlength=len(used)) + decay * w[used] / len(batch)
            gw[used] += step**2
            w[used] -= rate_w * step / np.sqrt(gw[used])
            pull = error[d][:, None] * (total[d] - x)
            step = np.stack([np.bincount(back, weights=pull[:, k], minlength=len(used)) for k in range(rank)], axis=1) + decay * v[used] / len(batch)
            gv[used] += step**2
            v[used] -= 0.3 * rate_w * step / np.sqrt(gv[used])
    made = Machine(table, w0, w, v)
    y = np.array([label for label, _ in aside])
    z = np.array([made.log_odds(table[t][table[t] >= 0]) for _, t in aside])
    if 0 < y.sum() < len(y):
        cuts = np.unique(z)
        gain = np.array([(z[y == 1] >= c).mean() - cost * (z[y == 0] >= c).mean() for c in cuts])
        best = int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1])
        made.w0 -= float((cuts[best] + cuts[best - 1]) / 2 if best else cuts[best])
    return made


def _text(docs: DataFrame, name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def held_out(id_col: str = "doc_id"):
    """Whether the labels of a document are kept from training: crc32 of its id as text is 0 modulo 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, most_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine fitted to ``most_rows`` labelled documents at most, as many of either label as there are, up to half each.

    The rows are those with the least hash of their id; the texts are found by a broadcast of these
    at most ``most_rows`` ids, and only their terms come to the driver, ``most_bytes`` of them at most
    (in the order of the hashes). Of several rows of one id the one whose terms are least counts. Null
    ids and labels other than 0 and 1 are left out; of unequal labels of one id the greater counts.
    """
    known = labels.select(F.col(id_col).cast("string").alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.groupBy("k").agg(F.max("y").alias("y")).where(~held_out("k"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    sample = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most_rows // 2)
        sample = part if sample is None else sample.unionAll(part)
    rows = docs.select(F.col(id_col).cast("string").alias("k"), _text(docs, text_col).alias("t")).join(F.broadcast(sample), "k").select("k", "y", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            texts = batch.column(2)
            got = [np.sort(terms(texts[k].as_py(), seen)).tobytes() for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, type=pa.binary())], names=["k", "y", "terms"])

    found = rows.mapInArrow(work, "k string, y int, terms binary").groupBy("k", "y").agg(F.min("terms").alias("terms"))
    # most_rows rows at most, so one task can add them up.
    upto = F.sum(F.octet_length("terms")).over(Window.orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, 0))
    # As Arrow, all terms come in a few buffers, which are read where they are.
    found = found.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("y", "terms").orderBy("y", "terms").toArrow()
    pairs = [(y.as_py(), np.frombuffer(t.as_buffer(), dtype=np.int32) if len(t.as_buffer()) else np.zeros(0, dtype=np.int32)) for y, t in zip(found["y"], found["terms"], strict=True)]
    return train(pairs, counts.get(1, 0) / total if total else 0.0)


def _scores(texts: Iterable[bytes], machine: Machine, seen: dict) -> list[float]:
    return [machine.score(terms(t, seen, machine.table)) for t in texts]


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5 on) of every whole text.

    Nothing but the text enters a score. Null and empty texts get the score of a text without known
    terms; a null id is the empty text for held_out; repeated rows get the same score each. Without
    labels of both kinds all texts get the share of label 1. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), _text(docs, text_col).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            texts = batch.column(2)
            score = np.array(_scores((texts[k].as_py() for k in range(len(texts))), shared.value, seen), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns under their names, without the rows whose score reaches ``threshold``.

    Scores are those of ``toxicity``: null and empty texts are judged as texts without known terms,
    of repeated rows all stay or all go, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)
    carried = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    schema = carried.schema
    carried = carried.withColumn("t", _text(carried, f"c{at}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            score = _scores((texts[k].as_py() for k in range(len(texts))), shared.value, seen)
            yield batch.drop_columns(["t"]).filter(pa.array([s < threshold for s in score]))

    return carried.mapInArrow(work, schema).toDF(*docs.columns)
