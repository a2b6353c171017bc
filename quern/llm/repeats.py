"""Repeated windows of a corpus, found by anchors in three rounds of questions and answers.

Documents are dealt once into chunks by a hash of their id. In each round every chunk asks the
buckets that hold its keys, and gets one short answer for each key:

1. the anchors' hashes: does another chunk have this anchor? (All but a few per cent of anchors of
   fresh text end here; 6 bytes each.)
2. the runs of windows under repeated anchors, as hashes: is an equal run earlier?
3. the units of runs that are first of their kind but share an anchor with others: which of their
   windows occur earlier, in what order of documents?

Keys are made unique within a chunk before they leave it, so a passage of a third of all documents
reaches its bucket once per chunk. Under an anchor with very many contexts windows are asked one by
one, by their own hash, and so spread over all buckets. Chunks and buckets grow in number, not in
size, as the corpus grows; nothing goes to the driver but the corpus size in bytes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.anchors import Anchors, word_units
from quern.llm.arrays import spread

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Parts of a bucket whose spans are sorted at a time; all spans under a key are in one part.
PARTS = 16
#: Contexts of one anchor from which on its windows are asked one by one.
HOT = 4096
_ASK = "bucket long, chunk long, key binary, whole binary, doc binary, pos binary, size binary"
_ANSWER = "bucket long, chunk long, code binary"
_LAST = np.iinfo(np.int64).max


class Plan:
    """What is sought: windows of ``window`` words or bytes; ``by_place`` if an earlier place in the same document counts."""

    def __init__(self, words: bool, window: int, gram: int, by_place: bool, resolve, buckets: int, with_text: bool, hot: int = HOT):
        self.words, self.window, self.by_place, self.resolve, self.buckets, self.with_text, self.hot = words, window, by_place, resolve, buckets, with_text, hot
        self.anchors = Anchors(window, gram)

    def __reduce__(self):
        return Plan, (self.words, self.window, self.anchors.gram, self.by_place, self.resolve, self.buckets, self.with_text, self.hot)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """Equal ranges of 64-bit keys."""
        return ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """The documents of a chunk in order of id, as units, with the runs of windows that share an anchor."""

    def __init__(self, plan: Plan, table: pa.Table):
        self.plan = plan
        ids = table.column("doc_id").to_pylist()
        texts = table.column("t").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids = [ids[k] for k in order]
        self.texts = [texts[k] for k in order]
        self.doc_ids = np.array([_LAST if x is None else x for x in self.ids], dtype=np.int64)
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        if plan.words:
            cat = np.frombuffer(b"\n".join(self.texts), dtype=np.uint8)
            self.units, start, _ = word_units(cat)
            self.counts = np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes + 1)))))
        else:
            self.units, self.counts = np.frombuffer(b"".join(self.texts), dtype=np.uint8), sizes
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        left = np.repeat(self.starts[1:].astype(np.int32), self.counts) - np.arange(len(self.units), dtype=np.int32)
        self.first, self.last, self.hash, self.whole = plan.anchors.find(self.units, left >= plan.window)
        del left
        self.key1, self.at1, self.n1 = np.unique(self.hash >> np.uint64(16), return_inverse=True, return_counts=True)

    def docs_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of places: document, then (where it counts) start in the document."""
        d = self.docs_of(at)
        return self.doc_ids[d], (at - self.starts[d]) if self.plan.by_place else np.zeros(len(at), dtype=np.int64)

    def second(self, flags: np.ndarray) -> None:
        """The runs under repeated anchors, and the first of each kind in this chunk."""
        run = np.flatnonzero((flags | (self.n1 > 1))[self.at1])
        doc, pos = self.rank(self.first[run])
        order = np.lexsort((pos, doc, self.whole[run], self.hash[run]))
        run, doc, pos = run[order], doc[order], pos[order]
        h, w = self.hash[run], self.whole[run]
        fresh = np.ones(len(run), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        self.kind = np.cumsum(fresh) - 1
        head = np.flatnonzero(fresh)
        self.run, self.head = run, head
        self.key2, self.whole2, self.doc2, self.pos2 = h[head], w[head], doc[head], pos[head]
        self.is_first = (doc == self.doc2[self.kind]) & (pos == self.pos2[self.kind]) if len(run) else np.zeros(0, dtype=bool)

    def third(self, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spans to ask about: their kind, first window, number of windows and key."""
        lead = self.run[self.head]
        soft = np.flatnonzero(code == 2)
        hot = np.flatnonzero(code == 3)
        n = (self.last - self.first + 1)[lead[hot]]
        each = spread(self.first[lead[hot]], n)
        kind = np.concatenate([soft, np.repeat(hot, n)])
        first = np.concatenate([self.first[lead[soft]], each])
        many = np.concatenate([(self.last - self.first + 1)[lead[soft]], np.ones(len(each), dtype=np.int64)])
        place = np.argsort(each, kind="stable")
        own = np.zeros(len(each), dtype=np.uint64)
        own[place] = self.plan.anchors.window_hashes(self.units, each[place])
        key = np.concatenate([self.key2[soft], own])
        order = np.argsort(self.plan.bucket(key), kind="stable")
        return kind[order], first[order], many[order], key[order]


def _rows(plan: Plan, chunk: int, key: np.ndarray, columns: list[list[bytes]] | None, cut) -> list[tuple]:
    buckets = plan.bucket(key)
    edge = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True]))) if len(key) else np.array([0])
    return [(int(buckets[a]), chunk, *cut(a, b)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], type=kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _numbers(rows: list, kind: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(r, dtype=kind) for r in rows]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=kind)), np.array([len(p) for p in parts], dtype=np.int64)


def _split(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _carry(chunk: int, *states: bytes) -> tuple:
    """A row that a chunk sends to itself, past the buckets."""
    return (-1 - chunk, chunk, *states, *[None] * (5 - len(states)))


def _passed(table: pa.Table) -> tuple[list[tuple], list[dict]]:
    """Rows that chunks sent to themselves (as answers), and questions."""
    rows = table.to_pylist()
    own = [(r["bucket"], r["chunk"], b"".join(len(x).to_bytes(8, "little") + x for x in (r["key"], r["whole"]) if x is not None)) for r in rows if r["bucket"] < 0]
    return own, [r for r in rows if r["bucket"] >= 0]


def _states(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _answers(table: pa.Table) -> tuple[list[bytes], list[bytes]]:
    """What a chunk kept for itself, and the answers in order of bucket."""
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    own = [r["code"] for r in rows if r["bucket"] < 0]
    return (_states(own[0]) if own else []), [r["code"] for r in rows if r["bucket"] >= 0]


def ask_first(plan: Plan):
    def work(key: tuple, docs: pa.Table) -> pa.Table:
        c, number = Chunk(plan, docs), key[0].as_py()
        wide = c.key1 << np.uint64(16)
        return _table(_rows(plan, number, wide, None, lambda a, b: (_six(c.key1[a:b]), None, None, None, None)), _ASK)

    return work


def answer_first(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [_from_six(r["key"]) for r in rows]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for r, k in zip(rows, keys, strict=True):
        at = np.searchsorted(twice, k)
        found = np.zeros(len(k), dtype=bool)
        inside = at < len(twice)
        found[inside] = twice[at[inside]] == k[inside]
        out.append((r["bucket"], r["chunk"], len(k).to_bytes(4, "little") + np.packbits(found).tobytes()))
    return _table(out, _ANSWER)


def _flags(codes: list[bytes]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x, dtype=np.uint8, offset=4), count=int.from_bytes(x[:4], "little")).astype(bool) for x in codes]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def ask_second(plan: Plan):
    def work(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        c, number = Chunk(plan, docs), key[0].as_py()
        flags = _flags(_answers(answers)[1])
        c.second(flags)
        cut = lambda a, b: (c.key2[a:b].tobytes(), c.whole2[a:b].tobytes(), c.doc2[a:b].tobytes(), c.pos2[a:b].astype(np.int32).tobytes() if plan.by_place else None, None)
        rows = _rows(plan, number, c.key2, None, cut)
        rows.append(_carry(number, len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()))
        return _table(rows, _ASK)

    return work


def answer_second(plan: Plan):
    """0: first of its kind, alone under its anchor; 1: an equal run is earlier; 2, 3: first, but other kinds share the anchor (3: very many)."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        out, rows = _passed(table)
        if rows:
            h, sizes = _numbers([r["key"] for r in rows], "u8")
            w, _ = _numbers([r["whole"] for r in rows], "u8")
            doc, _ = _numbers([r["doc"] for r in rows], "i8")
            pos = _numbers([r["pos"] for r in rows], "i4")[0] if rows[0]["pos"] is not None else np.zeros(len(h), dtype=np.int32)
            order = np.lexsort((pos, doc, w, h))
            new_h = np.ones(len(h), dtype=bool)
            new_h[1:] = h[order][1:] != h[order][:-1]
            new_w = new_h.copy()
            new_w[1:] |= w[order][1:] != w[order][:-1]
            group, kind = np.cumsum(new_h) - 1, np.cumsum(new_w) - 1
            kinds = np.bincount(group, weights=new_w)[group] if len(h) else np.zeros(0)
            head = order[np.flatnonzero(new_w)][kind] if len(h) else order
            first = (doc[order] == doc[head]) & (pos[order] == pos[head])
            code = np.empty(len(h), dtype=np.uint8)
            code[order] = np.where(~first, 1, np.where(kinds == 1, 0, np.where(kinds > plan.hot, 3, 2)))
            out += [(r["bucket"], r["chunk"], x.tobytes()) for r, x in zip(rows, _split(code, sizes), strict=True)]
        return _table(out, _ANSWER)

    return work


def ask_third(plan: Plan):
    def work(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        c, number = Chunk(plan, docs), key[0].as_py()
        (flags,), codes = _answers(answers)
        c.second(_flags([flags]))
        code = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in codes]) if codes else np.zeros(0, dtype=np.uint8)
        _, first, many, keys = c.third(code)
        doc, pos = c.rank(first)
        units = lambda a, b: c.units[spread(first[a:b], many[a:b] + plan.window - 1)].tobytes()
        part = (keys % np.uint64(PARTS)).astype(np.uint8)
        cut = lambda a, b: (part[a:b].tobytes(), units(a, b), doc[a:b].tobytes(), pos[a:b].astype(np.int32).tobytes() if plan.by_place else None, many[a:b].astype(np.uint16).tobytes())
        rows = _rows(plan, number, keys, None, cut)
        rows.append(_carry(number, flags, code.tobytes()))
        return _table(rows, _ASK)

    return work


def answer_third(plan: Plan):
    """A bit for each window asked about: does it occur earlier?"""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        out, rows = _passed(table)
        if rows:
            many, spans = _numbers([r["size"] for r in rows], "u2")
            units, _ = _numbers([r["whole"] for r in rows], "u8" if plan.words else "u1")
            doc, _ = _numbers([r["doc"] for r in rows], "i8")
            pos = _numbers([r["pos"] for r in rows], "i4")[0].astype(np.int64) if rows[0]["pos"] is not None else np.zeros(len(doc), dtype=np.int64)
            part, _ = _numbers([r["key"] for r in rows], "u1")
            many = many.astype(np.int64)
            size = many + plan.window - 1
            starts, bits = np.cumsum(size) - size, np.cumsum(many) - many
            earlier = np.zeros(int(many.sum()), dtype=bool)
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                n, own = many[mine], units[spread(starts[mine], size[mine])]
                first = np.cumsum(size[mine]) - size[mine]
                at, span = spread(first, n), np.repeat(np.arange(len(mine)), n)
                place = pos[mine][span] + (at - first[span] if plan.by_place else 0)
                earlier[spread(bits[mine], n)] = plan.resolve(own, first, at, doc[mine][span], place, plan)
            per_row = np.add.reduceat(many, np.cumsum(spans) - spans)
            out += [(r["bucket"], r["chunk"], len(x).to_bytes(4, "little") + np.packbits(x).tobytes()) for r, x in zip(rows, _split(earlier, per_row), strict=True)]
        return _table(out, _ANSWER)

    return work


def earlier_in(group: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether an equal window (same number in ``group``) has a smaller (doc, place)."""
    order = np.lexsort((place, doc, group))
    fresh = np.ones(len(group), dtype=bool)
    fresh[1:] = group[order][1:] != group[order][:-1]
    head = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(group) else order
    out = np.zeros(len(group), dtype=bool)
    out[order] = (doc[order] != doc[head]) | (place[order] != place[head])
    return out


def removed(c: Chunk, code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each unit whether a window that occurs earlier covers it."""
    kind, first, many, _ = c.third(code)
    edges = np.zeros(len(c.units) + 1, dtype=np.int32)
    if len(c.run):
        # Whole runs: of a kind seen earlier in another chunk, or not the first here.
        gone = (code[c.kind] == 1) | ~c.is_first
        np.add.at(edges, c.first[c.run[gone]], 1)
        np.add.at(edges, c.last[c.run[gone]] + c.plan.window, -1)
        # Single windows of first runs; every run as early as the one that was asked about shares its answer.
        at, k = spread(first, many), np.repeat(kind, many)
        at, k = at[bits], k[bits]
        offset = at - c.first[c.run[c.head[k]]]
        equal = np.flatnonzero(c.is_first)
        by_kind = c.kind[equal]
        lo, hi = np.searchsorted(by_kind, k, "left"), np.searchsorted(by_kind, k, "right")
        all_runs = c.run[equal[spread(lo, hi - lo)]]
        at = c.first[all_runs] + np.repeat(offset, hi - lo)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + c.plan.window, -1)
    return np.cumsum(edges[:-1]) > 0


def finish(plan: Plan, schema: str):
    def work(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(plan, docs)
        (flags, code), codes = _answers(answers)
        c.second(_flags([flags]))
        gone = removed(c, np.frombuffer(code, dtype=np.uint8), _flags(codes))
        rows = []
        for k, text in enumerate(c.texts):
            cut = gone[c.starts[k] : c.starts[k + 1]]
            n = int(cut.sum())
            spans = int((cut[1:] > cut[:-1]).sum() + cut[0]) if n else 0
            if plan.words:
                kept = b" ".join(text.split() if not n else compress(text.split(), (~cut).tolist()))
            else:
                kept = text if not n else np.frombuffer(text, dtype=np.uint8)[~cut].tobytes()
            row = (c.ids[k], len(cut), n, spans, hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept) if plan.with_text else row)
        return _table(rows, schema)

    return work


def repeats(docs: DataFrame, words: bool, window: int, gram: int, by_place: bool, resolve, id_col: str, text_col: str, unit: str, with_text: bool, hot: int = HOT) -> DataFrame:
    """doc_id, n_<unit>, n_removed, n_spans, kept_sha256 (and kept) of each document without its repeated windows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    at_once = 2 * spark.sparkContext.defaultParallelism
    chunks = max(at_once, -(-total // CHUNK_BYTES))
    plan = Plan(words, window, gram, by_place, resolve, max(at_once, -(-total // BUCKET_BYTES)), with_text, hot)
    # By id and text, so that rows without an id, or of one id, are not all in one chunk.
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "t"), F.lit(chunks)))
    schema = f"doc_id long, n_{unit} long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    # As many tasks as buckets, up to four times the usual number: small answers take long to find.
    tasks = min(plan.buckets, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ask = chunked.groupBy("chunk").applyInArrow(ask_first(plan), _ASK).repartition(tasks, "bucket")
    answer = ask.groupBy("bucket").applyInArrow(answer_first, _ANSWER)
    ask = chunked.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(ask_second(plan), _ASK).repartition(tasks, "bucket")
    answer = ask.groupBy("bucket").applyInArrow(answer_second(plan), _ANSWER)
    ask = chunked.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(ask_third(plan), _ASK).repartition(tasks, "bucket")
    answer = ask.groupBy("bucket").applyInArrow(answer_third(plan), _ANSWER)
    return chunked.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(finish(plan, schema), schema)
