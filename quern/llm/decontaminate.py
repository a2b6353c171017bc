"""Benchmark decontamination with suffix arrays of the training documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.arrays import PLAIN, groups, pieces, spread, word_ids
from quern.llm.common import settle

#: Bytes of training text in a shard: one suffix array.
SHARD_BYTES = 4 << 20
SCORES = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long"
#: What a pass over one part of the benchmark leaves to the next.
STATE = "hits binary, items array<string>, longest long, longest_at long"
SCORE_NAMES, STATE_NAMES = ([f.split()[0] for f in s.split(", ")] for s in (SCORES, STATE))


class TestIndex:
    """The words of some benchmark items as numbers, and every suffix of them to a depth of ``window`` words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.known, self.names = window, {}, []
        tokens, starts, lengths, owners = [], [], [], []
        at = 0
        for name, text in items:
            ids = [self.known.setdefault(w, len(self.known) + 1) for words in pieces(text.translate(PLAIN)) for w in words]
            if not ids:
                continue
            need = min(window, len(ids))
            owner = len(self.names)
            self.names.append(name)
            tokens += ids
            for s in range(len(ids) - need + 1):
                starts.append(at + s)
                lengths.append(need)
                owners.append(owner)
            at += len(ids)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.owners = np.array(owners, dtype=np.int64)
        self.offsets = np.array(starts, dtype=np.int64)
        self.least = int(self.lengths.min()) if len(starts) else 0
        # As many words to a 64-bit key as there is room for; keys big-endian, so that bytes sort as words do.
        self.bits = max(2, int(len(self.known) + 1).bit_length())
        self.per_key = max(1, 64 // self.bits)
        self.keys = -(-window // self.per_key)
        if len(starts):
            text = np.concatenate([np.array(tokens, dtype=np.int32), np.zeros(window, dtype=np.int32)])
            low = self.packed(text, self.offsets, self.lengths, 0)
            high = self.packed(text, self.offsets, self.lengths, (1 << self.bits) - 1)
            self.low, self.high = low, high

    def packed(self, tokens: np.ndarray, at: np.ndarray, lengths: np.ndarray | None = None, fill: int = 0) -> np.ndarray:
        """The ``window`` words at each position as one byte string; ``fill`` beyond ``lengths``."""
        out = np.zeros((len(at), self.keys), dtype=">u8")
        for k in range(self.keys):
            key = np.zeros(len(at), dtype=np.uint64)
            for j in range(k * self.per_key, (k + 1) * self.per_key):
                if j < self.window:
                    word = tokens[at + j].astype(np.uint64)
                    if lengths is not None:
                        word = np.where(j < lengths, word, np.uint64(fill))
                else:
                    word = np.uint64(0)
                key = (key << np.uint64(self.bits)) | word
            out[:, k] = key
        return out.view(f"S{8 * self.keys}").ravel()

    def search(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place where a window of the items occurs in ``tokens``: (window, position) pairs.

        Suffixes that leave the items' vocabulary before the shortest window ends cannot match and
        are left out of the suffix array.
        """
        none = np.zeros(0, dtype=np.int64)
        if not self.least or len(tokens) < self.least:
            return none, none
        stop = np.flatnonzero(np.concatenate((tokens, [0])) == 0)
        at = np.flatnonzero(tokens)
        at = at[stop[np.searchsorted(stop, at)] - at >= self.least]
        if not len(at):
            return none, none
        padded = np.concatenate([tokens, np.zeros(self.window, dtype=np.int32)])
        suffixes = self.packed(padded, at)
        order = np.argsort(suffixes, kind="stable")
        suffixes, at = suffixes[order], at[order]
        first = np.searchsorted(suffixes, self.low, "left")
        last = np.searchsorted(suffixes, self.high, "right")
        found = np.flatnonzero(last > first)
        counts = (last - first)[found]
        return np.repeat(found, counts), at[spread(first[found], counts)]


def _longest(query: np.ndarray, place: np.ndarray, index: TestIndex, first: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the length in words of the longest verbatim match with an item, and where it starts."""
    length, start = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    if not len(query):
        return length, start
    diagonal = place - index.offsets[query]
    order = np.lexsort((place, diagonal, index.owners[query]))
    p, d, o, need, doc = place[order], diagonal[order], index.owners[query][order], index.lengths[query][order], docs[order]
    fresh = np.ones(len(p), dtype=bool)
    fresh[1:] = (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (o[1:] != o[:-1])
    heads = np.flatnonzero(fresh)
    runs = np.diff(np.append(heads, len(p))) - 1 + need[heads]
    best = np.lexsort((p[heads], -runs, doc[heads]))
    which, one = np.unique(doc[heads][best], return_index=True)
    length[which] = runs[best][one]
    start[which] = (p[heads][best][one]) - first[which]
    return length, start


def judge(texts: list[bytes], index: TestIndex) -> tuple[list[np.ndarray], list[set[str]], np.ndarray, np.ndarray, list[int]]:
    """Per text: which words are hit, which items occur; the longest match and its place; the number of words."""
    ids = [word_ids(t.translate(PLAIN), index.known) for t in texts]
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    # One 0 after each document: no match runs into the next.
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    tokens = np.zeros(int(first[-1]), dtype=np.int32)
    for x, s in zip(ids, first, strict=False):
        tokens[s : s + len(x)] = x
    query, place = index.search(tokens)
    edges = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + index.lengths[query] if len(query) else place, -1)
    hit = np.cumsum(edges[:-1]) > 0
    docs = np.searchsorted(first, place, "right") - 1
    length, start = _longest(query, place, index, first, docs, len(texts))
    items: list[set[str]] = [set() for _ in texts]
    if len(query):
        for d, o in np.unique(np.stack([docs, index.owners[query]], axis=1), axis=0).tolist():
            items[d].add(index.names[o])
    return [hit[s : s + n] for s, n in zip(first, sizes, strict=False)], items, length, start, sizes.tolist()


def scored(texts: list[bytes], index: TestIndex, before: list[dict]) -> tuple[list[np.ndarray], list[set[str]], np.ndarray, np.ndarray, list[int]]:
    """What `judge` gives, together with what earlier parts of the benchmark gave (``before``: rows of STATE, or none)."""
    hits, items, length, start, sizes = judge(texts, index)
    for k, row in enumerate(before):
        hits[k] |= np.unpackbits(np.frombuffer(row["hits"] or b"\0", dtype=np.uint8), count=sizes[k]).astype(bool)
        items[k] |= set(row["items"])
        if row["longest"] >= length[k]:
            length[k], start[k] = row["longest"], row["longest_at"]
    return hits, items, length, start, sizes


def _state(hits: list[np.ndarray], items: list[set[str]], length: np.ndarray, start: np.ndarray, sizes: list[int], share: int) -> list[pa.Array]:
    return [pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()), pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(length, pa.int64()), pa.array(start, pa.int64())]


def _scores(hits: list[np.ndarray], items: list[set[str]], length: np.ndarray, start: np.ndarray, sizes: list[int], share: int) -> list[pa.Array]:
    n_hit = [int(h.sum()) for h in hits]
    names = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
    guilty = [h > 0 and share * h >= n for h, n in zip(n_hit, sizes, strict=True)]
    places = [int(at) if n else None for n, at in zip(length, start, strict=True)]
    return [pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(names, pa.string()), pa.array(guilty, pa.bool_()), pa.array(length, pa.int64()), pa.array(places, pa.int64())]


def _parts(benchmark: DataFrame, part_bytes: int, item_col: str, text_col: str) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The benchmark in parts of ``part_bytes`` of text at most (a longer item is a part of its own), and whether each is the last."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    held: list[tuple[str, bytes]] = []
    for part in groups(((r[0], r[1].encode()) for r in rows.toLocalIterator()), part_bytes):
        if held:
            yield held, False
        held = part
    yield held, True


def _pass(rows: DataFrame, head: int, index, share: int, last: bool, keep: bool) -> DataFrame:
    """``rows`` (``head`` columns, the text ``t``, and STATE after another pass) judged by one more part of the benchmark."""
    known = len(rows.columns) > head + 1
    schema = StructType(rows.schema.fields[: head if last else head + 1])
    if not keep:
        schema = StructType(schema.fields + StructType.fromDDL(SCORES if last else STATE).fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(head)
            for group in groups(((k, texts[k].as_py()) for k in range(batch.num_rows)), SHARD_BYTES):
                part = batch.slice(group[0][0], len(group))
                own = part.select(list(range(head if last else head + 1)))
                got = scored([t for _, t in group], index.value, part.select(STATE_NAMES).to_pylist() if known else [])
                if keep:
                    yield own.filter(pa.array([not h.any() for h in got[0]], type=pa.bool_()))
                else:
                    names = SCORE_NAMES if last else STATE_NAMES
                    yield pa.RecordBatch.from_arrays([*own.columns, *(_scores if last else _state)(*got, share)], names=[*own.schema.names, *names])

    return rows.mapInArrow(work, schema)


def _run(docs: DataFrame, benchmark: DataFrame, window: int, share: int, part_bytes: int, id_col: str, text_col: str, item_col: str, bench_text: str, keep: bool) -> DataFrame:
    """One pass over the documents for each part; between passes they are settled, and the part is taken back."""
    context = benchmark.sparkSession.sparkContext
    if keep:
        head = len(docs.columns)
        rows = docs.toDF(*[f"c{k}" for k in range(head)]).withColumn("t", docs_text(docs, text_col))
    else:
        head = 1
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    for part, last in _parts(benchmark, part_bytes, item_col, bench_text):
        index = context.broadcast(TestIndex(part, window))
        rows = _pass(rows, head, index, share, last, keep)
        if not last:
            rows = settle(rows)
            index.unpersist()
    return rows.toDF(*docs.columns) if keep else rows


def docs_text(docs: DataFrame, text_col: str):
    """The text column of a frame whose columns were renamed c0, c1, ... (names may clash)."""
    return F.coalesce(F.col(f"c{docs.columns.index(text_col)}").cast("string"), F.lit("")).cast("binary")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, part_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """What each document shares with the benchmark, word for word; nothing is shuffled.

    Each task cuts its documents into shards of about 4 MB, builds the suffix array of a shard's
    words to a depth of ``window`` words and binary-searches every benchmark suffix in it. Runs of
    consecutive hits give the longest verbatim match and its place. Of the benchmark, ``part_bytes``
    of text at most are broadcast at once; a larger one takes a pass over the documents for each part,
    what the passes found being joined by document where it stands.

    A window is ``window`` words of one item, or the whole of a shorter item. One row per input row:
    doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 (their
    ids sorted as strings, joined by commas), contaminated (n_hit > 0 and ``share`` * n_hit >=
    n_words), longest, longest_at (word offset, null if nothing matched). Null texts have no words;
    items without words match nothing; items of one id count as one item, a null id is the empty
    string; repeated rows are judged each. An empty benchmark hits nothing; no documents, no rows.
    """
    return _run(docs, benchmark, window, share, part_bytes, id_col, text_col, item_col, bench_text, keep=False)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, part_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """``docs``, all columns under their names, without the rows in which any window of the benchmark occurs (n_hit > 0).

    Nulls, repeated rows and empty tables are as for ``contamination``: a null or empty text stays, of
    repeated rows all stay or all go, an empty benchmark removes nothing.
    """
    return _run(docs, benchmark, window, 20, part_bytes, id_col, text_col, item_col, bench_text, keep=True)
