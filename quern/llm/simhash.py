"""SimHash near-dedup by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrays import pieces
from quern.llm.common import bitmap, bitmap_bits, join_keyed, marked, numbered, settle, text_of
from quern.llm.components import WHOLE, components

#: Fingerprints in a tile.
TILE = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _tally(digests: bytes) -> np.ndarray:
    """How many of the 8-byte hashes have each bit set, the highest bit first."""
    table = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    if len(table) < 512:
        return np.unpackbits(table, axis=1).sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(table[:, k], minlength=256) @ _BITS for k in range(8)])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's ``width``-word shingles (of the whole text if it has fewer words; 0 if none)."""
    counts, total, carried = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_digest
    for words in pieces(text.lower()):
        words = carried + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            first = [0, *(ends[:-width] + 1).tolist()]
            got = b"".join([digest(joined[i:j], seed) for i, j in zip(first, ends[width - 1 :].tolist(), strict=True)])
            counts += _tally(got)
            total += len(words) - width + 1
        carried = words[-(width - 1) :] if width > 1 else []
    if not total:
        if not carried:
            return 0
        counts, total = _tally(digest(b" ".join(carried), seed)), 1
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long), th (a hash of the text), fp (the fingerprint as a signed long) of every row; null texts have fingerprint 0."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = np.array([fingerprint(texts[k].as_py(), width, seed) for k in range(len(texts))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    return rows.mapInArrow(work, "doc_id long, th long, fp long")


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray, left: list, right: list) -> None:
    """Keep of the pairs (i, j) those that connect rows not yet connected, and name what they connect alike."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        if not len(i):
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        # Each root is joined to one lower root at a time; what is left is looked at again.
        _, one = np.unique(high, return_index=True)
        left.append(i[one])
        right.append(j[one])
        label[high[one]] = low[one]
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            np.copyto(label, jumped)


def _apart(fp: np.ndarray, i: object, j: object) -> np.ndarray:
    """In how many bits the fingerprints at ``i`` differ from those at ``j``; ``fp`` has a row for each 64-bit word."""
    total = np.bitwise_count(fp[0][i] ^ fp[0][j])
    for word in fp[1:]:
        total = np.add(total, np.bitwise_count(word[i] ^ word[j]), dtype=np.uint16)
    return total


def compare(group: np.ndarray, fp: np.ndarray, radius: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group within ``radius`` bits; enough of them to connect all such rows.

    Fingerprints of several words have a row of ``fp`` for each. Rows come sorted by group and
    population count. In a group of over ``rows`` rows each tile of so many is held against the rows
    from it on whose population counts are in reach, by one exclusive-or and bit count of the whole
    tile. Smaller groups are compared together: row i with row i + s for s = 1, 2, ... A pair stands
    only if its rows are not yet connected, so that a group of n alike fingerprints yields n - 1
    pairs and not n * n / 2.
    """
    fp = np.atleast_2d(fp)
    n = fp.shape[1]
    label = np.arange(n)
    ones = np.bitwise_count(fp).sum(axis=0, dtype=np.int16)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(begin, n))
    left, right = [], []
    for first, last in zip(begin[size > rows], (begin + size)[size > rows], strict=True):
        mine = ones[first:last]
        for at in range(first, last, rows):
            end = min(at + rows, last)
            stop = first + int(np.searchsorted(mine, mine[end - 1 - first] + radius, "right"))
            near = _apart(fp, np.s_[at:end, None], np.s_[None, at:stop]) <= radius
            i, j = np.nonzero(near)
            _connect(label, at + i[j > i], at + j[j > i], left, right)
    last = np.repeat(np.cumsum(size) - 1, size)
    alive, step = np.flatnonzero(np.repeat(size <= rows, size)), 1
    while True:
        # Population counts rise within a group: once a row's partner is out of reach, so are all later ones.
        alive = alive[alive + step <= last[alive]]
        if len(alive):
            alive = alive[ones[alive + step] - ones[alive] <= radius]
        if not len(alive):
            break
        near = alive[_apart(fp, alive, alive + step) <= radius]
        _connect(label, near, near + step, left, right)
        step += 1
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """The rows of a partition sorted by its first column, cut between groups."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if held and held[-1][0][-1] != now[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        begin = int(np.searchsorted(now[0], now[0][-1], "left"))
        if begin:
            held.append([x[:begin] for x in now])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([x[begin:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _tile_pair(d: int):
    """The pair of a row's own tile (ones, part) and tile q of population count ones + d, the lower one first."""
    own = F.struct(F.col("ones").alias("p"), F.col("part").alias("q"))

    def pair(q):
        met = F.struct((F.col("ones") + d).cast("int").alias("p"), q.alias("q"))
        if d:
            return F.struct((met if d < 0 else own).alias("x"), (own if d < 0 else met).alias("y"))
        low, high = F.least(q, F.col("part")), F.greatest(q, F.col("part"))
        return F.struct(F.struct(F.col("ones").alias("p"), low.alias("q")).alias("x"), F.struct(F.col("ones").alias("p"), high.alias("q")).alias("y"))

    return pair


def key_blocks(count: int, radius: int, tile: int = TILE) -> int:
    """Into how many blocks the bits are cut, so that a group of fingerprints under a key is a few tiles on average.

    1: no key at all, every tile of the table meets every other within the radius (32 tiles at most).
    Otherwise the fewest blocks, radius + 1 or more, that leave about a tile to a key.
    """
    if count <= 32 * tile:
        return 1
    blocks = radius + 1
    while blocks < 16 and count >> (64 * (blocks - radius) // blocks) > tile:
        blocks += 1
    return blocks


def links(nodes: DataFrame, radius: int = 3, blocks: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (``node``, ``fp``) within ``radius`` bits.

    Fingerprints are sorted by population count and cut into tiles; tiles whose counts can lie within
    the radius are compared in full, and pairs of tiles beyond it are never dealt out. With
    ``blocks`` above 1 this is done under keys: the bits fall into ``blocks`` blocks, two
    fingerprints within the radius agree in blocks - radius of them at least, and so meet under one
    of the keys made of that many blocks. Keys that one fingerprint holds alone are dropped. How many
    fingerprints a key has is joined back salted, whatever share of them it holds.
    """
    keys = []
    if blocks == 1:
        keys.append(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k")))
    else:
        cuts = [round(k * 64 / blocks) for k in range(blocks + 1)]
        for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
            mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            keys.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("k")))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("key")).select("node", "fp", F.col("key.n").alias("kn"), F.col("key.k").alias("kk"))
    rows = rows.withColumn("ones", F.bit_count("fp").cast("int"))
    per = rows.groupBy("kn", "kk", "ones").agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy("kn", "kk").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("ones", "c"))).alias("each")).where("c > 1")
    # Only keys of over a tile are looked up; the others are groups of a tile at most as they stand.
    crowded = settle(sizes.where(F.col("c") > tile))
    met = join_keyed(rows, crowded, ["kn", "kk"], "c", F.col("fp"))
    small = met.where("c is null").select(F.xxhash64("kn", "kk").alias("g"), "ones", "fp", "node")
    # A tile is (population count, part); a row goes to every pair of tiles that its own belongs to.
    parts = lambda p: F.expr(f"cast(coalesce(ceil(element_at(each, {p}) / {tile}D), 0) as int)")
    big = met.where("c is not null").withColumn("part", F.expr(f"cast(pmod(xxhash64(fp, 1), ceil(element_at(each, ones) / {tile}D)) as int)"))
    reach = []
    none = F.array().cast("array<struct<x:struct<p:int,q:int>,y:struct<p:int,q:int>>>")
    for d in range(-radius, radius + 1):
        other = F.when((F.col("ones") + d >= 0) & (F.col("ones") + d <= 64), parts(f"ones + ({d})")).otherwise(F.lit(0))
        reach.append(F.when(other > 0, F.transform(F.sequence(F.lit(0), other - 1), _tile_pair(d))).otherwise(none))
    tiled = big.select("kn", "kk", "ones", "fp", "node", F.explode(F.flatten(F.array(*reach))).alias("z"))
    tiled = tiled.select(F.xxhash64("kn", "kk", "z.x.p", "z.x.q", "z.y.p", "z.y.q").alias("g"), "ones", "fp", "node")
    ready = small.unionByName(tiled).repartition("g").sortWithinPartitions("g", "ones", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _, fp, node in _whole_groups(batches, 4):
            i, j = compare(g, fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    return ready.select("g", "ones", "fp", "node").mapInArrow(work, "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and the component of linked fingerprints that it belongs to.

    Each text is hashed once; from then on distinct fingerprints stand for their documents. They are
    compared exactly in tiles of bounded size (see ``links``; ``blocks`` is chosen by their number
    unless given), and the links found are merged into components by rounds over written tables.

    One row per input row: doc_id (long), fingerprint (16 hex digits), component_id (the smallest
    doc_id reachable). Null and wordless texts have fingerprint 0 and are linked like any other;
    rows with a null id get the component of their fingerprint if any row of the component has an id.
    Repeated rows share everything. An empty table gives no rows.
    """
    return _grouped(docs, radius, width, seed, blocks, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, radius: int, width: int, seed: int, blocks: int | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, fp, root (of the component) and component_id of every row."""
    fps = settle(fingerprints(docs, width, seed, id_col, text_col))
    nodes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")).withColumn("node", F.col("fp")))
    found = components(links(nodes.select("node", "fp"), radius, blocks or key_blocks(nodes.count(), radius)), whole=WHOLE)
    nodes = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = settle(nodes.join(lowest, "root").select("fp", "root", "component_id", "rows"))
    return join_keyed(fps, named, ["fp"], "rows", F.xxhash64("th", "doc_id")).drop("rows")


def drop_near_copies(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the one row of each component that has the smallest id (null ids last).

    Rows are told apart by id and a hash of the text; of repeated rows one stays. Columns may have
    any names.
    """
    names = docs.columns
    docs, (id_col, text_col) = numbered(docs, id_col, text_col)
    return keep_first(docs, _grouped(docs, radius, width, seed, blocks, id_col, text_col), id_col, text_col).toDF(*names)


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The one row of ``docs`` of each root in ``rows`` (doc_id, th, root) that has the smallest id (null ids last).

    What goes is decided on narrow rows. Only rows of ``docs`` that hit a bitmap of the keys that go,
    or that stand more than once, are joined with them; all others pass unshuffled.
    """
    key = lambda i, t: F.xxhash64(F.coalesce(i, F.lit(0)), i.isNull(), t)
    each = settle(rows.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")
    heads = each.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows")).where("rows > 1")
    many = join_keyed(each, settle(heads.select("root", "best", "kinds", "rows")), ["root"], "rows", F.xxhash64("doc_id", "th")).where("rows > 1")
    looked = settle(many.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), (order == F.col("best")).alias("__first")).where("not __first").unionAll(each.where("n > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.lit(True).alias("__first"))))
    bits = bitmap_bits(looked.count())
    own = F.col(id_col).cast("long"), F.xxhash64(text_of(text_col))
    kept = marked(docs, key(*own), bitmap(looked.select(key(F.col("__id"), F.col("__th")).alias("__key")), "__key", bits), bits, "__met")
    alone = kept.where("not __met").select(*docs.columns)
    # A key that goes stands in looked as not the first; one that only stands more than once as the first.
    verdict = looked.groupBy("__id", "__th").agg(F.min("__first").alias("__first"))
    met = kept.where("__met").withColumns({"__i": own[0], "__t": own[1]}).join(verdict, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th")), "left")
    # Rows that met the bitmap by chance are told apart by a number of their own.
    row = F.when(F.col("__first").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    met = met.where(F.coalesce("__first", F.lit(True))).withColumn("__row", row).dropDuplicates(["__i", "__t", "__row"])
    return alone.unionAll(met.select(*docs.columns))
