"""Connected components of links between longs, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import join_keyed, settle


#: Links that one task may hold (16 MB).
WHOLE = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links that is not the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _finished(links: DataFrame) -> DataFrame:
    """The stars of a bounded number of links, made in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            node, root = stars(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    return links.select("v", "u").repartition(1).mapInArrow(work, "node long, root long")


def components(edges: DataFrame, most_rounds: int = 60, whole: int = 0) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node in ``edges`` (``a``, ``b``).

    In the large-star step each node links its larger neighbours to its smallest neighbour, in the
    small-star step its smaller ones. Both keep the components, and after about log2(n) rounds only
    stars around the smallest nodes are left. A node's neighbours are never gathered: the smallest
    one comes from a pre-aggregated minimum that is joined back by broadcast, or salted where there are
    too many, whatever share of the links a node holds. Each round's links are written out,
    so that a lost executor repeats one round at most. ``whole`` links at most, from the start or
    left by a round, are finished in one task. Links that are not stars after ``most_rounds``
    rounds raise an error. Null ends and links of a node to itself count for nothing, repeated links once;
    no links, no rows.
    """
    links = settle(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct())
    state, count = None, links.count()
    for _ in range(most_rounds):
        if count <= whole:
            return settle(_finished(links))
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(links.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_keyed(both, least, ["x"], "n", F.col("y")).where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = settle(large)
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_keyed(large, low, ["v"], "n", F.col("u")).select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        links = settle(small.where("v <> u").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, count = now, now[0]
    else:
        raise RuntimeError(f"links are not stars after {most_rounds} rounds")
    return links.select(F.col("v").alias("node"), F.col("u").alias("root"))
