"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import join_keyed, root_of, running_sum, settle, text_of, unit_hash


def shard(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal documents into ``shards`` shards of equal counts whose sources mix as the corpus does.

    Rows are shuffled within each source by a seeded hash and ranked; a row's fractional rank is
    (rank - jitter) / rows of its source, the jitter (one per source) spreading small sources. Rows
    sorted by fractional rank are cut into shards whose counts differ by one at most (law ``rows``).
    Ranks are exact and made in two steps over buckets whose number and rows grow with
    the root of the rows, so no source is ranked in one task. Texts are read once; narrow rows are written out.

    One row per input row: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (0, 1, ...
    in each shard), grown_shard (null under this law). A null text has no bytes; a null source is a
    source of its own; null ids come first among equal hashes. Repeated rows are dealt one by one.
    An empty table gives no rows.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("__source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = settle(rows.withColumn("__u", unit_hash(F.col("doc_id"), F.col("text_crc32"), seed=seed)).withColumn("__one", F.lit(1).cast("long")))
    counts = settle(rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    buckets = 1 + isqrt(total)
    ranked = join_keyed(rows, counts, ["__source"], "__n", F.col("__u"))
    ranked = ranked.withColumn("__bucket", F.expr(f"floor(__u * {root_of('__n')})"))
    ranked = running_sum(ranked, ["__source"], "__bucket", [F.col("__u"), F.col("doc_id"), F.col("size")], "__one", "__rank")
    jitter = unit_hash(F.col("__source"), F.col("__source").isNull(), seed=seed + 1)
    ranked = ranked.withColumn("__frac", (F.col("__rank") - jitter) / F.col("__n"))
    ranked = ranked.withColumn("__part", F.floor(F.col("__frac") * buckets)).withColumn("__all", F.lit(0))
    placed = running_sum(ranked, ["__all"], "__part", [F.col("__frac"), F.col("__source"), F.col("__rank")], "__one", "__at")
    placed = placed.withColumn("__rows", F.lit(total).cast("long"))
    position = F.col("__at") - 1
    cut = F.expr(f"(__at - 1) * {shards} div __rows")
    return placed.withColumn("__shard", cut).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (position - F.expr(f"(__shard * __rows + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__source").alias("source"),
    )
