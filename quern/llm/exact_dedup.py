"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bitmap, bitmap_bits, join_keyed, marked, settle, text_of

#: A run of white space that is not already one space.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """White-space runs as one space."""
    return F.regexp_replace(text, _RUN, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, filter_bits: int | None = None, digest_all: bool = False) -> DataFrame:
    """Group documents of equal text; one row per input row: id, keep_id, group_size, kept, text_sha256.

    The first scan counts (length, hash of the first ``prefix`` characters) and keeps the pairs that
    occur twice in a bitmap of 2**filter_bits bits: by default eight a row, but 2**28 (32 MB) at most. The
    second scan takes the full hash only of rows whose pair is in the bitmap; a false hit costs a
    hash and changes nothing. Groups are made of the surviving narrow rows, pre-aggregated by task.

    Texts are equal if they are the same after each white-space run becomes one space. A null text
    is empty. The row with the smallest id stays (null ids come last); of repeated rows with that id
    exactly one stays. Without ``digest_all``, text_sha256 is null for rows that no other row could
    equal. An empty table gives no rows; other columns are ignored.
    """
    text = normalised(text_of(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("__t"))
    base = base.select("doc_id", "__t", F.octet_length("__t").alias("__len"), F.xxhash64(F.substring("__t", 1, prefix)).alias("__ph"))
    bits = filter_bits or bitmap_bits(docs.count())
    crowded = base.groupBy("__len", "__ph").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.xxhash64("__len", "__ph").alias("__key"))
    found = marked(base, F.xxhash64("__len", "__ph"), bitmap(crowded, "__key", bits), bits, "__alive")
    digest = F.unhex(F.sha2("__t", 256))
    rows = found.select(
        "doc_id",
        F.monotonically_increasing_id().alias("__row"),
        "__len",
        "__ph",
        "__alive",
        (digest if digest_all else F.when(F.col("__alive"), digest)).alias("__sha"),
    )
    rows = settle(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("__row").alias("row")))
    groups = rows.where("__alive").groupBy("__len", "__ph", "__sha").agg(first.alias("__first"), F.count(F.lit(1)).alias("__size")).where("__size > 1")
    joined = join_keyed(rows, settle(groups), ["__len", "__ph", "__sha"], "__size", F.col("__row"))
    alone = F.col("__size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__first.id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__first.row") == F.col("__row"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )
