"""What the operators of this subpackage share: table access, word classes and cut lineage."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and the words between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of this machine only where the session names none and runs in one process, as in local tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: lost executors do not lose it, and what reads it twice sees the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns renamed c0, c1, ..., so that none clashes with a name used here, and the new names of ``wanted``."""
    names = docs.columns
    return docs.toDF(*[f"c{k}" for k in range(len(names))]), [f"c{names.index(w)}" for w in wanted]


def unit_hash(*columns: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the seed and the columns alone (52 bits of their MD5)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def join_keyed(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, spread: Column, at_most: int = 1000, salts: int = 1024, whole: int = 100_000) -> DataFrame:
    """``rows`` left-joined with ``table`` (one narrow row per key, null keys equal), whatever share of the rows a key holds.

    A table of ``whole`` rows at most is broadcast, and the rows are not shuffled. Of a larger one,
    ``weight`` being the number of rows that a key has, the keys with more than one ``at_most``-th
    of their sum are ``at_most`` at most: these alone are broadcast. The rows they match take part in
    the shuffle for the other keys under salts made of ``spread``, which match nothing there, so that
    no task gets all rows of a key.
    """
    known = table.agg(F.sum(weight), F.count(F.lit(1))).first()
    total = known[0] or 0
    payload = [c for c in table.columns if c not in keys]
    side = lambda df, p: df.select(*[F.col(k).alias(f"__{p}_{k}") for k in keys], F.struct(*payload).alias(f"__{p}"))
    same = lambda p: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{p}_{k}")) for k in keys])
    if known[1] <= whole:
        return rows.join(F.broadcast(side(table, "h")), same("h"), "left").select(*rows.columns, *[F.col(f"__h.{c}").alias(c) for c in payload])
    heavy = side(table.where(F.col(weight) * at_most > total), "h")
    light = side(table.where(F.col(weight) * at_most <= total), "l").withColumn("__ls", F.lit(0).cast("long"))
    joined = rows.join(F.broadcast(heavy), same("h"), "left")
    salt = F.when(F.col("__h").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts)) + 1).cast("long")
    joined = joined.withColumn("__salt", salt).join(light, same("l") & (F.col("__salt") == F.col("__ls")), "left")
    found = [F.when(F.col("__h").isNotNull(), F.col(f"__h.{c}")).otherwise(F.col(f"__l.{c}")).alias(c) for c in payload]
    return joined.select(*rows.columns, *found)


#: Bits in a row of a bitmap.
SLICE = 32768


def bitmap_bits(rows: int, least: int = 20, most: int = 28) -> int:
    """Bits for ``rows`` keys as a power of two: eight a key, ``2**least`` to ``2**most`` (32 MB)."""
    return max(least, min(most, (8 * max(rows, 1)).bit_length()))


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap of 2**bits bits over the longs in ``key``, in rows of SLICE bits: its size does not grow with the rows."""
    place = keys.select(F.pmod(F.col(key), F.lit(1 << bits)).alias("__pos"))
    return place.groupBy(F.expr(f"__pos div {SLICE}").alias("__bucket")).agg(F.expr(f"bitmap_construct_agg(cast(__pos % {SLICE} as int))").alias("__bits"))


def marked(rows: DataFrame, key: Column, made: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with ``name``: whether the bit of ``key`` is set; false for no key of the bitmap, true for hardly another."""
    columns = rows.columns
    rows = rows.withColumn("__pos", F.pmod(key, F.lit(1 << bits))).withColumn("__slot", F.expr(f"__pos div {SLICE}"))
    rows = rows.join(F.broadcast(made), F.col("__slot") == F.col("__bucket"), "left")
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast(__pos % {SLICE} div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(F.expr("shiftright(__byte, cast(__pos % 8 as int)) & 1") == 1, F.lit(False))
    return rows.withColumn("__byte", byte).select(*columns, hit.alias(name))


def root_of(rows: str) -> str:
    """SQL for a number of buckets that leaves as many rows to a bucket as there are buckets, about."""
    return f"(1L + floor(sqrt({rows})))"


def running_sum(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same keys up to each row, itself included.

    ``bucket`` is a column that never falls as ``order`` rises. Each (keys, bucket) group is summed
    in a task of its own and starts from the total of the buckets before it, so one hot key is
    spread over its buckets. Keys may be null.
    """
    from pyspark.sql import Window as W

    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("__total"))
    before = F.sum("__total").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"__b_{k}") for k in [*keys, bucket]], F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    same = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in [*keys, bucket]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = rows.withColumn("__within", within).join(totals, condition, "left")
    return joined.withColumn(name, F.col("__before") + F.col("__within")).drop("__within", "__before", *[f"__b_{k}" for k in [*keys, bucket]])
