"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import WORD, join_keyed, numbered, root_of, running_sum, settle, unit_hash


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Targets of sources (``__source``, ``source_size``, ``__rows``): all sizes shared by weight, none above ``most`` times its source.

    Sources ordered by code point, null last, take the weights in turn. The level at which the
    weights share what the stopped sources leave is read off running sums over the sources in the
    order in which they are stopped: no iteration, one pass over a table with a row per source.
    """
    turn = (F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    table = sizes.withColumn("__w", weight).withColumn("__cap", (F.col("source_size") * most).cast("long"))
    order = W.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("__source").asc_nulls_last())
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    table = table.withColumns(
        {
            "__left": F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("__cap").over(earlier), F.lit(0)),
            "__share": F.sum("__w").over(W.partitionBy()) - F.coalesce(F.sum("__w").over(earlier), F.lit(0.0)),
        }
    )
    table = table.withColumn("__stop", F.col("__w") * F.col("__left") >= F.col("__cap") * F.col("__share"))
    free = F.first(F.when(~F.col("__stop"), F.struct("__left", "__share")), ignorenulls=True).over(W.partitionBy().orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = table.withColumn("__free", free)
    target = F.when(F.col("__stop"), F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__free.__left") / F.col("__free.__share"))
    return level.select("__source", "source_size", "__rows", target.alias("target"))


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with __source, __u (a random number of the id), __place (the order of equal ranks) and __size (words)."""
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns(
        {
            "__source": F.col(source_col).cast("string"),
            "__u": unit_hash(F.col(id_col), seed=seed),
            "__place": F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")),
            "__size": words,
        }
    )


#: A document's length beside its source's mean, in 1024ths: whole numbers, so that sums do not depend on their order.
_LONG = "__size * 1024 div (__size + __mean)"


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` joined with their source's plan, with __q: random odds over inclusion odds.

    The inclusion probability of a document is p * (1 + (1 - p) * (l - m)), where p is the fraction
    of the source to be sampled, l the document's size over itself plus the mean size, and m the mean
    of l over the source's words: longer documents are likelier, every probability lies between 0
    and 1, and the words expected are p times the source's.
    """
    rows = rows.withColumn("__g", F.expr(f"({_LONG}) / 1024.0D - __longs / (1024.0D * source_size)"))
    rows = rows.withColumn("__pi", F.expr("__p * (1.0D + (1.0D - __p) * __g)"))
    return rows.withColumn("__q", F.expr("CASE WHEN __pi > 0 AND __pi < 1 THEN (__u / (1.0D - __u)) / (__pi / (1.0D - __pi)) END"))


def _plan(rows: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """Per source: source_size, target, certain copies, what ranks its documents and the last place of the sample."""
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    targets = source_targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("__whole", whole).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    targets = targets.withColumn("__p", F.when((F.col("source_size") > 0) & (F.col("__whole") < most), F.col("__rest") / F.expr("nullif(source_size, 0)")).otherwise(F.lit(0.0)))
    targets = settle(targets.withColumn("__mean", F.expr("greatest(source_size div __rows, 1L)")))
    longs = join_keyed(rows, targets.select("__source", "__rows", "__mean"), ["__source"], "__rows", F.col("__u"))
    longs = longs.groupBy(F.col("__source").alias("__r")).agg(F.sum(F.expr(f"__size * ({_LONG})")).alias("__longs"))
    targets = settle(targets.join(longs, F.col("__source").eqNullSafe(F.col("__r")), "left").drop("__r"))
    ranked = _ranked(join_keyed(rows, targets, ["__source"], "__rows", F.col("__u"))).where("__q is not null")
    # Never falls as q rises, and deals a source's documents into buckets of about the root of its rows.
    ranked = ranked.withColumn("__many", F.expr(root_of("__rows"))).withColumn("__bucket", F.expr("__many - floor(__many / (1.0D + __q * (__p / (1.0D - __p))))"))
    summed = running_sum(ranked, ["__source"], "__bucket", [F.col("__q"), F.col("__place"), F.col("__size")], "__size", "__upto")
    taken = summed.where(F.col("__upto") - F.col("__size") / 2 <= F.col("__rest"))
    last = taken.groupBy("__source").agg(F.max(F.struct("__q", "__place")).alias("__last")).withColumnRenamed("__source", "__r")
    return targets.join(last, F.col("__source").eqNullSafe(F.col("__r")), "left").drop("__r", "__rest")


def _copied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    joined = _ranked(join_keyed(rows, settle(plan), ["__source"], "__rows", F.col("__u")))
    extra = F.coalesce(F.struct("__q", "__place") <= F.col("__last"), F.lit(False)) & F.col("__q").isNotNull()
    return joined.withColumn("__copies", (F.col("__whole") + extra.cast("long")).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document enters a mixture whose sources meet ``source_targets`` in words.

    A source's target over its size gives every document floor(ratio) certain whole copies. Of what
    is left documents are sampled with unequal probabilities (see ``_ranked``): they are ranked by
    their random odds u / (1 - u) over their inclusion odds and taken from the front (Pareto order
    sampling). The size of the sample is fixed in words, which the targets are in: it is the
    prefix whose words come nearest to what the copies leave, so a source misses its target by half a
    document at most. No document is taken over ``most`` times. The same rows and seed give the same
    mixture. A source is summed over buckets of about the root of its rows, never in one task.

    One row per input row: doc_id, source, size (words; null text: 0), source_size, target, copies,
    taken (size times copies). Null is a source of its own, the last; rows of one id and size are taken or left
    together; documents without words take no words; a source without words takes no copies. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    # Texts are read and counted once.
    rows = settle(_keyed(rows, seed, "doc_id", "text", "source").select("__source", "__u", "__place", "__size", "doc_id"))
    rows = _copied(rows, _plan(rows, weights, most))
    return rows.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: every row of ``docs``, all columns under their names, as many times as ``mix`` takes it.

    Nulls, ties, repeated rows and empty tables are as for ``mix``. With up to 100,000 sources texts are
    read twice and not shuffled.
    """
    names = docs.columns
    docs, (id_col, text_col, source_col) = numbered(docs, id_col, text_col, source_col)
    rows = _keyed(docs, seed, id_col, text_col, source_col)
    plan = _plan(settle(rows.select("__source", "__u", "__place", "__size")), weights, most)
    rows = _copied(rows, plan).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns).toDF(*names)
