"""Line dedup: lines that stand on many distinct sites are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bitmap, bitmap_bits, join_keyed, marked, settle, text_of


def _key(line: Column) -> Column:
    """128 bits of a line without the blanks around it."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def spread_lines(lines: DataFrame, least_sites: int, margin: float = 0.1, log2_buckets: int = 12) -> DataFrame:
    """Keys (a, b) of the lines that ``least_sites`` or more sites have, and their rows; ``lines`` has a, b, site.

    A HyperLogLog sketch per line estimates its sites; sketches are made where the rows are and merged
    by the aggregation, so a line of every document costs a sketch per task. Lines whose least and
    greatest site are the same drop out. Where the estimate is within ``margin`` of the threshold (or
    2 sites), the sites are counted exactly.
    """
    sketch = F.hll_sketch_agg("site", log2_buckets)
    each = lines.groupBy("a", "b").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), sketch.alias("sketch"), F.count(F.lit(1)).alias("rows")).where("lo <> hi")
    slack = max(2.0, margin * least_sites)
    estimates = settle(each.select("a", "b", "rows", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= least_sites - slack))
    clear = estimates.where(F.col("n") > least_sites + slack).select("a", "b", "rows")
    near = estimates.where(F.col("n") <= least_sites + slack).select("a", "b", "rows")
    # Made distinct where the rows are, so that a frequent line is a row per site here.
    sites = lines.select("a", "b", "site").distinct().join(near, ["a", "b"], "left_semi")
    exact = sites.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_sites).select("a", "b")
    return clear.unionAll(near.join(exact, ["a", "b"], "left_semi"))


def line_dedup(docs: DataFrame, least_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Remove lines that ``least_sites`` or more distinct sites have, wherever they stand.

    Lines end at line feeds and are compared without blanks, tabs and carriage returns around them;
    blank lines always stay. Which lines go is decided on the input. Only keys of lines are
    shuffled to find them; then each document that has boilerplate meets the keys of its own once.

    One row per input row: doc_id, n_lines, n_removed, kept_sha256 (lowercase hex of the kept lines
    joined by line feeds), kept (that text). A null text is one empty line; null sites count as one
    site; repeated rows are judged each; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"))
    # Rows of the same id and text share a key: what is found for one holds for the other.
    rows = rows.withColumn("key", F.xxhash64("doc_id", "t"))
    bare = F.col("site")
    lines = rows.select("key", bare, F.explode(F.array_distinct(F.transform(F.split("t", "\n"), lambda x: F.when(F.btrim(x, F.lit(" \t\r")) != "", _key(x))))).alias("k"))
    lines = settle(lines.where("k is not null").select("key", "site", "k.a", "k.b"))
    wide = settle(spread_lines(lines.select("a", "b", "site"), least_sites))
    hit = join_keyed(lines, wide.withColumn("wide", F.lit(True)), ["a", "b"], "rows", F.col("key")).where("wide")
    bad = settle(hit.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("bad"), F.count(F.lit(1)).alias("rows")))
    # Texts without such a line pass unshuffled; a bitmap of the keys tells them, with few false hits.
    bits = bitmap_bits(bad.count())
    rows = marked(rows.drop("site"), F.col("key"), bitmap(bad, "key", bits), bits, "met")
    joined = join_keyed(rows.where("met"), bad, ["key"], "rows", F.monotonically_increasing_id(), whole=0).drop("rows")
    joined = joined.unionByName(rows.where("not met").withColumn("bad", F.lit(None).cast(dict(bad.dtypes)["bad"]))).withColumn("lines", F.split("t", "\n"))
    keep = F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), _key(x)) | (F.btrim(x, F.lit(" \t\r")) == ""))
    joined = joined.withColumn("left", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(keep))
    kept = F.array_join("left", "\n")
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_removed"), kept.alias("kept")).withColumn("kept_sha256", F.sha2("kept", 256))
