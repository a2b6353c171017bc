"""The operators of this subpackage as registered queries, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import table
from quern.llm.decontaminate import contamination
from quern.llm.exact_dedup import exact_dedup
from quern.llm.line_dedup import line_dedup
from quern.llm.mixing import mix
from quern.llm.pii import find_pii
from quern.llm.sharding import shard
from quern.llm.simhash import simhash_groups
from quern.llm.substring_dedup import substring_dedup
from quern.llm.suffix_dedup import suffix_dedup
from quern.llm.toxicity import fit, toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).drop("source")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest", "longest_at")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("n_spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("redacted")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept")


OP1 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP3 = r"""
WITH poly AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
x AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (
  SELECT doc_id, source, (strlen(h) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM x, poly),
u AS (SELECT *, (('0x' || substr(md5('7:' || doc_id || ':' || text_crc32), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u,
    (('0x' || substr(md5('8:' || coalesce(source, '') || ':' || (source IS NULL)::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS jitter FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, doc_id, size) AS place, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM u),
f AS (SELECT *, row_number() OVER (ORDER BY (place - jitter) / n, source NULLS FIRST, place) - 1 AS at_ FROM r),
s AS (SELECT *, at_ * 16 // total AS shard FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (at_ - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('11:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::BIGINT AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS share
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * rest >= cap * share AS stop FROM r),
f AS (SELECT rest AS f_rest, share AS f_share FROM c WHERE NOT stop ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN stop THEN cap::DOUBLE ELSE w * f_rest / f_share END AS target FROM c LEFT JOIN f ON true),
k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
l AS (SELECT source, sum(size * (size * 1024 // (size + mean)))::BIGINT AS longs FROM d JOIN (SELECT source AS src, greatest(source_size // n, 1) AS mean FROM s) ON source IS NOT DISTINCT FROM src GROUP BY source),
n AS (SELECT d.*, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS rem, greatest(k.source_size // s.n, 1) AS mean, l.longs
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source),
i AS (SELECT *, CASE WHEN source_size > 0 AND whole < 3 THEN rem / source_size ELSE 0.0 END::DOUBLE AS p, (size * 1024 // (size + mean)) / 1024.0::DOUBLE - longs / (1024.0::DOUBLE * source_size) AS g FROM n),
pi AS (SELECT *, p * (1.0::DOUBLE + (1.0::DOUBLE - p) * g) AS pi FROM i),
o AS (SELECT *, CASE WHEN pi > 0 AND pi < 1 THEN (u / (1.0::DOUBLE - u)) / (pi / (1.0::DOUBLE - pi)) END AS q FROM pi),
q AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY q, doc_id::VARCHAR, size ROWS UNBOUNDED PRECEDING) END AS upto FROM o)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN upto - size / 2.0 <= rem THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS run FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) u WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS run FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) u WHERE len(w) >= n),
m AS (SELECT doc_id, item, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.run = bw.run),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM m, LATERAL (SELECT unnest(range(i, i + n)) AS place) u GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS run FROM u),
f AS (SELECT doc_id, i, word, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS later FROM g),
c AS (SELECT doc_id, i, word, max(later::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
u AS (SELECT doc_id, h, unnest(range(1, strlen(h) // 2 + 1)) AS i FROM d),
g AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS b, CASE WHEN 2 * i + 98 <= strlen(h) THEN substr(h, 2 * i - 1, 100) END AS run FROM u),
f AS (SELECT doc_id, i, b, run IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY run) AS later FROM g),
c AS (SELECT doc_id, i, b, max(later::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS head FROM c),
s AS (SELECT doc_id, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, sum(head::INT)::BIGINT AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

OP10 = r"""
WITH l AS (
  SELECT doc_id, source, u.line, u.n FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n) u),
b AS (SELECT trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l GROUP BY 1 HAVING count(DISTINCT coalesce('=' || source, '')) >= 5 AND bare <> ''),
m AS (SELECT l.*, trim(line, ' ' || chr(9) || chr(13)) IN (SELECT bare FROM b) AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_sharding": OP3, "op4_mixing": OP4, "op6_decontamination": OP6, "op7_substring_dedup": OP7, "op9_suffix_dedup": OP9, "op10_line_dedup": OP10}
