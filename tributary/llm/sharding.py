"""Proportional stratified interleaving: shards that all have the corpus's mixture of sources.

Rows are shuffled by a seeded key within their source.  A row with rank r of
the n rows of its source gets the fractional rank (r + u) / n, u in [0, 1)
being fixed for the source, so that every source is spread evenly over
[0, 1).  All rows are sorted by it and cut into shards of equal counts; each
shard then holds its share of every source, give or take one row.

Both ranks are taken in buckets (``plans.ranking``): no source, however hot,
meets in one task.  Native: DataFrame functions only.

Defined cases: a null or empty text has no bytes; null sources are one
source; repeated rows are rows of their own; of rows with equal shuffle keys
the smaller text checksum comes first; an empty table gives no rows; other
columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import source_key, utf8_bytes
from tributary.plans.ranking import HASH_RANGE, buckets_for, hex_fraction, running, shuffle_key

LAW = "rows"


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: str = "shards") -> DataFrame:
    """``docs`` (doc_id, text, source) to doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    n = docs.select(F.count(F.lit(1))).first()[0]
    buckets = buckets_for(n)
    rows = docs.select(
        "doc_id",
        (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        source_key(F.col("source")).alias("__src"),
        shuffle_key(seed, F.col("doc_id")).alias("__key"),
    ).withColumn("__bucket", F.floor(hex_fraction(F.col("__key")) * buckets / HASH_RANGE).cast("int"))
    tie = ["__key", "text_crc32", "size"]
    ranked = running(rows, ["__src"], "__bucket", tie, rank="__r", size="__n_src")
    phase = hex_fraction(shuffle_key(seed, F.col("__src"))) / float(HASH_RANGE)
    placed = ranked.select(
        "doc_id", "size", "text_crc32", "__src", "__r",
        ((F.col("__r") + phase) / F.col("__n_src").cast("double")).alias("__at"),
    ).withColumn("__slice", F.floor(F.col("__at") * buckets).cast("int"))
    order = running(placed, [], "__slice", ["__at", "__src", "__r"], rank="__pos")
    shard = F.floor(F.expr(f"__pos * {shards} div {max(n, 1)}")).cast("bigint")
    return order.withColumn("__shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("__shard").cast("int").alias("shard"),
        (F.col("__pos") - F.expr(f"(__shard * {n} + {shards - 1}) div {shards}")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The checksum is left to a table of 256 rows, made by the CRC-32 rule.
ORACLE_SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, coalesce('s' || source, 't') AS src,
         md5('shards:' || doc_id) AS k,
         CASE WHEN coalesce(text, '') = '' THEN 0::BIGINT ELSE
           xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\1,', 'g'), ',')[:-2],
                              lambda x: ('0x' || x)::BIGINT)),
               lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295::BIGINT) END AS crc
  FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k, crc, size) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM d),
p AS (SELECT *, (r + ('0x' || left(md5('shards:' || src), 8))::BIGINT / 4294967296.0::DOUBLE) / n::DOUBLE AS pos FROM r),
g AS (SELECT *, row_number() OVER (ORDER BY pos, src, r) - 1 AS g, count(*) OVER () AS total FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (g * 8 // total)::INTEGER AS shard,
       (g - ((g * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM g
"""
