"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Each source's documents are shuffled by a seeded key and laid end to end;
   the line of words is cut into blocks of equal length, shorter ones where
   the source's target has fewer than PARTS of them.
2. Targets: weights share the wished total; what a source cannot give (more
   than ``most`` times its size) goes to the others by weight, until none is
   above its bound.
3. Slot i of the schedule has the golden-ratio point i * phi mod 1.  Mapped
   through the cumulative targets, counted in blocks, it names a source: any
   stretch of slots holds the sources' words in proportion.
4. The k-th slot of a source takes its block k mod (number of blocks); past
   the last block the source starts again, ``most`` times at most.

Golden-ratio points are kept as 32-bit integers, so that all engines agree.
Ranks and running sums are taken in buckets, and slots meet documents by
(source, block): a hot source is spread over all tasks.  Native: DataFrame
functions only.

Defined cases: a null or empty text has size 0 and takes nothing; null
sources are one source, the last; repeated rows are rows of their own; of
rows with equal shuffle keys the smaller text comes first by checksum; an
empty table gives no rows; other columns of the input, whatever their names,
are kept by ``mixed_documents`` and left out by ``mixture``; a text of many
blocks is cut over them, however long it is.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.text import source_key, words
from tributary.plans.ranking import HASH_RANGE, buckets_for, hex_fraction, running, shuffle_key
from tributary.plans.scratch import Scratch

#: 2^32 divided by the golden ratio, the odd multiplier of the schedule.
GOLDEN = 2654435769
#: The schedule has about this many slots, more once blocks have BLOCK_MOST words.
SLOTS, BLOCK_MOST = 1 << 18, 1 << 16
#: A source's target has so many blocks at least (down to blocks of a word), so that rounding to blocks is small beside it.
PARTS = 512
#: The circle of points is cut into so many cells to find a point's source by an equi-join.
CELL_BITS = 12


def targets(sizes: DataFrame, weights: tuple[int, ...], factor: float, most: float) -> DataFrame:
    """``sizes`` (__src, source_size), one row a source, to the target of each; weights go round in order of __src."""
    everything = W.partitionBy()
    n = len(weights)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__i") - 1, F.lit(n)) + 1).cast("int"))
    base = (
        sizes.withColumn("__i", F.row_number().over(W.orderBy("__src")))
        .withColumn("__w", cycle)
        .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__goal", F.sum("source_size").over(everything) * F.lit(float(factor)))
    )
    by_need = W.orderBy((F.col("__cap") / F.col("__w")).asc(), "__src")
    level = (
        base.withColumn("__k", F.row_number().over(by_need))
        .withColumn("__given", F.coalesce(F.sum("__cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__left", F.sum("__w").over(by_need.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("__level", (F.col("__goal") - F.col("__given")) / F.col("__left"))
    )
    free = F.col("__level") * F.col("__w") <= F.col("__cap")
    first = F.min(F.when(free, F.struct("__k", "__level"))).over(everything)
    return level.withColumn("__first", first).select(
        "__src", "source_size",
        F.when(F.col("__first").isNull() | (F.col("__k") < F.col("__first.__k")), F.col("__cap"))
        .otherwise(F.col("__first.__level") * F.col("__w")).alias("target"),
    )


def schedule(goal: DataFrame, slots: int, most: int, buckets: int) -> DataFrame:
    """slot, __src, __block, epoch; ``goal`` has __src, source_size, __length (of a block) and __share (of the slots)."""
    spark = goal.sparkSession
    run = W.orderBy("__src")
    edge = goal.withColumn("__to", F.sum("__share").over(run)).withColumn("__all", F.sum("__share").over(W.partitionBy()))
    unit = lambda x: F.round(x / F.col("__all") * float(HASH_RANGE)).cast("bigint")
    arcs = edge.filter("__share > 0").withColumn("__hi", unit(F.col("__to"))).withColumn(
        "__lo", F.coalesce(F.lag("__hi").over(run), F.lit(0))).filter("__hi > __lo")
    width = HASH_RANGE >> CELL_BITS
    arcs = arcs.select("__src", "source_size", "__length", "__lo", "__hi", F.explode(F.expr(f"sequence(__lo div {width}, (__hi - 1) div {width})")).alias("__cell"))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(HASH_RANGE)) * F.lit(GOLDEN), F.lit(HASH_RANGE)).alias("__u"),
    ).withColumn("__cell", F.expr(f"__u div {width}"))
    named = points.join(arcs, "__cell").filter("__u >= __lo and __u < __hi").select("slot", "__src", "source_size", "__length")
    named = named.withColumn("__bucket", F.expr(f"cast(slot * {buckets} div {slots} as int)"))
    ranked = running(named, ["__src"], "__bucket", ["slot"], rank="__k")
    return (
        ranked.withColumn("__blocks", F.expr("(source_size + __length - 1) div __length"))
        .select("slot", "__src", F.expr("__k % __blocks").alias("__block"), F.expr("__k div __blocks").alias("epoch"))
        .filter(F.col("epoch") < most)
    )


class Mix:
    """One mixture of ``docs`` (doc_id, text, source): its lines of words, blocks, targets and schedule."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), factor: float = 1.5, most: int = 2,
                 seed: str = "mix", keep: list[str] | None = None):
        self.scratch = Scratch(docs.sparkSession, "mix")
        rows = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row") if keep else "doc_id",
            words(F.col("text")).alias("__words"),
            source_key(F.col("source")).alias("__src"),
            shuffle_key(seed, F.col("doc_id")).alias("__key"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("__crc"),
        )
        slim = self.scratch.save(rows.select("doc_id", "__words", "__src", "__key", "__crc"), "rows") if not keep else rows
        n, total = slim.select(F.count(F.lit(1)), F.coalesce(F.sum("__words"), F.lit(0))).first()
        wish = int(total * factor)
        block = max(1, min(BLOCK_MOST, wish // SLOTS))
        buckets = buckets_for(n)
        slim = slim.withColumn("__bucket", F.floor(hex_fraction(F.col("__key")) * buckets / HASH_RANGE).cast("int"))
        line = running(slim, ["__src"], "__bucket", ["__key", "__crc", "__words"], weight="__words",
                       rank="__r", before="__from", size="__rows", total="source_size")
        goal = targets(slim.groupBy("__src").agg(F.sum("__words").alias("source_size")), weights, factor, most)
        length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / PARTS))).cast("bigint")
        goal = goal.withColumn("__length", length).withColumn("__share", F.col("target") * (F.lit(float(block)) / F.col("__length")))
        self.goal = self.scratch.save(goal, "goal")
        shares, words_ = self.goal.agg(F.coalesce(F.sum("__share"), F.lit(0.0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
        slots = -(-wish // block) if shares == words_ else ceil(wish / block * (shares / words_))
        self.line = line.join(self.goal.select("__src", "target", "__length"), "__src")
        self.slots = schedule(self.goal, slots, most, buckets_for(slots))

    def pieces(self) -> DataFrame:
        """The parts of documents: __block and the words __n that the block has of the document; a text without words has one of none."""
        last = "greatest(__from + __words - 1, __from)"
        cut = self.line.withColumn("__block", F.explode(F.expr(f"sequence(__from div __length, ({last}) div __length)")))
        inside = "least(__from + __words, (__block + 1) * __length) - greatest(__from, __block * __length)"
        return cut.withColumn("__n", F.expr(f"greatest({inside}, 0)"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the schedule takes of each document."""
    mix = Mix(docs, **options)
    times = mix.slots.groupBy("__src", "__block").agg(F.count(F.lit(1)).alias("__times"))
    taken = mix.pieces().join(times, ["__src", "__block"], "left")
    return (
        taken.groupBy("__src", "__r")
        .agg(F.first("doc_id").alias("doc_id"), F.first("__words").alias("size"), F.first("source_size").alias("source_size"),
             F.first("target").alias("target"), F.sum(F.col("__n") * F.coalesce("__times", F.lit(0))).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the schedule takes the block its first word is in; texts without words go.

    The rows keep all their columns, whatever their names, and travel once by (source, bucket) and once by (source, block).
    """
    mix = Mix(docs, keep=docs.columns, **options)
    start = mix.line.filter("__words > 0").select("__row", "__src", F.expr("__from div __length").alias("__block"))
    start = mix.scratch.save(start, "start")  # so that the first shuffle of whole rows goes before the second
    return start.join(mix.slots.select("__src", "__block"), ["__src", "__block"]).select("__row.*")


#: Of equal blocks for all sources, as they are wherever each source has one part in PARTS of the targets or blocks are single words.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('s' || source, 't') AS src, md5('mix:' || doc_id) AS k FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
         sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM s),
l AS (
  SELECT *, row_number() OVER q AS k,
         (goal - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW q AS (ORDER BY cap / w, src)),
f AS (SELECT k, level FROM l WHERE level * w <= cap ORDER BY k LIMIT 1),
t AS (SELECT l.src, source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN cap ELSE f.level * w END AS target FROM l LEFT JOIN f ON true),
n AS (SELECT b, ((wish + b - 1) // b)::BIGINT AS slots FROM (
  SELECT greatest(1, least(65536, wish // 262144))::BIGINT AS b, wish FROM (SELECT floor(sum(source_size) * 1.5)::BIGINT AS wish FROM s))),
e AS (SELECT *, sum(target) OVER (ORDER BY src) AS upto, sum(target) OVER () AS total FROM t),
a AS (SELECT src, source_size, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo, hi
      FROM (SELECT *, round(upto / total * 4294967296.0)::BIGINT AS hi FROM e WHERE target > 0)),
p AS (SELECT i, ((i % 4294967296) * 2654435769) % 4294967296 AS u FROM (SELECT unnest(range(slots)) AS i FROM n)),
c AS (SELECT src, (source_size + b - 1) // b AS blocks, row_number() OVER (PARTITION BY src ORDER BY i) - 1 AS k
      FROM p JOIN a ON u >= lo AND u < hi, n),
m AS (SELECT src, k % blocks AS block, count(*) AS times FROM c WHERE k // blocks < 2 GROUP BY ALL),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
x AS (SELECT doc_id, size, src, start, unnest(range(start // b, (greatest(start + size - 1, start)) // b + 1)) AS block, b FROM o, n)
SELECT doc_id, size, any_value(source_size)::BIGINT AS source_size, any_value(target)::DOUBLE AS target,
       sum(greatest(least(start + size, (x.block + 1) * b) - greatest(start, x.block * b), 0) * coalesce(times, 0))::BIGINT AS taken
FROM x JOIN t USING (src) LEFT JOIN m ON m.src = x.src AND m.block = x.block
GROUP BY doc_id, size, src, start
"""
