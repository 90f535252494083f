"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are put into an order that brings like to like (by their largest
component, then by a hash) and cut into ranges of RANGE and blocks of BLOCK.
A block keeps the maximum and minimum of each component (the maxima of the two
terms, one for each sign); with a query they give an upper bound of all scores
in the block.  A query takes the blocks by falling bound, scores all vectors
of a block through its forward index (the matrix of its vectors), and ends
when the next bound is below its k-th score.  Blocks whose bound equals it are
still scored, as ties go to the smaller id.

Queries are cut into blocks as well; a cell is a block of queries and a range
of vectors, both of bounded size.  The cells' best are merged by a window that
keeps k rows of each query on both sides of the shuffle.

All scores are exact: products of components below LARGE run in floats that
hold them exactly, those of vectors with a larger one in 64-bit or, where that
isn't enough, in Python's integers.

Defined cases: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; a score that no long holds ranks by
its value as a float and is given as the nearest long; shorter vectors are filled up
with zeros; a repeated candidate row is a candidate each time; of a repeated
query id the smallest vector counts; rows with the query's id are not its
candidates; an empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.plans.ranking import running

SCALE, BLOCK, RANGE, QUERIES = 64, 128, 4096, 4096
#: Integers below it are kept in 32 bits and scored in floats.
LARGE = 1 << 26
LONGS = np.iinfo(np.int64)


def _quantised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """vec_id, the vector (a byte 0 and 32-bit integers, or a byte 1 and the unscaled floats), and the number and sign of its largest component."""
    for f in frames:
        ids, blobs, leads = [], [], []
        for i, e in zip(f["vec_id"], f["embedding"]):
            if e is None:
                continue
            x = np.asarray(e, np.float64)  # a null component becomes NaN
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                q = np.floor(x * SCALE)
            k = int(np.argmax(np.abs(x))) if len(x) else 0
            ids.append(i)
            blobs.append(b"\0" + q.astype(np.int32).tobytes() if (np.abs(q) < LARGE).all() else b"\1" + x.tobytes())
            leads.append(2 * k + int(len(x) > 0 and x[k] < 0))
        yield pd.DataFrame({"vec_id": np.array(ids, np.int64), "v": pd.Series(blobs, dtype=object), "lead": np.array(leads, np.int64)})


def integers(x: np.ndarray) -> list[int]:
    """floor(SCALE * x) of finite floats of any size."""
    return [math.floor(v * SCALE) if abs(v) < 2.0**1000 else int(v) * SCALE for v in x.tolist()]


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Rows of floats that are whole numbers below LARGE, or of Python's integers if one of them isn't."""
    plain = all(b[0] == 0 for b in blobs)
    out = np.zeros((len(blobs), width), np.float64 if plain else object)
    for r, b in enumerate(blobs):
        v = np.frombuffer(b, np.int32, offset=1) if b[0] == 0 else integers(np.frombuffer(b, np.float64, offset=1))
        out[r, : len(v)] = v if plain else [int(i) for i in v]
    return out


def _width(blobs) -> int:
    return max(((len(b) - 1) // (8 if b[0] else 4) for b in blobs), default=0)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores (None or -inf: none) and ids of each query's k best, and the number of blocks scored."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    whole = lambda x: (x.astype(np.int64) if kind is object and x.dtype != object else x).astype(kind)
    queries, vectors = whole(queries), whole(vectors)
    none = -np.inf if kind is np.float64 else -(1 << 62) if kind is np.int64 else -(most + 1)
    cuts = range(0, len(vectors), block)
    high = np.stack([vectors[a : a + block].max(0) for a in cuts])
    low = np.stack([vectors[a : a + block].min(0) for a in cuts])
    plus, minus = np.where(queries > 0, queries, 0), np.where(queries < 0, -queries, 0)
    bound = plus @ high.T - minus @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    n = len(queries)
    scores = np.full((n, k), none, dtype=kind)
    found = np.full((n, k), LONGS.max)
    active, visits = np.arange(n), 0
    for r in range(bound.shape[1]):
        b = order[active, r]
        go = bound[active, b] >= scores[active, k - 1]
        active, b = active[go], b[go]
        if not len(active):
            break
        visits += len(active)
        for x in np.unique(b):
            rows = active[b == x]
            own = slice(x * block, min((x + 1) * block, len(vectors)))
            s = queries[rows] @ vectors[own].T
            s[query_ids[rows][:, None] == ids[own][None, :]] = none
            better = (s >= scores[rows, k - 1][:, None]).any(1)
            rows, s = rows[better], s[better]
            if not len(rows):
                continue
            all_s = np.concatenate([scores[rows], s], 1)
            all_i = np.concatenate([found[rows], np.broadcast_to(ids[own], s.shape)], 1)
            if kind is object:
                keep = np.array([sorted(range(len(q)), key=lambda j: (-q[j], i[j]))[:k] for q, i in zip(all_s, all_i)])
            else:
                keep = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            scores[rows] = np.take_along_axis(all_s, keep, 1)
            found[rows] = np.take_along_axis(all_i, keep, 1)
    return np.where(scores == none, None, scores) if kind is not np.float64 else scores, found, visits


CELL = "query_id bigint, vec_id bigint, score bigint, above double, visits bigint, blocks bigint"


def _cell(k: int):
    """The best of a cell; ``above`` orders scores of which ``score`` is only the nearest long, and the first row counts blocks."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        rows, visits, blocks = [], 0, 0
        if len(queries) and len(vectors):
            vectors = vectors.sort_values(["pos", "vec_id"])
            width = max(_width(queries["v"]), _width(vectors["v"]))
            split = lambda f: [f[f["v"].map(lambda b: b[0] == large)] for large in (0, 1)]
            for i, q in enumerate(split(queries)):
                for j, v in enumerate(split(vectors)):
                    if len(q) and len(v):
                        qid, ids = q["vec_id"].to_numpy(np.int64), v["vec_id"].to_numpy(np.int64)
                        scores, found, n = best(_matrix(list(q["v"]), width), qid, _matrix(list(v["v"]), width), ids, k)
                        visits, blocks = visits + n, blocks + len(q) * -(-len(v) // BLOCK)
                        for a, s, f in zip(qid.tolist(), scores.tolist(), found.tolist()):
                            rows += [(a, y, min(max(int(x), LONGS.min), LONGS.max), _above(int(x))) for x, y in zip(s, f) if x is not None and x > -math.inf]
        out = pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "above"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "above": "float64"})
        out["visits"], out["blocks"] = 0, 0
        if len(out):
            out.loc[0, ["visits", "blocks"]] = visits, blocks
        return out

    return run


def _above(score: int) -> float:
    """0 of a score that a long holds."""
    if LONGS.min <= score <= LONGS.max:
        return 0.0
    return float(max(min(score, 1 << 1023), -(1 << 1023)))


def cells(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The best of every cell: query_id, vec_id, score, above, and the blocks scored and all blocks of the cell on one of its rows."""
    q = vectors.filter("vec_id is not null").select("vec_id", "embedding").mapInPandas(_quantised, "vec_id bigint, v binary, lead bigint")
    spread = q.withColumn("__bucket", F.col("lead") * 64 + F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    placed = running(spread, [], "__bucket", ["vec_id"], rank="pos").select("vec_id", "v", "pos", F.expr(f"pos div {RANGE}").alias("range"))
    asked = q.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("__bucket", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    asked = running(asked, [], "__bucket", ["vec_id"], rank="pos").select("vec_id", "v", F.expr(f"pos div {QUERIES}").alias("part"))
    n = q.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    ranges, parts = -(-n[0] // RANGE), -(-n[1] // QUERIES)
    if not n[1]:
        return vectors.sparkSession.createDataFrame([], CELL)
    renamed = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from one table
    left = renamed(asked).withColumn("range", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ranges - 1).cast("bigint"))))
    right = renamed(placed).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return left.groupBy("part", "range").cogroup(right.groupBy("part", "range")).applyInPandas(_cell(k), CELL)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``vectors`` (vec_id, embedding) to query_id, rank, vec_id and score; queries are the ids that ``every`` divides."""
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("above"), "vec_id")
    return cells(vectors, k, every).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visited(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """visits and blocks: how many blocks were scored for the queries, of how many there are."""
    return cells(vectors, k, every).agg(F.sum("visits").alias("visits"), F.sum("blocks").alias("blocks"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
