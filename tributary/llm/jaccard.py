"""N-gram Jaccard join in the metric space of shingle sets, and its connected components.

d(A, B) = 1 - |A n B| / |A u B| is a metric; documents link when d <= 1 - t.

*First level, over the cluster.*  Unrelated documents are all about 1 apart,
so that a handful of whole documents as pivots leaves everything in one
region.  The first level's pivots are single shingles: {s} is 1 - 1/|A| from A
if s is in A, else 1 from it, so the nearest pivots of A are its own shingles,
and its Voronoi cell is that of the first of them in one global order (rarest
first).  A link of A misses at most w = |A| - ceil(t |A|) of A's shingles
(the triangle inequality through A n B), so its cell can lie no further than
the window of A's first w + 1 shingles: A is copied to those regions.  Linked
documents meet in at least one of them, whatever the global order is.  The
order looks at one shingle of ``classes`` first, by the exact number of distinct
sets that hold it in the whole corpus, then at the others by their hashes.

*Next levels, in a region.*  Members are parted by whole-document pivots:
distances to the pivots, Voronoi regions, and copies of every member whose
distance to a pivot is within 2 (1 - t) of its smallest (the triangle
inequality); the regions are joined recursively until they are small or no
longer shrink, and then compared pair by pair, in blocks, with bounds by size.
Members known to be connected aren't compared again.  Nothing is approximate.

Regions are gathered so that a set travels once: sets that share a pivot,
directly or over others, form a cell, which one task joins as far as it has at
most HEAVY shingles.  A heavier cell is parted by whole-document pivots over
the cluster, as above but with tables: some of its members are pivots, blocks
of the cell meet them, every member is copied to the regions that its window
reaches, and those are light, or parted again by other pivots.  Members that
link to one pivot are of one class and needn't meet again, so that a group of
near copies takes time in proportion to its size.  Where regions don't shrink,
what is left of the cell goes by its shingles' regions or by pairs of blocks,
whichever moves less; regions and blocks of a single class are left out.
Equal sets are one class from the start and are never paired.  All tables
between stages are written to the shared folder.

Defined cases: null texts and texts without words have the empty set, which
links with nothing; repeated rows and equal texts link; repeated ids are rows
of their own, an id's component being that of its set; rows with a null id
link like others, and a component of such rows alone has a null id; an empty
table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.shingles import shingle_sets
from tributary.plans.components import components
from tributary.plans.ranking import running
from tributary.plans.scratch import Scratch

#: Shingles in a cell, and in a page of the frequency count; sets that a task remembers.
HEAVY, PAGE_SHINGLES, PAGE_SETS, REMEMBERED = 2_000_000, 250_000, 4_096, 200_000
SMALL, PIVOTS, BLOCK, COLUMNS = 64, 8, 256, 4_096
#: Rounds of document pivots over the cluster, and the share of a region that counts as shrunk.
ROUNDS, SHRUNK = 4, 0.7


def window(n: int, percent: int) -> int:
    """How many of its first shingles a set of n is copied to."""
    return n - (percent * n + 99) // 100 + 1


def _sketches(size: int, percent: int, classes: int):
    """A page of sets a row: doc_ids, keys of texts, sizes, digests; of the sets that are new to the task the shingles of the first class and as many of the others as the window lacks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        page = TaskContext.get().partitionId() << 32
        seen: set[bytes] = set()
        rows, first, counts, rest, rests = [], [], [], [], []
        for f in frames:
            for a in range(0, len(f), 256):
                part = f.iloc[a : a + 256]
                for d, key, x in zip(part["doc_id"], part["key"], shingle_sets(part["text"], size)):
                    digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                    new = len(x) > 0 and digest not in seen
                    if new:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                        own = x[x % classes == 0]
                        lack = max(0, window(len(x), percent) - len(own))
                        other = x[x % classes != 0][:lack]
                        first.append(own)
                        rest.append(other)
                    counts.append(len(first[-1]) if new else 0)
                    rests.append(len(rest[-1]) if new else 0)
                    rows.append((d, key, len(x), digest))
                if rows and (len(rows) >= PAGE_SETS or sum(map(len, first)) >= PAGE_SHINGLES):
                    yield out(page, rows, first, counts, rest, rests)
                    page += 1
                    rows, first, counts, rest, rests = [], [], [], [], []
        if rows:
            yield out(page, rows, first, counts, rest, rests)

    def out(page, rows, first, counts, rest, rests):
        blob = lambda parts, kind: (np.concatenate(parts) if parts else np.zeros(0)).astype(kind).tobytes()
        return pd.DataFrame({
            "page": [page], "doc_ids": [[r[0] for r in rows]], "keys": [[r[1] for r in rows]], "sizes": [[r[2] for r in rows]], "digests": [[r[3] for r in rows]],
            "counts": [np.array(counts, np.int32).tobytes()], "first": [blob(first, np.uint64)],
            "rests": [np.array(rests, np.int32).tobytes()], "rest": [blob(rest, np.uint64)],
        })

    return run


def _places(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A page's distinct shingles by bucket, how many sets hold each, where each entry finds its own, and their buckets."""
    u, which, n = np.unique(h, return_inverse=True, return_counts=True)
    bucket = ((u >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(u), np.int64)
    back[order] = np.arange(len(u))
    return u[order], n[order], back[which], bucket[order]


def _deal(parts: int):
    """A page's distinct shingles and their counts by bucket of the hash: a frequent shingle is one entry a page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for page, first in zip(f["page"], f["first"]):
                u, n, _, bucket = _places(np.frombuffer(first, np.uint64), parts)
                if len(u):
                    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(u)]
                    yield pd.DataFrame([(int(bucket[a]), page, u[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()) for a, b in pairwise(edges)],
                                       columns=["bucket", "page", "hashes", "counts"])

    return run


def _frequencies(f: pd.DataFrame) -> pd.DataFrame:
    """For each page how many sets of the corpus hold its shingles (255: as many or more, which keeps one global order)."""
    sizes = [len(x) // 8 for x in f["hashes"]]
    h = np.frombuffer(b"".join(f["hashes"]), np.uint64)
    _, which = np.unique(h, return_inverse=True)
    total = np.bincount(which, np.frombuffer(b"".join(f["counts"]), np.uint32))
    df = np.minimum(total, 255).astype(np.uint8)[which]
    cuts = np.cumsum([0, *sizes])
    return pd.DataFrame({"page": f["page"], "bucket": f["bucket"], "dfs": [df[a:b].tobytes() for a, b in pairwise(cuts)]})


def _windows(percent: int, parts: int):
    """Of each set of a page the shingles of its window that another set may hold."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pivots, owners, sizes = [], [], []
        for r in left.itertuples():
            h, rest = np.frombuffer(r.first, np.uint64), np.frombuffer(r.rest, np.uint64)
            df = np.frombuffer(b"".join(right.sort_values("bucket")["dfs"]), np.uint8)[_places(h, parts)[2]] if len(h) else np.zeros(0, np.uint8)
            a = b = 0
            for digest, n, c, c2 in zip(r.digests, r.sizes, np.frombuffer(r.counts, np.int32), np.frombuffer(r.rests, np.int32)):
                if c or c2:
                    k = window(n, percent)
                    own, f = h[a : a + c], df[a : a + c]
                    if k < c:
                        keep = np.lexsort((own, f))[:k]
                        own, f = own[keep], f[keep]
                    own = np.concatenate([own[f > 1], rest[b : b + c2]])
                    pivots.append(own)
                    owners += [digest] * len(own)
                    sizes += [n] * len(own)
                a, b = a + c, b + c2
        got = np.concatenate(pivots).view(np.int64) if pivots else np.zeros(0, np.int64)
        return pd.DataFrame({"pivot": got, "digest": pd.Series(owners, dtype=object), "n": np.array(sizes, np.int64)})

    return run


def distances(sets: list[np.ndarray], sizes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the distance to the set ``p``, and how many shingles they share."""
    flat = np.concatenate(sets)
    at = np.searchsorted(p, flat)
    hit = p[np.minimum(at, len(p) - 1)] == flat
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    common = np.add.reduceat(hit.astype(np.int64), starts)
    return 1 - common / (sizes + len(p) - common), common


class Join:
    """Connects all links among the sets of one cell; sets of one class, where they have one, are connected already."""

    def __init__(self, sets: list[np.ndarray], percent: int, classes: list[bytes | None] | None = None):
        self.sets, self.percent, self.eps = sets, percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets], np.int64)
        self.parent = list(range(len(sets)))
        first: dict[bytes, int] = {}
        for i, c in enumerate(classes or []):
            if c is not None:
                self.parent[i] = first.setdefault(c, i)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = i = p[p[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)

    def common(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """|A n B| of all rows and columns, by products of 0/1 matrices over the shingles that several of them hold."""
        both = np.concatenate([rows, cols])
        _, which, n = np.unique(np.concatenate([self.sets[i] for i in both]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(both)), self.size[both])
        several = n > 1
        number = np.cumsum(several) - 1
        keep = several[which]
        col, owner = number[which][keep], owner[keep]
        order = np.argsort(col, kind="stable")
        col, owner = col[order], owner[order]
        out = np.zeros((len(rows), len(cols)), np.float32)
        for a in range(0, int(several.sum()), COLUMNS):
            lo, hi = np.searchsorted(col, [a, a + COLUMNS])
            m = np.zeros((len(both), COLUMNS), np.float32)
            m[owner[lo:hi], col[lo:hi] - a] = 1
            out += m[: len(rows)] @ m[len(rows) :].T
        return out.astype(np.int64)

    def compare(self, rows: np.ndarray, cols: np.ndarray) -> None:
        c = self.common(rows, cols)
        for i, j in zip(*np.nonzero(self.linked(c, self.size[rows][:, None], self.size[cols][None, :]))):
            if rows[i] != cols[j]:
                self.link(int(rows[i]), int(cols[j]))

    def region(self, ids: np.ndarray) -> None:
        if len({self.find(int(i)) for i in ids}) == 1:
            return
        if len(ids) <= SMALL:
            return self.compare(ids, ids)
        # pivots: the member of median size, then always the one furthest from all pivots so far
        pivot = int(ids[np.argsort(self.size[ids], kind="stable")[len(ids) // 2]])
        d = np.empty((len(ids), PIVOTS))
        chosen = []
        for k in range(PIVOTS):
            d[:, k], common = distances([self.sets[i] for i in ids], self.size[ids], self.sets[pivot])
            chosen.append(pivot)
            for i in ids[self.linked(common, self.size[ids], np.int64(self.size[pivot]))]:
                self.link(pivot, int(i))
            pivot = int(ids[np.argmax(d[:, : k + 1].min(1))])
            if pivot in chosen:
                d = d[:, : k + 1]
                break
        near = d.min(1)
        parts = [ids[d[:, k] - near <= 2 * self.eps + 1e-9] for k in range(d.shape[1]) if (d.argmin(1) == k).any()]
        if max(map(len, parts)) <= 0.7 * len(ids):
            for p in parts:
                self.region(p)
            return
        order = np.argsort(self.size[ids], kind="stable")  # no longer shrinks: blocks by size, bounds by size and pivots
        blocks = [order[a : a + BLOCK] for a in range(0, len(order), BLOCK)]
        for x, bx in enumerate(blocks):
            for by in blocks[x:]:
                if 100 * self.size[ids[bx]].max() < self.percent * self.size[ids[by]].min():
                    break
                gap = np.maximum(d[by].min(0) - d[bx].max(0), d[bx].min(0) - d[by].max(0))
                if gap.max() > self.eps + 1e-9 or len({self.find(int(i)) for i in ids[np.concatenate([bx, by])]}) == 1:
                    continue
                self.compare(ids[bx], ids[by])


    def across(self, left: np.ndarray, right: np.ndarray) -> None:
        """Joins two blocks of a region, each of which is joined on its own elsewhere."""
        by_size = lambda ids: ids[np.argsort(self.size[ids], kind="stable")]
        left, right = by_size(left), by_size(right)
        for bx in np.split(left, range(BLOCK, len(left), BLOCK)):
            for by in np.split(right, range(BLOCK, len(right), BLOCK)):
                small, large = (bx, by) if self.size[bx[-1]] < self.size[by[0]] else (by, bx)
                if 100 * self.size[small].max() < self.percent * self.size[large].min() or len({self.find(int(i)) for i in np.concatenate([bx, by])}) == 1:
                    continue
                self.compare(bx, by)


def _joined(percent: int) -> Callable:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("digest")
        digests, side = list(f["digest"]), f["side"].to_numpy()
        j = Join([np.frombuffer(b, np.uint64) for b in f["shingles"]], percent, list(f["class"]))
        if side.any():
            j.across(np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        else:
            j.region(np.arange(len(digests)))
        return pd.DataFrame({"a": pd.Series([digests[x] for x, _ in j.links], dtype=object), "b": pd.Series([digests[y] for _, y in j.links], dtype=object)})

    return run


NEAR = "region string, digest binary, n bigint, class binary, core binary, ks array<int>"


def _near(percent: int) -> Callable:
    """A block of a region meets the region's pivots: the pivot that each member links to and the Voronoi regions in its window.

    Links of the pivots among themselves are rows without ``ks``.
    """

    def run(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(members):
            return pd.DataFrame([], columns=[c.split()[0] for c in NEAR.split(", ")])
        region, eps = members["region"].iloc[0], 1 - percent / 100
        pivots = pivots.sort_values("k")
        names, points = list(pivots["digest"]), [np.frombuffer(b, np.uint64) for b in pivots["shingles"]]
        among = Join(points, percent)
        among.compare(np.arange(len(points)), np.arange(len(points)))
        sets = [np.frombuffer(b, np.uint64) for b in members["shingles"]]
        sizes = np.array([len(x) for x in sets], np.int64)
        d, linked = np.empty((len(sets), len(points))), np.empty((len(sets), len(points)), bool)
        for k, p in enumerate(points):
            d[:, k], common = distances(sets, sizes, p)
            linked[:, k] = among.linked(common, sizes, np.int64(len(p)))
        inside = d - d.min(1)[:, None] <= 2 * eps + 1e-9
        rows = [(region, names[x], 0, None, names[y], None) for x, y in among.links]
        for i, (digest, n, known) in enumerate(zip(members["digest"], members["n"], members["class"])):
            k = int(linked[i].argmax()) if linked[i].any() else -1
            own = names[among.find(k)] if k >= 0 else None
            rows.append((region, digest, n, known if known is not None else own, names[k] if k >= 0 else None, np.flatnonzero(inside[i]).tolist()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NEAR.split(", ")])

    return run


def _sets(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 256):
                part = f.iloc[a : a + 256]
                yield pd.DataFrame({"digest": part["digest"], "shingles": [x.tobytes() for x in shingle_sets(part["text"], size)]})

    return run


def _weighed(rows: DataFrame) -> DataFrame:
    """(region, w, uniform): the shingles of each region, and whether its members are of one class."""
    return rows.groupBy("region").agg(
        F.sum("n").alias("w"), ((F.count("class") == F.count(F.lit(1))) & F.min("class").eqNullSafe(F.max("class"))).alias("uniform"))


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, digest, class, block), the members of one class side by side, and the pairs of blocks (region, i, j, w) that have to meet."""
    half = HEAVY // 2
    by = F.coalesce(F.hex("class"), F.lit(""))
    place = F.when(F.col("__by") == "", -1).otherwise(F.conv(F.substring("__by", 1, 2), 16, 10).cast("int"))
    rows = rows.withColumn("__by", by).withColumn("__bucket", place * 64 + F.pmod(F.xxhash64("digest"), F.lit(64)).cast("int"))
    laid = running(rows, ["region"], "__bucket", ["__by", "digest"], weight="n").select("region", "digest", "class", "n", F.expr(f"__before div {half}").alias("block"))
    own = laid.groupBy("region", "block").agg(
        F.sum("n").alias("w"), F.when((F.count("class") == F.count(F.lit(1))) & (F.min("class") == F.max("class")), F.min("class")).alias("one"))
    named = lambda i: own.select("region", F.col("block").alias(i), F.col("w").alias(f"w{i}"), F.col("one").alias(f"one{i}"))
    pairs = named("i").join(named("j"), "region").filter("i <= j and not coalesce(onei = onej, false)")
    return laid, pairs.select("region", "i", "j", F.expr("if(i = j, wi, wi + wj)").alias("w"))


def _paired(laid: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell, digest, class, side) of the pairs of blocks."""
    pairs = pairs.withColumn("cell", F.concat_ws(":", "region", "i", "j"))
    sides = pairs.select("region", "cell", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.filter("i < j").select("region", "cell", F.col("j").alias("block"), F.lit(1).alias("side")))
    return laid.join(sides, ["region", "block"]).select("cell", "digest", "class", "side")


def _parted(rows: DataFrame, fetch: Callable, percent: int, scratch: Scratch, r: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of document pivots over ``rows`` (region, digest, n, class, w): the links to pivots, the regions (region, digest, n, class, w)
    of what shrinks, and the rows of what doesn't, both with the classes that are known now and without what is of one class."""
    full = scratch.save(rows.join(fetch(rows.select("digest").distinct()), "digest"), f"heavy{r}")
    first = W.partitionBy("region").orderBy(F.xxhash64("digest", F.lit(r)), "digest")
    chosen = full.select("region", "digest", "w", "shingles").withColumn("k", F.row_number().over(first) - 1).filter(F.col("k") < PIVOTS)  # PIVOTS rows of each task are shuffled
    blocks = F.expr(f"w div {max(1, HEAVY // 4)} + 1")
    chosen = chosen.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    chosen = chosen.select(*[F.col(c).alias(c) for c in ("region", "block", "k", "digest", "shingles")])  # both sides come from one table
    dealt = full.withColumn("block", F.pmod(F.xxhash64("digest", F.lit("block")), blocks)).select("region", "block", "digest", "n", "class", "shingles")
    near = scratch.save(dealt.groupBy("region", "block").cogroup(chosen.groupBy("region", "block")).applyInPandas(_near(percent), NEAR), f"near{r}")
    scratch.drop(f"heavy{r}")
    links = near.filter("core is not null and core != digest").select(F.col("digest").alias("a"), F.col("core").alias("b")).distinct()
    members = near.filter("ks is not null")
    sub = members.select(F.col("region").alias("parent"), "digest", "n", "class", F.explode("ks").alias("k")).withColumn("region", F.concat_ws("/", "parent", "k"))
    weights = sub.groupBy("parent", "region").agg(F.sum("n").alias("w"))
    whole = members.groupBy(F.col("region").alias("parent")).agg(F.sum("n").alias("all"))
    shrunk = scratch.save(weights.groupBy("parent").agg(F.max("w").alias("most")).join(whole, "parent").select("parent", (F.col("most") <= SHRUNK * F.col("all")).alias("shrinks")), f"shrunk{r}")
    smaller = sub.join(shrunk.filter("shrinks"), "parent").select("region", "digest", "n", "class")
    same = members.join(shrunk.filter("not shrinks").select(F.col("parent").alias("region")), "region").select("region", "digest", "n", "class")
    mixed = lambda df, name: scratch.save(df.join(_weighed(df), "region").filter("not uniform").drop("uniform"), name)
    return links, mixed(smaller, f"smaller{r}"), mixed(same, f"same{r}")


def _cells(pivots: DataFrame, roots: DataFrame, fetch: Callable, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(cell, digest, class, side) of all cells, and the links (a, b) that were found on the way."""
    none = F.lit(None).cast("binary")
    node = pivots.select("digest", "n", "h").distinct().join(roots.withColumnRenamed("node", "h"), "h", "left")
    node = node.select(F.hex(F.coalesce("root", "h")).alias("region"), "digest", "n", none.alias("class"))
    node = scratch.save(node.join(node.groupBy("region").agg(F.sum("n").alias("w")), "region"), "nodes")
    light = lambda df: df.filter(F.col("w") <= HEAVY).select(F.col("region").alias("cell"), "digest", "class", F.lit(0).alias("side"))
    rows, cells, links, left = node.filter(F.col("w") > HEAVY), [light(node)], [], []
    for r in range(ROUNDS):
        if rows.isEmpty():
            break
        found, smaller, same = _parted(rows, fetch, percent, scratch, r)
        links.append(found)
        cells.append(light(smaller))
        cells.append(light(same))
        left.append(same.filter(F.col("w") > HEAVY))
        rows = smaller.filter(F.col("w") > HEAVY)
    if links:
        left.append(rows)
        rest = left[0]
        for x in left[1:]:
            rest = rest.unionByName(x)
        laid, pairs = _blocks(rest)
        laid, pairs = scratch.save(laid, "laid"), scratch.save(pairs, "pairs")
        by_shingle = rest.join(pivots.select("digest", "pivot").distinct(), "digest").select(F.col("region").alias("parent"), F.concat_ws("#", "region", F.hex("pivot")).alias("region"), "digest", "n", "class")
        weights = by_shingle.groupBy("parent", "region").agg(
            F.sum("n").alias("w"), ((F.count("class") == F.count(F.lit(1))) & F.min("class").eqNullSafe(F.max("class"))).alias("uniform")).filter("not uniform")
        weights = scratch.save(weights, "weights")
        cost = pairs.groupBy("region").agg(F.sum("w").alias("c")).join(weights.groupBy(F.col("parent").alias("region")).agg(F.sum("w").alias("s")), "region", "left")
        choice = scratch.save(cost.select("region", F.coalesce(F.col("s") < F.col("c"), F.lit(False)).alias("shingles")), "choice")
        cells.append(_paired(laid, pairs.join(choice.filter("not shingles").select("region"), "region")))
        chosen = weights.join(choice.filter("shingles").select(F.col("region").alias("parent")), "parent").select("region", "w")
        parts = by_shingle.drop("parent").join(chosen, "region")
        cells.append(light(parts))
        cells.append(_paired(*_blocks(parts.filter(F.col("w") > HEAVY).drop("w"))))
    out, found = cells[0], links[0] if links else None
    for c in cells[1:]:
        out = out.unionByName(c)
    for x in links[1:]:
        found = found.unionByName(x)
    return out, found


def linked_documents(docs: DataFrame, value: Column, size: int, percent: int) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, key (a hash of the text), n_shingles and least, the smallest ``value`` (over the others) that links lead to; null of empty sets."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    classes = np.uint64(max(1, min(4, 60 // (100 - percent))))  # a class should be well larger than a window
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    sketch = scratch.save(texts.mapInPandas(
        _sketches(size, percent, classes),
        "page bigint, doc_ids array<string>, keys array<bigint>, sizes array<bigint>, digests array<binary>, counts binary, first binary, rests binary, rest binary"), "sketch")
    shingles = sketch.agg(F.coalesce(F.sum(F.octet_length("first") / 8), F.lit(0))).first()[0]
    parts = max(24, int(shingles // 400_000))
    dealt = sketch.select("page", "first").mapInPandas(_deal(parts), "bucket bigint, page bigint, hashes binary, counts binary")
    often = dealt.repartition(parts, "bucket").groupBy("bucket").applyInPandas(_frequencies, "page bigint, bucket bigint, dfs binary")
    pivots = sketch.drop("doc_ids", "keys").groupBy("page").cogroup(often.groupBy("page")).applyInPandas(_windows(percent, parts), "pivot bigint, digest binary, n bigint")
    # regions and their cells only gather sets: 64 bits of a digest name it, and a set that several tasks have seen is there several times
    pivots = scratch.save(pivots.withColumn("h", F.xxhash64("digest")), "pivots")
    regions = pivots.groupBy("pivot").agg(F.min("h").alias("centre"), F.max("h").alias("last")).filter("centre != last")
    pivots = scratch.save(pivots.join(regions.select("pivot", "centre"), "pivot"), "regions")
    roots = components(pivots.select(F.col("h").alias("a"), F.col("centre").alias("b")), scratch, "cells")

    members = sketch.select(F.explode(F.arrays_zip("doc_ids", "keys", "sizes", "digests")).alias("m")).select(
        F.col("m.doc_ids").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("m.keys").alias("key"), F.col("m.sizes").alias("n_shingles"), F.col("m.digests").alias("digest"))
    least = members.groupBy("digest").agg(F.min("key").alias("key")).join(pivots.select("digest").distinct(), "digest")
    kept = scratch.save(texts.select("key", "text").join(least, "key").dropDuplicates(["digest"]).select("digest", "text"), "texts")  # the texts travel once

    def fetch(digests: DataFrame | None = None) -> DataFrame:
        """(digest, shingles), from one text of each digest."""
        return (kept if digests is None else kept.join(digests, "digest", "left_semi")).mapInPandas(_sets(size), "digest binary, shingles binary")

    cells, more = _cells(pivots.select("pivot", "digest", "n", "h"), roots, fetch, percent, scratch)
    links = cells.join(fetch(), "digest").groupBy("cell").applyInPandas(_joined(percent), "a binary, b binary")
    links = scratch.save(links.unionByName(more) if more is not None else links, "links")
    linked = components(links, scratch, "links").withColumnRenamed("node", "digest")
    whole = members.filter("n_shingles > 0").groupBy("digest").agg(F.min(value).alias("own")).join(linked, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    smallest = whole.groupBy("root").agg(F.min("own").alias("least"))
    named = scratch.save(whole.join(smallest, "root").select("digest", "least"), "named")
    scratch.drop("pivots", "regions", "nodes", "texts", "links")
    return members.join(named, "digest", "left").select("doc_id", "key", "n_shingles", "least")


def components_of(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_shingles and component_id, the smallest doc_id that links lead to."""
    found = linked_documents(docs, F.col("doc_id"), size, percent)
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key): the documents, told apart by id and text, that aren't the one of their component that stays.

    That of the smallest id stays (null ids last), of equal ids that of the smallest hash of its text.
    """
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("key").alias("k"))
    found = linked_documents(docs, place, size, percent).filter("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("least.d")) & (F.col("key") == F.col("least.k"))
    return found.filter(~stays).select("doc_id", "key").distinct()


#: All pairs that share a shingle, and reachability along the links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(o, t) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.o, e.y FROM r JOIN e ON e.x = r.t)
SELECT o AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(t) AS component_id FROM r LEFT JOIN n ON n.doc_id = o GROUP BY o
"""
