"""Networks of users and their statistics.

Edges are rows (src, dst).  Reply graphs keep parallel edges and loops where a
statistic counts them (edges, degrees, assortativity, modularity) and use the
simple graph for clustering, paths and components.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans.components import components
from tributary.plans.scratch import Scratch

#: Nodes that share one thing are paired from a list up to this many; beyond, each block of as many meets all others.
SHARERS = 1_000
#: Edges that a task of triangles holds, about.
HELD = 3_000_000
#: Origins of a task's searches, and edges of a component that a task searches as a whole.
ORIGINS, SEARCHED = 1024, 8_000_000
#: Edges in a packed row, bytes of the bits that a step of a task compares, and pairs that a step lists.
PACKED, STEP, LISTED = 500_000, 1 << 25, 1 << 22


def reply_edges(log: DataFrame) -> DataFrame:
    """``log`` (node, parent, root, user): user to the parent's user, else to the root's user for nodes that aren't roots; others drop out."""
    by = log.select("node", F.col("user").alias("named")).dropDuplicates(["node"])
    one = log.join(by.select(F.col("node").alias("parent"), F.col("named").alias("p")), "parent", "left")
    two = one.join(by.select(F.col("node").alias("root"), F.col("named").alias("r")), "root", "left")
    to = F.coalesce("p", F.when(F.col("node") != F.col("root"), F.col("r")))
    return two.select(F.col("user").alias("src"), to.alias("dst")).filter("src is not null and dst is not null")


def projection_edges(pairs: DataFrame) -> DataFrame:
    """``pairs`` (node, shared): simple edges between nodes that share something, src < dst.

    Things are dealt out by range, so that those of close names, which often have the same nodes, list a pair once before it travels.
    Pairs travel packed, to parts of bounded size, which list each of theirs once.
    """
    own = pairs.select("node", "shared").filter("node is not null and shared is not null")
    sizes = own.groupBy("shared").agg(F.count(F.lit(1)).alias("n"))
    n = F.least("n", F.lit(SHARERS)).cast("double")
    bound, most = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= SHARERS, n * (n - 1) / 2)), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot, many = sizes.filter(F.col("n") > SHARERS), most > SHARERS
    dealt = (own.join(hot, "shared", "left_anti") if many else own).repartitionByRange("shared").sortWithinPartitions("shared", "node")
    kind = own.schema["node"].dataType.simpleString()
    cuts = _cuts(own.select("node").distinct(), math.ceil(bound / (2 * LISTED)))
    packed = dealt.select("shared", "node").mapInPandas(lambda rows: _dealt(_listed(rows), cuts), "at int, data binary")
    found = packed.repartition(len(cuts) + 1, "at").groupBy("at").applyInPandas(_once, f"src {kind}, dst {kind}")
    if not many:
        return found
    rows = own.distinct().join(hot.withColumn("blocks", F.ceil(F.col("n") / SHARERS).cast("int")), "shared")
    left = rows.select(F.col("node").alias("src"), "shared", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    right = rows.select(F.col("node").alias("dst"), "shared", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return found.unionByName(left.join(right, ["shared", "block"]).filter("src < dst").select("src", "dst")).distinct()


def _listed(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Pairs of the nodes of each thing, each once in about ``LISTED`` pairs; ``rows`` (shared, node) in order, none of a thing elsewhere."""
    held, n = [], 0
    for pdf in rows:
        held.append(pdf)
        n += len(pdf)
        if n * SHARERS >= 16 * LISTED:
            own = pd.concat(held, ignore_index=True)
            cut = int(np.flatnonzero((own["shared"] == own["shared"].iloc[-1]).to_numpy())[0])  # the last thing may go on
            yield from _pairs_of(own[:cut])
            held, n = [own[cut:]], len(own) - cut
    if n:
        yield from _pairs_of(pd.concat(held, ignore_index=True))


def _pairs_of(own: pd.DataFrame) -> Iterator[tuple]:
    """(names, src, dst), the pairs as numbers of names, in order and each once."""
    own = own.drop_duplicates()
    if own.empty:
        return
    thing, (code, names) = pd.factorize(own["shared"])[0], pd.factorize(own["node"], sort=True)
    names = names.to_numpy()
    after = np.searchsorted(thing, thing, "right") - np.arange(len(own)) - 1  # nodes of the thing that follow
    bound = np.concatenate([[0], np.cumsum(after)])
    k = 0
    while k < len(own):
        m = max(k + 1, int(np.searchsorted(bound, bound[k] + LISTED, "right")) - 1)
        src = np.repeat(np.arange(k, m), after[k:m])
        dst = src + 1 + np.arange(len(src)) - np.repeat(bound[k:m] - bound[k], after[k:m])
        both = _sorted_once(code[src] * len(names) + code[dst])
        yield names, both // len(names), both % len(names)
        k = m


def _sorted_once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _cuts(nodes: DataFrame, parts: int) -> list:
    """The least ``node`` of all but the first of about ``parts`` ranges of near equal numbers of nodes, in order."""
    if parts < 2:
        return []
    low = nodes.repartitionByRange(parts, "node").groupBy(F.spark_partition_id().alias("p")).agg(F.min("node").alias("low")).collect()
    low = sorted(r["low"] for r in low)[1:]
    return low[:: max(1, math.ceil(len(low) / parts))]


def _dealt(found: Iterator[tuple], cuts: list) -> Iterator[pd.DataFrame]:
    """Pairs packed by part, which is the range that src falls into."""
    for names, src, dst in found:
        at = np.searchsorted(np.array(cuts, names.dtype), names, "right")[src] if cuts else np.zeros(len(src), int)  # in order, as src is
        ends = np.flatnonzero(np.concatenate([[len(at) > 0], at[1:] != at[:-1], [len(at) > 0]]))
        yield pd.DataFrame([(int(at[k]), _packed(names, src[k:m], names, dst[k:m])) for k, m in zip(ends[:-1], ends[1:])], columns=["at", "data"]).astype({"at": np.int32})


def _once(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a part, in order and each once."""
    held = [_unpacked(x) for x in pdf["data"]]
    names = pd.Index(np.unique(np.concatenate([x for a, _, b, _ in held for x in (a, b)])))
    both = _sorted_once(np.concatenate([names.get_indexer(a)[u].astype(np.int64) * len(names) + names.get_indexer(b)[v] for a, u, b, v in held]))
    return pd.DataFrame({"src": names.to_numpy()[both // len(names)], "dst": names.to_numpy()[both % len(names)]})


def _packed(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> bytes:
    """Pairs (a[u], b[v]), in order: the names that occur, and the steps from pair to pair, byte by byte, compressed."""

    def lean(names: np.ndarray, code: np.ndarray):
        there = np.zeros(len(names), bool)
        there[code] = True
        return pa.array([names[there]]), (np.cumsum(there) - 1)[code]

    (x, u), (y, v) = lean(a, u), lean(b, v)
    steps = [pa.array([np.ascontiguousarray(np.diff(c, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()]) for c in (u, v)]
    batch = pa.RecordBatch.from_arrays([x, steps[0], y, steps[1]], ["a", "u", "b", "v"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = pa.ipc.open_stream(data).read_all()
    names = lambda c: t.column(c).chunk(0).values.to_numpy(zero_copy_only=False)
    code = lambda c: np.cumsum(np.ascontiguousarray(np.frombuffer(t.column(c)[0].as_py(), np.uint8).reshape(4, -1).T).view("<i4").ravel())
    return names("a"), code("u"), names("b"), code("v")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def simple(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src != dst").distinct()


def degrees(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(node, degree), a loop counting twice; nodes of ``isolated`` (node) without edges have 0."""
    found = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    if isolated is None:
        return found
    return isolated.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def number_of_nodes(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    return degrees(edges, isolated).agg(F.count(F.lit(1)).alias("value"))


def number_of_edges(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("value"))


def degree_summary(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """density 2m / (n (n - 1)), mean degree 2m / n and largest degree."""
    d = degrees(edges, isolated).agg(F.sum("degree").cast("double").alias("m2"), F.count(F.lit(1)).cast("double").alias("n"), F.max("degree").alias("max_degree"))
    return d.select((F.col("m2") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0.0))).alias("density"), (F.col("m2") / F.nullif("n", F.lit(0.0))).alias("mean_degree"), "max_degree")


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at both ends over all edges in both directions; what concerns one end follows from the degrees alone."""
    scratch = Scratch(edges.sparkSession, "assortativity")
    edges = scratch.save(edges.select("src", "dst"), "edges")
    d = scratch.save(degrees(edges), "degrees")
    x = F.col("degree").cast("double")
    one = d.agg(F.sum(x).alias("n"), F.sum(x * x).alias("sx"), F.sum(x * x * x).alias("sxx"))
    near = edges.join(d.select(F.col("node").alias("dst"), x.alias("y")), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("y").alias("near"))
    two = near.join(d, "node").agg(F.sum(2.0 * F.col("near") * x).alias("sxy"))
    mean = F.col("sx") / F.col("n")
    return one.join(two).select(((F.col("sxy") / F.col("n") - mean * mean) / F.nullif(F.col("sxx") / F.col("n") - mean * mean, F.lit(0.0))).alias("value"))


def number_of_components(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """Nodes less the nodes that aren't the smallest of their component."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    inner = components(e, Scratch(edges.sparkSession, "net")).agg(F.count(F.lit(1)).alias("k"))
    return number_of_nodes(edges, isolated).join(inner).select((F.col("value") - F.col("k")).alias("value"))


def clustering(edges: DataFrame, isolated: DataFrame | None = None, listed: bool = False) -> DataFrame:
    """Mean local clustering over all nodes; below degree 2 it is 0.  ``listed``: the edges are simple ones, each once."""
    scratch = Scratch(edges.sparkSession, "clustering")
    edges = scratch.save(edges, "edges")
    e = edges if listed else scratch.save(simple(edges), "simple")
    d = degrees(e)
    nodes = (d.select("node") if listed and isolated is None else degrees(edges, isolated).select("node")).join(d, "node", "left").join(triangles(e), "node", "left")
    k = F.col("degree").cast("double")
    return nodes.agg(F.avg(F.when(k >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).otherwise(0.0)).alias("value"))


def triangles(e: DataFrame, held: int | None = None) -> DataFrame:
    """(node, t): triangles of every node that has one, of simple edges.

    Nodes fall into blocks, and each three blocks meet in a task that holds the edges between them, about ``held``; a triangle
    belongs to the blocks of its corners, and so to one task.  Blocks are ranges, of which only those meet that have edges between
    them, unless some three have too many; then they go by hash.  Edges travel packed, once for each block.
    """
    held = held or HELD
    blocks = max(1, math.ceil(math.sqrt(6 * e.count() / held) - 1e-9))
    cuts = _cuts(degrees(e).select("node"), blocks)
    block = lambda c: sum((F.when(F.col(c) >= F.lit(x), 1).otherwise(0) for x in cuts), F.lit(0)).cast("int")
    pair = lambda: (F.least(block("src"), block("dst")).alias("i"), F.greatest(block("src"), block("dst")).alias("j"))
    sizes = {(r["i"], r["j"]): r["n"] for r in e.groupBy(*pair()).agg(F.count(F.lit(1)).alias("n")).collect()} if cuts else {(0, 0): 0}
    third = {(i, j): [k for k in range(blocks + 1) if (min(i, k), max(i, k)) in sizes and (min(j, k), max(j, k)) in sizes] for i, j in sizes}
    loads = Counter()
    for at, k, n in {(tuple(sorted((i, j, k))), (i, j), n) for (i, j), n in sizes.items() for k in third[i, j]}:
        loads[at] += n
    if max(loads.values(), default=0) > 2 * held:
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        third = {(i, j): list(range(blocks)) for i in range(blocks) for j in range(i, blocks)}
    tasks = len({tuple(sorted((*ij, k))) for ij, ks in third.items() for k in ks})
    up = block("src") <= block("dst")
    ends = e.select(F.when(up, F.struct("src", "dst")).otherwise(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))).alias("e")).select("e.src", "e.dst")
    packed = ends.select(block("src").alias("i"), block("dst").alias("j"), "src", "dst").mapInPandas(lambda rows: _sides(rows, third), "i int, j int, third array<int>, data binary")
    meet = packed.withColumn("k", F.explode("third")).withColumn("at", F.sort_array(F.array("i", "j", "k")))
    kind = e.schema["src"].dataType.simpleString()
    found = meet.select("at", "i", "j", "data").repartition(tasks, "at").groupBy("at").applyInPandas(_corners, f"node {kind}, t bigint")
    return found.groupBy("node").agg(F.expr("sum(t) div 2").alias("t")).filter("t > 0")


def _sides(rows: Iterator[pd.DataFrame], third: dict) -> Iterator[pd.DataFrame]:
    """Edges (i, j, src, dst) packed by their ends' blocks, with the blocks that those meet."""
    held, n = [], 0

    def out() -> pd.DataFrame:
        own = pd.concat(held)
        (u, a), (v, b) = (pd.factorize(own[c], sort=True) for c in ("src", "dst"))
        a, b = a.to_numpy(), b.to_numpy()
        at = own["i"].to_numpy(np.int64) << 32 | own["j"].to_numpy(np.int64)
        order = np.lexsort((u * len(b) + v, at))
        u, v, at = u[order], v[order], at[order]
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        sides = [(int(at[k] >> 32), int(at[k] & 0xFFFFFFFF), k, m) for k, m in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame([(i, j, third[i, j], _packed(a, u[k:m], b, v[k:m])) for i, j, k, m in sides], columns=["i", "j", "third", "data"])

    for pdf in rows:
        held.append(pdf)
        n += len(pdf)
        if n >= PACKED:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in rows:
        held.append(pdf)
        n += len(pdf)
        if n >= PACKED:
            yield _packs(held)
            held, n = [], 0
    if n:
        yield _packs(held)


def _packs(held: list[pd.DataFrame]) -> pd.DataFrame:
    out = []
    for (i, j), g in pd.concat(held).sort_values(["i", "j", "src", "dst"]).groupby(["i", "j"]):
        t = pa.Table.from_pandas(g.drop(columns=["i", "j"]), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        out.append((i, j, sink.getvalue().to_pybytes()))
    return pd.DataFrame(out, columns=["i", "j", "data"])


def _corners(pdf: pd.DataFrame) -> pd.DataFrame:
    """Twice the triangles of each node with corners in the three blocks ``at``: those on each of its edges, whose third corner is in the block that the edge leaves over."""
    at = [int(x) for x in pdf["at"].iloc[0]]
    sides = {(int(i), int(j)): [_unpacked(x) for x in g["data"]] for (i, j), g in pdf.groupby(["i", "j"])}
    names = {b: pd.Index(np.unique(np.concatenate([x[2 * k] for ij, own in sides.items() for k in (0, 1) if ij[k] == b for x in own]))) for b in set(at) if any(b in ij for ij in sides)}
    ends = {ij: tuple(np.concatenate([names[ij[k]].get_indexer(x[2 * k])[x[2 * k + 1]].astype(np.int32) for x in own]) for k in (0, 1)) for ij, own in sides.items()}
    names = {b: v.to_numpy() for b, v in names.items()}
    del sides
    sums = {b: np.zeros(len(v), np.int64) for b, v in names.items()}
    for (i, j), (u, v) in ends.items():
        left = at.copy()
        left.remove(i)
        left.remove(j)
        r = left[0]
        a, b = _toward(ends, i, r), _toward(ends, j, r)
        if a is None or b is None:
            continue
        n = _common(u, v, a, b, len(names[i]), len(names[j]), len(names[r]))
        sums[i] += np.bincount(u, n, len(names[i])).astype(np.int64)
        sums[j] += np.bincount(v, n, len(names[j])).astype(np.int64)
    node = np.concatenate([names[b] for b in names])
    t = np.concatenate([sums[b] for b in names])
    return pd.DataFrame({"node": node[t > 0], "t": t[t > 0]})


def _toward(ends: dict, p: int, r: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Edges from block p (first) to block r; both ways if the blocks are one."""
    if (min(p, r), max(p, r)) not in ends:
        return None
    u, v = ends[min(p, r), max(p, r)]
    if p == r:
        return np.concatenate([u, v]), np.concatenate([v, u])
    return (u, v) if p < r else (v, u)


def _common(u: np.ndarray, v: np.ndarray, a: tuple, b: tuple, nu: int, nv: int, nr: int) -> np.ndarray:
    """For each edge (u, v) the nodes that both are linked to by ``a`` and ``b``: by bits where rows are dense, else by a search from the shorter list."""
    words = (nr + 63) // 64
    da, db = np.bincount(a[0], minlength=nu), np.bincount(b[0], minlength=nv)
    probes = int(np.minimum(da[u], db[v]).sum())
    if (nu + nv) * words * 8 <= 4 * STEP and words * len(u) <= 50 * probes + 1_000_000:
        x, y = _bits(*a, nu, words), _bits(*b, nv, words)
        out, step = np.empty(len(u), np.int64), max(1, STEP // (words * 8))
        for k in range(0, len(u), step):
            out[k : k + step] = np.bitwise_count(x[u[k : k + step]] & y[v[k : k + step]]).sum(1, dtype=np.int64)
        return out
    out = np.zeros(len(u), np.int64)
    short = da[u] <= db[v]
    for here, (p, q), dp, s, t in ((short, (a, b), da, u, v), (~short, (b, a), db, v, u)):
        order = np.argsort(p[0], kind="stable")
        to, start = p[1][order], np.concatenate([[0], np.cumsum(dp)])
        keys = np.sort(q[0].astype(np.int64) * nr + q[1])
        which = np.flatnonzero(here & (dp[s] > 0))
        size = dp[s[which]]
        bound = np.concatenate([[0], np.cumsum(size)])
        k = 0
        while k < len(which) and len(keys):
            m = max(k + 1, int(np.searchsorted(bound, bound[k] + STEP // 16, "right")) - 1)
            e, n = which[k:m], size[k:m]
            edge = np.repeat(np.arange(len(e)), n)
            third = to[np.repeat(start[s[e]], n) + np.arange(len(edge)) - np.repeat(bound[k:m] - bound[k], n)]
            key = t[e][edge].astype(np.int64) * nr + third
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[e] += np.bincount(edge[keys[spot] == key], minlength=len(e))
            k = m
    return out


def _bits(row: np.ndarray, col: np.ndarray, n: int, words: int) -> np.ndarray:
    """Rows of bits, one for each pair (row, col)."""
    out = np.zeros(n * words * 8, np.uint8)
    np.bitwise_or.at(out, row.astype(np.int64) * words * 8 + (col >> 3), (1 << (col & 7)).astype(np.uint8))
    return out.view(np.uint64).reshape(n, words)


def mean_path(edges: DataFrame, sources: int | None = None, seed: int = 1, held: int | None = None) -> DataFrame:
    """Mean shortest path over reachable pairs, by breadth-first search from all nodes (exact) or from ``sources`` of them (an estimate).

    A component of up to ``held`` edges goes to a task for each block of its nodes, which are the origins of one search by bits;
    larger components, and the estimate, are searched by joins.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    e = scratch.save(simple(edges), "simple")
    if sources:
        pairs, total = _levels(e, scratch, sources, seed)
    else:
        found = components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch, "parts")
        named = scratch.save(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "named")
        own = e.join(named.select(F.col("node").alias("src"), "root"), "src")
        sizes = scratch.save(named.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(own.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "root"), "sizes")
        rows = own.join(sizes, "root")
        limit = held or SEARCHED
        bins = max(1, math.ceil((sizes.filter(F.col("n") <= ORIGINS).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]) / PACKED))
        alone = F.col("n") > ORIGINS
        blocks = F.when(alone, F.ceil(F.col("n") / F.when(F.col("m") <= 1_000_000, ORIGINS).otherwise(4 * ORIGINS))).otherwise(1).cast("int")
        at = F.when(alone, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins)))
        packed = rows.filter(F.col("m") <= limit).select(at.alias("i"), blocks.alias("j"), "root", "src", "dst").mapInPandas(_pack, "i long, j int, data binary")
        tasks = packed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("j") - 1))).groupBy("i", "k").applyInPandas(_searches, "pairs long, total long")
        pairs, total = tasks.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        if not sizes.filter(F.col("m") > limit).isEmpty():
            more = _levels(scratch.save(rows.filter(F.col("m") > limit).select("src", "dst"), "large"), scratch)
            pairs, total = pairs + more[0], total + more[1]
    value = total / pairs if pairs else None
    return edges.sparkSession.range(1).select(F.lit(value).cast("double").alias("value"))


def _searches(pdf: pd.DataFrame) -> pd.DataFrame:
    """Reached pairs and the sum of their distances, from the ``k``-th of ``j`` blocks of the nodes of each component."""
    k, pairs, total = int(pdf["k"].iloc[0]), 0, 0
    for j, g in pdf.groupby("j"):
        edges = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in g["data"]]).to_pandas()
        for _, own in edges.groupby("root"):
            ends, names = pd.factorize(pd.concat([own["src"], own["dst"]], ignore_index=True), sort=True)
            n, half = len(names), len(own)
            size = -(-n // int(j))
            to = np.concatenate([ends[half:], ends[:half]])[np.argsort(ends, kind="stable")].astype(np.int32)
            start = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
            width = 64 * max(1, STEP // (8 * n))  # origins of a search, whose bits are held three times
            for low in range(k * size, min(n, (k + 1) * size), width):
                a, b = _search(to, start, np.arange(low, min(low + width, n, (k + 1) * size)))
                pairs, total = pairs + a, total + b
    return pd.DataFrame({"pairs": [pairs], "total": [total]})


def _search(to: np.ndarray, start: np.ndarray, origins: np.ndarray) -> tuple[int, int]:
    """Each node's row has a bit for each origin that has reached it; a level adds the rows of its neighbours."""
    n, m = len(start) - 1, len(origins)
    words = (m + 63) // 64
    at = np.zeros((n, words), np.uint64)
    bit = np.uint64(1) << (np.arange(m) % 64).astype(np.uint64)
    at[origins, np.arange(m) // 64] = bit
    seen, full = at.copy(), np.bitwise_or.reduceat(bit, np.arange(0, m, 64))
    pairs, total, level = 0, 0, 0
    while True:
        level += 1
        todo = np.flatnonzero((seen != full).any(1))
        after, k, found = np.zeros_like(at), 0, 0
        bound = np.concatenate([[0], np.cumsum(start[todo + 1] - start[todo])])
        while k < len(todo):
            e = max(k + 1, int(np.searchsorted(bound, bound[k] + max(1, STEP // (8 * words)), "right")) - 1)
            size, base = bound[k + 1 : e + 1] - bound[k:e], bound[k:e] - bound[k]
            near = to[np.repeat(start[todo[k:e]] - base, size) + np.arange(bound[e] - bound[k])]
            new = np.bitwise_or.reduceat(at[near], base, axis=0) & ~seen[todo[k:e]]
            found += int(np.bitwise_count(new).sum(dtype=np.int64))
            after[todo[k:e]] = new
            k = e
        if not found:
            return pairs, total
        pairs, total = pairs + found, total + found * level
        seen |= after
        at = after


def _levels(edges: DataFrame, scratch: Scratch, sources: int | None = None, seed: int = 1) -> tuple[int, int]:
    """Reached pairs and the sum of their distances, a level of all searches at a time.

    An origin's search ends when it has reached its whole component.  In a graph without directions a new node isn't on the two
    levels before, so that only these are looked at.
    """
    e = scratch.save(both_ways(edges), "edges")
    nodes = e.select("src").distinct()
    if sources:
        nodes = nodes.orderBy(F.xxhash64(F.lit(seed), "src")).limit(sources)
    frontier = scratch.save(nodes.select(F.col("src").alias("origin"), F.col("src").alias("node")), "level0")
    named = both_ways(edges).select(F.col("src").alias("node")).distinct().join(
        components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch, "joined"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("others"))
    open_ = scratch.save(frontier.select("origin").join(named.join(sizes, "root").select(F.col("node").alias("origin"), "others"), "origin"), "open0")
    before, pairs, total, level = None, 0, 0, 0
    while True:
        level += 1
        seen = frontier if before is None else frontier.unionByName(before)
        reach = frontier.join(open_.filter("others > 0").select("origin"), "origin", "left_semi")
        step = reach.join(e.withColumnRenamed("src", "node"), "node").select("origin", F.col("dst").alias("node")).distinct()
        before, frontier = frontier, scratch.save(step.join(seen, ["origin", "node"], "left_anti"), f"level{level}")
        if level > 2:
            scratch.drop(f"level{level - 3}")
        n = frontier.count()
        if not n:
            break
        pairs, total = pairs + n, total + n * level
        found = frontier.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
        open_ = scratch.save(open_.join(found, "origin", "left").select("origin", (F.col("others") - F.coalesce("n", F.lit(0))).alias("others")), f"open{level}")
    return pairs, total


def _settled(links: DataFrame, m2: float, scratch: Scratch, name: str, rounds: int) -> DataFrame:
    """(node, community): rounds of moves over ``links`` (src, dst, w, both ways), until the modularity no longer grows; the best is returned."""
    k = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    now = scratch.save(k.select("node", F.col("node").alias("community"), "k"), f"{name}round0")
    best, best_q, r = now, None, 0
    while r < rounds:
        inner = links.join(now.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(now.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
        inside = inner.filter("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        squares = now.groupBy("community").agg(F.sum("k").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t")), F.lit(0.0))).first()[0]
        q = inside / m2 - squares / m2**2
        if best_q is not None and q <= best_q + 1e-9 and r % 2 == 0:
            break
        if best_q is None or q > best_q:
            best, best_q = now, q
        r += 1
        total = now.groupBy("community").agg(F.sum("k").alias("total"))
        near = links.filter("src != dst").join(now.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("w"))
        own = now.select("node", "community", F.lit(0.0).alias("w"))
        choice = near.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w")).join(total, "community").join(
            now.select("node", F.col("community").alias("own"), "k"), "node")
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - rest * F.col("k") / m2
        top = choice.groupBy("node").agg(F.max_by("community", F.struct(gain.alias("g"), (F.col("community") == F.col("own")).alias("stay"), F.col("community"))).alias("best"))
        moved = now.join(top, "node", "left").select(
            "node", F.when(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0, F.coalesce("best", "community")).otherwise(F.col("community")).alias("community"), "k")
        now = scratch.save(moved, f"{name}round{r}")
    return best.select("node", "community")


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 16) -> DataFrame:
    """(node, community) by the Louvain method as joins and aggregates; no task holds the graph.

    On each level nodes move to the neighbouring community of largest modularity gain, half of them in a round, by hash, until
    the modularity no longer grows; then communities become the nodes of the next level, until none merge.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    links = scratch.save(both_ways(edges).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")), "links0")
    m2 = float(links.agg(F.coalesce(F.sum("w"), F.lit(1.0))).first()[0])
    parts = None
    for level in range(levels):
        found = scratch.save(_settled(links, m2, scratch, f"level{level}", rounds), f"found{level}")
        parts = found if parts is None else scratch.save(
            parts.join(found.select(F.col("node").alias("community"), F.col("community").alias("up")), "community").select("node", F.col("up").alias("community")), f"parts{level}")
        if found.filter("node != community").isEmpty():
            break
        a, b = found.select(F.col("node").alias("src"), F.col("community").alias("a")), found.select(F.col("node").alias("dst"), F.col("community").alias("b"))
        links = scratch.save(links.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), f"links{level + 1}")
    return parts


def modularity(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Newman's Q of a partition (node, community), by default that of ``louvain``."""
    edges = Scratch(edges.sparkSession, "modularity").save(edges, "edges")
    parts = louvain(edges) if parts is None else parts
    d = degrees(edges).join(parts, "node").groupBy("community").agg(F.sum("degree").cast("double").alias("k"))
    inner = edges.join(parts.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    share = inner.agg(F.count(F.when(F.col("a") == F.col("b"), 1)).cast("double").alias("inside"), F.count(F.lit(1)).cast("double").alias("m"))
    squares = d.agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return share.join(squares).select((F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("value"))
