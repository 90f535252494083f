"""Quality scores by a sparse ensemble of rules.

Statistics of a text are Spark columns.  On a bounded sample of labelled rows
small boosted trees are grown over them; each path from a root to a node is a
rule, a conjunction of thresholds.  A logistic model over the rules is fitted
with an L1 penalty, which leaves few of them; those are compiled into one
Spark column expression, so that scoring runs inside the JVM.

Only the fitting is bounded (ROWS labelled rows, by a hash of the id, and
2 ROWS of distinct texts of them); every whole text is scored.

Defined cases: a null text has the statistics of the empty text and is
scored like it; rows without a label don't take part in fitting; a document
with several labels counts once for each; without labels, or with one kind
only, the score is the smoothed share of label 1; repeated rows are scored
alike; an empty table gives no rows; other columns of the input are kept by
``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import WORD

ROWS, TREES, DEPTH, BINS = 20_000, 24, 3, 64
#: Rows that a leaf and a rule hold at least: a 200th of the sample, between these.
LEAF = (2, 25)
RATE, PENALTY, STEPS = 0.3, 0.002, 400
STATISTICS = ("chars", "words", "word_length", "upper", "digits", "symbols", "lines", "distinct", "longest_run", "repeated_lines", "repeated_pairs")


def repeated(items: Column) -> Column:
    """The share of an array's items that are equal to an earlier one; 0 of an empty array."""
    return (F.size(items) - F.size(F.array_distinct(items))) / F.greatest(F.size(items), F.lit(1)).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Name to expression; shares are of characters, but ``distinct`` of words, ``longest_run`` of words like the one before,
    ``repeated_lines`` of lines and ``repeated_pairs`` of pairs of neighbouring words that were there before."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    per = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    parts = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    return {
        "chars": F.log1p(F.length(t).cast("double")),
        "upper": per(r"[A-ZÀ-Þ]"),
        "digits": per("[0-9]"),
        "symbols": per(r"[^\p{L}\p{N}\s.,;:'\x22()-]"),
        "lines": per(r"\n"),
        "repeated_lines": repeated(F.split(t, "\n")),
        "__parts": parts,
    }


def with_statistics(docs: DataFrame, prefix: str = "__q_") -> DataFrame:
    s = statistics(F.col("text"))
    got = docs.withColumns({prefix + k.strip("_"): v for k, v in s.items()})
    parts, n = F.col(prefix + "parts"), F.size(prefix + "parts")
    some = F.greatest(n, F.lit(1)).cast("double")
    after = F.slice(parts, 2, F.greatest(n, F.lit(1)))
    pairs = F.zip_with(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), after, lambda a, b: F.xxhash64(a, b))
    counted = got.withColumns({
        prefix + "words": F.log1p(n.cast("double")),
        prefix + "word_length": F.coalesce(F.length("text"), F.lit(0)) / some,
        prefix + "distinct": F.size(F.array_distinct(parts)) / some,
        prefix + "longest_run": (n - F.size(F.filter(F.zip_with(parts, after, lambda a, b: a.eqNullSafe(b)), lambda same: ~same))) / some,
        prefix + "repeated_pairs": repeated(pairs),
    })
    return counted.drop(prefix + "parts")


@dataclass(frozen=True)
class Rule:
    """(statistic, above, threshold) in conjunction: above is x > threshold, else x <= threshold."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.terms:
            c = x[:, STATISTICS.index(name)]
            out &= (c > at) if above else (c <= at)
        return out

    def column(self, prefix: str) -> Column:
        out = None
        for name, above, at in self.terms:
            c = F.col(prefix + name)
            test = (c > F.lit(at)) if above else (c <= F.lit(at))
            out = test if out is None else out & test
        return out


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule]
    weights: list[float]

    def column(self, prefix: str = "__q_") -> Column:
        z = F.lit(float(self.bias))
        for r, w in zip(self.rules, self.weights):
            z = z + F.when(r.column(prefix), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _leaf(rows: int) -> int:
    return min(max(LEAF[0], rows // 200), LEAF[1])


def _grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One tree by gain of the second-order loss: the rules of all its nodes, and what its leaves add to each row."""
    rules, add = [], np.zeros(len(x))
    leaf = _leaf(len(x))

    def node(rows: np.ndarray, terms: tuple, depth: int) -> None:
        if terms:
            rules.append(Rule(terms))
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None)
        if depth < DEPTH and len(rows) >= 2 * leaf:
            for f in range(x.shape[1]):
                k = len(edges[f])
                if not k:
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, v, k + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < leaf) | (len(rows) - nl < leaf)] = 0
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], (f, j))
        if best[1] is None:
            add[rows] += -RATE * gs / (hs + 1)
            return
        f, j = best[1]
        low = binned[rows, f] <= j
        at = float(edges[f][j])
        node(rows[low], (*terms, (STATISTICS[f], False, at)), depth + 1)
        node(rows[~low], (*terms, (STATISTICS[f], True, at)), depth + 1)

    node(np.arange(len(x)), (), 0)
    return rules, add


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(prior, [], [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    rng = np.random.default_rng(seed)
    z, rules = np.full(len(y), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        part = rng.random(len(y)) < 0.7  # rows left out of a tree have no gradient in it
        grown, add = _grow(x, edges, binned, (p - y) * part, p * (1 - p) * part)
        z += add
        rules += grown
    columns: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for r in rules:
        c = r.holds(x)
        if _leaf(len(y)) <= c.sum() <= len(y) - _leaf(len(y)):
            key = np.packbits(c).tobytes()
            if key not in columns or len(r.terms) < len(columns[key][0].terms):
                columns[key] = (r, c)
    kept = [r for r, _ in columns.values()]
    if not kept:
        return Ensemble(prior, [], [])
    m = np.stack([c for _, c in columns.values()], 1).astype(np.float64)
    scale, means = m.std(0), m.mean(0)
    w, b = lasso((m - means) / scale, y, prior)
    own = w / scale
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(float(b - (own * means).sum()), [kept[i] for i in some], [float(own[i]) for i in some])


def lasso(m: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean logistic loss plus PENALTY times the sum of absolute weights, by accelerated proximal gradient."""
    step = 4 * len(y) / np.linalg.norm(m, 2) ** 2
    w, v, b, t = np.zeros(m.shape[1]), np.zeros(m.shape[1]), bias, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(m @ v + b)))
        new = v - step * (m.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        b -= (p - y).mean() * 4 * 0.5
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return w, b


def _few(df: DataFrame, key: Column, most: int) -> DataFrame:
    """``most`` rows by the least hashes; of more rows only those below a hash that leaves about as many reach the driver's merge."""
    n = df.count()
    if n > most:
        share = min(1.0, (most + 6 * most**0.5) / n)
        df = df.filter(key <= F.lit(int(-(2**63) + share * (2**64 - 1))))
    return df.orderBy(key, *df.columns).limit(most)


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality") -> Ensemble:
    """``training`` is over doc_id; ``docs`` (doc_id, text), ``labels`` (doc_id and ``label``)."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("__y")).filter(training & F.col("__y").isNotNull())
    few = _few(known, F.xxhash64("doc_id"), ROWS)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"))
    distinct = rows.select("doc_id", F.xxhash64("text").alias("__h"), "__y", *["__q_" + s for s in STATISTICS]).dropDuplicates(["doc_id", "__h", "__y"])
    got = _few(distinct, F.xxhash64("doc_id", "__h"), 2 * ROWS).select("__y", *["__q_" + s for s in STATISTICS]).toPandas()
    got = got.sort_values(list(got.columns)).to_numpy(np.float64)
    return fit(got[:, 1:], got[:, 0])


def score(docs: DataFrame, model: Ensemble, name: str = "score") -> DataFrame:
    """``docs`` (text and whatever else) with the score, in [0, 1]."""
    return with_statistics(docs).withColumn(name, model.column()).drop(*["__q_" + s for s in STATISTICS])
