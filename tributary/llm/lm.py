"""Language-model scores by a weighted backoff automaton.

Tokens are a text's words (A-Z lowered) and one end.  Unigrams are smoothed by
adding 0.1 over all words seen in training and one more for the unseen; this
is the base score.  Two- and three-word sequences of any words, the marks of
beginning and end included, that occur LEAST times get discounted shares:
P(w | h) = (c(hw) - D) / c(h) for kept sequences and b(h) P(w | shorter h) for
all others, where b(h) spreads the mass that the kept sequences of h leave over
the words that have none.  All probabilities of a context add up to 1.

The automaton has a state for the empty context, each word and each kept pair.
An arc reads a word, adds its log-probability and leads to the longest context
that the words read so far end in; a failure arc adds log b(h), reads nothing
and leads to the context that is one word shorter.  One traversal of a text
from left to right carries the state and adds up the arcs (``walk``).

No part of the model has a fixed size, and none is collected or broadcast.
Texts are cut into pages of about PAGE tokens, each with a list of its own
words.  A page counts what it holds, asks the whole corpus for the totals, and
so gets just the part of the automaton that its own texts meet, in four rounds:

1. words: their counts;
2. pairs of words that are kept: their counts;
3. triples of which both pairs are kept: their counts; and for each word what
   its kept pairs add up to, which gives the weight of its failure arc;
4. for each kept pair what its kept triples add up to.

In a round a page sends, for each of its distinct keys (64-bit hashes), its
own count, to the bucket of that range of keys; the bucket adds up and answers
each page in the order that it asked in.  Of the pages that hold a sequence
one is told that it owns it and reports it to its context once.  All sums are
of integers, so that scores don't depend on an order.  Pages and answers are
written tables; a page and a bucket are of bounded size, a frequent key is one
entry a page, and the number of pages and buckets grows with the corpus.

Defined cases: a null text is the empty text: its one token is the end; with
no training text all scores are those of an empty model (0); a null or repeated
doc_id is a row of its own; repeated rows are scored alike; a very long text is
one page; an empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.shingles import mix, word_hashes
from tributary.plans.scratch import Scratch

ADDED, DISCOUNT = 0.1, 0.75
#: Sequences seen less often aren't kept.
LEAST = 2
#: Tokens of a page, and tokens of the corpus for each bucket of keys.
PAGE, BUCKET = 1 << 20, 1 << 21
#: The end is the first word of every page.
END = 0
#: No word holds a space.
END_HASH, BEGIN_HASH = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
PAGES = "page bigint, tokens bigint, doc_ids array<string>, fit binary, sizes binary, hashes binary, ids binary"
ASKED = "bucket int, page bigint, kind string, keys binary, vals binary"
ANSWERED = "page bigint, kind string, bucket int, vals binary, tokens bigint, words bigint"
SCORED = "doc_id string, n_tokens bigint, n_known bigint, base_score double, score double"


def tokens(text: str | None) -> list[bytes]:
    """bytes.lower() lowers A-Z only, bytes.split() parts at the six ASCII white-space characters."""
    return (text or "").encode("utf-8").lower().split()


def pack(x: np.ndarray) -> bytes:
    """Integers as bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T)
    return x.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if x.size else b""


def unpack(blob: bytes, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(memoryview(blob)[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    with np.errstate(over="ignore"):
        return mix(mix(a) + b)


class _Local(dict):
    """Numbers for the words of a page, in order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _paged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    page = TaskContext.get().partitionId() << 32
    local, docs, fit, sizes, ids, held = _Local(), [], [], [], [], 0

    def out():
        hashes = np.concatenate([[END_HASH], word_hashes(b" ".join(local))])
        return pd.DataFrame({
            "page": [page], "tokens": [held], "doc_ids": [list(docs)], "fit": [np.array(fit, np.uint8).tobytes()], "sizes": [np.array(sizes, np.int64).tobytes()],
            "hashes": [pack(hashes)], "ids": [pack(np.concatenate(ids))]})

    end = np.array([END], np.uint32)
    for f in frames:
        for d, t, own in zip(f["doc_id"], f["text"], f["fit"]):
            words = tokens(t)
            docs.append(d)
            fit.append(bool(own))
            sizes.append(len(words) + 1)
            ids += [np.fromiter(map(local.__getitem__, words), np.uint32, len(words)), end]
            held += len(words) + 1
            if held >= PAGE:
                yield out()
                page += 1
                local, docs, fit, sizes, ids, held = _Local(), [], [], [], [], 0
    if docs:
        yield out()


def _sums(at: np.ndarray, n: int, *values: np.ndarray | None) -> np.ndarray:
    """For each of n places the sums of the values (None: their number) there; exact up to 2^53."""
    return np.stack([np.bincount(at, v, n).astype(np.uint64) for v in values])


class Page:
    """The tokens of a page, and of the automaton what the answers so far tell of it."""

    def __init__(self, row, answers: pd.DataFrame | None = None, mass: float = 0.0):
        self.page, self.docs, self.mass = row.page, row.doc_ids, mass
        fit, self.sizes = np.frombuffer(row.fit, np.uint8), np.frombuffer(row.sizes, np.int64)
        self.hashes, self.word = unpack(row.hashes, np.uint64), unpack(row.ids, np.uint32).astype(np.int64)
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.fit = np.repeat(fit, self.sizes) > 0
        self.n = len(self.hashes)
        self.got: dict[str, np.ndarray] = {}
        if answers is not None:
            for kind, g in answers.sort_values("bucket").groupby("kind"):
                width = WIDTH[kind]
                self.got[kind] = np.concatenate([unpack(v, np.uint64).reshape(width, -1) for v in g["vals"]], axis=1)

    def answer(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """The answers of a round in the order of ``keys``, which is that of the question."""
        out = np.zeros((WIDTH[kind], len(keys)), np.uint64)
        if len(keys):
            out[:, np.argsort(keys, kind="stable")] = self.got[kind]
        return out.astype(np.int64)

    def words(self) -> None:
        """count: of each word, and at last of the beginning as a context."""
        self.count = self.answer("w", self.hashes)[0]
        self.count = np.append(self.count, self.count[END])

    def asked_words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes, _sums(self.word[self.fit], self.n, None)

    def candidates(self) -> None:
        """Distinct pairs whose words are seen LEAST times; pair_at: the one that ends at each token, or -1."""
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.edges[:-1]] = self.n  # the beginning
        good = np.flatnonzero((self.count[before] >= LEAST) & (self.count[self.word] >= LEAST))
        found, which = np.unique(before[good] * (self.n + 1) + self.word[good], return_inverse=True)
        self.pair_at = np.full(len(self.word), -1)
        self.pair_at[good] = which
        self.first, self.second = found // (self.n + 1), found % (self.n + 1)
        self.key = joined(np.append(self.hashes, BEGIN_HASH)[self.first], self.hashes[self.second])

    def asked_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.key, _sums(self.pair_at[self.fit & (self.pair_at >= 0)], len(self.key), None)

    def pairs(self) -> None:
        """Only the kept pairs, their counts and which of them this page owns."""
        got = self.answer("p", self.key)[0]
        kept = got > 0
        number = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)
        self.pair_at = number[self.pair_at]
        self.first, self.second, self.key = self.first[kept], self.second[kept], self.key[kept]
        self.pair, self.own_pair = got[kept] >> 1, (got[kept] & 1) > 0

    def triple_candidates(self) -> None:
        n = max(1, len(self.key))
        both = np.zeros(len(self.word), bool)
        both[1:] = (self.pair_at[1:] >= 0) & (self.pair_at[:-1] >= 0)
        both[self.edges[:-1]] = False
        at = np.flatnonzero(both)
        found, which = np.unique(self.pair_at[at - 1] * n + self.pair_at[at], return_inverse=True)
        self.triple_at = np.full(len(self.word), -1)
        self.triple_at[at] = which
        self.left, self.right = found // n, found % n
        self.triple_key = joined(self.key[self.left], self.key[self.right])

    def asked_triples(self) -> tuple[np.ndarray, np.ndarray]:
        return self.triple_key, _sums(self.triple_at[self.fit & (self.triple_at >= 0)], len(self.triple_key), None)

    def triples(self) -> None:
        got = self.answer("t", self.triple_key)[0]
        kept = got > 0
        self.triple_at = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)[self.triple_at]
        self.left, self.right = self.left[kept], self.right[kept]
        self.triple, self.own_triple = got[kept] >> 1, (got[kept] & 1) > 0

    def word_contexts(self) -> np.ndarray:
        return np.flatnonzero(self.count >= LEAST)

    def asked_word_contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word's own kept pairs: their counts, their number, and the counts of their second words."""
        own, at = self.own_pair, self.word_contexts()
        sums = _sums(self.first[own], self.n + 1, self.pair[own], None, self.count[self.second[own]])
        return np.append(self.hashes, BEGIN_HASH)[at], sums[:, at]

    def pair_contexts(self) -> np.ndarray:
        return np.flatnonzero(self.second != END)

    def asked_pair_contexts(self) -> tuple[np.ndarray, np.ndarray]:
        own, at = self.own_triple, self.pair_contexts()
        sums = _sums(self.left[own], len(self.key), self.triple[own], None, self.pair[self.right[own]])
        return self.key[at], sums[:, at]

    def automaton(self) -> None:
        """Arcs by level, and the weights of the failure arcs."""
        one = (self.count + ADDED) / self.mass
        self.arc1 = np.log10(one)
        self.arc2 = np.log10((self.pair - DISCOUNT) / self.count[self.first])
        self.arc3 = np.log10((self.triple - DISCOUNT) / self.pair[self.left])
        self.fail1, self.fail2 = np.zeros(self.n + 1), np.zeros(len(self.key))
        at = self.word_contexts()
        c, (sum_, kinds, after) = self.count[at], self.answer("b", np.append(self.hashes, BEGIN_HASH)[at])
        self.fail1[at] = np.log10((c - sum_ + DISCOUNT * kinds) / c / ((self.mass - after - ADDED * kinds) / self.mass))
        at = self.pair_contexts()
        c, c1, (sum_, kinds, after) = self.pair[at], self.count[self.second[at]], self.answer("c", self.key[at])
        self.fail2[at] = np.log10((c - sum_ + DISCOUNT * kinds) / c / ((c1 - after + DISCOUNT * kinds) / c1))

    def scored(self) -> pd.DataFrame:
        base = self.arc1[self.word]
        nan = lambda arcs, at: np.where(at >= 0, np.append(arcs, np.nan)[at], np.nan)
        two, three = nan(self.arc2, self.pair_at), nan(self.arc3, self.triple_at)
        weight1, weight2 = self.fail1[self.word], np.where(self.pair_at >= 0, np.append(self.fail2, 0.0)[self.pair_at], 0.0)
        begin = float(self.fail1[self.n])
        found = [walk(begin, *(x[a:b].tolist() for x in (base, two, three, weight1, weight2))) for a, b in pairwise(self.edges)]
        starts = self.edges[:-1]
        return pd.DataFrame({
            "doc_id": pd.Series(list(self.docs), dtype=object), "n_tokens": self.sizes,
            "n_known": np.add.reduceat((self.count[self.word] > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(base, starts), "score": np.array(found, np.float64)})


def walk(begin: float, one: list[float], two: list[float], three: list[float], weight1: list[float], weight2: list[float]) -> float:
    """The sum over a text's path.  By token: its arcs from the root, from a word and from a pair (nan: there is none),
    and the weights of the failure arcs that leave the states of one and of two words that the token ends."""
    total, depth, fail1, fail2 = 0.0, 1, begin, 0.0
    for p1, p2, p3, w1, w2 in zip(one, two, three, weight1, weight2):
        if depth == 2 and p3 != p3:
            total += fail2
            depth = 1
        if depth == 2:
            total += p3
        elif p2 == p2:
            total += p2
            depth = 2
        else:
            total += fail1 + p1  # down to the root
            depth = 1
        fail1, fail2 = w1, w2
    return total


#: Numbers of an answer: totals of words, kept pairs and triples; sums of the kept continuations of words and pairs.
WIDTH = {"w": 1, "p": 1, "t": 1, "b": 3, "c": 3}


def _asked(page: Page, kind: str, keys: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    """The page's keys in order, a row for each range of them."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[:, order]
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]])
    return [(int(bucket[a]), page.page, kind, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(values[:, a:b])) for a, b in pairwise(cuts) if b > a]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _first(buckets: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                p = Page(row)
                yield _frame(_asked(p, "w", *p.asked_words(), buckets), ASKED)

    return run


def _step(n: int, buckets: int, mass: float = 0.0) -> Callable:
    """What a page asks in round n, or its scores in round 5, given all answers before."""

    def run(pages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pages.itertuples():
            p = Page(row, answers, mass)
            p.words()
            p.candidates()
            if n == 2:
                out += _asked(p, "p", *p.asked_pairs(), buckets)
                continue
            p.pairs()
            p.triple_candidates()
            if n == 3:
                out += _asked(p, "b", *p.asked_word_contexts(), buckets) + _asked(p, "t", *p.asked_triples(), buckets)
                continue
            p.triples()
            if n == 4:
                out += _asked(p, "c", *p.asked_pair_contexts(), buckets)
                continue
            p.automaton()
            out.append(p.scored())
        return pd.concat(out) if n == 5 else _frame(out, ASKED)

    return run


def _answered(f: pd.DataFrame) -> pd.DataFrame:
    """Sums over all pages of a range of keys, to each page that asked."""
    rows = []
    for kind, g in f.sort_values("page").groupby("kind"):
        keys = [np.cumsum(unpack(b, np.uint64), dtype=np.uint64) for b in g["keys"]]
        values = np.concatenate([unpack(v, np.uint64).reshape(WIDTH[kind], -1) for v in g["vals"]], axis=1)
        _, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        totals = _sums(which, len(first), *values)
        seen = (int(totals[0].sum()), int((totals[0] > 0).sum())) if kind == "w" else (0, 0)
        if kind in "pt":
            totals = np.where(totals >= LEAST, 2 * totals, 0).astype(np.uint64)
        answer = totals[:, which]
        if kind in "pt":
            answer[0, first] += answer[0, first] > 0  # the owner's
        at = 0
        for page, k in zip(g["page"], keys):
            rows.append((page, kind, g["bucket"].iloc[0], pack(answer[:, at : at + len(k)]), *seen))
            at, seen = at + len(k), (0, 0)
    return _frame(rows, ANSWERED)


def scores(docs: DataFrame, training: Column) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_tokens, n_known, train_tokens, base_score and score."""
    scratch = Scratch(docs.sparkSession, "lm")
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("fit"))
    pages = scratch.save(texts.mapInPandas(_paged, PAGES), "pages")
    buckets = max(16, -(-pages.select(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] // BUCKET))

    def answers(asked: DataFrame, name: str) -> DataFrame:
        return scratch.save(asked.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_answered, ANSWERED), name)

    def step(n: int, known: list[DataFrame], schema: str = ASKED, mass: float = 0.0) -> DataFrame:
        told = known[0]
        for k in known[1:]:
            told = told.unionByName(k)
        return pages.groupBy("page").cogroup(told.groupBy("page")).applyInPandas(_step(n, buckets, mass), schema)

    known = [answers(pages.mapInPandas(_first(buckets), ASKED), "words")]
    total, distinct = known[0].select(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    for n in (2, 3, 4):
        known.append(answers(step(n, known), f"round{n}"))
    found = step(5, known, SCORED, total + ADDED * (distinct + 1))
    return found.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
