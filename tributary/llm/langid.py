"""Language identification by cross-parsing: the language whose text explains a document in the fewest phrases.

Labelled text of each language becomes a suffix automaton.  A document is
parsed against each: from where a phrase starts, the automaton follows the
characters as long as they occur in the language's text; where they stop, a
phrase ends and the next begins.  The number of phrases per character is an
estimate of the cross entropy; the smallest wins.

The automata are dense tables, whose missing transitions lead on from the
root and count a phrase, so that a step is one look-up.  Texts are cut into
windows of WINDOW characters, where a phrase ends too, and all windows of a
batch take their steps together in numpy.  Whole texts are parsed.

Every letter of the sample has symbols of its own: one for the most frequent
letters, several for the others, so that any script is told apart in tables of
bounded width.

Only the fitting is bounded, and every labelled language is learned: the
automata hold at most SAMPLE symbols a language (of more than LANGS languages
a share each), from at most STRETCH characters of distinct labelled texts of
any length in order of their hash.

Defined cases: a null text or one without a letter gets ``und`` and score 0;
of equal languages the first by name wins; with no labelled text all are
``und``; repeated rows are predicted alike; an empty table gives no rows;
other columns of the input are kept by ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE, TEXTS, LANGS, WINDOW = 24_000, 48, 64, 1024
#: Characters of a labelled text that are learned at most.
STRETCH = SAMPLE // 4
OTHER, SPACE, BREAK, PAD, FIRST_LETTER = 0, 1, 2, 3, 4
#: Letters beyond the frequent ones take several symbols, digits to this base; SPELLED marks them until then.
DIGITS, SPELLED = 16, 255
UNDETERMINED = "und"


def sample(docs: DataFrame, training: Column) -> list[tuple[str, list[str]]]:
    """Distinct labelled texts of each language, the first STRETCH characters of longer ones; two scans, no whole text is shuffled.

    TEXTS a language; of more than LANGS languages fewer of each, one at least.
    """
    fit = docs.filter(training & F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("__h", F.xxhash64("text"))
    least = W.partitionBy("lang", "__part").orderBy("__h")  # in parts first: a language may hold most of the rows
    parts = fit.select("lang", "__h").distinct().withColumn("__part", F.pmod("__h", F.lit(64))).withColumn("__rn", F.row_number().over(least)).filter(F.col("__rn") <= TEXTS)
    chosen = parts.withColumn("__rn", F.row_number().over(W.partitionBy("lang").orderBy("__h"))).filter(F.col("__rn") <= TEXTS)
    of: dict[str, list[int]] = {}
    for r in chosen.select("lang", "__h").orderBy("lang", "__h").collect():
        of.setdefault(r["lang"], []).append(r["__h"])
    most = max(1, min(TEXTS, TEXTS * LANGS // max(1, len(of))))
    picked = [(lang, h) for lang, hashes in of.items() for h in hashes[:most]]
    if not picked:
        return []
    wanted = docs.sparkSession.createDataFrame(picked, "lang string, __h bigint")
    texts = fit.select("lang", "__h", F.substring("text", 1, STRETCH).alias("text")).join(F.broadcast(wanted), ["lang", "__h"]).groupBy("lang", "__h").agg(F.min("text").alias("text"))
    got: dict[str, list[str]] = {}
    for r in texts.orderBy("lang", "__h").collect():
        got.setdefault(r["lang"], []).append(r["text"])
    return sorted(got.items())


class Alphabet:
    """Symbols of all letters of the sample: one each for the ``most`` frequent, digits to the base of DIGITS for the others.

    The first digit of a letter is told from the further ones.
    """

    def __init__(self, texts: list[str], most: int = 60):
        seen: dict[str, int] = {}
        for t in texts:
            for ch in t.lower():
                if ch.isalpha():
                    seen[ch] = seen.get(ch, 0) + 1
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        letters, rare = letters[:most], sorted(ord(c) for c in letters[most:])
        lead = FIRST_LETTER + len(letters)
        n = 1
        while DIGITS**n < len(rare):
            n += 1
        self.size = lead + (DIGITS * min(n, 2) if rare else 0)
        self.code = np.array([OTHER if chr(i).isalpha() else SPACE for i in range(0x110000)], np.uint8)
        for k, ch in enumerate(letters):
            self.code[ord(ch)] = FIRST_LETTER + k
        self.code[rare] = SPELLED
        self.rare = np.array(rare, np.uint32)
        place = DIGITS ** np.arange(n - 1, -1, -1)
        self.digits = (np.arange(len(rare))[:, None] // place % DIGITS + np.where(np.arange(n), lead + DIGITS, lead)).astype(np.uint8)

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text in lower case; anything but letters is a space, and runs of spaces are one."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.code[raw]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
        raw, c = raw[keep], c[keep]
        spelled = c == SPELLED
        if spelled.any():
            n = self.digits.shape[1]
            times = np.where(spelled, n, 1)
            at = (np.cumsum(times) - times)[spelled]
            c = np.repeat(c, times)
            c[at[:, None] + np.arange(n)] = self.digits[np.searchsorted(self.rare, raw[spelled])]
        return c


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, depth = [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(step)
        step.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if depth[q] == depth[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                depth.append(depth[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """All languages' automata in one table of 4 * (next state's row) + phrases ended by the step."""

    def __init__(self, labelled: list[tuple[str, list[str]]]):
        self.langs = [lang for lang, _ in labelled]
        self.alphabet = Alphabet([t for _, texts in labelled for t in texts])
        width = self.alphabet.size
        tables, self.roots, base = [], [], 0
        for _, texts in labelled:
            parts, left = [], max(WINDOW, min(SAMPLE, SAMPLE * LANGS // len(labelled)))
            for t in texts:
                c = self.alphabet.codes(t)[:left]
                parts += [c, np.array([BREAK], np.uint8)]
                left -= len(c)
                if left <= 0:
                    break
            step = suffix_automaton(np.concatenate(parts))
            start = np.zeros(width, np.int64)
            for c, to in step[0].items():
                start[c] = to
            t = np.empty((len(step), width), np.int64)
            # a character that the root knows starts the next phrase; any other is a phrase of its own
            t[:] = np.where(start > 0, 4 * (base + start * width) + 1, 4 * base + 2)
            t[0] = np.where(start > 0, 4 * (base + start * width), 4 * base + 1)
            for s, moves in enumerate(step):
                for c, to in moves.items():
                    t[s, c] = 4 * (base + to * width)
            t[:, PAD] = 4 * (base + np.arange(len(step)) * width)
            for unknown in (OTHER, BREAK):
                t[:, unknown] = 4 * base + 2
                t[0, unknown] = 4 * base + 1
            self.roots.append(base)
            tables.append(t.ravel())
            base += t.size
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text by language."""
        k = len(self.langs)
        owner, cuts = [], []
        for i, c in enumerate(texts):
            for a in range(0, len(c), WINDOW):
                owner.append(i)
                cuts.append(c[a : a + WINDOW])
        out = np.zeros((k, len(texts)), np.int64)
        order = sorted(range(len(cuts)), key=lambda j: len(cuts[j]))
        for a in range(0, len(order), 1024):
            group = order[a : a + 1024]
            longest = len(cuts[group[-1]])
            lanes = np.full((len(group), longest), PAD, np.uint8)
            for row, j in enumerate(group):
                lanes[row, : len(cuts[j])] = cuts[j]
            steps = np.ascontiguousarray(lanes.T).astype(np.int32)
            roots = np.array(self.roots, np.int32)[:, None]
            at = np.repeat(roots, len(group), axis=1)
            got = np.zeros(at.shape, np.int32)
            for c in steps:
                v = self.table[at + c]
                got += v & 3
                at = v >> 2
            got += at != roots
            np.add.at(out, (slice(None), np.array([owner[j] for j in group])), got)
        return out.T


def predict(docs: DataFrame, labelled: list[tuple[str, list[str]]], pred: str = "lang_pred", score: str = "score", cost: str = "cost") -> DataFrame:
    """``docs`` with the language, a score in [0, 1] (the runner-up's share of the phrases of both) and phrases a symbol."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Parser(labelled)) if labelled else None

    @F.pandas_udf("lang string, score double, cost double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = held.value if held else None
        for b in batches:
            known = [i for i, t in enumerate(b) if parser and t and any(map(str.isalpha, t))]
            lang, sure, rate = [UNDETERMINED] * len(b), np.zeros(len(b)), np.full(len(b), np.nan)
            if known:
                codes = [parser.alphabet.codes(b.iloc[i]) for i in known]
                found = parser.phrases(codes)
                for i, c, n in zip(known, found, codes):
                    best = int(np.argmin(c))
                    rest = np.delete(c, best)
                    lang[i], rate[i] = parser.langs[best], c[best] / len(n)
                    sure[i] = rest.min() / (rest.min() + c[best]) if len(rest) else 1.0
            yield pd.DataFrame({"lang": lang, "score": sure, "cost": rate})

    return docs.withColumn("__lid", run(F.col("text"))).withColumns(
        {pred: F.col("__lid.lang"), score: F.col("__lid.score"), cost: F.col("__lid.cost")}).drop("__lid")
