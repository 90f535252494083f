"""SentencePiece (BPE) encoding by backtracking over longest matches, and decoding.

A sequence of pieces is the one that merging would give exactly when every two
neighbours are compatible: merging the text of both gives the same two again.
So the encoder needs no merge queue over the text.  An Aho-Corasick automaton
lists all pieces in the text; from the left, the longest piece that is
compatible with its left neighbour is taken.  Where none is, the last piece is
given up, its start is marked as failed in a bitfield, and the next shorter
piece is tried; a position that failed once is never tried again, which keeps
the work linear.  Compatibility is found by re-merging the two pieces once and
is then remembered.

No piece of the vocabulary holds a space mark after another character, so the
marked words of a text are independent; this is checked when a model is
loaded.  Results of words are remembered up to a bound.

Defined cases: a null text is the empty text, which gets the end id alone;
repeated rows are encoded alike; a very long text is encoded whole, word by
word, and a word of any length by itself; null ids are ids like others; an
empty table gives no rows; other columns of the input are left out by
``digests`` and kept by ``encode`` and ``decode``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Bounds on what a worker remembers: results of words, compatibility of pairs.
WORDS_KEPT, PAIRS_KEPT, LONGEST_KEPT = 150_000, 250_000, 64
SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Encoder:
    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        normal = [i for i in range(size) if not (i in self.byte_of or i in self.silent or i == self.unknown or sp.is_unused(i))]
        #: Merges are made by falling score; of equal scores the one further left.
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.id_of = {self.pieces[i]: i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space mark after another character; words aren't independent")
        self.compatible: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[str, int, str | None]] = {}
        self.older = self.words
        #: Ids from here on stand for their pieces' text.
        self.plain = max([*self.byte_of, *self.silent, self.unknown]) + 1
        self.automaton = ahocorasick.Automaton()
        reached = {p for p in self.score if len(p) == 1 or self.merge(p) == [p]}  # in others no merging ever ends
        for p in reached:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.own = {p: p for p in reached}
        #: The next shorter piece at the same place.
        self.shorter = {p: next((self.own[p[:k]] for k in range(len(p) - 1, 1, -1) if p[:k] in reached), p[0]) for p in reached if len(p) > 1}

    def merge(self, text: str) -> list[str]:
        """The definition: join the best-scored pair of neighbours until none is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: str, right: str) -> bool:
        if len(self.compatible) >= PAIRS_KEPT:
            self.compatible.clear()
        known = self.compatible[left, right] = self.merge(left + right) == [left, right]
        return known

    def split(self, word: str) -> list[str]:
        """The pieces of a marked word that isn't empty; characters that are no piece stand alone."""
        n = len(word)
        longest = list(range(1, n + 1))
        for last, size in self.automaton.iter(word):  # ends rise, so the longest piece of a start comes last
            longest[last - size + 1] = last + 1
        failed = bytearray(n // 8 + 1)
        known, shorter = self.compatible.get, self.shorter
        taken: list[str] = []
        own = self.own.get  # pieces that are remembered share one string
        start, piece = 0, own(word[: longest[0]], word[: longest[0]])
        while True:
            left = taken[-1] if taken else None
            while piece:
                end = start + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = left is None or known((left, piece))
                    if fits or fits is None and self.fit(left, piece):
                        break
                piece = shorter.get(piece)
            if piece:
                taken.append(piece)
                if end == n:
                    return taken
                piece = word[end : longest[end]]
                start, piece = end, own(piece, piece)
            else:
                if not taken:
                    raise ValueError(f"no encoding of {word!r}")
                failed[start >> 3] |= 1 << (start & 7)
                piece = taken.pop()  # it is refused by its failed end and gives way to a shorter one
                start -= len(piece)

    def ids(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.split(word):
            i = self.id_of.get(p)
            if i is not None:
                out.append(i)
            elif self.id_of_byte:
                out.extend(self.id_of_byte[b] for b in p.encode("utf-8"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def word(self, word: str) -> tuple[str, int, str | None]:
        """The ids of a word as text, their number, and the decoded word where it isn't the word itself."""
        found = self.words.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                ids = self.ids(word)
                found = (" ".join(map(str, ids)), len(ids), self._text(ids) if min(ids) < self.plain else None)
            if len(word) <= LONGEST_KEPT:
                if len(self.words) >= WORDS_KEPT:  # what wasn't asked for in a whole turn is forgotten
                    self.words, self.older = {}, self.words
                self.words[word] = found
        return found

    @staticmethod
    def marked(text: str) -> list[str]:
        """The words of a text with their space marks, one mark being put before the text."""
        return _MARKED.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text and the end id."""
        out = [int(i) for w in self.marked(text or "") for i in self.word(w)[0].split()]
        return [*out, self.end]

    def _text(self, ids) -> str:
        """Pieces joined, marks as spaces; bytes that are no UTF-8 become one replacement character each."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw = bytearray()
            if i not in self.silent:
                out.append(self.pieces[i] if i != self.unknown else " ⁇ ")
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids) -> str:
        text = self._text(ids)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and the digests of the ids and of the decoded text."""
        known, find = self.words.get, self.word
        marked = self.marked(text or "")
        words = [known(w) or find(w) for w in marked]
        ids = " ".join([*[w[0] for w in words], str(self.end)])
        decoded = "".join([m if w[2] is None else w[2] for m, w in zip(marked, words)]).replace(MARK, " ")
        decoded = decoded[1:] if decoded.startswith(" ") else decoded
        return sum([w[1] for w in words]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _utf8(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    return Encoder(model_file)


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of all ids of the text, the end id last."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(model_file)
        for b in batches:
            yield pd.Series([e.encode(t) for t in b])

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a column of the text of the ids; null ids give null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(model_file)
        for b in batches:
            yield pd.Series([None if x is None else e.decode(x) for x in b])

    return docs.withColumn(text, run(F.col(ids)))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, without ids or decoded texts leaving the worker."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(model_file)
        for b in batches:
            yield pd.DataFrame([e.digest(t) for t in b], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run(F.col("text")).alias("__d")).select("doc_id", "__d.*")
