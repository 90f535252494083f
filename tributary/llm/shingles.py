"""Sets of word shingles as sorted 64-bit hashes, for batches of texts, in numpy.

Two different shingles have the same hash with a chance of 2^-64; sets are
compared by hashes throughout.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x = x ^ (x >> np.uint64(29))
    x = x * _BASE
    return x ^ (x >> np.uint64(32))


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers), 64), _BASE | np.uint64(1), np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word of a lower-cased text."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        a = np.frombuffer(raw, np.uint8, end - at, at)
        inside = ~_SPACE[a]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = end
        if not len(starts):
            continue
        sizes = ends - starts
        where = np.flatnonzero(inside)
        place = where - np.repeat(starts, sizes)
        v = (a[where].astype(np.uint64) + np.uint64(1)) * _power(int(sizes.max()))[place]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out.append(mix(np.add.reduceat(v, first) + sizes.astype(np.uint64) * _STEP))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts, size: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words than ``size`` are one shingle, no word is none."""
    raws = [(t or "").encode("utf-8").lower() for t in texts]
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def flush():
        nonlocal group, held
        joined = b"\n".join(group)
        w = word_hashes(joined)
        counts = [len(r.split()) for r in group]
        n = len(w)
        s = mix(w + np.uint64(1))
        full = s[: max(0, n - size + 1)].copy()
        for k in range(1, size):
            full = mix(full * _STEP ^ w[k : k + len(full)])
        at = 0
        for c in counts:
            if c >= size:
                out.append(np.unique(full[at : at + c - size + 1]))
            elif c:
                x = s[at]
                for k in range(1, c):
                    x = mix(np.array([x * _STEP ^ w[at + k]], np.uint64))[0]
                out.append(mix(np.array([x ^ np.uint64(c)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += c
        group, held = [], 0

    with np.errstate(over="ignore"):
        for r in raws:
            group.append(r)
            held += len(r)
            if held > BLOCK:
                flush()
        if group:
            flush()
    return out
