"""Edit distance of pairs of texts, in Arrow batches: columns of 64 rows at a time as bits (Myers, Hyyro), many pairs at
once. Exact, for texts of any length; memory is that of the patterns of some pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the tables of letters of the pairs that are compared at once.
TABLE = 64 << 20
_ONE = np.uint64(1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without what they begin and end with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b, n = a[start:], b[start:], n - start
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = int(differ[0]) if len(differ) else n
    return a[: len(a) - end], b[: len(b) - end]


def _columns(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distances of pairs (pattern, text), longest texts first; neither is empty."""
    size, m, n = len(pairs), np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    letters, coded = np.unique(np.concatenate([a for a, _ in pairs]), return_inverse=True)
    words, none = int((m.max() + 63) // 64), len(letters)
    table = np.zeros((words, none + 1, size), np.uint64)
    row = np.concatenate([np.arange(k) for k in m])
    np.bitwise_or.at(table, (row >> 6, coded, np.repeat(np.arange(size), m)), _ONE << (row & 63).astype(np.uint64))
    texts = np.full((int(n.max()), size), none)
    for i, (_, b) in enumerate(pairs):
        at = np.minimum(np.searchsorted(letters, b), none - 1)
        texts[: len(b), i] = np.where(letters[at] == b, at, none)
    up, down = np.full((words, size), ~np.uint64(0)), np.zeros((words, size), np.uint64)
    open_ = np.searchsorted(-n, -np.arange(int(n.max())), "left")  # texts that go on after so many letters
    each, last = np.arange(size), np.uint64(63)
    for j, k in enumerate(open_.tolist()):
        at, here = texts[j, :k], each[:k]
        plus, minus = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(words):
            pv, mv, eq = up[w, :k], down[w, :k], table[w, at, here]
            xv = eq | mv
            eq |= minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            plus_out, minus_out = ph >> last, mh >> last
            ph, mh = (ph << _ONE) | plus, (mh << _ONE) | minus
            up[w, :k], down[w, :k] = mh | ~(xv | ph), ph & xv
            plus, minus = plus_out, minus_out
    found = n.astype(np.int64)
    for w in range(words):
        bits = np.clip(m - 64 * w, 0, 64)
        mask = np.where(bits == 64, ~np.uint64(0), (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)
        found += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask).astype(np.int64)
    return found


def distances(xs: list, ys: list) -> list:
    """Edit distances of texts, None where one is None."""
    out: list = [None] * len(xs)
    open_ = []
    for i, (x, y) in enumerate(zip(xs, ys)):
        if x is None or y is None:
            continue
        if x == y:
            out[i] = 0
            continue
        a, b = _trimmed(_codes(x), _codes(y))
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        if len(a):
            open_.append((i, a, b))
        else:
            out[i] = len(b)
    open_.sort(key=lambda p: (-((len(p[1]) + 63) // 64), -len(p[2])))
    while open_:
        words = (len(open_[0][1]) + 63) // 64
        most = max(1, TABLE // (8 * 128 * words))
        some = sorted(open_[:most], key=lambda p: -len(p[2]))
        some = some[: max(1, TABLE // (8 * words * (1 + len(np.unique(np.concatenate([a for _, a, _ in some]))))))]
        taken = {p[0] for p in some}
        open_ = [p for p in open_[:most] if p[0] not in taken] + open_[most:]
        for p, d in zip(some, _columns([(a, b) for _, a, b in some]).tolist()):
            out[p[0]] = d
    return out


def distance(a: Column, b: Column) -> Column:
    """Edit distance in letters, for long texts."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(distances([v if isinstance(v, str) else None for v in x], [v if isinstance(v, str) else None for v in y]), dtype="Int32")

    return run(a, b)
