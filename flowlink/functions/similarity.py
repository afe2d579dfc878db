"""Jaro-Winkler similarity of names, computed for whole Arrow batches at a time."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAME = 0.94
CLOSE = 0.84
PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4
# Bounds the cells one comparison works on: pairs x length x length.
CELLS = 4_000_000
TILE = 1 << 18  # pairs whose shared letters are counted at once
ALPHABET = 256  # letters that are counted one by one; more share their counts


def code_points(texts: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts as rows of code points, their lengths); ``filler`` pads short rows."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), filler, dtype=np.int32)
    for i, t in enumerate(texts):
        if t:
            out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
    return out, lengths


def jaro_winkler_arrays(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity of each pair, in [0, 1].

    Half transpositions count in full, and the prefix boost has no floor. Two empty texts
    are equal, an empty and a present one have nothing in common.
    """
    if not left:
        return np.zeros(0)
    longest = max(max(map(len, left)), max(map(len, right)), 1)
    step = max(1, CELLS // (longest * longest))
    if len(left) > step:
        parts = [jaro_winkler_arrays(left[i : i + step], right[i : i + step]) for i in range(0, len(left), step)]
        return np.concatenate(parts)
    return _scores(*code_points(left, -1), *code_points(right, -2))


def _scores(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``jaro_winkler_arrays`` of names as ``code_points``, the right ones with another filler."""
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    places = np.arange(b.shape[1])[None, :]
    free = places < lb[:, None]
    matched = np.zeros(a.shape, dtype=bool)
    taken = np.zeros(b.shape, dtype=bool)
    rows = np.arange(len(a))
    for i in range(a.shape[1]):
        options = free & (b == a[:, i : i + 1]) & (np.abs(places - i) <= reach)
        first = options.argmax(axis=1)
        found = options[rows, first]
        matched[found, i] = True
        taken[rows[found], first[found]] = True
        free[rows[found], first[found]] = False
    m = matched.sum(axis=1).astype(np.float64)
    # Matched characters of both sides, in order, side by side.
    in_a = np.take_along_axis(a, np.argsort(~matched, axis=1, kind="stable"), axis=1)
    in_b = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable"), axis=1)
    width = min(a.shape[1], b.shape[1])
    swapped = ((in_a[:, :width] != in_b[:, :width]) & (np.arange(width)[None, :] < m[:, None])).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - swapped / 2) / m) / 3
    jaro = np.where(m > 0, jaro, 0.0)
    head = min(PREFIX_LENGTH, width)
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1)
    out = jaro + prefix * PREFIX_WEIGHT * (1 - jaro)
    return np.where((la == 0) & (lb == 0), 1.0, out)


BUCKETS, BUCKET_BITS = 12, 5


def letters(name: Column) -> Column:
    """How often the letters of a name occur, by code point modulo ``BUCKETS``, in one number.

    NULL where a count might not fit: names of more than 31 characters.
    """
    most = (1 << BUCKET_BITS) - 1
    places = F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name))).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.expr("1L") * F.pow(F.lit(2.0), F.pmod(F.ascii(F.substr(name, i, F.lit(1))), F.lit(BUCKETS)) * BUCKET_BITS).cast("bigint")
    return F.when(F.length(name) <= most, F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: acc + one(i)))


def similarity_bound(a: Column, b: Column, a_letters: Column, b_letters: Column) -> Column:
    """What the Jaro-Winkler similarity of two names can be at most; NULL where unknown.

    No more characters match than the names share letters, and nothing is transposed at
    best; the common prefix is counted exactly.
    """
    most = F.lit((1 << BUCKET_BITS) - 1)
    held = lambda c, i: F.shiftright(c, i * BUCKET_BITS).bitwiseAND(most)
    shared = sum((F.least(held(a_letters, i), held(b_letters, i)) for i in range(1, BUCKETS)), F.least(held(a_letters, 0), held(b_letters, 0)))
    jaro = (shared / F.length(a) + shared / F.length(b) + 1) / 3
    alike = lambda n: (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))
    prefix = F.lit(0.0)
    for n in range(1, PREFIX_LENGTH + 1):
        prefix = F.when(alike(n), n * PREFIX_WEIGHT).otherwise(prefix)
    known = a_letters.isNotNull() & b_letters.isNotNull() & (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(known, jaro + prefix * (1 - jaro))


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """NULL when either name is NULL."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = jaro_winkler_arrays(a[known].tolist(), b[known].tolist())
    return pd.Series(out).where(known, None)


def _unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Letter counts, each as so many ones: a product of two rows is what they share."""
    return np.concatenate([counts[:, [c]] >= np.arange(1, m + 1)[None, :] for c, m in enumerate(most)], axis=1).astype(np.float32)


def _needed(length: int, others: np.ndarray, floor: float, prefix: int) -> np.ndarray:
    """Letters that a name must share with names of these lengths, ``prefix`` first ones alike, to reach the floor."""
    jaro = (floor - 1e-9 - PREFIX_WEIGHT * prefix) / (1 - PREFIX_WEIGHT * prefix)
    return np.maximum(np.ceil((3 * jaro - 1) * length * others / (length + others) - 1e-6), 1).astype(np.float32)


def similar_in_blocks(left: list[str], right: list[str], floor: float = CLOSE, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in left, index in right, similarity) of all pairs at or above the floor.

    The characters two names share bound their similarity from above; only pairs whose
    bound reaches the floor are compared, with ``ordered`` the lower name first. Shared
    characters are counted by a matrix product, tile by tile. Only names with one and the
    same first letter can have a common prefix: just these are looked at for it.
    """
    none = np.zeros(0, np.int64)
    rows, columns = (np.flatnonzero([len(t) > 0 for t in side]) for side in (left, right))
    if not len(rows) or not len(columns):
        return none, none, np.zeros(0)
    a, la = code_points([left[x] for x in rows], -1)
    b, lb = code_points([right[x] for x in columns], -2)
    in_a, in_b = np.lexsort((a[:, 0], la)), np.argsort(b[:, 0], kind="stable")
    a, la, b, lb = a[in_a], la[in_a], b[in_b], lb[in_b]
    rows, columns = rows[in_a], columns[in_b]
    alphabet = np.intersect1d(a, b)
    if not len(alphabet):
        return none, none, np.zeros(0)
    # Many letters are counted in groups: names share no more of a group's than of it.
    groups = np.arange(len(alphabet)) % ALPHABET

    def counted(side: np.ndarray) -> np.ndarray:
        out = np.zeros((len(side), min(len(alphabet), ALPHABET)), np.int16)
        at = np.minimum(np.searchsorted(alphabet, side), len(alphabet) - 1)
        row, place = np.nonzero(alphabet[at] == side)
        np.add.at(out, (row, groups[at[row, place]]), 1)
        return out

    counts_a, counts_b = counted(a), counted(b)
    most = np.minimum(counts_a.max(axis=0), counts_b.max(axis=0))
    ones_a, ones_b = _unary(counts_a, most), np.ascontiguousarray(_unary(counts_b, most).T)
    head = min(PREFIX_LENGTH, a.shape[1], b.shape[1])
    found_a, found_b = [], []
    cuts = np.flatnonzero((np.diff(la) != 0) | (np.diff(a[:, 0]) != 0)) + 1
    whole = np.concatenate([[0], np.flatnonzero(np.diff(la)) + 1, [len(a)]])
    for begin, end in zip(whole[:-1], whole[1:]):
        need = _needed(int(la[begin]), lb, floor, 0)
        step = max(1, TILE // len(b))
        for start in range(begin, end, step):
            near = np.flatnonzero(ones_a[start : min(start + step, end)] @ ones_b >= need)
            i, j = near // len(b) + start, near % len(b)
            other = a[i, 0] != b[j, 0]
            found_a.append(i[other])
            found_b.append(j[other])
    bounds = np.concatenate([[0], cuts, [len(a)]])
    for begin, end in zip(bounds[:-1], bounds[1:]):
        first, last = (np.searchsorted(b[:, 0], a[begin, 0], side) for side in ("left", "right"))
        if first == last:
            continue
        needs = np.stack([_needed(int(la[begin]), lb[first:last], floor, k) for k in range(head + 1)])
        at = np.arange(last - first)
        step = max(1, TILE // (last - first))
        for start in range(begin, end, step):
            part = slice(start, min(start + step, end))
            shared = ones_a[part] @ ones_b[:, first:last]
            same, prefix = np.ones(shared.shape, dtype=bool), np.zeros(shared.shape, dtype=np.int8)
            for k in range(head):
                same &= a[part, k : k + 1] == b[first:last, k][None, :]
                prefix += same
            near = np.flatnonzero(shared >= needs[prefix, at])
            found_a.append(near // len(at) + start)
            found_b.append(near % len(at) + first)
    i, j = np.concatenate(found_a), np.concatenate(found_b)
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(side, ((0, 0), (0, width - side.shape[1])), constant_values=-1) for side in (a, b))
    scores = np.zeros(len(i))
    step = max(1, CELLS // (width * width))
    for start in range(0, len(i), step):
        m, n = i[start : start + step], j[start : start + step]
        x, lx, y, ly = a[m], la[m], b[n], lb[n]
        if ordered:
            lower = np.fromiter((left[p] <= right[q] for p, q in zip(rows[m], columns[n])), bool, len(m))
            x, y = np.where(lower[:, None], x, y), np.where(lower[:, None], y, x)
            lx, ly = np.where(lower, lx, ly), np.where(lower, ly, lx)
        scores[start : start + step] = _scores(np.where(x < 0, -1, x), lx, np.where(y < 0, -2, y), ly)
    kept = scores >= floor
    return rows[i[kept]], columns[j[kept]], scores[kept]


# --- An index of close names ------------------------------------------------------------

MOST_KEYS = 24  # keys a name may have per length of its partner and common prefix


@lru_cache(maxsize=1 << 16)
def _shared_letters(la: int, lb: int, prefix: int, floor: float) -> int | None:
    """Letters that names of these lengths must share to be that close; NULL if they can't be.

    With ``prefix`` first letters alike, Jaro has to reach the floor less the boost, and it
    does only if m matches give m / la + m / lb + 1 >= 3 * Jaro.
    """
    jaro = (floor - PREFIX_WEIGHT * prefix) / (1 - PREFIX_WEIGHT * prefix)
    need = max(1, math.ceil((3 * jaro - 1) * la * lb / (la + lb) - 1e-9))
    return None if need > min(la, lb) or prefix > min(la, lb) else need


@lru_cache(maxsize=1 << 16)
def _at_once(la: int, lb: int, need: int) -> int:
    """How many shared letters make one key: as many as keep the keys of both names few."""
    best = 1
    for r in range(2, min(need, 4) + 1):
        if math.comb(max(la, lb) - need + r, r) <= MOST_KEYS:
            best = r
    return best


def index_keys(name: str, lengths: Iterable[int], frequency: Mapping[str, float], left: bool, floor: float = CLOSE) -> Iterator[tuple]:
    """Keys of a name: two names as close as ``floor`` have one in common.

    ``lengths`` are those of the other side's names, ``frequency`` says how often letters
    occur. Per common prefix and pair of lengths, names that are close share ``need``
    letters; sorted from the rarest to the most frequent, the first len - need + r letters
    of both then hold r shared ones, and each such r letters are a key. Neither letters
    shared by many names nor names of other lengths make a key of their own.
    """
    seen: dict[str, int] = {}
    letters = []
    for c in name:
        seen[c] = seen.get(c, 0) + 1
        letters.append((frequency.get(c, 0.0) * 0.3 ** seen[c], c, seen[c]))
    letters.sort()
    tokens = [f"{c}{k}" for _, c, k in letters]
    for prefix in range(PREFIX_LENGTH + 1):
        for other in lengths:
            need = _shared_letters(len(name), other, prefix, floor)
            if need is None:
                continue
            la, lb = (len(name), other) if left else (other, len(name))
            r = _at_once(la, lb, need)
            for chosen in combinations(tokens[: len(name) - need + r], r):
                yield (prefix, name[:prefix], la, lb, *chosen)
