"""String similarity: Indel ratio and what is built on it. Plain Python over Arrow batches; bit-parallel LCS on big integers.

`ratio` is 200 * LCS / (|a| + |b|) over code points (two empty strings: 100). It is not Levenshtein.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a, b) -> int:
    """Length of the longest common subsequence of two sequences of hashables."""
    if len(a) < len(b):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    s = full
    for x in a:
        u = s & where.get(x, 0)
        s = (s + u | s - u) & full if u else s
    return len(b) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(token_sort(a), token_sort(b))


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """The best ratio of the shorter string with windows of the longer one, windows cut at both ends included.

    With a floor, scores up to it may be given as the floor. A window moved by one gains one at most, so windows that
    cannot beat the best so far are skipped; one cut shorter gains nothing.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else floor
    best = _windows(a, b, floor)
    return _windows(b, a, best) if len(a) == len(b) else best


def _windows(a: str, b: str, best: float) -> float:
    n, i = len(a), 0
    while i <= len(b) - n:
        hits = lcs(a, b[i : i + n])
        best = max(best, 100.0 * hits / n)
        if best >= 100.0:
            return best
        i += max(1, int(best * n / 100) + 1 - hits)
    for cut in (lambda k: b[:k], lambda k: b[len(b) - k :]):
        k = n - 1
        while k > 0:
            hits = lcs(a, cut(k))
            best = max(best, 200.0 * hits / (n + k))
            if 200.0 * hits <= best * (n + hits):
                break
            k = min(k - 1, int(200.0 * hits / best - n))
    return best


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = x & y, x - y, y - x
    if both and (not one or not two):
        return 100.0
    s, p, q = (" ".join(sorted(z)) for z in (both, one, two))
    sp, sq = (f"{s} {z}".strip() for z in (p, q))
    return max(ratio(p, q), *((ratio(s, sp), ratio(s, sq), ratio(sp, sq)) if both else (0.0,)))


def len_ratio(a: str, b: str) -> float:
    return min(len(a), len(b)) / max(len(a), len(b)) if a and b else 0.0


def similarity(a: str, b: str) -> float:
    """max(ratio, token_sort_ratio) of normalised strings."""
    one = ratio(a, b)
    return one if one == 100.0 else max(one, token_sort_ratio(a, b))


def _middles(ref, hyp) -> tuple[int, list, list]:
    """Two sequences without their common ends, and the length of these: some best alignment matches them one to one."""
    n, m = len(ref), len(hyp)
    start, most = 0, min(n, m)
    while start < most and ref[start] == hyp[start]:
        start += 1
    end, most = 0, most - start
    while end < most and ref[n - 1 - end] == hyp[m - 1 - end]:
        end += 1
    return start + end, ref[start : n - end], hyp[start : m - end]


def edit_distance(ref, hyp) -> int:
    """Edit distance of two sequences: the differences down a column of the table are two bit vectors, one big integer each, and a
    symbol of the other sequence updates them all at once."""
    _, x, y = _middles(ref, hyp)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return len(y)
    where: dict = {}
    for i, v in enumerate(x):
        where[v] = where.get(v, 0) | 1 << i
    full, top = (1 << len(x)) - 1, len(x) - 1
    up, down, distance = full, 0, len(x)  # rows where the value rises or falls by one
    for v in y:
        same = where.get(v, 0)
        level = (((same & up) + up) ^ up) | same | down  # rows whose diagonal step costs nothing
        right, left = (down | ~(level | up)) & full, level & up
        distance += (right >> top) - (left >> top)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = (left | ~(level | right)) & full, right & level
    return distance


def error_counts(ref, hyp) -> tuple[int, int]:
    """(edit distance, most hits among its optimal alignments).

    Optimal alignments stay on the diagonals that the distance lets them reach, so that only these are filled, a row of
    the table at a time.
    """
    ends, ref, hyp = _middles(ref, hyp)
    n, m = len(ref), len(hyp)
    distance = edit_distance(ref, hyp)
    spare = (distance - abs(m - n)) // 2
    low, high = min(0, m - n) - spare, max(0, m - n) + spare
    known: dict = {}
    y = np.array([known.setdefault(v, len(known)) for v in hyp], np.int64)
    unit = 1 << 32  # a value is distance * unit - hits
    ramp = np.arange(m + 1, dtype=np.int64) * unit
    row = np.where(np.arange(m + 1) <= high, ramp, 1 << 61)
    for i, v in enumerate(ref, 1):
        a, b = max(0, i + low), min(m, i + high) + 1
        fresh = row[a:b] + unit
        k = max(a, 1)  # the first column has no diagonal
        step = np.where(y[k - 1 : b - 1] == known.get(v, -1), -1, unit)
        np.minimum(fresh[k - a :], row[k - 1 : b - 1] + step, out=fresh[k - a :])
        row[a:b] = np.minimum.accumulate(fresh - ramp[a:b]) + ramp[a:b]
    return distance, int(distance * unit - row[-1]) + ends


def stem(word: str) -> str:
    """Porter's stemmer, by its published rules; words of up to three letters stay."""
    return _stem(word) if len(word) > 3 else word


def _measure(s: str) -> tuple[int, str]:
    kinds = ""
    for i, c in enumerate(s):
        vowel = c in "aeiou" or c == "y" and i > 0 and kinds[-1] == "c"
        kinds += "v" if vowel else "c"
    m = sum(1 for x, y in zip(kinds, kinds[1:], strict=False) if x == "v" and y == "c")
    return m, kinds


# The suffixes of the published rules, steps 2, 3 and 4.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(100_000)
def _stem(w: str) -> str:
    def cvc(s: str) -> bool:
        k = _measure(s)[1]
        return len(s) >= 3 and k[-3:] == "cvc" and s[-1] not in "wxy"

    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3])[0] > 0 else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _measure(base)[1]:
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _measure(w)[1][-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w)[0] == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _measure(w[:-1])[1]:
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for suffix, to in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)])[0] > 0:
                    w = w[: -len(suffix)] + to
                break
    for suffix in sorted(STEP4, key=lambda s: -len(s)):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base)[0] > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])[0]
        if m > 1 or m == 1 and not cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w)[0] > 1 else w


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


_udfs: dict = {}


def score(name: str, a: Column | str, b: Column | str) -> Column:
    """A score of two string columns by name (ratio, token_sort_ratio, partial_ratio, token_set_ratio, similarity)."""
    f = {"ratio": ratio, "token_sort_ratio": token_sort_ratio, "partial_ratio": partial_ratio, "token_set_ratio": token_set_ratio, "similarity": similarity}[name]
    return _udfs.setdefault(name, _pairwise(f))(a, b)


def partial_above(a: Column | str, b: Column | str, limit: float) -> Column:
    """partial_ratio > limit, stopping at what decides it."""
    return F.pandas_udf(lambda x, y: pd.Series([p is not None and q is not None and partial_ratio(p, q, limit) > limit for p, q in zip(x, y, strict=True)], dtype=bool), "boolean")(a, b)
