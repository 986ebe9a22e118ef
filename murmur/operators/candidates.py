"""Which pairs of texts can satisfy a similarity rule at all: lossless bounds over blocks of texts, in numpy.

A rule is a list of clauses, any of which makes a duplicate; each clause looks at one view of the texts (lower case, without
digits, the first words) and asks for a ratio, a ratio of sorted words, a partial ratio or a token-set ratio over a limit. What
a clause needs at least:

    lengths    200 * shorter / (shorter + longer) over the limit
    letters    the LCS is at most the letters in common, repeats included (by classes of letters, which only add to it)
    bigrams    deleting a character breaks two neighbourships at most, inserting one breaks one: if a window of the longer text
               scores over p with the shorter (n characters), they share at least (1.5 p / 100 - 1) (n + k) - 1 bigrams, where the
               window has k > p n / (200 - p) characters; and d insertions and deletions from the nearest substring of the longer
               text leave 100 - 50 d / n at most
    words      a token-set ratio of 80 needs shared words with two thirds of one side's letters, or letters in common for
               80 % of both sides' lengths

Texts are sorted by length, so that the bound on lengths is a range for each block of rows; the others are tested for whole blocks
at once, and pairs that pass go to a bit-parallel LCS, or distance to a substring, that runs over many pairs at a time. Only what
is still possible then reaches the rule itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from murmur.functions import fuzzy

#: Classes of letters and of bigrams; rows of one side that are tested at once; texts over this many characters meet singly.
LETTERS, BIGRAMS, WORDS, ROWS, LONG = 48, 256, 64, 256, 512
#: Pairs whose LCS is computed at once, whose counts are compared at once, whose distances are computed at once.
PAIRS, COMPARED, STEPPED = 1 << 16, 1 << 14, 1 << 14
_LOW = np.uint64(0x00FF00FF00FF00FF)
_LANES = np.uint64(0x0001000100010001)


@dataclass(frozen=True)
class Clause:
    """kind: ratio, sorted, partial or token_set; over: the limit is not reached by equality; least: the share of the longer text
    that the shorter one must exceed; chars: the fewest characters (exceeded) of either text, null views never match."""

    kind: str
    limit: float
    view: Callable[[str], str | None] = str
    least: float = 0.0
    chars: int = -1
    over: bool = True


def _saturated(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts up to 255 in bytes, and what each row has beyond that."""
    low = np.minimum(table, 255).astype(np.uint8)
    return low, table.sum(1) - low.sum(1, dtype=np.int64)


def _counts(lists: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each class occurs in each list of classes, saturated."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)
    return _saturated(np.bincount(np.repeat(np.arange(len(lists)), sizes) * width + flat, minlength=len(lists) * width).reshape(-1, width))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows of at most 256 bytes, whole words: four at a time, in the 16-bit lanes of a word."""
    words = x.view(np.uint64)
    lanes = sum((words[:, w] & _LOW) + (words[:, w] >> np.uint64(8) & _LOW) for w in range(words.shape[1]))
    return (lanes * _LANES >> np.uint64(48)).astype(np.int64)


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At most what rows i of a and rows j of b have in common, in arrays of pairs."""
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), COMPARED):
        part = slice(at, at + COMPARED)
        out[part] = _sums(np.minimum(a[0][i[part]], b[0][j[part]]))
    if a[1].any() and b[1].any():
        out += np.minimum(a[1][i], b[1][j])
    return out


class View:
    """One view of a block of texts: lengths, and what the bounds count."""

    def __init__(self, texts: list[str | None]):
        self.there = np.array([t is not None for t in texts], bool)
        self.texts = [t or "" for t in texts]
        self.size = np.fromiter(map(len, self.texts), np.int64, len(texts))
        self.points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in self.texts]

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters by class."""
        return _counts([p % LETTERS for p in self.points], LETTERS)

    @cached_property
    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        return _counts([(p[:-1].astype(np.int64) * 31 + p[1:]) % BIGRAMS if len(p) > 1 else [] for p in self.points], BIGRAMS)

    @cached_property
    def sorted(self) -> View:
        return View([fuzzy.token_sort(t) for t in self.texts])

    @cached_property
    def word_set(self) -> View:
        return View([" ".join(sorted(set(t.split()))) for t in self.texts])

    @cached_property
    def words(self) -> list[dict[str, None]]:
        """The distinct words of each text, sorted."""
        return [dict.fromkeys(sorted(set(t.split()))) for t in self.texts]

    @cached_property
    def word_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """How many distinct words each text has, and how many characters these have."""
        return np.fromiter(map(len, self.words), np.int64, len(self.words)), np.fromiter((sum(map(len, w)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def word_letters(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of distinct words (and one more each), by class of the word."""
        out = np.zeros((len(self.texts), WORDS), np.int64)
        for i, t in enumerate(self.texts):
            for w in set(t.split()):
                out[i, zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS] += len(w) + 1
        return _saturated(out)


def lcs_pairs(x: View, y: View, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCS of x[i] and y[j] for arrays of pairs: a bit for each character of x[i], all pairs of one width in step."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    swap = x.size[i] > LONG
    for k in np.flatnonzero(swap | (y.size[j] > 8 * LONG)):
        out[k] = fuzzy.lcs(x.texts[i[k]], y.texts[j[k]])
    short = np.flatnonzero(~swap & (y.size[j] <= 8 * LONG) & (x.size[i] > 0) & (y.size[j] > 0))
    width = (x.size[i[short]] + 63) // 64
    for w in np.unique(width):
        own = short[width == w]
        own = own[np.argsort(-y.size[j[own]], kind="stable")]
        for at in range(0, len(own), PAIRS):
            part = own[at : at + PAIRS]
            out[part] = _lcs_block(x, y, i[part], j[part], int(w))
    return out


def _bits(parts: list[np.ndarray], y: View, j: np.ndarray, width: int, top: bool = False):
    """(bits of each letter in each part, by part and letter, in words; letters of the texts that j names, by step; the column of
    each pair; for each step how many pairs have such a letter): what a bit-parallel pass reads, pairs by y's size, descending.
    top: bits end with the highest one, and those that a part has not got match any letter."""
    cols, pj = np.unique(j, return_inverse=True)
    known, codes = np.unique(np.concatenate(parts), return_inverse=True)
    letters = len(known) + 1  # the last is any letter that no part has
    table = np.zeros((width, len(parts), letters), np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    part, place = np.repeat(np.arange(len(parts)), sizes), np.concatenate([np.arange(n) for n in sizes])
    if top:
        place = place + np.repeat(64 * width - sizes, sizes)
        table[0] = ((np.uint64(1) << (64 - sizes).astype(np.uint64)) - np.uint64(1))[:, None]
    np.bitwise_or.at(table, (place >> 6, part, codes), np.uint64(1) << (place & 63).astype(np.uint64))
    longest = int(y.size[cols].max())
    other = np.full((longest, len(cols)), len(known), np.int64)
    flat = np.concatenate([y.points[c] for c in cols])
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    column, step = np.repeat(np.arange(len(cols)), y.size[cols]), np.concatenate([np.arange(n) for n in y.size[cols]])
    other[step, column] = np.where(known[at] == flat, at, len(known))
    live = np.searchsorted(-y.size[j], -np.arange(longest), "left")
    return table.reshape(width, -1), letters, other, pj, live.tolist()


def _lcs_block(x: View, y: View, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    rows, row = np.unique(i, return_inverse=True)
    table, letters, other, col, live = _bits([x.points[r] for r in rows], y, j, width)
    row *= letters
    state = np.full((width, len(i)), ~np.uint64(0))
    for step, n in enumerate(live):
        at = row[:n] + other[step].take(col[:n])
        carry = None
        for w in range(width):
            s = state[w, :n]
            u = table[w].take(at)
            u &= s
            total = s + u
            if width > 1:
                more = total < s
                if carry is not None:
                    total += carry
                    more |= total < carry
                carry = more.astype(np.uint64)
            u ^= s
            np.bitwise_or(total, u, out=s)
    last = x.size[i] - 64 * (width - 1)
    state[width - 1] |= np.where(last < 64, ~np.uint64(0) << (last % 64).astype(np.uint64), np.uint64(0))
    return 64 * width - np.bitwise_count(state).sum(0, dtype=np.int64)


def nearest_pairs(x: View, y: View, i: np.ndarray, j: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """At least how many insertions and deletions make x[i] a substring of y[j] (any, the empty one included), for arrays of pairs: the
    sum of what its parts of 64 characters need, each by itself, until it exceeds what is enough. 0, which bounds nothing, where
    y[j] is very long."""
    out = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero(y.size[j] <= 8 * LONG)
    at = 0
    while len(open_ := open_[(x.size[i[open_]] > at) & (out[open_] <= enough[open_])]):
        own = open_[np.argsort(-y.size[j[open_]], kind="stable")]
        for k in range(0, len(own), STEPPED):
            part = own[k : k + STEPPED]
            out[part] += _nearest_block(x, y, i[part], j[part], at)
        at += 64
    return out


def _nearest_block(x: View, y: View, i: np.ndarray, j: np.ndarray, at: int) -> np.ndarray:
    """Of 64 characters of x from `at` on: the table of distances D has a row for each of them and a column for each letter of y; its
    first row is 0, as a substring begins anywhere, and D = (left upper) where letters are equal, else 1 + min(left, upper).
    Neighbours differ by -1, 0 or 1; rises and falls down a column are two bit vectors. Where letters differ and the column to the
    left rises, a cell differs from its left one as the cell above does: so carries run in an addition, once for falls, once for rises."""
    rows, row = np.unique(i, return_inverse=True)
    parts = [x.points[r][at : at + 64] for r in rows]
    size = np.fromiter(map(len, parts), np.uint64, len(parts))[row]
    if not len(y.points[j[0]]):
        return size.astype(np.int64)
    table, letters, other, col, live = _bits(parts, y, j, 1, top=True)
    row *= letters
    table, last = table[0], np.uint64(63)
    ups, downs = ~np.uint64(0) << (np.uint64(64) - size), np.zeros(len(i), np.uint64)
    score, best = size.copy(), size.copy()
    where, buffers = np.empty(len(i), np.int64), np.empty((8, len(i)), np.uint64)
    for letter, n in zip(other, live, strict=True):
        up, down, now, place = ups[:n], downs[:n], score[:n], where[:n]
        same, equal, passed, fall, free, some, rise, on = buffers[:, :n]
        letter.take(col[:n], out=place, mode="clip")
        place += row[:n]
        table.take(place, out=same, mode="clip")
        np.bitwise_and(same, up, out=equal)
        np.bitwise_xor(up, equal, out=passed)
        np.add(up, equal, out=fall)
        fall ^= passed  # cells above that fall
        np.bitwise_and(passed, fall, out=some)
        some |= equal
        some >>= last
        now -= some
        np.bitwise_or(same, down, out=free)
        np.bitwise_or(free, up, out=some)
        some |= fall
        np.invert(some, out=some)
        some |= down  # cells that rise whatever the one above does
        np.bitwise_or(passed, some, out=on)
        np.add(on, some, out=rise)
        rise ^= on
        rise ^= some  # cells above that rise
        np.bitwise_and(passed, rise, out=on)
        some |= on
        some >>= last
        now += some
        np.minimum(best[:n], now, out=best[:n])
        np.bitwise_or(free, rise, out=some)
        np.invert(some, out=some)
        some |= fall
        np.bitwise_or(some, on, out=up)
        np.bitwise_and(rise, free, out=down)
    return best.astype(np.int64)


def _beyond(score: np.ndarray, clause: Clause) -> np.ndarray:
    """Whether an upper bound reaches the limit; a hair is granted, as the rule itself decides."""
    return score > clause.limit - 1e-9


def _ratio(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


def bigrams_needed(short: np.ndarray, limit: float) -> np.ndarray:
    """Bigrams that a text of so many characters shares with one that has a window scoring over the limit."""
    return (short + limit * short / (200 - limit)) * (1.5 * limit / 100 - 1) - 1 - 1e-9 if limit > 67 else np.zeros(len(short))


class Block:
    """Texts of one side, with the views that a rule's clauses look at."""

    def __init__(self, texts: list[str], clauses: tuple[Clause, ...]):
        self.clauses = clauses
        made: dict[Callable, View] = {}
        for c in clauses:
            if c.view not in made:
                made[c.view] = View([c.view(t) for t in texts])
        self.views = [made[c.view] for c in clauses]
        self.texts = texts
        self.one_view = len(made) == 1
        self.first = self.views[0].size if self.one_view else np.fromiter(map(len, texts), np.int64, len(texts))

    def may(self, other: Block, i: np.ndarray, j: np.ndarray, exact: bool = True) -> np.ndarray:
        """Of pairs (i, j): which the bounds leave, after lengths and letters; with exact, after the LCS as well."""
        return self.judge(other, i, j, exact)[0]

    def judge(self, other: Block, i: np.ndarray, j: np.ndarray, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """may(), and for which of these pairs a clause holds for certain: all kinds but partial ratios are computed with exact."""
        out, sure = np.zeros(len(i), bool), np.zeros(len(i), bool)
        for c, x, y in zip(self.clauses, self.views, other.views, strict=True):
            left = np.flatnonzero(~out)
            if len(left):
                out[left] = _clause(c, x, y, i[left], j[left], exact)
                if exact and c.kind != "partial":
                    sure[left] = out[left]
        return out, sure


def _clause(c: Clause, x: View, y: View, i: np.ndarray, j: np.ndarray, exact: bool) -> np.ndarray:
    n, m = x.size[i], y.size[j]
    short, long = np.minimum(n, m), np.maximum(n, m)
    ok = x.there[i] & y.there[j] & (short > c.chars)
    if c.kind in ("ratio", "sorted"):
        ok &= _beyond(_ratio(short, n + m), c) if c.kind == "ratio" else ok
        if c.kind == "sorted":
            x, y = x.sorted, y.sorted
            n, m = x.size[i], y.size[j]
            ok &= _beyond(_ratio(np.minimum(n, m), n + m), c)
        k = np.flatnonzero(ok)
        common = _common(x.letters, y.letters, i[k], j[k])
        ok[k] = _beyond(_ratio(common, n[k] + m[k]), c)
        k = np.flatnonzero(ok)
        if exact:
            score = _ratio(lcs_pairs(x, y, i[k], j[k]), n[k] + m[k])
            ok[k] = score > c.limit if c.over else score >= c.limit
    elif c.kind == "partial":
        ok &= (short > c.least * long - 1e-9) if c.least else ok
        k = np.flatnonzero(ok & (short > 0))
        ok &= (short > 0) | (long == 0)  # two empty texts score 100, one empty text 0
        common = _common(x.letters, y.letters, i[k], j[k])
        ok[k] = _beyond(_ratio(common, short[k] + common), c)
        k = k[ok[k]]
        ok[k] = _common(x.bigrams, y.bigrams, i[k], j[k]) >= bigrams_needed(short[k], c.limit)
        k = k[ok[k]]
        if exact:
            ok[k] = _beyond(_windows_at_most(x, y, i[k], j[k], c.limit), c)
    else:
        a, b = x.word_set, y.word_set
        n, m = a.size[i], b.size[j]
        ok &= (n > 0) & (m > 0)
        k = np.flatnonzero(ok)
        common = _common(a.letters, b.letters, i[k], j[k])
        both = _beyond(_ratio(common + 2, n[k] + m[k]), c)
        shared = _common(x.word_letters, y.word_letters, i[k], j[k])
        ok[k] = both | _beyond(_ratio(shared, shared + np.minimum(n[k], m[k])), c)
        k, common = k[ok[k]], common[ok[k]]
        if exact and len(k):
            ok[k] = _token_sets(x, y, i[k], j[k], c, common)
    return ok


def _windows_at_most(x: View, y: View, i: np.ndarray, j: np.ndarray, limit: float) -> np.ndarray:
    """What no partial ratio of these pairs over the limit exceeds. A window of k characters at d edits from the shorter text (n
    characters, k <= n) scores 100 - 100 d / (n + k), so the nearest substring bounds all windows; of texts equally long either may
    be cut."""
    n, m = x.size[i], y.size[j]
    short = np.maximum(np.minimum(n, m), 1)
    enough = 2 * short * (1 - limit / 100) + 1e-6
    edits = np.full(len(i), np.iinfo(np.int64).max)
    for a, b, p, q, k in ((x, y, i, j, np.flatnonzero(n <= m)), (y, x, j, i, np.flatnonzero(n >= m))):
        edits[k] = np.minimum(edits[k], nearest_pairs(a, b, p[k], q[k], enough[k]))
    return 100.0 - 50.0 * edits / short


def _shared_words(x: View, y: View, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct words x[i] and y[j] have in common, how many characters these have, and which of x[i]'s and of y[j]'s words they
    are (bits; with many words a number of the pair's own), for arrays of pairs: the words of x[i] are looked up among (text, word) of y."""
    there = np.unique(j).tolist()
    number = {w: n for n, w in enumerate(dict.fromkeys(w for k in there for w in y.words[k]))}
    keys = np.array([k * len(number) + number[w] for k in there for w in y.words[k]], np.int64)
    place = np.concatenate([np.arange(len(y.words[k])) for k in there])
    keys, place = keys[order := np.argsort(keys)], place[order]
    rows, row = np.unique(i, return_inverse=True)
    sizes = np.fromiter((len(x.words[r]) for r in rows), np.int64, len(rows))
    flat = [w for r in rows.tolist() for w in x.words[r]]
    code = np.fromiter((number.get(w, -1) for w in flat), np.int64, len(flat))
    chars = np.fromiter(map(len, flat), np.int64, len(flat))
    first = np.cumsum(sizes) - sizes
    common, letters, mine, other = np.zeros((4, len(i)), np.int64)
    for n in range(int(sizes.max(initial=0))):  # the n-th word of each x[i]
        k = np.flatnonzero(sizes[row] > n)
        at = first[row[k]] + n
        k, at = k[code[at] >= 0], at[code[at] >= 0]
        key = j[k] * len(number) + code[at]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[found] == key
        k, at, found = k[hit], at[hit], found[hit]
        common[k] += 1
        letters[k] += chars[at]
        mine[k] |= 1 << min(n, 62)
        other[k] |= 1 << np.minimum(place[found], 62)
    many = (x.word_sizes[0][i] > 62) | (y.word_sizes[0][j] > 62)
    mine[many] = other[many] = -1 - np.flatnonzero(many)
    return common, letters, mine, other


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct pair occurs first, which one each pair is) of two arrays; those of a are small numbers."""
    known, of = np.unique(b, return_inverse=True)
    return np.unique(a * len(known) + of, return_index=True, return_inverse=True)[1:]


def _token_sets(x: View, y: View, i: np.ndarray, j: np.ndarray, c: Clause, both: np.ndarray) -> np.ndarray:
    """Whether token-set ratios of these pairs (with words each) reach the limit, as the rule has it; both: at most the letters that
    their distinct words have in common, spaces included. With s the shared words and p, q the others of either side, the ratio of s with
    s p is that of their lengths, and s p and s q have s, the space and the LCS of p and q in common, so that only this LCS is computed,
    where its bounds (lengths, letters in common less those of s) leave it open and once for equal p and q."""
    reaches = lambda score: score > c.limit if c.over else score >= c.limit
    common, letters, mine, other = _shared_words(x, y, i, j)
    one, two = x.word_sizes[0][i] - common, y.word_sizes[0][j] - common
    p, q = (np.maximum(v.word_sizes[1][k] - letters + n - 1, 0) for v, k, n in ((x, i, one), (y, j, two)))
    some, least = common > 0, np.minimum(p, q)
    s = np.where(some, letters + common - 1, 0)
    head = s + some
    score = np.where(some, np.where((one == 0) | (two == 0), 100.0, _ratio(s, s + head + least)), 0.0)
    out = reaches(score)
    most = np.minimum(least, np.maximum(both - letters - common, 0))
    k = np.flatnonzero(~out & reaches(_ratio(head + most, 2 * head + p + q)))
    if len(k):
        sides = []
        for u, v, m, n, bits in ((x, y, i[k], j[k], mine[k]), (y, x, j[k], i[k], other[k])):
            at, of = _distinct_pairs(m, bits)
            known: dict[str, int] = {}
            rest = [known.setdefault(" ".join(w for w in u.words[a] if w not in v.words[b]), len(known)) for a, b in zip(m[at].tolist(), n[at].tolist(), strict=True)]
            sides.append((View(list(known)), np.array(rest, np.int64)[of]))
        (u, a), (v, b) = sides
        at, of = _distinct_pairs(a, b)
        hits = lcs_pairs(u, v, a[at], b[at])[of]
        out[k] = reaches(_ratio(head[k] + hits, 2 * head[k] + p[k] + q[k]))
    return out


def possible(x: Block, y: Block, ordered: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, exact: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """judged() without what is certain."""
    for i, j, _ in judged(x, y, ordered, exact):
        yield i, j


def judged(x: Block, y: Block, ordered: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, exact: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) arrays of the pairs of two blocks that a rule's bounds leave. ordered: which pairs count at all.

    Rows go by length; where every clause bounds lengths, a block of rows meets the range of lengths that it can match only.
    """
    least = min(_least_share(c) for c in x.clauses) if x.one_view else 0.0
    up, across = np.argsort(x.first, kind="stable"), np.argsort(y.first, kind="stable")
    sizes = y.first[across]
    many = min(2 * ROWS, max(ROWS // 4, 16 * PAIRS // max(len(across), 1)))
    for at in range(0, len(up), many):
        rows = up[at : at + many]
        lo, hi = 0, len(across)
        if least > 0:
            low, high = x.first[rows[0]], x.first[rows[-1]]
            lo, hi = np.searchsorted(sizes, low * least - 1), np.searchsorted(sizes, (high + 1) / least + 1, "right")
        cols = across[lo:hi]
        i, j = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
        if ordered is not None:
            use = ordered(i, j)
            i, j = i[use], j[use]
        ok, sure = x.judge(y, i, j, exact)
        yield i[ok], j[ok], sure[ok]


def _least_share(c: Clause) -> float:
    """The share of the longer text's length that the shorter has at least where a clause holds; 0 where it can be any."""
    if c.kind == "ratio":
        return max(0.0, c.limit / (200 - c.limit) - 1e-9)
    return max(0.0, c.least - 1e-9) if c.kind == "partial" else 0.0
