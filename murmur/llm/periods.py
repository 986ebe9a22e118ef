"""Periodic runs of words: stretches that repeat with a period, each at full length and once, under its smallest period.

A text is cut into words (runs of bytes other than space and 0x09-0x0D). A run of period q is a stretch of at least
max(shortest, 2 * q) words in which words q apart are the same, q being its smallest period, and which no neighbouring
word extends.

Runs come from a suffix automaton of the words. A state stands for strings that end at the same places; its places are
those of its children in the tree of suffix links, and are gathered by merging ordered sets, the smaller into the
larger. Where an end meets a new neighbour at a distance d not over the state's length L, the L words before both are
the same, which makes a square of period d. The two ends have not met below, so their common past is exactly L words: the
square reaches back to the run's first word. It is extended to the right until words d apart differ; a seed whose right side can still
grow is left to the seed at the run's last word, which exists for the smallest period: the two last places of the run's
string of length - q words are neighbours, as a third one between them would make a smaller period. Of seeds that give the
same stretch the smallest distance is its period.

Only words that can belong to a run reach the automaton. A run's first length - q words (half of `shortest` at least) occur
again q words later, and both places together cover it; so every word of a run lies in a window of shortest / 2 words
that occurs twice. Windows are compared by 64-bit hashes in numpy: a chance collision adds words, never loses one. What
is left falls into separate stretches, each with an automaton of its own; memory is that of the longest such stretch
(some 600 bytes a word), time n log n of words.

Cases: null and empty texts have no words and no runs (collapsed text empty); texts are read whole; repeated rows give
repeated rows; a null id stays null, and its text gets no planted repeats in the query; extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, read, utf8

#: Fewest words of a run.
SHORTEST = 12
#: Most elements in a block of an ordered set.
BLOCK = 1024


class Ends:
    """An ordered set of end positions in blocks, so that an insertion moves one block only."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert x, which is not in the set; what stands before and after it."""
        blocks, tops = self.blocks, self.tops
        k = bisect_left(tops, x)
        if k == len(tops):  # beyond all
            block = blocks[-1]
            before, after = block[-1], None
            block.append(x)
            k, tops[-1] = len(tops) - 1, x
        else:
            block = blocks[k]
            at = bisect_left(block, x)
            after = block[at]
            before = block[at - 1] if at else blocks[k - 1][-1] if k else None
            block.insert(at, x)
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks[k : k + 1] = [block[:half], block[half:]]
            tops[k : k + 1] = [block[half - 1], block[-1]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a word: of each state the length of its longest string, its suffix link, and the end of the
    prefix that it stands for (-1: none). State 0 is the root."""
    length, link, own, to = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(word):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        own.append(i)
        to.append({})
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = now
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 != length[q]:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                to.append(dict(to[q]))
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[now] = q
        last = now
    return length, link, own


def runs_of(word: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word, by start, then period."""
    n = len(word)
    length, link, own = automaton(word)
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in own]
    found: dict[tuple[int, int], int] = {}

    def seed(first: int, end: int, common: int) -> None:
        d = end - first
        if d <= common and common + d >= shortest and (end + 1 == n or word[end + 1] != word[end + 1 - d]):
            key = first - common + 1, common + d
            found[key] = min(d, found.get(key, d))

    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):  # children before their parents
        u = link[v]
        if u == 0:  # nothing in common
            sets[v] = None
            continue
        small, large, common = sets[v], sets[u], length[u]
        sets[v] = None
        if large is None:
            sets[u] = small
            continue
        if small.size > large.size:
            small, large = large, small
        previous = None
        for x in small:
            before, after = large.add(x)
            if before is not None and before != previous:  # two of the smaller set have met below
                seed(before, x, common)
            if after is not None:
                seed(x, after, common)
            previous = x
        sets[u] = large
    return sorted((start, size, d) for (start, size), d in found.items())


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The maximal stretches [first, end) of positions that lie in a window of so many ids that occurs twice."""
    n = len(ids) - window + 1
    if n < 2:
        return []
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    x = (x ^ x >> np.uint64(31)) * _MIX[1]
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ h >> np.uint64(29)) * _MIX[2] + x[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window) + 1
    first, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
    return list(zip(first.tolist(), (last + window).tolist(), strict=True))


def runs(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of ids, by start, then period.

    Stretches are narrowed again while that drops a quarter of a stretch at least, then go through the automaton.
    """
    window = (shortest + 1) // 2
    out, todo = [], [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < shortest:
            continue
        parts = stretches(ids[lo:hi], window)
        if sum(b - a for a, b in parts) <= 3 * (hi - lo) // 4:
            todo += [(lo + a, lo + b) for a, b in parts]
            continue
        for a, b in parts:
            if b - a >= shortest:
                out += [(lo + a + s, size, d) for s, size, d in runs_of(ids[lo + a : lo + b].tolist(), shortest)]
    return sorted((s, size, d) for s, size, d in out)


def scan(text: bytes, shortest: int = SHORTEST) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Of a text: how many words, its runs, and its words without those that repeat a run's first period."""
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = runs(ids, shortest)
    if found:
        s, size, d = np.array(found).T
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, s + d, 1)
        np.add.at(step, s + size, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
    return len(ids), found, b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of each text, by start, then period, and its words without repeats of a
    run's first period, joined by single spaces."""
    if shortest < 2:
        raise ValueError("a run has at least two words")
    bounded(docs.sparkSession)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, kept = [], [], []
            for t in batch.column(1):
                one, two, three = scan(t.as_py(), shortest)
                n.append(one)
                found.append([{"start": s, "length": size, "period": d} for s, size, d in two])
                kept.append(three.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A text, where the id's hash says so with its words from one on replaced by repeats of those that follow it (see the query)."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(F.col(id_col).cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise(F.col(text_col))


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, after repeats are planted: with h = crc32 of the id and g = h / 10, where 10 divides h, each
    word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic_runs(docs).withColumn("top", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
        F.floor(-1000 * F.col("top.l") / F.col("top.p")).alias("exponent_milli"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# Pairs of equal windows of six words at one distance, consecutive ones joined to stretches: a stretch of m windows at distance q is
# one of m + 5 + q words with period q.
SQL = r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]))::BIGINT[]), lambda c, b: xor((xor(c, b)) >> 1, 3988292384 * (xor(c, b) & 1))) AS c FROM documents),
  h AS (SELECT r, doc_id, w, len(w) AS n, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g FROM w),
  a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM h),
  t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
  k AS MATERIALIZED (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS k FROM (SELECT r, w, unnest(range(0, n - 5)) AS i FROM t)),
  e AS (SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.k = y.k AND x.i < y.i),
  s AS (SELECT r, q, min(i) AS s, count(*) + 5 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
  u AS MATERIALIZED (SELECT r, s, l, min(q) AS q FROM s GROUP BY r, s, l),
  m AS (SELECT r, count(*) AS n_runs, min({'l': -l, 's': s, 'q': q}) AS top, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS runs FROM u GROUP BY r),
  o AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM u),
  c AS (SELECT x.r, string_agg(x.x, ' ' ORDER BY x.i) AS kept FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t) x ANTI JOIN o ON o.r = x.r AND o.i = x.i GROUP BY x.r)
  SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, (-top.l)::BIGINT AS length, top.q AS period, (-1000 * top.l)::BIGINT // top.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
  FROM t LEFT JOIN m USING (r) LEFT JOIN c USING (r)"""
