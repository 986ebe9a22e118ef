"""Suffix-array dedup: remove every byte that a repeated string of LENGTH bytes covers.

Not every suffix is sorted. Each start t of a LENGTH-byte string S(t) is represented by an anchor: the position, among
the WINDOW positions from t on, whose GRAM bytes have the smallest hash (its upper 44 bits; the first of equals). WINDOW + GRAM - 1 <= LENGTH,
so the anchor depends on S(t) alone: equal strings have their anchors at equal offsets, with equal grams.

1. Anchors' gram hashes are counted over the corpus. A string can repeat only where its anchor's gram does.
2. The suffixes at repeated anchors, with as many bytes to the left as their starts reach back, are range-partitioned by
   their LEAD leading bytes; splitters come from a bounded sample of leading bytes, and there are as many buckets as keep
   each under about BUCKET bytes. LEAD bytes are what every match has after its anchor, so what splitters part is compared
   by them: suffixes on two sides differ within LEAD bytes, and no match crosses a boundary.
3. A bucket sorts its suffixes by multikey quicksort over 8-byte words (all segments at once, a three-way partition of
   each by its middle word). Suffixes that share LEAD bytes form a run.
4. In a run, two suffixes that share r bytes from the anchor on and l bytes before it have all LENGTH-byte strings in
   common that start between LENGTH - r and l bytes before the anchor. Suffixes come together from the longest shared left
   sides to the shortest; each one that joins a group is compared with its neighbours there in suffix order, which share
   most with it. So every repeated start is found from prefixes shared in sorted order, in k log k comparisons for k
   suffixes. Repeated starts give spans, which join back to the documents.

A gram in more than HOT documents (boilerplate in a share of all of them) would make one run that no splitter cuts. Each
of its starts goes by itself then: 128-bit digests of their LENGTH-byte strings are counted by an aggregate and joined back.

Identical surroundings of an anchor, in one batch, are merged before the shuffle (one row with all its places), so
copies and periodic texts cost one row per batch. The hash of an anchor decides only what is compared, never a result;
two different texts of one id with equal 64-bit hashes would share spans, and two strings at hot grams with equal 128-bit
digests would count as one; nothing else is left to chance.

Cases: null texts are empty; texts under LENGTH bytes keep everything; matches never cross documents; repeated rows
(same id, same text) are repetitions of each other; null ids are ids like any other; extra columns are dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, pieces, read, shuffles, utf8, written

LENGTH, GRAM, WINDOW = 400, 128, 256
#: Bytes after its anchor that any match has, in whole words of 8.
LEAD = (LENGTH - WINDOW + 1) // 8 * 8
#: Bytes of suffixes in a bucket, about.
BUCKET = 64 << 20
#: Documents with a gram beyond which its starts are compared by digest.
HOT = 50_000
#: Anchors of one in so many grams give their leading bytes to the sample, which holds at most SAMPLE of them.
SAMPLED, SAMPLE = 16, 20_000
#: Bytes of text worked on at once.
BLOCK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size`-byte string of data."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = (1 << 16) - size
    for at in range(0, n, step):
        part = data[at : at + step + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * _UP[: len(part)], dtype=np.uint64, out=sums[1:])
        k = len(part) - size + 1
        h = (sums[size:] - sums[:k]) * _DOWN[:k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[at : at + k] = h ^ (h >> np.uint64(32))
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every `size` values in a row; size is a power of two."""
    k = 1
    while k < size:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, first start, last start) of each anchor of one text; starts run over 0 ... n - LENGTH."""
    out = []
    last = len(data) - LENGTH
    for at in range(0, last + 1, BLOCK):
        starts = min(BLOCK, last + 1 - at)
        h = rolling(data[at : at + starts + WINDOW + GRAM - 2], GRAM)
        # the hash's upper bits over the position: the smallest value is the first of the smallest hashes
        where = (sliding_min(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), WINDOW)[:starts] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        ends = np.append(new[1:], starts) - 1
        out.append((where[new] + at, h[where[new]], new + at, ends + at))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of words, and the number of leading words each shares with the row before it.

    All open segments advance together: each takes its middle row's word as pivot and splits in three; the equal part
    goes on with the next word, the others with the same one.
    """
    n, width = words.shape
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    starts, ends, depths = np.array([0] * (n > 1), np.int64), np.array([n] * (n > 1), np.int64), np.array([0] * (n > 1), np.int64)
    while len(starts):
        sizes = ends - starts
        rows = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        segment = np.repeat(np.arange(len(starts)), sizes)
        value = words[order[rows], depths[segment]]
        pivot = words[order[(starts + ends) // 2], depths][segment]
        side = np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
        key = segment * 3 + side
        order[rows] = order[rows][np.argsort(key, kind="stable")]
        counts = np.bincount(key, minlength=3 * len(starts)).reshape(-1, 3)
        first = starts[:, None] + np.concatenate([np.zeros((len(starts), 1), np.int64), np.cumsum(counts, 1)[:, :2]], 1)
        for k in (1, 2):  # a part that begins inside its segment shares the words already passed
            inside = (counts[:, k] > 0) & (first[:, k] > starts)
            shared[first[inside, k]] = depths[inside]
        deeper = counts[:, 1] > 0
        done = deeper & (depths + 1 == width)
        for a, b in zip(first[done, 1].tolist(), (first[done, 1] + counts[done, 1]).tolist(), strict=True):
            shared[a + 1 : b] = width
        parts = [(first[:, k], counts[:, k], depths + (k == 1)) for k in (0, 1, 2)]
        keep = [(c > 1) & (d < width) for _, c, d in parts]
        starts, ends, depths = (np.concatenate([v[m] for v, m in zip(c, keep, strict=True)]) for c in ([s for s, _, _ in parts], [s + c for s, c, _ in parts], [d for _, _, d in parts]))
    return order, shared


#: Words of a suffix's sorting key; its length comes last, so that padding sorts as the end of a text does.
WORDS = LENGTH // 8


def runs(contexts: list[bytes], lefts: np.ndarray) -> list[np.ndarray]:
    """Indices of contexts in suffix order (of the bytes from the anchor on), by runs that share LEAD bytes."""
    if not contexts:
        return []
    sides = [c[k:] for c, k in zip(contexts, lefts.tolist(), strict=True)]
    raw = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in sides), ">u8").astype(np.uint64).reshape(-1, WORDS)
    order, shared = multikey_quicksort(np.concatenate([raw, np.array([[len(x)] for x in sides], np.uint64)], 1))
    return np.split(order, np.flatnonzero(shared[1:] < LEAD // 8) + 1)


def common(x: bytes, y: bytes) -> int:
    """The number of leading bytes that two strings share."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
    return n - (differ.bit_length() + 7) // 8


def matches(rights: list[bytes], lefts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each suffix of a run (bytes from the anchor on, in suffix order; bytes before it, reversed): ranges (least, most)
    of distances before the anchor at which LENGTH-byte strings start that another suffix of the run has as well."""
    found: list[list[tuple[int, int]]] = [[] for _ in rights]
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    ties = sorted(((common(lefts[i], lefts[j]), n) for n, (i, j) in enumerate(zip(by_left, by_left[1:], strict=False))), reverse=True)
    group = [[i] for i in by_left]  # where a group begins and ends in the left order: its members, in suffix order
    first, last = list(range(len(by_left))), list(range(len(by_left)))
    for l, n in ties:
        one, two = group[first[n]], group[n + 1]
        a, b = first[n], last[n + 1]
        small, large = (one, two) if len(one) < len(two) else (two, one)
        for i in small:
            at = bisect.bisect_left(large, i)
            for j in large[max(at - 1, 0) : at + 1]:
                least = LENGTH - common(rights[i], rights[j])
                if least <= l:
                    found[i].append((least, l))
                    found[j].append((least, l))
            large.insert(at, i)
        group[a] = large
        first[b], last[a] = a, b
    return found


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).select("id", F.xxhash64("t").alias("h"), "t")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, start, end): byte spans, not yet merged, that repeated strings cover; h is the text's hash."""
    spark = docs.sparkSession
    bounded(spark)
    rows = _rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, f, n, lead = [], [], [], []
            for i, t in enumerate(batch.column(2)):
                text = t.as_py()
                if len(text) >= LENGTH:
                    at, hashes, _, _ = anchors(np.frombuffer(text, np.uint8))
                    unique, first, count = np.unique(hashes, return_index=True, return_counts=True)
                    f.append(unique)
                    n.append(count)
                    index += [i] * len(unique)
                    lead += [text[p : p + LEAD] if u % SAMPLED == 0 else None for u, p in zip(unique.tolist(), at[first].tolist(), strict=True)]
            if f:
                keys = batch.select(["id", "h"]).take(pa.array(index))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f).view(np.int64)), *keys.columns, pa.array(np.concatenate(n), pa.int32()), pa.array(lead, pa.binary())], ["f", "id", "h", "n", "lead"])

    found = written(rows.mapInArrow(grams, f"f long, id {kind}, h long, n int, lead binary"), "suffix-grams")
    often = written(found.groupBy("f").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where("n > 1"), "suffix-repeated")
    hot = often.where(F.col("docs") > HOT).select("f")
    often = often.where(F.col("docs") <= HOT)
    volume = often.agg(F.coalesce(F.sum(F.least("n", F.lit(HOT))), F.lit(0))).first()[0] * (LENGTH + WINDOW // 2)
    often = often.select("f")
    sample = found.where("lead is not null").join(often, "f", "left_semi").select("f", "lead").distinct().orderBy(F.xxhash64("f"), "lead").limit(SAMPLE).collect()
    parts = max(shuffles(spark), math.ceil(volume / BUCKET))
    leads = sorted(bytes(r.lead) for r in sample)
    splitters = sorted({leads[len(leads) * k // (4 * parts)] for k in range(1, 4 * parts)}) if leads else []

    def having(grams: DataFrame) -> DataFrame:
        """(id, h, t, fs): the texts in which some of these grams occur, with those grams."""
        wanted = found.join(grams, "f", "left_semi").groupBy("id", "h").agg(F.collect_set("f").alias("fs"))
        wanted = wanted.select(F.col("id").alias("wid"), F.col("h").alias("wh"), "fs").hint("shuffle_hash")
        return rows.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh"))).select("id", "h", "t", "fs")

    def places_of(text: bytes, fs: pa.ListScalar) -> Iterator[tuple[int, int, int]]:
        """(anchor, first start, last start) of the wanted grams in a text."""
        want = np.sort(fs.values.to_numpy().view(np.uint64))
        at, hashes, first, last = anchors(np.frombuffer(text, np.uint8))
        place = np.minimum(np.searchsorted(want, hashes), len(want) - 1)
        for k in np.flatnonzero(want[place] == hashes).tolist():
            yield int(at[k]), int(first[k]), int(last[k])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
            for i, (t, fs) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                text = t.as_py()
                for anchor, a, b in places_of(text, fs):
                    held.setdefault((text[a : b + LENGTH], anchor - a), []).append((i, a))
            for group in pieces(iter(held.items()), lambda x: len(x[0][0]) + 24 * len(x[1]), 8 << 20):
                refs = [r for _, r in group]
                keys = batch.select(["id", "h"]).take(pa.array([i for r in refs for i, _ in r], pa.int64()))
                kinds = pa.StructArray.from_arrays([*keys.columns, pa.array([a for r in refs for _, a in r], pa.int64())], ["id", "h", "start"])
                places = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r) for r in refs])]).astype(np.int32), kinds)
                bucket = [bisect.bisect_right(splitters, c[k : k + LEAD]) for (c, k), _ in group]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([c for (c, _), _ in group], pa.binary()), pa.array([k for (_, k), _ in group], pa.int32()), places], ["bucket", "context", "left", "places"])

    suffixes = having(often).mapInArrow(cut, f"bucket int, context binary, left int, places array<struct<id:{kind},h:bigint,start:bigint>>")
    dealt = suffixes.repartition(parts, "bucket")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[bytes, int], int] = {}
        places: list[list] = []
        for batch in batches:
            for c, k, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                i = at.setdefault((c, k), len(places))
                if i == len(places):
                    places.append([])
                places[i].append(p.values)
        contexts, lefts = [c for c, _ in at], np.array([k for _, k in at], np.int64)
        del at
        for group in pieces(iter(runs(contexts, lefts)), lambda r: sum(len(places[i]) for i in r.tolist()), 20_000):
            out: list[list] = [[], [], []]
            for run in group:
                own, k = run.tolist(), lefts[run].tolist()
                near = matches([contexts[i][n:] for i, n in zip(own, k, strict=True)], [contexts[i][:n][::-1] for i, n in zip(own, k, strict=True)]) if len(own) > 1 else [[]]
                for i, n, ranges in zip(own, k, near, strict=True):
                    if sum(map(len, places[i])) > 1:
                        ranges = [(n + LENGTH - len(contexts[i]), n)]
                    for least, most in joined(ranges):
                        for some in places[i]:
                            start = some.field("start").to_numpy()
                            out[0].append(some)
                            out[1].append(start + n - most)
                            out[2].append(start + n - least + LENGTH)
            if out[0]:
                keys = pa.concat_arrays(out[0])
                yield pa.RecordBatch.from_arrays([keys.field("id"), keys.field("h"), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]))], ["id", "h", "start", "end"])

    spans = dealt.mapInArrow(solve, f"id {kind}, h long, start long, end long")
    if not hot.limit(1).count():
        return spans

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, fs) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                text = t.as_py()
                for _, a, b in places_of(text, fs):  # WINDOW starts at most
                    keys = batch.select(["id", "h"]).take(pa.array(np.full(b + 1 - a, i)))
                    each = pa.array([hashlib.blake2b(text[p : p + LENGTH], digest_size=16).digest() for p in range(a, b + 1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*keys.columns, each, pa.array(np.arange(a, b + 1))], ["id", "h", "digest", "start"])

    each = written(having(hot).mapInArrow(digests, f"id {kind}, h long, digest binary, start long"), "suffix-digests")
    twice = each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return spans.union(each.join(twice, "digest", "left_semi").select("id", "h", "start", F.col("start") + LENGTH))


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of whole numbers (both ends included), those that touch as one."""
    return [(a, b - 1) for a, b in merged([(a, b + 1) for a, b in ranges])]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each document."""
    spans = repeated_spans(docs, id_col, text_col).groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("id").alias("sid"), F.col("h").alias("sh"), "spans").hint("shuffle_hash")
    both = _rows(docs, id_col, text_col).join(spans, F.col("id").eqNullSafe(F.col("sid")) & (F.col("h") == F.col("sh")), "left").select("id", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                text = t.as_py()
                gone = merged([(x["start"], x["end"]) for x in s.as_py() or ()])
                kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    done = both.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return done.withColumn("kept", F.col("kept").cast("string")) if keep_text else done.drop("kept")


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


# Every start of a LENGTH-byte string by itself, on the hexadecimal form of the bytes; repeated ones merged to runs.
SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS x FROM documents),
  w AS (SELECT rid, p, md5(substr(x, 2 * p + 1, 800)) AS m FROM (SELECT rid, x, unnest(range(0, length(x) // 2 - 399)) AS p FROM d)),
  r AS (SELECT rid, p FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
  g AS (SELECT rid, p, sum(first) OVER (PARTITION BY rid ORDER BY p) AS run FROM (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 400 THEN 0 ELSE 1 END AS first FROM r)),
  s AS (SELECT rid, run, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY rid, run),
  k AS (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s
    UNION ALL SELECT rid, length(x) // 2, coalesce(b, 0) FROM d LEFT JOIN (SELECT rid, max(b) AS b FROM s GROUP BY rid) USING (rid)),
  t AS (SELECT rid, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, (length(x) // 2 - length(kept) // 2)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (rid) LEFT JOIN (SELECT rid, count(*) AS n FROM s GROUP BY rid) USING (rid)
"""
