"""SimHash near-duplicates by a segment-popcount embedding.

A document's words form shingles; each is hashed to 64 bits; a fingerprint bit is 1 where it is set in over half of the
hashes. A fingerprint maps to the bit counts of its 32 two-bit segments: a point whose Manhattan distance to another is
at most their Hamming distance. The segments form blocks; if two fingerprints differ in at most BITS bits, then some
block's points differ by at most floor(BITS / blocks) = 1 (blocks = 3 for 4 bits). So for each block every fingerprint
goes to its own grid cell, and to the cells one step up in one coordinate: a pair at distance at most 1 meets in the cell
of one of them. What meets is verified by the exact Hamming distance.

Only distinct fingerprints are joined, so copies of a text, however many, cost one point. Inside a cell no list of pairs
is emitted: links are found there and reduced to a spanning forest. Small cells compare whole columns of pairs. A cell of
more than SMALL points is divided again, by the exact bits of each of BITS + 1 parts of the fingerprint (two that differ
in at most BITS bits agree in one part), and parts that are still large are searched breadth-first, each fingerprint
against those not yet reached: at most n - 1 edges for n points and part. Components of fingerprints then join back to the documents on the fingerprint.

Cases: null texts count as empty ones; texts without words have fingerprint zero, linked like any other; fewer words
than a shingle make one shingle; null ids are the smallest of nothing (a component of null ids only has a null id);
repeated rows share their component; extra columns are dropped by the query and kept by representatives().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import bounded, free, read, shuffles, utf8, written
from murmur.llm.graph import components

#: Words in a shingle, seed of the hash, differing bits that still link.
WORDS, SEED, BITS = 4, 42, 4
#: Bits of a segment; a cell with more points than this is searched breadth-first.
SEGMENT, SMALL = 2, 256


def fingerprint(text: bytes, size: int = WORDS, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: -size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int("".join("1" if 2 * c > len(h) else "0" for c in counts), 2)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint's bits as a long."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def blocks(bits: int) -> list[tuple[int, int]]:
    """(first, last + 1) segments of each block: as few blocks as leave one of them within a distance of 1."""
    n = bits // 2 + 1
    edges = np.linspace(0, 64 // SEGMENT, n + 1).round().astype(int)
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def cells(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, fp, own): every fingerprint in its own cell of each block, and in those one step up in one coordinate."""
    x = fp.view(np.uint64)
    out = []
    for k, (a, b) in enumerate(blocks(bits)):
        counts = [(x >> np.uint64(SEGMENT * i) & np.uint64(1)) + (x >> np.uint64(SEGMENT * i + 1) & np.uint64(1)) for i in range(a, b)]
        key = np.full(len(x), k, np.uint64)
        for c in counts:
            key = key * np.uint64(3) + c
        out.append((key, x, np.ones(len(x), bool)))
        for i, c in enumerate(counts):
            up = c < 2
            out.append((key[up] + np.uint64(3 ** (len(counts) - 1 - i)), x[up], np.zeros(int(up.sum()), bool)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forest(cell: np.ndarray, fp: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints of the same cell within `bits`, at least one of each pair at home there: enough of them
    to connect whatever these links connect, at most one for each point and cell visited."""
    order = np.lexsort((~own, cell))
    cell, fp, own = cell[order], fp[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(cell)))
    a, b = [], []
    ends = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(own & np.repeat((sizes > 1) & (sizes <= SMALL), sizes))  # those at home come first in their cell
    n = ends[at] - at - 1
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // 2_000_000)) + 1):
        one = np.repeat(at[some], n[some])
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        near = np.bitwise_count(fp[one] ^ fp[two]) <= bits
        a.append(fp[one[near]])
        b.append(fp[two[near]])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        for some in parts_of(fp[s : s + n], bits):
            one, two = search(fp[s : s + n][some], own[s : s + n][some], bits)
            a.append(one)
            b.append(two)
    one, two = (np.concatenate(z) if z else np.zeros(0, np.uint64) for z in (a, b))
    return one.astype(np.uint64), two.astype(np.uint64)


def parts_of(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    """Groups of two and more positions that agree in one of bits + 1 parts of the fingerprint: those within `bits` meet in one."""
    edges = np.linspace(0, 64, bits + 2).round().astype(int)
    out = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        part = fp >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
        order = np.argsort(part, kind="stable")
        out += [x for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x) > 1]
    return out


def search(f: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among these points (one of each pair at home), breadth-first."""
    a, b = [], []
    rank = np.argsort(~home, kind="stable")
    f, home = f[rank], home[rank]
    open_ = np.ones(len(f), bool)
    for first in range(int(home.sum())):
        if not open_[first]:
            continue
        open_[first] = False
        stack = [first]
        while stack:
            at = stack.pop()
            rest = np.flatnonzero(open_ if home[at] else open_ & home)
            found = rest[np.bitwise_count(f[rest] ^ f[at]) <= bits]
            open_[found] = False
            stack += found.tolist()
            a.append(np.full(len(found), f[at]))
            b.append(f[found])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) over distinct fingerprints (column fp): a spanning set of the links of at most `bits` differing bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                cell, fp, own = cells(batch.column(0)[at : at + 20_000].to_numpy(zero_copy_only=False), bits)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(own)], ["cell", "fp", "own"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:  # sorted by cell: whole cells are solved as soon as enough rows have come
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= 200_000:
                cell, fp, own = (np.concatenate(c) for c in zip(*held, strict=True))
                last = int(np.argmax(cell == cell[-1]))
                yield edges(*forest(cell[:last], fp[:last], own[:last], bits))
                held, rows = [(cell[last:], fp[last:], own[last:])], 0
        if held:
            yield edges(*forest(*(np.concatenate(c) for c in zip(*held, strict=True)), bits))

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = distinct.select("fp").mapInArrow(spread, "cell long, fp long, own boolean").repartition(shuffles(distinct.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(solve, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(id, fp, component) for each document: the smallest id reachable over links."""
    fps = written(fingerprints(docs, id_col, text_col, size, seed), "simhash-fps")
    of_fp = groups(fps, bits).select("f", "component")
    return fps.join(of_fp, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), "fp", "component")


def groups(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(f, root, component) for each fingerprint of fps (id, fp): the smallest fingerprint and the smallest id reachable over links."""
    least = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = components(links(least, bits))
    class_of = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    class_of = written(class_of.select("fp", "first", "root"), "simhash-classes")
    ids = written(class_of.groupBy("root").agg(F.min("first").alias("component")), "simhash-roots")
    return written(class_of.join(ids, "root").select(F.col("fp").alias("f"), "root", "component"), "simhash-components")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id (null only where all are), of several texts with
    that id the one with the smallest hash, of equal texts any one. Groups are told apart by their root, not by an id.

    Texts meet the (id, hash) pairs that stay in a hash join, unsorted; rows are only compared among themselves if a pair
    that stays repeats.
    """
    x = free(docs)
    digest = F.unhex(F.sha2(utf8(text_col), 256))
    pairs = docs.select(F.struct(F.col(id_col).alias("id"), digest.alias("h")).alias("id"), F.col(text_col).alias("t"))
    fps = written(fingerprints(pairs, "id", "t", size, seed).select("id.id", "id.h", "fp"), "simhash-fps")
    own = fps.join(groups(fps, bits), F.col("fp") == F.col("f")).where(F.col("id").eqNullSafe(F.col("component")))
    own = own.groupBy("root", "id", "h").agg(F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct("h", "id", "n")).alias("one"))
    first = written(own.select(*(F.col(f"one.{c}").alias(f"{x}{c}") for c in ("id", "h", "n"))), "simhash-first")
    both = docs.withColumn(f"{x}own", digest)
    kept = both.join(first.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(f"{x}id")) & (F.col(f"{x}own") == F.col(f"{x}h")), "left_semi")
    if first.where(F.col(f"{x}n") > 1).limit(1).count():
        kept = kept.dropDuplicates([id_col, f"{x}own"])
    return kept.select(*docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
