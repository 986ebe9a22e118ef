"""Exact top-k by integer inner product: a Voronoi kNN join.

Vectors are turned into integers and assigned to the nearest of a few pivots (the vectors with the smallest hashes of
their ids); queries are grouped by fewer of them, as many as there are query slices, so that a vector is copied once for
each QUERIES queries at most, however many cells there are. Summaries of the cells (count, radius, smallest distances) and
of the query groups (radius, largest norm) bound every score: for q in a group with pivot p' and radius u, and x at distance d from its pivot p,
|<q, x> - <p', p>| <= u |p| + |q| d. The best lower bounds of k + 1 distinct ids (a query's own id is one of them at most)
give a threshold that k candidates reach, however often ids repeat; a cell is joined with a query group, and one of its vectors copied to that group, only if its upper bound reaches the threshold.
Groups are then solved locally (one matrix product for each piece) and merged.

Cells and query groups are cut into slices of bounded size by a hash of a row number, so that a common vector or id,
however often it occurs, does not meet in one task. Only summaries come to the driver: at most PIVOTS rows and PIVOTS * (k + 1)
distances; the plan of pairs has at most PIVOTS ** 2 rows and is broadcast.

In many dimensions the bounds are loose and most cells pass: the join then costs |queries| * |data| products, as any
exact method does, spread evenly.

Cases: vectors that are null, or hold null or non-finite components, or ones beyond 62 bits, take no part, nor do null
ids; scores that do not fit into 64 bits are given, and ranked, as the nearest number that does; a shorter vector counts as padded with zeros; ties go to the smaller id; a row is no candidate of queries with its
own id; rows with a repeated id are candidates each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import bounded, read, written

#: Most pivots; vectors in a slice of a cell; queries in a slice of a group; queries multiplied at once.
PIVOTS, SLICE, QUERIES, BLOCK = 256, 20_000, 20_000, 128
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integers(values: list[float | None] | None, scale: float) -> np.ndarray | None:
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64) * scale
    if not np.isfinite(x).all() or (np.abs(x) >= 2.0**62).any():
        return None
    return np.floor(x).astype(np.int64)


def stack(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(packed), dim), np.int64)
    for i, b in enumerate(packed):
        v = np.frombuffer(b, np.int64)
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products, held within 64 bits: in floating point where every partial sum is below 2 ** 53, else in Python's integers."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, _LOW, _HIGH).astype(np.int64)


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of each query's k best among x, ties to the smaller id."""
    out = []
    for at in range(0, len(q), BLOCK):
        own = slice(at, at + BLOCK)
        s = products(q[own], x)
        allowed = q_ids[own, None] != ids[None, :]
        s = np.where(allowed, s, _LOW)
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), _LOW)
        rows, cols = np.nonzero((s >= least[:, None]) & allowed)
        order = np.lexsort((ids[cols], ~s[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, cols = rows[rank < k], cols[rank < k]
        out.append((rows + at, ids[cols], s[rows, cols]))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, every: int = 100, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, id, score) for the rows whose id is divisible by `every`, against all other rows: a list for each such row,
    also where several have one id."""
    spark = vectors.sparkSession
    bounded(spark)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, v) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i is not None and (v := integers(x, scale)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["id", "v"])

    ready = written(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>")).mapInArrow(quantise, "id long, v binary"), "topk-vectors")
    n, longest = ready.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    dim = longest // 8
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    query = F.col("id") % every == 0
    count = pivots or max(1, min(PIVOTS, round(math.sqrt(n) / 14)))
    centres = np.unique(stack([r.v for r in ready.orderBy(F.xxhash64("id"), "id").limit(count).collect()], dim), axis=0).astype(float)
    groups = min(len(centres), -(-ready.where(query).count() // QUERIES)) or 1
    heads = np.linspace(0, len(centres) - 1, groups).round().astype(int)  # the pivots that queries are grouped by

    def nearest_of(x: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ((some**2).sum(1) - 2 * x @ some.T).argmin(1)
        return at, np.sqrt(((x - some[at]) ** 2).sum(1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stack(batch.column(1).to_pylist(), dim).astype(float)
            if not len(x):
                continue
            cell, d = nearest_of(x, centres)
            head, u = nearest_of(x, centres[heads])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d), pa.array(heads[head], pa.int32()), pa.array(u), pa.array(np.sqrt((x**2).sum(1)))], ["id", "v", "cell", "d", "qcell", "u", "norm"])

    cells = written(ready.mapInArrow(assign, "id long, v binary, cell int, d double, qcell int, u double, norm double").withColumn("row", F.monotonically_increasing_id()), "topk-cells")
    nearest = cells.groupBy("cell", "id").agg(F.min("d").alias("d"))
    near = nearest.select("cell", "id", "d", F.row_number().over(Window.partitionBy("cell").orderBy("d", "id")).alias("r")).where(F.col("r") <= k + 1).collect()
    sums = {r.cell: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()}
    asking = {r.qcell: r for r in cells.where(query).groupBy("qcell").agg(F.count("*").alias("nq"), F.max("u").alias("u"), F.max("norm").alias("norm")).collect()}
    plan = pairs(centres, sums, asking, [(r.cell, r.id, r.d) for r in near], k)
    if not plan:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    plan = F.broadcast(spark.createDataFrame(plan, "qcell int, cell int, upper double, norm double, least double, slices int, qslices int"))
    place = lambda n: F.pmod(F.xxhash64(F.lit(1), "row"), F.col(n)).cast("int")
    data = cells.select("row", "id", "v", "cell", "d").join(plan, "cell").where(F.col("upper") + F.col("norm") * F.col("d") >= F.col("least"))
    data = data.select("qcell", "cell", place("slices").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("qslices") - 1)).alias("qslice"), "id", "v")
    asked = cells.where(query).select("qcell", "id", "v", "row").join(plan, "qcell")
    asked = asked.select(F.col("qcell").alias("a"), place("qslices").alias("b"), F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("e"), F.col("id").alias("query"), F.col("row").alias("asker"), F.col("v").alias("q"))

    def solve(one: pa.Table, two: pa.Table) -> pa.Table:
        q, x = stack(one["q"].to_pylist(), dim), stack(two["v"].to_pylist(), dim)
        ids, askers = np.array(one["query"], np.int64), np.array(one["asker"], np.int64)
        at, other, score = best(ids, q, np.array(two["id"], np.int64), x, k) if len(q) and len(x) else [np.zeros(0, np.int64)] * 3
        return pa.table({c: pa.array(v, pa.int64()) for c, v in (("asker", askers[at]), ("query_id", ids[at]), ("id", other), ("score", score))})

    local = asked.groupBy("a", "b", "c", "e").cogroup(data.groupBy("qcell", "qslice", "cell", "slice")).applyInArrow(solve, "asker long, query_id long, id long, score long")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id")).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def pairs(centres: np.ndarray, sums: dict, asking: dict, near: list[tuple[int, int, float]], k: int) -> list[tuple]:
    """(query group, cell, upper bound without the vector's own distance, largest query norm, threshold, slices) of the pairs to join."""
    out = []
    for a, own in asking.items():
        dots, norms = centres @ centres[a], np.sqrt((centres**2).sum(1))
        slack = 1e-6 * (1 + np.abs(dots).max() + own.u * norms.max() + own.norm * max(s.radius for s in sums.values()))
        of_id: dict[int, float] = {}
        for c, i, d in near:
            bound = float(dots[c] - own.u * norms[c] - own.norm * d)
            of_id[i] = max(bound, of_id.get(i, bound))
        low = sorted(of_id.values(), reverse=True)
        least = float(low[k] - slack) if len(low) > k else -np.inf
        least = min(least, 2.0**63 * (1 - 1e-6)) if least > -(2.0**63) else -np.inf  # scores held at 64 bits tie
        for c, s in sums.items():
            upper = float(dots[c] + own.u * norms[c])
            if upper + own.norm * s.radius >= least:
                out.append((a, c, upper, float(own.norm), least, -(-s.n // SLICE), -(-own.nq // QUERIES)))
    return out


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS "rank", vec_id, score FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""
