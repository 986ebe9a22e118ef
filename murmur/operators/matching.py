"""Best-match joins under string similarity, and the measures that follow from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import fuzzy
from murmur.functions.quality import bind

#: Characters of reference texts that are sent to every task; more go in blocks of that size, each to the tasks that hold it.
BLOCK_CHARS = 4_000_000
#: Characters of the other side that meet a block in one task, where there are several blocks.
PART_CHARS = 32_000_000
#: Characters of texts times characters of references that one task takes on, about.
TASK_WORK = 400_000_000_000
#: Characters of reference texts that are matched at once.
PACKED_CHARS = 100_000
# Thresholds of a match, of an exact and of a covered one, and of a hallucination.
THRESHOLDS, EXACT, COVERED, MATCHED, HALLUCINATED = (60, 70, 80), 95, 50, 70, 60


class Packed:
    """Reference texts side by side in one big integer, each in whole bytes with a free bit above it, so that one pass over
    a text gives the LCS with all of them (bit-parallel; a carry ends in the free bit)."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts])
        width = self.size // 8 + 1
        self.at = np.cumsum(width) - width
        total = int(width.sum())
        tables: dict[str, bytearray] = {}
        full = bytearray(total)
        for t, at in zip(texts, self.at.tolist(), strict=True):
            for i, c in enumerate(t):
                own = tables.get(c)
                if own is None:
                    own = tables[c] = bytearray(total)
                own[at + (i >> 3)] |= 1 << (i & 7)
                full[at + (i >> 3)] |= 1 << (i & 7)
        self.total, self.full = total, int.from_bytes(full, "little")
        self.where = {c: int.from_bytes(t, "little") for c, t in tables.items()}

    def lcs(self, text: str) -> np.ndarray:
        full, where = self.full, self.where.get
        s = full
        for c in text:
            hit = where(c)
            if hit is not None:
                u = s & hit
                s = ((s + u) | (s - u)) & full
        left = np.bitwise_count(np.frombuffer(s.to_bytes(self.total, "little"), np.uint8))
        return self.size - np.add.reduceat(left, self.at)

    def ratio(self, text: str) -> np.ndarray:
        n = self.size + len(text)
        return np.where(n > 0, 200.0 * self.lcs(text) / np.maximum(n, 1), 100.0)


class References:
    """A list of (id, text), ready to be scored against texts; ids ascend."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = sorted(rows)
        self.ids = np.array([i for i, _ in rows], np.int64)
        lots, held = [[]], 0
        for _, t in rows:
            if held > PACKED_CHARS:
                lots.append([])
                held = 0
            lots[-1].append(t)
            held += len(t) + 8
        self.lots = [(Packed(lot), Packed([fuzzy.token_sort(t) for t in lot])) for lot in lots if lot]

    def scores(self, text: str) -> np.ndarray:
        """similarity of a text with each reference."""
        own = fuzzy.token_sort(text)
        return np.concatenate([np.maximum(a.ratio(text), b.ratio(own)) for a, b in self.lots])


def best_of(refs: References, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Of rows (slice values ..., id, text), in lists: for each row its best reference, and at the end, for each slice and
    reference, its best row; as (slice values ..., side, id, other, score). Ties go to the smaller other id."""
    best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for batch in rows:
        out = []
        for *by, rid, text in batch:
            s = refs.scores(text)
            at = int(s.argmax())  # the first of equals has the smallest id
            out.append((*by, "r", rid, int(refs.ids[at]), float(s[at])))
            top, other = best.setdefault(tuple(by), (np.full(len(s), -1.0), np.zeros(len(s), np.int64)))
            win = (s > top) | ((s == top) & (rid < other))
            top[win], other[win] = s[win], rid
        yield out
    yield [(*by, "l", int(i), int(o), float(s)) for by, (top, other) in best.items() for i, o, s in zip(refs.ids, other, top, strict=True)]


def best_matches(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by ..., side, id, other, score): for each row of left (id, text) its best row of right (by ..., id, text) in each
    slice (side "l"), and for each row of right its best row of left ("r"). Rows without a text take no part.

    left is the reference list. It goes to the tasks in blocks of bounded size: a single one, checked by its characters,
    with the function; several by a grouped join of blocks and parts of right, without a cross join. Either way one
    function scores a text against a whole block in one pass, and each task emits best rows only, which an aggregate
    merges; the same result at every size.
    """
    refs = left.select("id", "text").where("text is not null")
    rows = right.select(*by, "id", "text").where("text is not null")
    chars = lambda df: df.agg(F.coalesce(F.sum(F.length("text") + 8), F.lit(0))).first()[0]
    held, size = chars(refs), chars(rows)
    blocks = math.ceil(held / BLOCK_CHARS)
    shares = math.ceil(size * min(held, BLOCK_CHARS) / TASK_WORK)  # tasks that a block's work is spread over
    schema = T.StructType([*(right.schema[c] for c in by), *(T.StructField(n, t) for n, t in (("side", T.StringType()), ("id", T.LongType()), ("other", T.LongType()), ("score", T.DoubleType())))])
    names = schema.names

    if blocks <= 1:
        few = [(r.id, r.text) for r in refs.collect()]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if few:
                for out in best_of(References(few), (b.itertuples(index=False, name=None) for b in batches)):
                    yield pd.DataFrame(out, columns=names)

        n = max(right.sparkSession.sparkContext.defaultParallelism, shares)
        rows = rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows  # a table in few files leaves cores idle, or tasks long
        found = rows.mapInPandas(run, schema)
    else:
        parts = max(1, math.ceil(size / PART_CHARS), shares)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        one = refs.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), "id", "text")
        two = rows.select("*", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int").alias("__part"), every(blocks).alias("__block"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame([], columns=names)
            held = b[[*by, "id", "text"]].itertuples(index=False, name=None)
            return pd.DataFrame([x for out in best_of(References(list(zip(a["id"], a["text"], strict=True))), iter([held])) for x in out], columns=names)

        found = one.groupBy("block", "part").cogroup(two.groupBy("__block", "__part")).applyInPandas(meet, schema)
    order = F.struct(F.col("score"), -F.col("other"))
    return found.groupBy(*by, "side", "id").agg(F.max_by(F.struct("other", "score"), order).alias("b")).select(*by, "side", "id", "b.other", "b.score")


def scored(matches: DataFrame, side: str, rows: DataFrame) -> DataFrame:
    """Every row of one side with its best partner: -1 and 0 where there is none."""
    own = matches.where(F.col("side") == side).select("id", "other", "score")
    return rows.join(own, "id", "left").withColumns({"other": F.coalesce("other", F.lit(-1).cast("long")), "score": F.coalesce("score", F.lit(0.0))})


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def prf(matches: DataFrame, gt: DataFrame, ext: DataFrame, by: tuple[str, ...] = (), thresholds=THRESHOLDS) -> DataFrame:
    """Precision (over extracted rows), recall (over reference rows) and F1 at each threshold, in each slice of ext.

    Both sides come from one aggregate over the matches, so these are computed once; rows without a partner count as
    not matched, by the sizes of the tables. Slices are those that ext has rows of.
    """
    hits = matches.groupBy(*by).agg(*(F.count_if((F.col("side") == side) & (F.col("score") >= t)).alias(f"{side}{t}") for side in "lr" for t in thresholds))
    hits = hits.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in hits.columns if c not in by))
    sizes = ext.groupBy(*by).agg(F.count("*").alias("n_ext")).crossJoin(F.broadcast(gt.agg(F.count("*").alias("n_gt"))))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    counts = sizes.join(hits, on, "left") if by else sizes.crossJoin(F.broadcast(hits))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    each = [F.struct(F.lit(t).alias("threshold"), n(f"l{t}").alias("tp_gt"), n(f"r{t}").alias("tp_ext"), (n("n_gt") - n(f"l{t}")).alias("fn"), (n("n_ext") - n(f"r{t}")).alias("fp"), share(n(f"r{t}"), n("n_ext")).alias("precision"), share(n(f"l{t}"), n("n_gt")).alias("recall")) for t in thresholds]
    return counts.select(*by, F.explode(F.array(*each)).alias("x")).select(*by, "x.*").withColumn("f1", f1(F.col("precision"), F.col("recall")))


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate; an empty reference gives 0 or 1."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


@F.pandas_udf(T.DoubleType())
def wer(ref_words: pd.Series, hyp_words: pd.Series) -> pd.Series:
    """Word error rate of two arrays of words; an empty reference gives 0 or 1, a null array null."""
    rate = lambda a, b: None if a is None or b is None else fuzzy.edit_distance(a, b) / len(a) if len(a) else float(len(b) > 0)
    return pd.Series([rate(a, b) for a, b in zip(ref_words, hyp_words, strict=True)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("wer", "cer", "mer", "wil")] + [T.StructField(c, T.IntegerType()) for c in ("ref_words", "hyp_words", "ref_chars", "hyp_chars")]))
def asr_metrics(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Word and character error rates, match error rate and word information lost."""
    out = []
    for a, b in zip(ref, hyp, strict=True):
        x, y = (a or "").split(), (b or "").split()
        d, hits = fuzzy.error_counts(x, y)
        n, m = len(x), len(y)
        extra = d - (n - hits)
        c, k = " ".join(x), " ".join(y)
        out.append((d / n if n else float(m > 0), fuzzy.edit_distance(c, k) / len(c) if c else float(bool(k)), d / (n + extra) if n + extra else 0.0, 1 - hits / n * hits / m if n and m else float(bool(n or m)), n, m, len(c), len(k)))
    return pd.DataFrame(out, columns=["wer", "cer", "mer", "wil", "ref_words", "hyp_words", "ref_chars", "hyp_chars"])


def rouge_n(tokens_ref: Column, tokens_hyp: Column, n: int) -> Column:
    """F of n-gram overlap, as multisets: grams are sorted and numbered within their run, so that multisets meet as sets."""
    grams = lambda t: F.when(F.size(t) >= n, F.array_sort(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " ")))).otherwise(F.array().cast("array<string>"))
    numbered = lambda g: bind(g, lambda x: F.transform(x, lambda w, i: F.concat(w, F.lit("\u0000"), (i - F.array_position(x, w)).cast("string"))))
    shared, a, b = F.size(F.array_intersect(numbered(grams(tokens_ref)), numbered(grams(tokens_hyp)))), F.greatest(F.size(tokens_ref) - (n - 1), F.lit(0)), F.greatest(F.size(tokens_hyp) - (n - 1), F.lit(0))
    return f1(share(shared, b), share(shared, a))


@F.pandas_udf(T.DoubleType())
def rouge_l(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """F of the longest common subsequence of two token arrays."""
    out = []
    for a, b in zip(ref, hyp, strict=True):
        a, b = list(a), list(b)
        n = fuzzy.lcs(a, b)
        p, r = n / len(b) if b else 0.0, n / len(a) if a else 0.0
        out.append(2 * p * r / (p + r) if n else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else [fuzzy.stem(w) for w in t])


def best_cosine(refs: DataFrame, others: DataFrame, by: str, slice_rows: int = 4096) -> DataFrame:
    """(by, id, best): for each vector of refs (by, id, e) the largest cosine with vectors of others (by, e) of its group.

    Both sides are cut into slices by row, as many as keep them under about slice_rows rows, and meet slice by slice, so
    that a large group is spread over tasks; partial maxima are merged by an aggregate.
    """
    most = lambda df: df.groupBy(by).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    n, m = math.ceil(most(refs) / slice_rows), math.ceil(most(others) / slice_rows)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = refs.select(by, "id", "e", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("s"), every(m).alias("t"))
    two = others.select(F.col(by).alias("__by"), F.pmod(F.xxhash64("e"), F.lit(m)).cast("int").alias("__t"), F.col("e").alias("f"), every(n).alias("__s"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({by: [], "id": [], "best": []})
        x, y = (np.array([list(v) for v in c], float) for c in (a["e"], b["f"]))
        x, y = (z / np.sqrt((z * z).sum(1, keepdims=True)) for z in (x, y))
        best = np.concatenate([(x[i : i + 256] @ y.T).max(1) for i in range(0, len(x), 256)])
        return pd.DataFrame({by: a[by], "id": a["id"], "best": best})

    schema = f"{by} {refs.schema[by].dataType.simpleString()}, id {refs.schema['id'].dataType.simpleString()}, best double"
    found = one.groupBy(by, "s", "t").cogroup(two.groupBy("__by", "__s", "__t")).applyInPandas(run, schema)
    return found.groupBy(by, "id").agg(F.max("best").alias("best"))


def rouge_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")
