"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

A source's documents are permuted by a hash of their ids and texts and cut into blocks (hash ranges). A source's target
gives its exact block quota: whole passes over all its blocks, then the first blocks in permuted order up to a cut. The
cut is found by descending through sums over hash digits (block, sub-block, rows of one sub-block), so no window ever
holds more than one sub-block of one source; the document at the cut gives as many of its first words as are missing.

The block copies that the quotas draw, of all sources together, are the root of a binary tree; each node hands a random
half of its units to either side. Which half is decided by one seeded permutation of all units, whose rank interval is
halved level by level: a node's left half is then a uniform draw without replacement, so its counts by source are
multivariate-hypergeometric, shard quotas are exact, and blocks disjoint. Documents take what the dealt copies of their
block give (dealt()); sharded() brings rows to their shards and shuffles each locally, by a seeded hash.

Only sums per source and block are shuffled, after partial aggregation; the plan has a row for each source and block and
is broadcast up to BROADCAST_ROWS rows, beyond which rows meet it by source and block, that is, evenly even for a hot
source. Source ranks come from range partitions and their counts, targets from sums, unit ranks from hash digits and
their counts: the only windows over everything hold one row per partition or digit.

Cases: null texts have size 0; sources go by code point, null last, and a null source is a source like any other;
sources without words have target 0; repeated ids are separate documents, apart by their texts; rows that repeat both
have one hash, and at the cut they fill what is missing one after the other; no documents give no rows; extra columns
are dropped by the query and kept by mixed() and sharded().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import free, read, shuffles, written

# Weights, repeating over the sources in order.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, most copies of a document, bits of a hash digit (2 ** bits blocks of a source),
#: levels of the tree (2 ** levels shards).
SHARE, MOST, DIGIT, LEVELS, SEED = 1.5, 2, 10, 4, 42
#: Rows of the plan up to which it is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 50_000

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with `number`, from 0 in the order of code points, null last: ranks within range partitions plus the counts before."""
    by = F.col("source").asc_nulls_last()
    parts = sources.repartitionByRange(by).withColumn("p", F.spark_partition_id())
    parts = written(parts.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(by)) - 1), "mix-numbers")
    before = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(F.col("p").alias("q"), (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), F.col("p") == F.col("q")).withColumn("number", F.col("before") + F.col("r")).drop("p", "q", "r", "before")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with `target`: shares by weight, each at most `most` sizes, the excess reshared by weight.

    A target is least(cap, level * weight); the level rises round by round, as sources fill up, and each round is one sum.
    """
    w = F.array(*(F.lit(float(x)) for x in weights))
    rows = numbered(sources).select("source", "source_size", F.element_at(w, (F.col("number") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    rows = written(rows, "mix-weights")
    level, full = 0.0, -1
    while True:
        is_full = F.col("cap") <= level * F.col("weight")
        got = rows.agg(F.sum("source_size").alias("size"), F.sum(F.when(is_full, F.col("cap"))).alias("capped"), F.sum(F.when(~is_full, F.col("weight"))).alias("open"), F.count_if(is_full).alias("full")).first()
        if not got.open or got.full == full:
            break
        full, level = got.full, (got.size * share - (got.capped or 0.0)) / got.open
    target = F.least("cap", F.lit(level) * F.col("weight")) if got.open else F.col("cap")
    return rows.select("source", "source_size", target.alias("target"))


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _digit(key: Column, n: int) -> Column:
    """The n-th digit of a hash, from the top; digits and then the rest, compared in turn, order hashes."""
    return F.shiftrightunsigned(key, 64 - DIGIT * n).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    return {"source": F.col(source_col), "size": word_count(text_col), "key": key, "block": _digit(key, 1), "sub": _digit(key, 2)}


def _reached(sums: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Where the running sum of words, in the order of `by`, passes what is wanted (s, left) of a source: that row's by,
    and what is left of it there. sums: (source, by, words), few rows for each source."""
    running = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    both = sums.withColumn("upto", F.sum("words").over(running)).join(wanted, F.col("source").eqNullSafe(F.col("s")))
    both = both.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
    return both.withColumn("left", F.col("left") - F.col("upto") + F.col("words")).drop("upto", "words", "source")


def quotas(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Of (source, size, key, block, sub): words by source and block; and a row for each source with its target, whole
    passes, and where the pass after them is cut (block, sub-block, key, words of the rows there, how many tie)."""
    blocks = written(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = written(sources.withColumn("passes", passes), "mix-sources")
    wanted = sources.select(F.col("source").alias("s"), (F.round("target") - F.col("passes") * F.col("source_size")).cast("long").alias("left"))
    cut = _small(written(_reached(blocks, wanted, "block"), "mix-cut").withColumnRenamed("block", "cut_block"))
    inside = rows.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("cut_block")))
    cut = _small(written(_reached(inside.groupBy("source", "sub").agg(F.sum("size").alias("words")), cut, "sub"), "mix-cut").withColumnRenamed("sub", "cut_sub"))
    inside = rows.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("cut_block")) & (F.col("sub") == F.col("cut_sub")))
    sums = inside.groupBy("source", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("ties"))
    at = _reached(sums, cut, "key").withColumnsRenamed({"key": "cut_key", "left": "cut_words"})
    return blocks, written(sources.join(at, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-quotas")


def split(units: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(source, block, copy) with `shard` below 2 ** levels: at each node of the tree, a random half of the units goes left.

    Ranks in a seeded permutation come from hash digits, their counts and the order within a digit; the halves of a
    node are those of its rank interval, an odd unit going left or right by the node's own hash.
    """
    key = F.xxhash64(F.lit(seed + 1), "source", "block", "copy")
    rows = written(units.withColumns({"k": key, "digit": _digit(key, 1)}), "mix-units")
    counts = rows.groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("digit").alias("d"), (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("size"))
    rank = F.row_number().over(Window.partitionBy("digit").orderBy("k", F.col("source").asc_nulls_last(), "block", "copy")) - 1
    out = rows.withColumn("rank", rank).join(F.broadcast(before), F.col("digit") == F.col("d"))

    def down(node: Column, level: Column) -> Column:
        odd = F.pmod(F.xxhash64(F.lit(seed - 1), level, node["shard"]), F.lit(2))
        return bind(F.shiftright(node["size"] + odd, 1), lambda half: F.when(node["rank"] < half, F.struct((node["shard"] * 2).alias("shard"), node["rank"].alias("rank"), half.alias("size"))).otherwise(F.struct((node["shard"] * 2 + 1).alias("shard"), (node["rank"] - half).alias("rank"), (node["size"] - half).alias("size"))))

    root = F.struct(F.lit(0).alias("shard"), (F.col("rank") + F.col("before")).alias("rank"), F.col("size").alias("size"))
    out = out.withColumn("shard", F.aggregate(F.sequence(F.lit(1), F.lit(levels)) if levels else F.array().cast("array<int>"), root, down)["shard"])
    return out.select(*units.columns, "shard")


def _small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, marked for broadcast if a count shows that it has no more rows than that."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def dealt(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """A row for each source and block (s, b): the source's size, target and cut, and `units`, the drawn copies of the
    block in order, each with its shard and whether it is the copy that the cut goes through (or before it, whole)."""
    blocks, plan = quotas(rows, weights, share, most)
    plan = plan.select(F.col("source").alias("s"), *(c for c in plan.columns if c != "source"))
    every = blocks.join(_small(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words")
    whole = F.col("passes") + F.when(F.col("block") < F.col("cut_block"), 1).otherwise(0)
    n = whole + F.when(F.col("block") == F.col("cut_block"), 1).otherwise(0)
    units = every.withColumns({"n": n, "whole": whole}).where("n > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "whole")
    units = split(units, levels, seed).withColumn("cut", F.col("copy") > F.col("whole"))
    units = units.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", "cut"))).alias("units"))
    units = units.select(F.col("source").alias("s"), F.col("block").alias("b"), "units")
    none = F.array().cast("array<struct<copy:int,shard:int,cut:boolean>>")
    every = every.join(units, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b", "passes")
    return written(every.withColumn("units", F.coalesce("units", none)).withColumnsRenamed({"source": "s", "block": "b"}), "mix-dealt")


def _drawn(rows: DataFrame, plan: DataFrame, x: str = "") -> DataFrame:
    """Rows (with the columns of _keys under the prefix x) joined with their block's row of dealt(), and `part`: the words
    that a copy with the cut in it takes of each row (before the cut all, at it what is missing). Where rows tie at a
    cut, these alone are ranked, and fill it one after the other."""
    tied = plan.where(F.col("ties") > 1).limit(1).count() > 0
    plan = _small(plan.select(*(F.col(c).alias(f"{x}{c}") for c in plan.columns)))
    of = lambda c: F.col(f"{x}{c}")
    both = rows.join(plan, of("source").eqNullSafe(of("s")) & (of("block") == of("b")))
    here = F.coalesce((of("block") == of("cut_block")) & (of("key") == of("cut_key")), F.lit(False))
    before = (of("sub") < of("cut_sub")) | ((of("sub") == of("cut_sub")) & (of("key") < of("cut_key")))
    first = F.when(before, of("size")).otherwise(F.lit(0)).cast("long")
    at = lambda left: F.greatest(F.lit(0), F.least(of("size"), left)).cast("long")
    if not tied:
        return both.withColumn(f"{x}part", F.when(here, at(of("cut_words"))).otherwise(first))
    filled = F.coalesce(F.sum(of("size")).over(Window.partitionBy(of("source")).orderBy(of("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return both.where(here).withColumn(f"{x}part", at(of("cut_words") - filled)).union(both.where(~here).withColumn(f"{x}part", first))


def _gives(unit: Column, x: str = "") -> Column:
    """The words that one copy of its block takes of a row."""
    return F.when(unit["cut"], F.col(f"{x}part")).otherwise(F.col(f"{x}size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """A row for each document: id, size, source_size, target, taken, and shards (an array: one for each copy that takes
    words of it). taken is the sum over those copies."""
    rows = written(docs.select(F.col(id_col).alias("id"), *(v.alias(k) for k, v in _keys(docs, id_col, text_col, source_col, seed).items())), "mix-rows")
    out = _drawn(rows, dealt(rows, weights, share, most, levels, seed))
    taken = F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + _gives(u))
    shards = F.transform(F.filter("units", lambda u: _gives(u) > 0), lambda u: u["shard"])
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """The mix itself, with `shard`: rows of docs, one for each copy that takes words of them, brought to their shards and
    shuffled there by a seeded hash (a shard's rows in as many slices as there are partitions for it). The document at a
    source's cut keeps the first words that the cut takes, joined by spaces; all others are whole."""
    x = free(docs)
    keys = {f"{x}{k}": v for k, v in _keys(docs, id_col, text_col, source_col, seed).items()}
    rows = written(docs.select(*(v.alias(k[len(x) :]) for k, v in keys.items())), "mix-rows")
    both = _drawn(docs.withColumns(keys), dealt(rows, weights, share, most, levels, seed), x)
    own = F.filter(F.col(f"{x}units"), lambda u: _gives(u, x) > 0)
    both = both.withColumn(f"{x}u", F.explode(own))
    cut = F.col(f"{x}u.cut") & (F.col(f"{x}part") < F.col(f"{x}size"))
    some = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col(f"{x}part").cast("int")), " ")
    both = both.withColumns({text_col: F.when(cut, some).otherwise(F.col(text_col)), f"{x}order": F.xxhash64(F.lit(seed + 2), f"{x}u.shard", f"{x}u.copy", f"{x}key")})
    n = shuffles(docs.sparkSession)
    slices = max(1, math.ceil(n / 2**levels))
    both = both.withColumn(f"{x}slice", F.pmod(F.col(f"{x}order"), F.lit(slices)))
    both = both.repartition(n, F.col(f"{x}u.shard"), F.col(f"{x}slice")).sortWithinPartitions(f"{x}u.shard", f"{x}slice", f"{x}order")
    return both.select(*docs.columns, F.col(f"{x}u.shard").alias("shard" if "shard" not in docs.columns else f"{x}shard"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """sharded() without the shard: the columns of docs, in the order of the mix."""
    return sharded(docs, **options).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
