"""Windows over positions: offsets, tiles, centre bands, interval joins, ordered merges, cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.quality import cycle_score
from murmur.functions.text import count_of


def offsets(frames: DataFrame, stream: str, order: tuple[str, ...], value: str, least: float) -> DataFrame:
    """Shift from one frame of a stream to the next (under `least`: 0) and its running sum."""
    w = Window.partitionBy(stream).orderBy(*order)
    d = F.col(value) - F.lag(value).over(w)
    out = frames.withColumn("shift", F.when(F.abs(d) < least, 0.0).otherwise(F.coalesce(d, F.lit(0.0))))
    return out.withColumn("cumulative", F.sum("shift").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def tile_starts(width: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles with a stride of tile - overlap, the last one aligned to the right end; one tile if it is narrow."""
    inner = F.filter(F.sequence(F.lit(0).cast("long"), width.cast("long"), F.lit(tile - overlap).cast("long")), lambda s: s + tile <= width)
    many = F.array_sort(F.array_distinct(F.concat(inner, F.array((width - tile).cast("long")))))
    return F.when(width <= tile, F.array(F.lit(0).cast("long"))).otherwise(many).cast("array<int>")


def center_band(words: DataFrame, x: str, width: Column, size: int = 3000, stride: int = 1500, tail: int = 500, margin: int = 750) -> DataFrame:
    """Words with each slice whose centre band holds them; the first slice keeps its head, the last one its tail.

    A word looks only at the slices that can cover it, found by arithmetic, so there is no range join.
    """
    last = F.greatest(F.floor((width - tail) / stride), F.lit(0)) * stride
    at = F.col(x)
    first = F.greatest(F.floor((at - size) / stride) + 1, F.lit(0))
    out = words.withColumn("slice", F.explode(F.transform(F.sequence(first, F.greatest(F.floor(at / stride), first)), lambda k: k * stride)))
    s = F.col("slice")
    return out.where((s <= last) & (at >= s) & (at < s + size) & ((s == 0) | (at - s >= margin)) & ((s == last) | (at - s < size - margin)))


def interval_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs whose half-open intervals overlap. Both sides go to the buckets that they touch and meet by equality; a pair
    is given in the bucket where the later of the two begins only, so none comes twice."""
    spread = lambda df, lo, hi, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.greatest(F.col(hi) - 1, F.col(lo)) / bucket))))
    one, two = spread(left, *a, "__k"), spread(right, *b, "__m")
    both = one.join(two, F.col("__k") == F.col("__m"))
    return both.where((F.col(a[1]) > F.col(b[0])) & (F.col(a[0]) < F.col(b[1])) & (F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / bucket) == F.col("__k"))).drop("__k", "__m")


def merge_tokens(sources: list[DataFrame], stream: str) -> DataFrame:
    """(stream, text): the tokens (x, pos, token) of all sources in the order of x; on ties earlier sources come first."""
    rows = reduce(DataFrame.unionByName, (s.select(stream, "x", F.lit(i).alias("src"), "pos", "token") for i, s in enumerate(sources)))
    ordered = F.array_sort(F.collect_list(F.struct("x", "src", "pos", "token")))
    return rows.groupBy(stream).agg(F.array_join(F.transform(ordered, lambda t: t["token"]), " ").alias("text"))


def scored_cycles(cycles: DataFrame, stream: str, delimiter: str) -> DataFrame:
    """Cycles (stream, pos, text) with their number, score and rank in the stream; of equal scores the later one leads."""
    w = Window.partitionBy(stream)
    numbered = cycles.withColumns({"cycle": (F.row_number().over(w.orderBy("pos")) - 1).cast("long"), "n": F.count("*").over(w)})
    score = cycle_score(count_of("text", delimiter), F.length("text"), (F.col("cycle") == 0) | (F.col("cycle") == F.col("n") - 1))
    return numbered.withColumn("score", score).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("cycle"))))
