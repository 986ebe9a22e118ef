"""Composite segmentation of recognised streams into items.

Cleaning, cycles, splitting, scoring and filters are built-in expressions over all streams at once; only the greedy
passes run per stream in grouped pandas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.quality import class_improve, cycle_score, garbage_v6, quality_improve, quality_v6
from murmur.functions.text import clean_text, find_delimiter, split_cycles, split_minlen, strip_affixes, strip_affixes_dash
from murmur.operators import dedup as D


def raw_items(streams: DataFrame) -> DataFrame:
    """(stream, pos, text): the best cycle split at the delimiter, then the next two cycles; without cycles the whole text."""
    x = streams.select("stream", clean_text("text").alias("text")).withColumn("d", find_delimiter("text"))
    x = x.select("stream", "text", "d.delimiter", "d.n")
    cycles = x.where("n >= 3").select("stream", "delimiter", F.posexplode(split_cycles("text", 200)).alias("cycle", "c"))
    counts = lambda c: F.floor((F.length(c) - F.length(F.expr("replace(c, delimiter, '')"))) / F.length("delimiter"))
    total = Window.partitionBy("stream")
    cycles = cycles.withColumn("total", F.count("*").over(total)).where("total >= 2")
    scored = cycles.withColumn("score", cycle_score(counts("c"), F.length("c"), (F.col("cycle") == 0) | (F.col("cycle") == F.col("total") - 1)))
    top = scored.withColumn("rank", F.row_number().over(total.orderBy(F.desc("score"), F.desc("cycle")))).where("rank <= 3")
    whole = x.join(top.select("stream").distinct(), "stream", "left_anti").select("stream", F.when(F.col("n") > 0, F.col("delimiter")).otherwise(" - ").alias("delimiter"), F.col("text").alias("c"), F.lit(1).alias("rank"))
    both = top.select("stream", "delimiter", "c", "rank").unionByName(whole)
    parts = both.select("stream", "rank", F.posexplode(F.expr("split(c, concat('\\\\Q', delimiter, '\\\\E'))")).alias("i", "t"))
    return numbered(parts, "rank")


def numbered(parts: DataFrame, first: str) -> DataFrame:
    """(stream, pos, text): parts (stream, first, i, t) numbered in their order in the stream."""
    pos = F.row_number().over(Window.partitionBy("stream").orderBy(first, "i")).cast("long")
    return parts.select("stream", pos.alias("pos"), F.trim("t").alias("text"))


def segment_news(streams: DataFrame) -> DataFrame:
    """Items of each stream (stream, text): split, cleaned, filtered, deduplicated by quality, artifacts of merging removed."""
    raw = raw_items(streams).withColumn("text", strip_affixes("text"))
    counts = raw.groupBy("stream").agg(F.count("*").alias("raw"), F.count_if(garbage_v6("text").isNull()).alias("kept"))
    good = raw.where(garbage_v6("text").isNull()).withColumn("quality", quality_v6("text"))
    unique = D.dedup(good, "v6", "stream")
    gone = D.merge_artifacts(unique.select("stream", F.col("kept_pos").alias("pos"), "text"), "stream").select("stream", F.col("pos").alias("kept_pos"))
    out = unique.join(gone, ["stream", "kept_pos"], "left_anti").join(counts, "stream")
    return out.withColumn("id", F.row_number().over(Window.partitionBy("stream").orderBy("kept_pos")))


def improve_pipeline(streams: DataFrame) -> DataFrame:
    """Items by the other route: all cycles, good and merged ones apart, both deduplicated, merged ones only where no good one covers them."""
    cycles = streams.select("stream", F.posexplode(split_cycles(clean_text("text"), 100)).alias("cycle", "c"))
    parts = cycles.select("stream", "cycle", F.posexplode(split_minlen("c")).alias("i", "t"))
    x = numbered(parts, "cycle").withColumn("text", strip_affixes_dash("text"))
    x = x.withColumns({"kind": class_improve("text"), "quality": quality_improve("text")})
    good, merged = (D.dedup(x.where(F.col("kind") == k), "improve", "stream").select("stream", "pos", "text") for k in ("good", "merged"))
    rest = D.uncovered(merged, good.select("stream", F.col("text").alias("good")), "stream")
    last = D.dedup(good.unionByName(rest).withColumn("quality", quality_improve("text")), "improve", "stream")
    return last.withColumn("quality", quality_improve("text")).withColumn("id", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("quality"), "kept_pos")))
