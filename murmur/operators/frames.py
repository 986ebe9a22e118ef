"""Operators over frames: rows of a stream (a user, a document, a run) in an order. Numbers, running sums and medians go by range
partitions (rounds.scanned), so that a stream may be of any size; the windows that are left are partitioned by the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators.rounds import quantile, scanned

def positions(frames: DataFrame, stream: str, order: tuple[str, ...], name: str = "pos", first: int = 0) -> DataFrame:
    """Frames with their number in the stream, from `first` on."""
    return scanned(frames, [stream], [F.col(c) for c in order], {name: F.lit(1)}).withColumn(name, (F.col(name) - 1 + first).cast("long"))


def with_median(groups: DataFrame, rows: DataFrame, by: str, value: str, name: str, scale: int = 1) -> DataFrame:
    """Groups (a row for each) with the exact median of a value of their rows."""
    middle = quantile(rows, [by], value, 0.5, "__m").withColumnRenamed(by, "__by")
    return groups.join(middle, F.col(by).eqNullSafe(F.col("__by")), "left").select(*groups.columns, (F.col("__m") * scale).alias(name))


def every_nth(frames: DataFrame, n: int, keep: Column | None = None) -> DataFrame:
    """Every n-th frame (by pos), of those that `keep` lets pass."""
    out = frames.where(F.col("pos") % n == 0)
    return out if keep is None else out.where(keep)


def batch(n: int, pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / n).cast("long")


def bucket_min_max(frames: DataFrame, stream: str, value: str, size: int) -> DataFrame:
    """(stream, bucket, low, high) of the full buckets of `size` frames; an incomplete last one is left out."""
    x = frames.groupBy(stream, batch(size).alias("bucket")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    return x.where(F.col("n") == size).drop("n")


def over_floor(rows: DataFrame, kind: str, value: Column, floors: dict[str, float], default: float) -> DataFrame:
    """Rows whose value is over (not at) the floor of their kind."""
    floor = F.lit(default)
    for k, v in floors.items():
        floor = F.when(F.col(kind) == k, v).otherwise(floor)
    return rows.where(value > floor)


def percentages(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, least, largest and median of a share, in percent."""
    sums = rows.groupBy(by).agg((F.avg(value) * 100).alias("avg_conf"), (F.min(value) * 100).alias("min_conf"), (F.max(value) * 100).alias("max_conf"))
    return with_median(sums, rows, by, value, "median_conf", 100)


def fill_rate(rows: DataFrame, by: str, filled: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(filled).alias("filled"), F.count("*").alias("total")).withColumn("rate", F.col("filled") / F.greatest(F.col("total"), F.lit(1)))


def first_write_wins(rows: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key, found by an aggregate (combined before its shuffle)."""
    others = [c for c in rows.columns if c not in (*keys, *order)]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *others), F.struct(*order)).alias("__f"))
    return first.select(*keys, "__f.*")


def deltas(frames: DataFrame, stream: str, order: tuple[str, ...], value: str) -> DataFrame:
    """(stream, n, mean, low, high, median) of the changes from one frame to the next."""
    x = frames.withColumn("__d", F.col(value) - F.lag(value).over(Window.partitionBy(stream).orderBy(*order)))
    sums = x.groupBy(stream).agg(F.count("__d").alias("n"), F.avg("__d").alias("mean"), F.min("__d").alias("low"), F.max("__d").alias("high"))
    return with_median(sums, x, stream, "__d", "median")


def even_sample(frames: DataFrame, stream: str, n: int = 12) -> DataFrame:
    """The frames at n evenly spaced positions of a stream, ends included, each once."""
    sizes = frames.groupBy(stream).agg(F.count("*").alias("__n"))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (n - 1)).cast("long")))
    return sizes.select(stream, F.explode(at).alias("pos")).join(frames, [stream, "pos"])


def progress(frames: DataFrame, stream: str, spent: str) -> DataFrame:
    """Elapsed time up to each frame (by pos), and what is left at the mean pace so far.

    Times as decimals add up exactly, whatever partitions a stream spans; doubles differ in their last bits.
    """
    x = scanned(frames.withColumn("__one", F.lit(1)), [stream], [F.col("pos")], {"elapsed": F.col(spent), "__k": F.col("__one")}, {"__k": "__n"})
    x = x.withColumn("elapsed", F.col("elapsed").cast("double"))
    return x.withColumn("eta", F.col("elapsed") / (F.col("pos") + 1) * (F.col("__n") - F.col("pos") - 1)).drop("__n", "__k", "__one")


def renumber(segments: DataFrame, stream: str, chunk: str, order: tuple[str, ...], seconds: str, chunk_seconds: int) -> DataFrame:
    """Segments numbered over all chunks of a stream, with times from the stream's start."""
    out = positions(segments, stream, (chunk, *order), "segment")
    return out.withColumn("start_sec", F.col(seconds) + F.col(chunk) * chunk_seconds)


def ordered_text(rows: DataFrame, by: str, order: tuple[str, ...], text: str, mark: str = " ") -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(items, lambda x: x["__t"]), mark).alias("text"))


def windows(rows: DataFrame, time: str, width: str, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """(start, segments, ...) of tumbling windows, or sliding ones."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w.alias("w")).agg(F.count("*").alias("segments"), *(v.alias(k) for k, v in aggregates.items())).select(F.col("w.start").alias("start"), "segments", *aggregates)


def chunk_ranges(rows: DataFrame, total: str, size: int) -> DataFrame:
    """One row for each chunk: number, start, end (cut at the total); one chunk at least."""
    n = F.greatest(F.lit(1), F.ceil(F.col(total) / size)).cast("int")
    out = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumns({"start_pos": F.col("chunk") * size, "end_pos": F.least((F.col("chunk") + 1) * size, F.col(total))})


def above_share_of_median(groups: DataFrame, value: str, least: int, share: float) -> DataFrame:
    """Groups of a size of at least that share of the median size, and of `least`."""
    bound = quantile(groups, [], value, 0.5, "__m").select(F.greatest(F.lit(least).cast("long"), F.floor(F.col("__m") * share).cast("long")).alias("__b"))
    return groups.crossJoin(F.broadcast(bound)).where(F.col(value) >= F.col("__b")).drop("__b")


def removal_guard(rows: DataFrame, kept: Column, judged: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows that are kept, or all of them where the judgement (a boolean column kept) removes more than that share."""
    guard = judged.agg((F.count_if("kept") < F.count("*") * (1 - most)).alias("__off"))
    return rows.crossJoin(F.broadcast(guard)).where(F.col("__off") | kept).drop("__off")


def counts_by(rows: DataFrame, by: str, kind: str, names: dict[str, str]) -> DataFrame:
    """A count of each kind beside its group."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(kind) == k).alias(name) for k, name in names.items()))


def first_of_each(rows: DataFrame, by: str, order: tuple[str, ...], n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def large_boxes(boxes: DataFrame, width: str = "w", height: str = "h", least: tuple[int, int] = (10, 5)) -> DataFrame:
    """Boxes that are neither narrower nor lower than the floor."""
    return boxes.where((F.col(width) >= least[0]) & (F.col(height) >= least[1]))


def requests(rows: DataFrame, start: str = "start_sec", end: str = "end_sec", most: float = 1800) -> DataFrame:
    """Requests with `error`: null where valid, or why a range of seconds is not."""
    wrong = F.when(F.col(end) <= F.col(start), "end_sec must be greater than start_sec").when(F.col(end) - F.col(start) > most, "segment too long")
    return rows.withColumn("error", wrong)


@F.pandas_udf(T.StructType([T.StructField("shift", T.IntegerType()), T.StructField("confidence", T.DoubleType())]))
def scroll_match(before, after, most, share):  # noqa: ANN001
    """How far a strip moved left from one frame to the next, and how sure that is: the largest normalised
    cross-correlation of a template (that share of the width, `most` from the right end) over the places it can have moved to."""
    import numpy as np
    import pandas as pd

    out = []
    for a, b, m, p in zip(before, after, most, share, strict=True):
        if a is None or b is None:
            out.append((0, 0.0))
            continue
        a, b = np.asarray(a, float), np.asarray(b, float)
        n = int(len(a) * p)
        one = len(a) - n - m
        two = len(a) - m
        if one < 0:
            one, two = 0, min(n, len(a) - m)
        template, low = a[one:two], max(0, one - m)
        region = b[low : min(len(a), two)]
        if len(template) < 10 or len(region) <= len(template):
            out.append((0, 0.0))
            continue
        t = template - template.mean()
        views = np.lib.stride_tricks.sliding_window_view(region, len(template))
        v = views - views.mean(1, keepdims=True)
        scale = np.sqrt((v * v).sum(1) * (t * t).sum())
        r = np.where(scale > 0, v @ t / np.where(scale > 0, scale, 1), 0.0)
        at = int(r.argmax())
        out.append((one - low - at, float(r[at])))
    return pd.DataFrame(out, columns=["shift", "confidence"]).astype({"shift": "int32"})
