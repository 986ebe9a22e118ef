"""Sinks: numbered items, timestamped runs with a latest alias, text chunks, subtitles, report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.text import srt_time
from murmur.operators.rounds import ranked


def with_ids(items: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Ids from 1 in each group."""
    return items.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def write_items(items: DataFrame, path: str, order: list[str], by: list[str]) -> None:
    with_ids(items, order, by).select(*by, "id", "text").write.mode("overwrite").partitionBy(*by).json(path)


def write_run(df: DataFrame, folder: str, stamp: str) -> None:
    """A folder of its own for each run, and a pointer to the latest one.

    The run is written under a hidden name, which listings leave out, and becomes visible by one rename; the pointer is a new file
    for each commit, itself visible by one rename, and readers (readers.read_latest) follow the newest. A crash at any step
    leaves the former run the latest; a run that is written again takes the place of its former rows.
    """
    spark = df.sparkSession
    own = uuid.uuid4().hex
    hidden = f"{folder}/_writing-{own}"
    df.write.json(hidden)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    files = path(folder).getFileSystem(conf)

    def move(old: str, new: str) -> None:
        if not files.rename(path(old), path(new)):
            raise OSError(f"{old} cannot become {new}")

    target = f"{folder}/run_ts={stamp}"
    if files.exists(path(target)):
        move(target, f"{folder}/_former-{own}")
    move(hidden, target)
    said = max((int(p.getPath().getName().split(".")[1]) for p in files.globStatus(path(f"{folder}/latest.*")) or ()), default=0)
    spark.createDataFrame([(f"run_ts={stamp}",)], "value string").coalesce(1).write.text(f"{folder}/_pointer-{own}")
    move(f"{folder}/_pointer-{own}", f"{folder}/latest.{said + 1:012d}")


def srt(segments: DataFrame, by: list[str]) -> DataFrame:
    """Subtitle records (number, times, text) of each group, in order."""
    w = Window.partitionBy(*by).orderBy("start", "id")
    return segments.select(*by, F.row_number().over(w).alias("n"), F.concat_ws("\n", F.row_number().over(w).cast("string"), F.concat(srt_time("start"), F.lit(" --> "), srt_time("end")), F.trim("text"), F.lit("")).alias("value"))


def write_chunks(segments: DataFrame, path: str, seconds: int = 900) -> None:
    """One text for each time chunk, under a two-line header, in folders by chunk."""
    chunk = F.floor(F.col("start") / seconds).cast("int")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: F.trim(x["text"])), "\n")
    out = segments.groupBy(chunk.alias("chunk_idx")).agg(F.count("*").alias("n"), text.alias("body"))
    out.select("chunk_idx", F.concat(F.format_string("# chunk %03d\n# segments %d\n", "chunk_idx", "n"), F.col("body")).alias("value")).write.mode("overwrite").partitionBy("chunk_idx").text(path)


def write_text(segments: DataFrame, path: str, by: list[str]) -> None:
    """The transcript of each group as text, a segment a line, in folders by group."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: F.trim(x["text"])), "\n")
    segments.groupBy(*by).agg(lines.alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def python_round(value: float | None, places: int) -> float | None:
    """Rounding as reports have it: the double nearest to the decimal, ties of the double itself to even."""
    return None if value is None else round(value, places)


def percent(value: float | None, places: int = 1) -> str:
    return "n/a" if value is None or value != value else f"{python_round(100 * value, places):.{places}f} %"


def _cells(df: DataFrame, most: int) -> list[list[str]]:
    """Header and rows of a report; a result of more rows than a report may have is an error, never cut."""
    show = lambda v: "n/a" if v is None or v != v else f"{python_round(v, 4):.4f}" if isinstance(v, float) else str(v)
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most; write a larger result to a table")
    return [list(df.columns), *(list(map(show, r)) for r in rows)]


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of a small result; missing values as n/a."""
    head, *rows = ("| " + " | ".join(r) + " |" for r in _cells(df, most))
    return "\n".join([head, "|" + "---|" * len(df.columns), *rows])


def ascii_table(df: DataFrame, most: int = 1000) -> str:
    """The same in columns of even width."""
    cells = _cells(df, most)
    wide = [max(map(len, c)) for c in zip(*cells, strict=True)]
    head, *rows = ("  ".join(v.ljust(n) for v, n in zip(r, wide, strict=True)).rstrip() for r in cells)
    return "\n".join([head, "-" * (sum(wide) + 2 * (len(wide) - 1)), *rows])


def stats_documents(rows: DataFrame, by: str, fields: dict) -> DataFrame:
    """(value): a JSON document of statistics for each group; fields are aggregates, or dicts of them for nested parts."""
    flat = {k if not isinstance(v, dict) else f"{k}.{n}": x for k, v in fields.items() for n, x in (v.items() if isinstance(v, dict) else [("", v)])}
    made = rows.groupBy(by).agg(*(x.alias(n) for n, x in flat.items()))
    part = lambda k, v: F.struct(*(F.col(f"`{k}.{n}`").alias(n) for n in v)).alias(k) if isinstance(v, dict) else F.col(k)
    return made.select(F.to_json(F.struct(by, *(part(k, v) for k, v in fields.items()))).alias("value"))


def write_variants(results: DataFrame, variant: str, order: tuple[str, ...], folder: str) -> None:
    """The results of each variant as JSON lines in a folder of its own, each with its number `n` in the variant (from 1).

    Lines are in order within a file and no task gathers a variant: rows are numbered and cut by ranges, so that a large
    variant is many files, whose names follow the order. Null variants go to the default folder.
    """
    numbered = ranked(results, [variant], [F.col(c) for c in order], "n")
    keys = [F.col(variant).asc_nulls_first(), F.col("n")]
    numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy(variant).json(folder)
