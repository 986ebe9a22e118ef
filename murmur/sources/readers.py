"""Readers with explicit schemas; every row keeps what its order depends on (position, chunk, path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The schemas of the engine's files.
ITEM = "id int, text string"
SEGMENT = "struct<id:int,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double>"
TRANSCRIPT = f"audio_file string, duration_seconds double, language string, model string, segment_count int, segments array<{SEGMENT}>"
WORD = "x int, text string, confidence double"
TILE = "tile string, model_id string, headlines array<struct<text:string,confidence:string>>, timing struct<wall_seconds:double,input_tokens:int,output_tokens:int>, cost struct<usd:double>, error string, _corrupt_record string"
RESULT = "struct<provider:string,model_id:string,display_name:string,summary:string,input_tokens:int,output_tokens:int,latency_seconds:double,status:string,error:string,timestamp:string>"
RUN = f"run_timestamp string, news_items_count int, news_items_source string, results array<{RESULT}>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items of a JSON array (or of JSON lines, which split), trimmed, none empty; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], ITEM)
    return spark.read.schema(ITEM).json(path, multiLine=not lines).withColumn("text", F.trim("text")).where("text <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text): lines that are neither blank nor comments, in their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "t"))
    return whole.select("path", F.col("pos").cast("long"), F.trim(F.regexp_replace("t", "\r$", "")).alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))


def read_chunks(spark: SparkSession, pattern: str) -> DataFrame:
    """(chunk, text) of whole text files whose folder names the chunk; empty ones are left out."""
    x = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\s+|\\s+$", "").alias("text"))
    return x.select(F.try_to_number(F.regexp_extract("path", "chunk_([0-9]+)", 1), F.lit("999999")).cast("int").alias("chunk"), "path", "text").where("text <> ''")


def read_segments(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(TRANSCRIPT).json(path, multiLine=not lines).select("audio_file", F.inline("segments"))


def read_words(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(x, text, confidence, status): the words of a file; one row with a status alone where it is missing or has none."""
    if not exists(spark, path):
        return spark.createDataFrame([(None, None, None, "missing")], f"{WORD}, status string")
    found = spark.read.schema(WORD).json(path, multiLine=not lines).where("text is not null").withColumn("status", F.lit("ok"))
    return found if found.limit(1).count() else spark.createDataFrame([(None, None, None, "empty")], found.schema)


def read_tiles(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """(tile, model_id, text, confidence): headlines of tile files; corrupt files, errors and combined files are left out."""
    x = spark.read.schema(TILE).option("mode", "PERMISSIVE").json(folder, multiLine=not lines, pathGlobFilter="*" if lines else "*.json").select("*", F.col("_metadata.file_name").alias("file"))
    good = x.where("_corrupt_record is null and error is null").where(~F.col("file").startswith("headlines_combined"))
    return good.select("tile", "model_id", F.explode_outer("headlines").alias("h")).select("tile", "model_id", "h.text", "h.confidence")


def read_runs(spark: SparkSession, labelled: list[tuple[str, str]], lines: bool = False) -> DataFrame:
    """Results of run files under (label, glob), each with its label; globs without files are left out."""
    found = [spark.read.schema(RUN).json(g, multiLine=not lines).select(F.lit(label).alias("label"), F.inline("results")) for label, g in labelled if exists(spark, g)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else spark.createDataFrame([], f"label string, {RESULT[7:-1].replace(':', ' ')}")


def run_number(path_col: str):
    """The number of a run_<n> folder; null where the name is another."""
    return F.nullif(F.regexp_extract(path_col, "run_([0-9]+)(?:/|$)", 1), F.lit("")).cast("int")


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in the order of names, from the file system's own listing: no file is opened."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or ())


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last path by name."""
    return max(listing(spark, pattern), default=None)


def read_latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The run that the newest pointer in the folder names (writers.write_run), None before the first."""
    pointer = newest(spark, f"{folder}/latest.*")
    if pointer is None:
        return None
    return spark.read.json(f"{folder}/{spark.read.text(pointer).first().value}")


def discover_runs(spark: SparkSession, folder: str, name: str = "run_") -> list[tuple[int, str]]:
    """(n, path) of the folders run_<n>, by number; other names are left out."""
    found = ((p.rsplit(f"/{name}", 1)[-1], p) for p in listing(spark, f"{folder}/{name}*"))
    return sorted((int(n), p) for n, p in found if n.isascii() and n.isdigit())


def preferred(spark: SparkSession, pattern: str, *parts: str) -> str | None:
    """The first path by name that holds one of these parts, else the first of all; None where nothing matches."""
    found = listing(spark, pattern)
    return next((p for p in found if any(x in p.rsplit("/", 1)[-1] for x in parts)), found[0] if found else None)
