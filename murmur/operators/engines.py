"""Recognisers over files: what an engine must offer, and running one over a table of files. Engines are plain classes that
are made on the executors, once for each task; those that need pixels or a network are the user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import parse_headlines


class WordEngine(Protocol):
    """Recognises words: (x, text, confidence 0 to 1) from left to right."""

    name: str

    def run(self, content: bytes) -> list[tuple[int, str, float]]: ...


class HeadlineEngine(Protocol):
    """Answers a prompt about an image with text, which should hold headlines as JSON; and the tokens in and out."""

    name: str
    model_id: str

    def call(self, content: bytes, mime: str, prompt: str) -> tuple[str, int, int]: ...


WORDS = "path string, engine string, full_text string, words array<struct<x:int,text:string,confidence:double>>, wall_seconds double, rss_mb_before double, rss_mb_after double, error string"
ANSWERS = "path string, engine string, model_id string, raw_text string, input_tokens int, output_tokens int, wall_seconds double, error string"


def resident_mb() -> float:
    """Memory that this process holds now, in MB; 0 where the system does not say."""
    import os

    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
    except (OSError, ValueError, AttributeError):
        return 0.0


def recognise(files: DataFrame, engine: Callable[[], WordEngine], separator: str = " ") -> DataFrame:
    """Words of each file (path, content): a record for every file, with an error where the engine raised one, the time that it
    took and the memory of the worker before and after."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine()
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held, began = resident_mb(), time.time()
                words, wrong = [], None
                try:
                    words = sorted(own.run(bytes(content)), key=lambda w: w[0])
                except Exception as e:  # a record for every file
                    wrong = f"{type(e).__name__}: {e}"
                out.append((path, own.name, separator.join(w[1] for w in words), words, time.time() - began, held, resident_mb(), wrong))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WORDS.split(", ")])

    return files.select("path", "content").mapInPandas(run, WORDS)


def timings(records: DataFrame) -> DataFrame:
    """Records of recognise() as timing records: seconds and MB to two places and one, the change of memory, and how much was read."""
    mb = {c: F.round(c, 1).alias(c) for c in ("rss_mb_before", "rss_mb_after")}
    change = F.round(F.col("rss_mb_after") - F.col("rss_mb_before"), 1).alias("rss_mb_delta")
    return records.select("path", "engine", F.round("wall_seconds", 2).alias("elapsed_seconds"), *mb.values(), change, F.length("full_text").alias("text_length_chars"), F.size("words").alias("word_count"), "error")


def resources(records: DataFrame) -> DataFrame:
    """(engine, calls, failed, seconds, slowest, rss_mb_peak, rss_mb_grown): what each engine took over all files, by partial sums."""
    grown = F.col("rss_mb_after") - F.col("rss_mb_before")
    return records.groupBy("engine").agg(F.count("*").alias("calls"), F.count("error").alias("failed"), F.sum("wall_seconds").alias("seconds"), F.max("wall_seconds").alias("slowest"), F.max("rss_mb_after").alias("rss_mb_peak"), F.max(grown).alias("rss_mb_grown"))


def ask(files: DataFrame, engine: Callable[[], HeadlineEngine], prompt: str) -> DataFrame:
    """Answers of an engine for each file, and the headlines parsed from them: a record for every file."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine()
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                began, mime = time.time(), "image/png" if path.lower().endswith(".png") else "image/jpeg"
                try:
                    text, tokens_in, tokens_out = own.call(bytes(content), mime, prompt)
                    out.append((path, own.name, own.model_id, text, tokens_in, tokens_out, time.time() - began, None))
                except Exception as e:  # a record for every file
                    out.append((path, own.name, own.model_id, "", None, None, time.time() - began, f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])
            yield made.astype({"input_tokens": "Int32", "output_tokens": "Int32"})

    answers = files.select("path", "content").mapInPandas(run, ANSWERS)
    none = F.array().cast("array<struct<text:string,confidence:string>>")
    return answers.withColumn("headlines", F.when(F.col("error").isNull(), F.coalesce(parse_headlines("raw_text"), none)).otherwise(none))
