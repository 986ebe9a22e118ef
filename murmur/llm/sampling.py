"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, label, text) of at most `most` labelled ids, those with the smallest hashes; one whole text for each id.

    The sample of labels has at most `most` rows, so it may be broadcast; ids or labels that are null take no part. Of
    several texts with one id, that with the smallest hash counts (the least of each partition first, then of all).
    """
    some = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    if where is not None:
        some = some.where(where)
    some = some.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("own"), F.col("text"))
    found = texts.join(F.broadcast(some), F.col("own") == F.col("id"))
    return found.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
