"""What the queries share: the tables, the items of documents, and queries of one function on every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.plans.registry import query

def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, pos, text): the sentences and lines of all documents."""
    parts = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "[.\\n]+")).alias("pos", "t"))
    return parts.select("doc_id", "source", "lang", F.col("pos").cast("long"), F.trim("t").alias("text")).where("text <> ''")


#: The same relation in SQL.
ITEMS = """(SELECT doc_id, source, lang, pos, trim(t) AS text FROM (
  SELECT doc_id, source, lang, unnest(string_split_regex(text, '[.\\n]+')) AS t, generate_subscripts(string_split_regex(text, '[.\\n]+'), 1) - 1 AS pos FROM documents
) WHERE trim(t) <> '')"""

SPACES = "[ \\t\\n\\r\\f\\v]+"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def wordlist(x: str) -> str:
    return f"list_filter(string_split({squeezed(x)}, ' '), lambda w: w <> '')"


def scalar(name: str, expression, sql: str | None, given: str = "text", base: str = "documents") -> None:
    """A query that applies one function to every row of documents (or items): `given` is SQL that both engines read."""
    keys = ["doc_id"] if base == "documents" else ["doc_id", "pos"]

    def run(spark, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents") if base == "documents" else items(spark, sf_dir)
        return rows.select(*keys, F.expr(given).alias("x")).select(*keys, expression(F.col("x")).alias("v"))

    source = "documents" if base == "documents" else ITEMS
    query(name, sql and f"SELECT {', '.join(keys)}, {sql} AS v FROM (SELECT {', '.join(keys)}, {given} AS x FROM {source})")(run)
