"""What operators that go in rounds share: written tables, ranks and components of groups of any size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); on a local master without it a temporary
    folder, the same one for the whole session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own[:] = _own or [tempfile.mkdtemp(prefix="murmur-")]
        at = _own[0]
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and lost executors cost no earlier round."""
    at = folder(df.sparkSession, f"rounds/{name}")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def scanned(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """df with running sums in its groups' order, the row itself included, for groups of any size; totals maps a running sum
    to the name of a column with the sum over the whole group.

    Rows are range-partitioned by group and order and written with their partition's number; each partition sums its rows
    by group; sums of the partitions before (a row for each group and partition that it spans) are joined back to the running
    sums within (group, partition). So no task holds more than one partition of a group. Rows that tie on the order may
    swap places; null counts as nothing; sums of doubles depend on where partitions end in their last bits, those of
    decimals and integers do not. Null keys are a group; a column of the name of a sum is replaced.
    """
    spark, totals = df.sparkSession, totals or {}
    df = df.drop(*sums, *totals.values())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = {f"__g{i}": c for i, c in enumerate(sums.values())}
    keys = [F.col(b).asc_nulls_first() for b in by]
    cut = stored(df.withColumns(given).repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "scanned")
    sizes = cut.groupBy(*by, "__part").agg(*(F.coalesce(F.sum(g), F.lit(0)).alias(g) for g in given))
    past = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    before = [F.coalesce(F.sum(g).over(past), F.lit(0)).alias(f"{g}_before") for g in given]
    of = dict(zip(sums, given, strict=True))
    sizes = sizes.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), *before, *(F.sum(of[k]).over(whole).alias(v) for k, v in totals.items()))
    here = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__part") == F.col("__p")]
    both = cut.withColumns({k: F.coalesce(F.sum(g).over(here), F.lit(0)) for k, g in of.items()}).join(sizes, on)
    return both.select(*df.columns, *((F.col(k) + F.col(f"{g}_before")).alias(k) for k, g in of.items()), *totals.values())


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row in its group, as row_number() would give it, for groups of any size (scanned)."""
    return scanned(df, by, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))


def quantile(df: DataFrame, by: list[str], value: str, share: float = 0.5, name: str = "quantile") -> DataFrame:
    """(by, name): the exact quantile of each group, interpolated between neighbours as percentile() does, for groups of any size.

    Equal values are counted before anything moves; running counts over them (scanned) tell which ones hold the two ranks that
    matter, and only these rows are aggregated. Nulls do not count; a group of nulls alone has none (null); NaN is the largest.
    """
    x = df.select(*by, F.col(value).cast("double").alias("__v"))
    counts = x.where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    seen = scanned(counts, by, [F.col("__v")], {"__k": F.col("__c")}, {"__k": "__n"})
    at = (F.col("__n") - 1) * F.lit(float(share))
    low, high = F.floor(at), F.ceil(at)
    holds = lambda r: (F.col("__k") - F.col("__c") <= r) & (r < F.col("__k"))
    ends = seen.where(holds(low) | holds(high)).groupBy(*by).agg(F.max(F.when(holds(low), F.col("__v"))).alias("__low"), F.max(F.when(holds(high), F.col("__v"))).alias("__high"), F.max(at).alias("__at"))
    between = F.when(F.floor("__at") == F.ceil("__at"), F.col("__low")).otherwise((F.ceil("__at") - F.col("__at")) * F.col("__low") + (F.col("__at") - F.floor("__at")) * F.col("__high"))
    if not by:
        return ends.select(between.alias(name))
    found = ends.select(*(F.col(c).alias(f"__{c}") for c in by), between.alias(name))
    groups = x.select(*by).distinct()
    return groups.join(found, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").select(*by, name)


def components(edges: DataFrame, by: str, most_rounds: int = 60) -> DataFrame:
    """(by, node, root) of a table of edges (by, u, v): the smallest node that each node reaches within its group.

    Every round, each node takes the smallest label of its neighbours and its own, then the label that its label has (so that
    chains halve), until nothing changes; each round is written. Labels are one row a node, joined to edges by
    (by, node); the joins can be split at nodes of many edges.
    """
    both = stored(edges.select(by, "u", "v").union(edges.select(by, F.col("v"), F.col("u"))).where("u <> v").distinct(), "edges")
    label = stored(both.groupBy(by, "u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "labels")
    for _ in range(most_rounds):
        far = label.select(F.col(by).alias("__by"), F.col("u").alias("__u"), F.col("root").alias("__root"))
        seen = both.join(far, F.col(by).eqNullSafe(F.col("__by")) & (F.col("v") == F.col("__u"))).select(by, "u", F.col("__root").alias("root"))
        near = stored(label.union(seen).groupBy(by, "u").agg(F.min("root").alias("root")), "labels")
        far = near.select(F.col(by).alias("__by"), F.col("u").alias("__u"), F.col("root").alias("__root"))
        jumped = near.join(far, F.col(by).eqNullSafe(F.col("__by")) & (F.col("root") == F.col("__u")), "left").select(by, "u", F.least("root", F.coalesce("__root", "root")).alias("root"))
        after = stored(jumped, "labels")
        old = label.select(F.col(by).alias("__by"), F.col("u").alias("__u"), F.col("root").alias("__root"))
        moved = after.join(old, F.col(by).eqNullSafe(F.col("__by")) & (F.col("u") == F.col("__u"))).where("root <> __root").limit(1).count()
        label = after
        if not moved:
            return label.withColumnRenamed("u", "node")
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
