"""Reports over runs: means and deviations, leaderboards, the latest success, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.rounds import ranked


def present(c: str) -> Column:
    """NaN counts as missing: avg skips nulls but not NaN."""
    return F.when(~F.isnan(c), F.col(c))


def mean_std(c: str) -> list[Column]:
    """mean, sample deviation (one value: 0; none: NaN) and n."""
    x = present(c)
    return [F.coalesce(F.avg(x), F.lit(float("nan"))).alias("mean"), F.when(F.count(x) == 0, float("nan")).otherwise(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias("std"), F.count(x).alias("n")]


def variance_report(runs: DataFrame, by: list[str], c: str) -> DataFrame:
    """mean_std with zeros where there is no value, and a note under three runs."""
    x = present(c)
    out = runs.groupBy(*by).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.count(x).alias("n"))
    return out.withColumn("note", F.when(F.col("n") < 3, "n<3"))


def two_level(runs: DataFrame, outer: str, inner: str, c: str) -> DataFrame:
    """The mean of the inner groups' means (not a rollup over rows)."""
    return runs.groupBy(outer, inner).agg(F.avg(present(c)).alias("mean")).groupBy(outer).agg(F.avg("mean").alias("mean"), F.count("*").alias("n_runs"))


def leaderboard(rows: DataFrame, metric: str, by: list[str], tie: list[str]) -> DataFrame:
    """Rows with their rank in the group, best first (nulls last), for groups of any size."""
    return ranked(rows, by, [F.desc(metric), *map(F.col, tie)])


# The documented precedence of result files, best first.
PRECEDENCE = ("retry", "chunked", "ollama", "original")


def latest_success(runs: DataFrame, by: list[str], precedence: str = "label", tie: str = "timestamp") -> DataFrame:
    """One record for each key: a success if there is one. Labels compare as strings ("label") or by PRECEDENCE ("rank")."""
    order = F.desc("label") if precedence == "label" else F.coalesce(F.array_position(F.array(*map(F.lit, PRECEDENCE)), "label"), F.lit(99))
    w = Window.partitionBy(*by).orderBy(F.when(F.col("status") == "success", 0).otherwise(1), order, F.desc(tie))
    return runs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def status_counts(records: DataFrame, by: str) -> DataFrame:
    good = F.col("status") == "success"
    return records.groupBy(by).agg(F.count_if(good).alias("ok"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"))


def succeeded(records: DataFrame, text: str = "summary") -> DataFrame:
    """Successful records whose text is not blank."""
    return records.where((F.col("status") == "success") & (F.trim(text) != ""))


def covered(records: DataFrame, by: str, least: int) -> DataFrame:
    """(by, n): groups with at least so many successful records."""
    return records.where(F.col("status") == "success").groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def with_defaults(rows: DataFrame, side: DataFrame, on: str, defaults: dict) -> DataFrame:
    """rows with the columns of an optional side input, defaults where it has no row."""
    return rows.join(side.select(on, *defaults), on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def unfinished(units: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work without a record that has no error."""
    return units.join(records.where("error is null").select(*keys).distinct(), keys, "left_anti")
