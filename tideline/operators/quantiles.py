"""Exact quantiles of many columns and keys without gathering any of them in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.sources.stages import materialise

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def value_counts(df: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:
    """Distinct values of each key and column with their counts, written once; NULL and NaN are one value, NULL."""
    values = []
    for c in columns:
        x = F.col(c).cast("double")
        values.append(F.struct(F.lit(c).alias("variable"), F.when(~F.isnan(x), x).alias("v")))
    long = df.select(*by, F.inline(F.array(*values)))
    counts = long.groupBy(*by, "variable", "v").agg(F.count(F.lit(1)).alias("c"))
    if not by:  # a column has its row even if there is nothing in it
        counts = counts.unionByName(df.sparkSession.createDataFrame([(c, None, 0) for c in columns], "variable string, v double, c long"))
    return materialise(counts, "values")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys that may be NULL; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same: list[Column] = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, reduce(and_, same), how).drop(*[f"_{k}" for k in keys])


def with_ranks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``end``: how many values of the key are up to this one, for distinct values ``v`` with counts ``c``.

    Values are dealt by ranges of key and value, so a key with most values is many tasks. Each range knows how many
    values of its keys are in the ranges before it; the rest is a running sum inside the range.
    """
    dealt = counts.repartitionByRange(*keys, "v").withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_range").agg(F.sum("c").alias("_sum"))
    starts = starts.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _joined(dealt, starts, [*keys, "_range"])
    return placed.withColumn("end", F.col("_start") + F.sum("c").over(inside)).drop("_range", "_start")


def numeric_summaries(df: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:
    """Minimum, quartiles, median, mean and maximum of every column for every key, in the same passes.

    Values that are NULL or NaN are missing; quartiles interpolate. A key whose column is all missing has n = 0 and
    NULLs, and so has a column of no rows where there are no keys. NULL is a key like others. The number of passes
    does not grow with the keys or columns, and nothing is collected.
    """
    keys = [*by, "variable"]
    counts = value_counts(df, columns, by)
    some = F.col("v").isNotNull()
    stats = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(some, F.col("c"))), F.lit(0)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum(F.when(some, F.col("c")))).alias("mean"),
    )
    ranked = _joined(with_ranks(counts.where(some), keys), stats.select(*keys, "n"), keys)
    ends = []
    for name, p in QUARTILES.items():
        at = (F.col("n") - 1) * p
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (rank < F.col("end")) & (rank >= F.col("end") - F.col("c"))
            ends.append(F.max(F.when(here, F.col("v"))).alias(f"{name}_{side}"))
    found = _joined(stats, ranked.groupBy(*keys).agg(*ends), keys, "left")

    def quartile(name: str) -> Column:
        low, high, at = F.col(f"{name}_lo"), F.col(f"{name}_hi"), (F.col("n") - 1) * QUARTILES[name]
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    out = {name: quartile(name).alias(name) for name in QUARTILES}
    return found.select(*keys, "n", "min", out["q1"], out["median"], "mean", out["q3"], "max")


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """The summary of one column over all rows."""
    return numeric_summaries(df, [col])
