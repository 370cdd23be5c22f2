"""Row numbers and file orders of sorted tables that are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.sources.stages import materialise


def numbered(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """Adds ``name``, from 0 in the given order (of ties any).

    Rows are dealt by ranges of the order and numbered inside them; only the counts of the ranges, one row for each
    partition, meet in a task.
    """
    columns = {f"_by{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    ranged = df.withColumns(columns).repartitionByRange(*columns)
    dealt = materialise(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*columns)) - 1
    rows = dealt.withColumn("_row", inside).join(starts, F.col("_range") == F.col("_of"))
    return rows.withColumn(name, F.col("_start") + F.col("_row")).select(*df.columns, name)


def in_file_order(df: DataFrame, name: str = "place") -> DataFrame:
    """Adds ``name``, from 0 in the order of the files that ``df`` was read from, and of the rows in each."""
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                  F.monotonically_increasing_id().alias("row"))
    return numbered(df.select("*", at.alias("_at")), ["_at.file", "_at.block", "_at.row"], name).drop("_at")
