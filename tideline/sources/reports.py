"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.sources.ordered import in_file_order


def concat_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack named tables into one with a ``table_name`` column."""
    tagged = [df.withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_tables(tables: dict[str, DataFrame], path: str, format: str = "csv") -> None:
    """Several tables under one folder, one sub-folder each."""
    writer = concat_tables(tables).write.mode("overwrite").partitionBy("table_name")
    writer.option("header", True).format(format).save(path)


def write_report(results: DataFrame, path: str, format: str = "csv", order: Sequence[str | Column] = ()) -> None:
    """Overwrite a report with the long result table.

    With ``order`` (``cohort.level_order`` for exposure groups) the rows are dealt by ranges of it and sorted inside
    them, so the files in the order of their names are the report in that order, whatever its size.
    """
    rows = results.orderBy(*order) if order else results
    rows.write.mode("overwrite").option("header", True).format(format).save(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report that was written as CSV, with ``place``: its row number, from 0 in file order."""
    return in_file_order(spark.read.schema(schema).option("header", True).csv(path))
