"""Definition sheets: which variables enter a table or a propensity model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline import schema as S
from tideline.sources.ordered import numbered


def read_definitions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A sheet exported to CSV: ``table1`` (Name, Description) or ``PS`` (Name, Set)."""
    schema = {"table1": S.TABLE1_SCHEMA, "PS": S.PS_SCHEMA}[kind]
    return spark.read.schema(schema).csv(path, header=True)


def definition_filter(defs: DataFrame, level: int | None = None) -> DataFrame:
    """Rows with a name and, with a level, those of the sets up to it."""
    kept = defs.where(F.col("Name").isNotNull())
    return kept if level is None else kept.where(F.col("Set") <= level)


def with_places(defs: DataFrame, key: str) -> DataFrame:
    """Adds ``place``, from 0 in the order of a key without repeats, for sheets that are tables."""
    return numbered(defs, [key])


def add_total_row(defs: DataFrame) -> DataFrame:
    """Prepend the row that labels the group sizes."""
    total = defs.sparkSession.createDataFrame([("n", "n")], S.TABLE1_SCHEMA)
    return total.unionByName(defs.select("Name", "Description"))
