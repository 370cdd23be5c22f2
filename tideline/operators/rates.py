"""Event counts and rates. Each can start from subjects or from survival cells."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tideline.functions.gamma import poisson_limits


def event_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Subjects, events and days of follow-up per key."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("status").alias("events"), F.sum("time").alias("fu")
    )


def weighted_event_rates(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Weighted events, weighted days and their ratio per key."""
    w = F.col(weight)
    return df.groupBy(*by).agg(
        F.sum(w * F.col("status")).alias("w_events"), F.sum(w * F.col("time")).alias("pt")
    ).withColumn("rate", F.try_divide("w_events", "pt"))


def counts_from_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Both of the above from cells, without another pass over the subjects."""
    event = F.col("status") == 1
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(event, F.col("n")).otherwise(0)).alias("events"),
        F.sum(F.col("n") * F.col("time")).alias("fu"),
        F.sum(F.when(event, F.col("w")).otherwise(0.0)).alias("w_events"),
        F.sum(F.col("w") * F.col("time")).alias("pt"),
        F.sum("n_missing").alias("n_missing"),
    ).withColumn("rate", F.try_divide("w_events", "pt"))


def with_total_events(df: DataFrame, by: list[str], events: str = "events") -> DataFrame:
    """Add the key's total events over all groups; a fit is only made where it is above 0."""
    return df.withColumn("total_events", F.sum(events).over(Window.partitionBy(*by)))


def poisson_rate_ci(
    df: DataFrame, events: str = "w_events", pt: str = "pt", level: float = 0.95, floor_events: bool = False
) -> DataFrame:
    """Add ``rate`` and its exact Poisson limits ``rate_lo, rate_hi``; NULL without person-time.

    ``df`` has one row per group and outcome. Weighted event sums are used as they are unless
    ``floor_events`` is set.
    """

    @F.pandas_udf("lo double, hi double")
    def limits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in parts:
            lo, hi = poisson_limits(x.fillna(0).to_numpy(float), level, floor_events)
            yield pd.DataFrame({"lo": lo, "hi": hi})

    return (
        df.withColumn("limits", limits(F.col(events).cast("double")))
        .withColumns(
            {
                "rate": F.try_divide(F.col(events).cast("double"), F.col(pt)),
                "rate_lo": F.try_divide("limits.lo", pt),
                "rate_hi": F.try_divide("limits.hi", pt),
            }
        )
        .drop("limits")
    )


def assemble(rates: DataFrame, hr: DataFrame, by: list[str]) -> DataFrame:
    """Join the rate rows with the hazard ratios of the same key; rates without a model keep NULL."""
    columns = [c for c in hr.columns if c not in rates.columns]
    return rates.join(hr.select(*by, *columns), by, "left")
