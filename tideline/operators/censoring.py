"""Outcomes as rows, and the censoring rules of the phases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tideline import schema as S

NO_HISTORY = ("cv_death", "death")


def unpivot_outcomes(
    df: DataFrame,
    outcomes: list[str],
    keep: list[str],
    competing: str | None = None,
    only: Callable[[str, Column], Column] | None = None,
) -> DataFrame:
    """One row per subject and outcome with ``outcome, hx, outcome_date``.

    ``competing`` names the outcome whose date rides along as ``competing_date``, so that competing
    events need no second look at the subject's other rows. ``only`` maps an outcome and its history to
    a condition; rows that fail it are left out.
    """
    rows = []
    for o in outcomes:
        hx = F.lit(0) if o in NO_HISTORY else F.col(f"hx_{o}").cast("int")
        row = F.struct(F.lit(o).alias("outcome"), hx.alias("hx"), F.col(f"outcome_{o}_date").alias("outcome_date"))
        rows.append(F.when(only(o, hx), row) if only else row)
    extra = [F.col(f"outcome_{competing}_date").alias("competing_date")] if competing else []
    long = df.select(*keep, *extra, F.inline(F.array(*rows)))
    return long.where(F.col("outcome").isNotNull()) if only else long


def censor(
    df: DataFrame,
    days: int | Column | None = None,
    study_end: str | None = None,
    prior_counts: bool | Column = True,
) -> DataFrame:
    """Add ``end_date, time, status`` and, with a ``competing_date``, ``competing``.

    Follow-up runs from the index day (day 1) to the first of outcome, death, day ``days`` and
    ``study_end``. With ``prior_counts`` an outcome before the index counts as history, not as an event;
    without it follow-up ends on day ``days`` even after ``study_end``. Both may be columns.
    """
    if days is None and study_end is None:
        raise ValueError("give days, study_end or both")
    index, outcome = F.col("index_date"), F.col("outcome_date")
    prior = F.lit(prior_counts) if isinstance(prior_counts, bool) else prior_counts
    bounds = [F.col("death_date")]
    if days is not None:
        bounds.append(F.date_add(index, days - 1))
    if study_end is not None:
        bounds.append(F.when(prior, F.lit(study_end).cast("date")))

    def happened(date: Column) -> Column:
        in_time = date.isNotNull() & (F.least(date, *bounds) == date)
        return (in_time & (~prior | (date >= index))).cast("int")

    end = F.least(outcome, *bounds)
    out = {
        "end_date": end,
        "time": F.date_diff(end, index) + 1,
        "status": happened(outcome),
        "hx": ((F.col("hx") != 0) | (prior & outcome.isNotNull() & (outcome < index))).cast("int"),
    }
    if "competing_date" in df.columns:
        out["competing"] = happened(F.col("competing_date"))
    return df.withColumns(out)


def censor_acute(df: DataFrame, days: int = S.ACUTE_DAYS) -> DataFrame:
    """First ``days`` days; history is the baseline flag only."""
    return censor(df, days=days, prior_counts=False)


def censor_open(df: DataFrame, study_end: str = S.STUDY_END) -> DataFrame:
    """From the (shifted) index to the end of the study."""
    return censor(df, study_end=study_end)


def censor_interval(df: DataFrame, days: int = S.INTERVAL_DAYS, study_end: str = S.STUDY_END) -> DataFrame:
    """``days`` days from the (shifted) index, at most to the end of the study."""
    return censor(df, days=days, study_end=study_end)


def competing_status(df: DataFrame) -> DataFrame:
    """Add ``status_cr``: 1 outcome, 2 competing event without the outcome, 0 neither."""
    return df.withColumn(
        "status_cr", F.when(F.col("status") == 1, 1).when(F.col("competing") == 1, 2).otherwise(0)
    )


def at_risk(df: DataFrame) -> DataFrame:
    """Rows without a history of the outcome; a NULL history is dropped."""
    return df.where(F.col("hx") == 0)


def assert_all(df: DataFrame, predicate: Column, message: str) -> DataFrame:
    """``df`` itself; running it fails at the first row where the predicate is not true."""
    return df.where(F.assert_true(F.coalesce(predicate, F.lit(False)), message).isNull())


def check_time(df: DataFrame) -> DataFrame:
    return assert_all(df, F.col("time") >= 0, "negative follow-up time")


def time_check(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and rows with a missing or negative time per key, without failing."""
    bad = ~F.coalesce(F.col("time") >= 0, F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"))
