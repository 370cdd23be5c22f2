"""Cohort build: derived columns, eligibility, exposure, landmarks. No step here shuffles."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from tideline import schema as S
from tideline.functions import columns as C

if TYPE_CHECKING:
    from tideline.sources.matched import SetStage


def index_from(df: DataFrame, date: str = S.STUDY_START) -> DataFrame:
    return df.where(F.col("index_date") >= F.lit(date).cast("date"))


def index_not_after(df: DataFrame, study_end: str = S.STUDY_END) -> DataFrame:
    return df.where(F.col("index_date") <= F.lit(study_end).cast("date"))


def with_scores(df: DataFrame) -> DataFrame:
    """Add age, comorbidity score, age-adjusted score and severity."""
    return df.withColumns(
        {"age": C.age_at_index(), "score_cci": C.comorbidity_score(), "severity": C.window_flag()}
    ).withColumn("score_cci_age", C.age_adjusted_score())


def alive_at_index_condition() -> Column:
    return F.col("death_date").isNull() | (F.col("death_date") >= F.col("index_date"))


def alive_at_index(df: DataFrame) -> DataFrame:
    return df.where(alive_at_index_condition())


def no_prior(df: DataFrame, flag: str = "hx_cv_major") -> DataFrame:
    """Rows whose history flag is 0; NULL is dropped."""
    return df.where(F.col(flag) == 0)


def min_age(df: DataFrame, years: int = S.MIN_AGE) -> DataFrame:
    return df.where(F.col("age") >= years)


def with_exposure(df: DataFrame) -> DataFrame:
    """Add dose sequence, days since the last dose, exposure groups and brand flags."""
    return df.withColumn("dose_seq", C.dose_sequence()).withColumns(
        {
            "days_since_dose": C.days_since_last_dose(),
            "group_brand": C.exposure_group(),
            "group_dose": C.dose_group(),
            "bnt": C.brand_flag("B"),
            "sino": C.brand_flag("S"),
        }
    )


def eligible(df: DataFrame) -> DataFrame:
    """Scored rows alive at index, without the prior event, adult, with their exposure."""
    return with_exposure(min_age(no_prior(alive_at_index(with_scores(df)))))


def attrition(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows left after each step, steps applied one after another, from one aggregate over ``df``."""
    names = list(steps)
    passed = [reduce(and_, [steps[n] for n in names[: i + 1]]) for i in range(len(names))]
    counts = df.agg(F.count(F.lit(1)).alias("c0"), *[F.count_if(p).alias(f"c{i + 1}") for i, p in enumerate(passed)])
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"c{i}").alias("n"))
            for i, n in enumerate(["all"] + names)]
    return counts.select(F.inline(F.array(*rows)))


def eligibility_steps() -> dict[str, Column]:
    """Steps over scored rows that carry their exposure."""
    return {
        "alive_at_index": alive_at_index_condition(),
        "no_prior": F.col("hx_cv_major") == 0,
        "adult": F.col("age") >= S.MIN_AGE,
        "analysable": F.col("group_dose").isNotNull() & (F.col("infected") == 1),
    }


def landmark_survivors(df: DataFrame, days: int = S.ACUTE_DAYS) -> DataFrame:
    return df.where(C.survives_to(days) == 1)


def landmark(df: DataFrame, days: int = S.ACUTE_DAYS) -> DataFrame:
    """Keep subjects alive at index + days and move their index there.

    Age, score and exposure keep the values of the original index.
    """
    return landmark_survivors(df, days).withColumn("index_date", F.date_add("index_date", days))


def analysable(df: DataFrame, group: str = "group_brand") -> DataFrame:
    """Infected subjects whose exposure is one of the levels."""
    return df.where(F.col(group).isNotNull() & (F.col("infected") == 1))


def use_dose_group(df: DataFrame) -> DataFrame:
    """Analyse by dose count: ``group`` becomes ``group_dose``."""
    return df.withColumn("group", F.col("group_dose"))


def with_vaccinated(df: DataFrame, group: str = "group_dose", baseline: str = S.DOSE_LEVELS[0]) -> DataFrame:
    return df.withColumn("vaccinated", (F.col(group) != baseline).cast("int"))


def exposed_only(df: DataFrame, group: str = "group_dose", baseline: str = S.DOSE_LEVELS[0]) -> DataFrame:
    """Drop the baseline level; the next level is the baseline of what is left."""
    return df.where(F.col(group) != baseline)


def recent_dose(df: DataFrame, days: int = S.RECENT_DOSE_DAYS, from_index: str = "index_date",
                last_dose: str = "length") -> DataFrame:
    """Unexposed subjects, and those whose last dose is at most ``days`` before ``from_index``.

    After ``landmark`` the index is the shifted one, so the same limit reaches less far back.
    """
    since = C.days_since_last_dose(index=from_index, last_dose=last_dose)
    return df.where((F.col("group_brand") == S.BRAND_LEVELS[0]) | (since <= days))


def test_type_in(df: DataFrame, values: list[str] = S.PCR_TEST_TYPES) -> DataFrame:
    return df.where(F.col("test_type").isin(values))


def phase_constants(df: DataFrame, phase: str) -> DataFrame:
    """Phase indicator 1, and no history for the two death outcomes."""
    return df.withColumns({phase: F.lit(1), "hx_cv_death": F.lit(0), "hx_death": F.lit(0)})


# How the names of 0/1 columns start.
FLAG_PREFIXES = ("dx", "px", "ip", "rx", "hx", "mm")


def flags_as_boolean(df: DataFrame, prefixes=FLAG_PREFIXES) -> DataFrame:
    """Cast every 0/1 column whose name starts with one of the prefixes to boolean."""
    starts = re.compile("^(" + "|".join(prefixes) + ")")
    casts = {c: F.col(c).cast("boolean") for c in df.columns if starts.match(c)}
    return df.withColumns(casts) if casts else df


def dose_in_window(df: DataFrame, lo: int = 0, hi: int = S.ACUTE_DAYS, doses=S.ALL_DOSE_DATES) -> DataFrame:
    """Rows with any dose in [index + lo, index + hi)."""
    index = F.col("index_date")
    return df.where(C.any_date_between(doses, F.date_add(index, lo), F.date_add(index, hi)))


def dose_in_window_long(df: DataFrame, doses: DataFrame, lo: int = 0, hi: int = S.ACUTE_DAYS) -> DataFrame:
    """As ``dose_in_window`` with doses as rows (``subject_id, dose_date``) instead of columns.

    Repeated dates are dropped first, which bounds the rows of one subject by the days.
    """
    index = F.col("index_date")
    doses = doses.select("subject_id", "dose_date").distinct()
    near = (F.col("dose_date") >= F.date_add(index, lo)) & (F.col("dose_date") < F.date_add(index, hi))
    return df.join(doses, (df["subject_id"] == doses["subject_id"]) & near, "left_semi")


def exclude_matched_sets(df: DataFrame, excluded: DataFrame, key: str = "match") -> DataFrame:
    """Drop every row whose set id is among the excluded ones; a NULL id matches a NULL id.

    The excluded side is reduced to distinct ids, so a large set costs one row there, and its rows on
    the other side can be split by the adaptive skew join.
    """
    ids = excluded.select(F.col(key).alias("excluded_key")).distinct()
    return df.join(ids, F.col(key).eqNullSafe(F.col("excluded_key")), "left_anti")


def exclude_stored_sets(stage: SetStage, condition: Column) -> DataFrame:
    """Drop every row whose set holds a row with ``condition``, as ``exclude_matched_sets`` does, without a shuffle.

    Sets meet in their bucket. The rows without an id are one set: they stay or go by a scalar.
    """
    ids = stage.sets.where(condition).select(F.col(stage.key).alias("excluded_key")).distinct()
    kept = stage.sets.join(ids, F.col(stage.key) == F.col("excluded_key"), "left_anti")
    return kept.unionByName(stage.none.where(~stage.none.where(condition).exists()))


def flag_stored_sets(stage: SetStage, flags: dict[str, Column]) -> DataFrame:
    """Add per flag 1 if the set of the row holds a row that meets it, 0 otherwise, without a shuffle of rows."""
    any_of = [F.max(F.when(c, 1).otherwise(0)).alias(name) for name, c in flags.items()]
    of_set = stage.sets.groupBy(F.col(stage.key).alias("flagged_key")).agg(*any_of)
    named = stage.sets.join(of_set, F.col(stage.key) == F.col("flagged_key")).drop("flagged_key")
    scalars = {name: stage.none.agg(c).scalar() for name, c in zip(flags, any_of)}
    return named.unionByName(stage.none.withColumns(scalars))


def subgroup_conditions() -> dict[str, Column]:
    """The ten subgroup definitions."""
    baseline = F.col("group") == S.DOSE_LEVELS[0]
    return {
        "age.l65": F.col("age") < 65,
        "age.ge65": F.col("age") >= 65,
        "sex.male": F.col("sex") == "M",
        "sex.female": F.col("sex") == "F",
        "cci.l4": F.col("score_cci_age") < 4,
        "cci.ge4": F.col("score_cci_age") >= 4,
        "sev1": F.col("severity") == 1,
        "sev0": F.col("severity") == 0,
        "bnt": baseline | (F.col("bnt") == 1),
        "sino": baseline | (F.col("sino") == 1),
    }


def subgroups(df: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """One row per subject and subgroup it belongs to, in one pass over ``df``."""
    conditions = conditions or subgroup_conditions()
    return explode_where(df, "subgroup", {n: F.lit(n) for n in conditions}, conditions)


def explode_where(df: DataFrame, name: str, values: dict[str, Column], conditions: dict[str, Column]) -> DataFrame:
    """One row per value whose condition holds.

    NULLs are filtered after the explode: array_compact would take the whole array out of code generation.
    """
    listed = F.array(*[F.when(conditions[k], v) for k, v in values.items()])
    return df.withColumn(name, F.explode(listed)).where(F.col(name).isNotNull())


def level_order(col: str, levels: list[str], first: list[str] = ()) -> list[str | Column]:
    """Sort keys of a result: the columns of ``first``, then the levels in their order, baseline first."""
    return [*first, C.level_index(col, levels)]


def order_by_level(df: DataFrame, col: str, levels: list[str], first: list[str] = ()) -> DataFrame:
    """Sort a result by level order, baseline first; for sinks only."""
    return df.orderBy(*level_order(col, levels, first))
