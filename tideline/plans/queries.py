"""The registered queries: each operator over the cohort built from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline import schema as S
from tideline.functions import columns as C
from tideline.operators import censoring as Z, cohort as K, quantiles, rates as R, survival as V, tables, weights
from tideline.plans import analysis
from tideline.plans.variants import VARIANTS
from tideline.session import shared_folder
from tideline.sources.cohort import normalise_dates, read_cohort as read_cohort_file
from tideline.sources.definitions import definition_filter, read_definitions, with_places
from tideline.sources.matched import SetStage, read_set_stage, write_set_stage
from tideline.sources.ordered import numbered
from tideline.sources.reports import concat_tables, read_report, write_report, write_tables
from tideline.sources.sample import SAMPLE_STUDY_END, person_table
from tideline.sources.stages import kept_stage, materialise, read_stage, write_stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TERMS = ["segment", "age", "sex", "score_cci"]
TABLE_VARIABLES = ["age", "score_cci", "sex", "segment", "dx_mi", "dx_cancer"]
# Name and description of the table variables; one is left out, one names no variable.
DESCRIPTIONS = [("age", "Age, years"), ("score_cci", "Comorbidity score"), ("sex", "Sex"), ("dx_mi", "Infarction"),
                ("bmi", "Body mass index")]


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column) -> Column:
    """Six decimals. The small addend moves sums that should be equal off the rounding ties."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# Sums over many subjects; they get three decimals, the other numbers six.
SUMS = {"w_events", "w_event", "pt", "w_risk", "fg_risk", "ess", "n", "count"}


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-5, 3) if c in SUMS else r6(c) for c in cols})


def derived(spark: SparkSession, sf: str) -> DataFrame:
    """All persons with scores and exposure, before eligibility."""
    return K.with_exposure(K.with_scores(person_table(spark, sf)))


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    return K.eligible(person_table(spark, sf))


def analysable(spark: SparkSession, sf: str) -> DataFrame:
    return K.use_dose_group(K.analysable(eligible(spark, sf)))


def postacute(spark: SparkSession, sf: str) -> DataFrame:
    return K.landmark(analysable(spark, sf), S.ACUTE_DAYS)


LONG = ["subject_id", "group", "index_date", "death_date"]


def acute_long(df: DataFrame, outcomes=S.OUTCOMES, keep=LONG, competing=None) -> DataFrame:
    return Z.censor_acute(Z.unpivot_outcomes(df, list(outcomes), keep, competing))


def open_long(df: DataFrame, outcomes=S.OUTCOMES, keep=LONG, competing=None) -> DataFrame:
    return Z.censor_open(Z.unpivot_outcomes(df, list(outcomes), keep, competing), SAMPLE_STUDY_END)


FOLLOW_UP = [*LONG, *[f"hx_{o}" for o in S.HX_OUTCOMES], *[f"outcome_{o}_date" for o in S.OUTCOMES]]


def weighted(spark: SparkSession, sf: str, terms: list[str], columns: list[str]) -> DataFrame:
    """Analysable acute subjects with weights and the columns asked for.

    Written once because the fit and the query both read them.
    """
    kept = dict.fromkeys(["subject_id", "group", *terms, *columns])
    rows = materialise(analysable(spark, sf).select(*kept), "weighted")
    return weights.iptw_weights(rows, weights.fit_propensity(rows, terms))


def weighted_cells(spark, sf, terms, competing=False) -> DataFrame:
    """Cells are a few thousand rows that several steps read, so they are written once."""
    long = open_long(weighted(spark, sf, terms, FOLLOW_UP), keep=[*LONG, "weight"], competing="death" if competing else None)
    if competing:
        long = Z.competing_status(long).where("outcome <> 'death'")
    status = "status_cr" if competing else "status"
    return materialise(V.survival_cells(Z.check_time(Z.at_risk(long)), ["outcome"], "weight", status), "cells")


def crude_cells(spark, sf) -> DataFrame:
    long = Z.check_time(Z.at_risk(open_long(analysable(spark, sf))))
    return materialise(V.survival_cells(long, ["outcome"]), "cells")


# Cohort build --------------------------------------------------------------------------------------


@query
def cohort_eligible(spark, sf):
    df = K.analysable(eligible(spark, sf))
    return df.select("subject_id", "match", "sex", "index_date", "death_date", "age", "group_brand", "group_dose")


@query
def index_from(spark, sf):
    return K.index_from(person_table(spark, sf), "1998-03-01").select("subject_id", "index_date")


@query
def attrition(spark, sf):
    return K.attrition(derived(spark, sf), K.eligibility_steps())


@query
def normalised_dates(spark, sf):
    """Outcome dates that arrive as text, one in eleven of them unreadable."""
    text = F.when(F.col("subject_id") % 11 == 0, F.lit("unknown")).otherwise(F.col("outcome_death_date").cast("string"))
    df = person_table(spark, sf).select("subject_id", text.alias("outcome_death_date"))
    return normalise_dates(df, ["outcome_death_date"])


@query
def age_scores(spark, sf):
    return K.with_scores(person_table(spark, sf)).select("subject_id", "age", "score_cci", "score_cci_age")


@query
def severity_flag(spark, sf):
    return K.with_scores(person_table(spark, sf)).select("subject_id", "severity")


@query
def dose_sequence(spark, sf):
    return derived(spark, sf).select("subject_id", "dose_seq")


@query
def days_since_dose(spark, sf):
    latest = C.days_since_last_dose(last_dose="max")
    return derived(spark, sf).select("subject_id", "days_since_dose", latest.alias("days_since_latest"))


@query
def exposure_groups(spark, sf):
    return derived(spark, sf).select("subject_id", "group_brand", C.level_index("group_brand", S.BRAND_LEVELS).alias("group_no"))


@query
def dose_groups(spark, sf):
    return K.use_dose_group(derived(spark, sf)).select("subject_id", "group")


@query
def brand_flags(spark, sf):
    return derived(spark, sf).select("subject_id", C.as_level("bnt", [0, 1]).alias("bnt"), C.as_level("sino", [0, 1]).alias("sino"))


@query
def relevel_exposed(spark, sf):
    df = K.exposed_only(K.with_vaccinated(analysable(spark, sf)))
    return df.select("subject_id", "vaccinated", "group", C.level_index("group", S.DOSE_LEVELS[1:]).alias("group_no"))


@query
def landmark_28(spark, sf):
    return K.landmark(eligible(spark, sf), 28).select("subject_id", "index_date", "age", "group_dose")


@query
def landmark_90(spark, sf):
    return K.landmark(eligible(spark, sf), 90).select("subject_id", "index_date", "age", "group_dose")


@query
def index_not_after(spark, sf):
    return K.index_not_after(K.landmark(eligible(spark, sf), 90), "1998-06-30").select("subject_id", "index_date")


@query
def recent_dose_180(spark, sf):
    used = ["subject_id", "index_date", "death_date", "group_brand", "dose_seq", *S.DOSE_DATES]
    df = materialise(eligible(spark, sf).select(used), "eligible")
    both = {"acute": K.recent_dose(df), "postacute": K.recent_dose(K.landmark(df))}
    return concat_tables({k: v.select("subject_id") for k, v in both.items()}).withColumnRenamed("table_name", "phase")


@query
def test_type(spark, sf):
    return K.test_type_in(eligible(spark, sf)).select("subject_id", "test_type")


@query
def dose_in_window(spark, sf):
    df = materialise(eligible(spark, sf).select("subject_id", "index_date", "death_date", *S.ALL_DOSE_DATES), "eligible")
    both = {"acute": K.dose_in_window(df, 0, 28), "postacute": K.dose_in_window(K.landmark(df), -28, 0)}
    return concat_tables({k: v.select("subject_id") for k, v in both.items()}).withColumnRenamed("table_name", "phase")


@query
def dose_in_window_rows(spark, sf):
    """The same with one row per dose, every urgent order being a dose."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderpriority = '1-URGENT'")
    doses = orders.select(F.col("o_custkey").alias("subject_id"), F.to_date("o_orderdate").alias("dose_date"))
    return K.dose_in_window_long(eligible(spark, sf), doses).select("subject_id")


@query
def exclude_matched_sets(spark, sf):
    """Sets with a dose in the first 28 days of any person leave the analysable subjects."""
    persons = person_table(spark, sf).drop(*[f"outcome_{o}_date" for o in S.OUTCOMES])
    persons = materialise(persons, "persons")
    excluded = K.dose_in_window(persons)
    return K.exclude_matched_sets(K.analysable(K.eligible(persons)), excluded).select("subject_id", "match")


def stored_sets(spark, sf) -> SetStage:
    path = f"{shared_folder(spark).rstrip('/')}/files/sets-{uuid.uuid4().hex}"
    write_set_stage(analysable(spark, sf).select("subject_id", "match", "index_date", "death_date", *S.ALL_DOSE_DATES), path)
    return read_set_stage(spark, path)


def dosed_early() -> Column:
    index = F.col("index_date")
    return C.any_date_between(S.ALL_DOSE_DATES, index, F.date_add(index, S.ACUTE_DAYS))


@query
def exclude_stored_sets(spark, sf):
    """Sets with an early dose of an analysable subject leave, on a stage that is bucketed by set."""
    return K.exclude_stored_sets(stored_sets(spark, sf), dosed_early()).select("subject_id", "match")


@query
def added_dose_flags_stored(spark, sf):
    """Per subject whether its set has an early dose, of anyone and of someone alive at the landmark."""
    flags = {"added_acute": dosed_early(), "added_post": dosed_early() & (C.survives_to(S.ACUTE_DAYS) == 1)}
    return K.flag_stored_sets(stored_sets(spark, sf), flags).select("subject_id", "match", *flags)


@query
def subgroup_membership(spark, sf):
    return K.subgroups(analysable(spark, sf)).select("subject_id", "subgroup")


@query
def flags_as_boolean(spark, sf):
    flags = ["dx_mi", "dx_cancer_mets", "hx_cv_mi"]
    return K.flags_as_boolean(person_table(spark, sf).select("subject_id", *flags, "infected"))


@query
def unpivot_outcomes(spark, sf):
    df = K.phase_constants(eligible(spark, sf), "acute")
    return Z.unpivot_outcomes(df, S.OUTCOMES, ["subject_id", "acute"])


# Censoring -----------------------------------------------------------------------------------------


CENSORED = ["subject_id", "outcome", "hx", "end_date", "time", "status"]


@query
def censor_acute(spark, sf):
    return Z.at_risk(acute_long(analysable(spark, sf))).select(CENSORED)


@query
def censor_open(spark, sf):
    return Z.at_risk(open_long(postacute(spark, sf))).select(CENSORED)


@query
def censor_interval(spark, sf):
    long = Z.unpivot_outcomes(postacute(spark, sf), S.OUTCOMES, LONG)
    return Z.at_risk(Z.censor_interval(long, study_end=SAMPLE_STUDY_END)).select(CENSORED)


@query
def censor_landmark_90(spark, sf):
    df = K.index_not_after(K.landmark(analysable(spark, sf), S.LATE_DAYS), SAMPLE_STUDY_END)
    return Z.at_risk(open_long(df)).select(CENSORED)


@query
def competing_status(spark, sf):
    long = open_long(postacute(spark, sf), outcomes=S.OUTCOMES[:-1], competing="death")
    return Z.at_risk(Z.competing_status(long)).select("subject_id", "outcome", "status", "competing", "status_cr")


# Rates ---------------------------------------------------------------------------------------------


@query
def event_counts(spark, sf):
    """Flagship: crude acute events, follow-up and rate per dose group, all outcomes in one pass."""
    long = Z.check_time(Z.at_risk(acute_long(analysable(spark, sf))))
    counts = R.event_counts(long, ["outcome", "group"])
    total = R.with_total_events(counts, ["outcome"])
    return rounded(total.withColumn("rate", F.try_divide("events", "fu")), "rate")


@query
def weighted_event_rates(spark, sf):
    long = Z.at_risk(acute_long(weighted(spark, sf, ["segment"], FOLLOW_UP), keep=[*LONG, "weight"]))
    return rounded(R.weighted_event_rates(long, ["outcome", "group"]), "w_events", "pt", "rate")


@query
def time_check(spark, sf):
    """Without the alive-at-index filter some deaths lie before the index."""
    df = K.use_dose_group(K.analysable(derived(spark, sf)))
    return Z.time_check(acute_long(df), ["outcome"])


@query
def rates(spark, sf):
    counts = R.counts_from_cells(crude_cells(spark, sf), ["outcome", "group"]).drop("n_missing")
    return rounded(counts, "w_events", "pt", "rate")


@query
def poisson_ci(spark, sf):
    counts = R.event_counts(Z.at_risk(acute_long(analysable(spark, sf))), ["outcome", "group"])
    return rounded(R.poisson_rate_ci(counts, "events", "fu"), "rate", "rate_lo", "rate_hi")


# Tables --------------------------------------------------------------------------------------------


def table_input(df: DataFrame) -> DataFrame:
    return K.flags_as_boolean(df)


TABLE_NUMBERS = ["n", "mean", "sd", "count", "pct"]


@query
def baseline_table(spark, sf):
    return rounded(tables.baseline_table(table_input(analysable(spark, sf)), TABLE_VARIABLES), *TABLE_NUMBERS)


@query
def baseline_table_weighted(spark, sf):
    df = table_input(weighted(spark, sf, ["segment"], TABLE_VARIABLES))
    return rounded(tables.baseline_table(df, TABLE_VARIABLES, weight="weight"), *TABLE_NUMBERS)


@query
def smd(spark, sf):
    table = tables.baseline_table(table_input(analysable(spark, sf)), TABLE_VARIABLES)
    return rounded(tables.smd(table), "smd")


@query
def baseline_export(spark, sf):
    # Both the print form and the differences read the table, so it is written once.
    table = materialise(tables.baseline_table(table_input(analysable(spark, sf)), TABLE_VARIABLES), "table1")
    defs = spark.createDataFrame(DESCRIPTIONS, S.TABLE1_SCHEMA)
    return tables.baseline_export(table, defs, TABLE_VARIABLES, smds=tables.smd(table))


@query
def weight_summary(spark, sf):
    return rounded(tables.weight_summary(weighted(spark, sf, ["segment"], [])), "w_min", "w_max", "w_mean", "cv", "ess")


@query
def balance_table(spark, sf):
    df = table_input(weighted(spark, sf, ["segment"], TABLE_VARIABLES))
    return rounded(tables.balance_table(df, TABLE_VARIABLES), "max_diff_un", "max_diff_adj")


@query
def balance_distribution(spark, sf):
    df = weighted(spark, sf, ["segment"], ["age"])
    return rounded(tables.balance_distributions(df, ["age", "segment"]), "share_un", "share_adj")


@query
def numeric_summary(spark, sf):
    out = quantiles.numeric_summary(weighted(spark, sf, ["segment"], []), "weight")
    return rounded(out, "min", "q1", "median", "mean", "q3", "max")


def fits(spark, sf) -> DataFrame:
    """Every stage and subgroup with the weights of its fit and the table variables, written once."""
    cohort = eligible(spark, sf)
    names = dict.fromkeys([*analysis._needed(list(VARIANTS), ["segment"], cohort.columns), *TABLE_VARIABLES])
    cohort = materialise(cohort.select(*names), "cohort")
    rows = analysis.weighted_stages(cohort, ["segment"], analysis.stages_of(list(VARIANTS)))
    return materialise(table_input(rows.select("stage", "group", "weight", *TABLE_VARIABLES)), "fits")


@query
def balance_by_fit(spark, sf):
    """Balance before and after weighting of all fits."""
    out = tables.ps_assess(fits(spark, sf), TABLE_VARIABLES, by=["stage"])["balance"]
    return rounded(out, "max_diff_un", "max_diff_adj")


@query
def distribution_by_fit(spark, sf):
    """Distributions of all table variables in all fits."""
    return rounded(tables.balance_distributions(fits(spark, sf), TABLE_VARIABLES, by=["stage"]), "share_un", "share_adj")


@query
def weights_by_fit(spark, sf):
    """Summary of the weights of all fits."""
    out = quantiles.numeric_summaries(fits(spark, sf), ["weight"], ["stage"])
    return rounded(out, "min", "q1", "median", "mean", "q3", "max")


@query
def stacked_tables(spark, sf):
    table = materialise(tables.baseline_table(table_input(analysable(spark, sf)), ["age", "dx_mi"]), "table1")
    return rounded(concat_tables({"all": table, "exposed": table.where("group <> 'X'")}), *TABLE_NUMBERS)


@query
def phase_tables(spark, sf):
    """The four tables of a phase, stacked."""
    parts = tables.phase_tables(table_input(weighted(spark, sf, ["segment"], TABLE_VARIABLES)), TABLE_VARIABLES)
    return rounded(concat_tables(parts), *TABLE_NUMBERS)


# Weights -------------------------------------------------------------------------------------------


@query
def definition_terms(spark, sf):
    """Parts as a definition sheet: some without a name, in sets 0 to 6."""
    parts = spark.read.parquet(f"{sf}/part.parquet")
    defs = parts.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("Name"),
        (F.col("p_size") % 7).cast("int").alias("Set"),
    )
    return definition_filter(defs, 4)


@query
def iptw_saturated(spark, sf):
    """With one categorical covariate the weight is the cell size over the cell's group size."""
    df = weighted(spark, sf, ["segment"], [])
    return rounded(df.select("subject_id", "segment", "group", "weight"), "weight")


@query
def propensity_wide(spark, sf):
    """A covariate whose levels grow with the subjects (the matched set): the fit without information matrices."""
    rows = analysable(spark, sf).where("match IS NOT NULL").select("subject_id", F.col("match").cast("string").alias("household"), "group")
    rows = materialise(rows, "households")
    df = weights.iptw_weights(rows, weights.fit_propensity(rows, ["household"]))
    return rounded(df.select("subject_id", "household", "group", "weight"), "weight")


@query
def propensity_scores(spark, sf):
    """Full model: expected group sizes within each covariate, which the maximum makes equal to the observed."""
    rows = materialise(analysable(spark, sf).select("group", *TERMS), "ps")
    scored = weights.propensity_scores(rows, weights.fit_propensity(rows, TERMS))
    names = [f"ps_{g}" for g in S.DOSE_LEVELS]
    columns = [F.lit("all"), F.concat(F.lit("segment "), "segment"), F.concat(F.lit("sex "), "sex"), F.lit("age"), F.lit("score_cci")]
    sizes = [F.lit(1.0), F.lit(1.0), F.lit(1.0), F.col("age").cast("double"), F.col("score_cci").cast("double")]
    long = scored.select(
        *names, F.inline(F.array(*[F.struct(c.alias("covariate"), x.alias("x")) for c, x in zip(columns, sizes)]))
    )
    sums = long.groupBy("covariate").agg(*[F.sum(F.col(n) * F.col("x")).alias(n) for n in names])
    return sums.select("covariate", *[F.round(F.col(n) + 1e-7, 5).alias(f"expected_{g}") for n, g in zip(names, S.DOSE_LEVELS)])


@query
def propensity_multinomial(spark, sf):
    df = weighted(spark, sf, TERMS, [])
    return rounded(tables.weight_summary(df), "w_min", "w_max", "w_mean", "cv", "ess")


# Survival ------------------------------------------------------------------------------------------


@query
def cox_risk_table(spark, sf):
    return rounded(V.risk_table(weighted_cells(spark, sf, ["segment"]), ["outcome"]), "w_event", "w_risk")


@query
def cox_score_test(spark, sf):
    return rounded(V.cox_score(crude_cells(spark, sf), ["outcome"]), "score", "info")


@query
def km_curve(spark, sf):
    curve = V.survival_curve(weighted_cells(spark, sf, ["segment"]), ["outcome"])
    return rounded(curve, "w_event", "w_risk", "surv", "cloglog")


@query
def cox_curve(spark, sf):
    curve = V.cox_curve(weighted_cells(spark, sf, ["segment"]), ["outcome"])
    return rounded(curve, "cum_hazard", "surv", "cloglog")


def hr_columns(fit: DataFrame) -> DataFrame:
    hr = V.add_reference_row(V.hazard_ratios(fit), ["outcome"])
    names = ["log_hr", "se", "hr", "hr_lo", "hr_hi"]
    return rounded(hr.select("outcome", "group", *names), *names)


@query
def cox_crude(spark, sf):
    return hr_columns(V.cox_ph(crude_cells(spark, sf), ["outcome"]))


@query
def cox_weighted(spark, sf):
    return hr_columns(V.cox_ph(weighted_cells(spark, sf, ["segment"]), ["outcome"], weighted=True))


@query
def ph_test(spark, sf):
    return rounded(V.ph_test(weighted_cells(spark, sf, ["segment"]), ["outcome"]), "chisq", "p")


@query
def fine_gray_risk_table(spark, sf):
    table = V.fine_gray_risk_table(weighted_cells(spark, sf, ["segment"], competing=True), ["outcome"])
    return rounded(table, "w_event", "g_before", "w_risk", "fg_risk")


@query
def fine_gray(spark, sf):
    return hr_columns(V.fine_gray(weighted_cells(spark, sf, ["segment"], competing=True), ["outcome"]))


# Analyses ------------------------------------------------------------------------------------------


@query
def result_table_crude(spark, sf):
    result = analysis.result_table(crude_cells(spark, sf), ["outcome"], weighted=False)
    numbers = ["w_events", "pt", "rate", "rate_lo", "rate_hi", "log_hr", "se", "hr", "hr_lo", "hr_hi"]
    return rounded(result.select("outcome", "group", "n", "events", "fu", *numbers), *numbers)


@query
def analysis_counts(spark, sf):
    """Counts, weighted events and person-time of every variant, weights saturated in one covariate."""
    cells = analysis.analysis_cells(eligible(spark, sf), ["segment"], VARIANTS, SAMPLE_STUDY_END)
    counts = R.counts_from_cells(cells, [*analysis.KEY, "group"])
    return rounded(counts.drop("rate", "fu", "n_missing"), "w_events", "pt")


RESULT_NUMBERS = S.RESULT_COLUMNS[7:17]
ADJUSTED, CRUDE = S.RESULT_COLUMNS[:17], [c for c in S.RESULT_COLUMNS if c.startswith("crude_") and c != "crude_converged"]


@query
def analysis_grid_saturated(spark, sf):
    """The full result of every variant, weights saturated in one covariate."""
    result = analysis.run_analysis(eligible(spark, sf), ["segment"], VARIANTS, SAMPLE_STUDY_END)
    return rounded(result.select(*ADJUSTED, "n_missing"), *RESULT_NUMBERS)


@query
def analysis_crude_saturated(spark, sf):
    """The hazard ratios without weights of every variant without the competing model."""
    variants = [v for v in VARIANTS if not v.competing]
    result = analysis.run_analysis(eligible(spark, sf), ["segment"], variants, SAMPLE_STUDY_END)
    return rounded(result.select(*analysis.KEY, "group", *CRUDE), *CRUDE)


@query
def analysis_ph_saturated(spark, sf):
    """The proportional-hazards test of every variant without the competing model."""
    variants = [v for v in VARIANTS if not v.competing]
    cells = analysis.written_cells(eligible(spark, sf), ["segment"], variants, SAMPLE_STUDY_END)
    # Where a coefficient is infinite the SQL has no test of the others, so such keys are left out on both sides.
    infinite = analysis.results_of(cells, variants).where(F.abs("log_hr") == float("inf")).select(*analysis.KEY).distinct()
    found = analysis.ph_of(cells, variants).join(infinite, analysis.KEY, "left_anti")
    return rounded(found.select(*analysis.KEY, "term", "chisq", "df", "p"), "chisq", "p")


@query
def analysis_missing_covariate(spark, sf):
    """The acute main analysis where every fifth subject lacks the covariate: these are counted and take no part."""
    cohort = eligible(spark, sf).withColumn("segment", F.when(F.col("subject_id") % 5 != 0, F.col("segment")))
    variants = [v for v in VARIANTS if (v.name, v.phase) == ("no_added_dose", "acute")]
    result = analysis.run_analysis(cohort, ["segment"], [replace(variants[0], exclude_added_dose=False)], SAMPLE_STUDY_END)
    return rounded(result.select("outcome", "group", "n", "events", "n_missing", *RESULT_NUMBERS), *RESULT_NUMBERS)


@query
def analysis_multinomial(spark, sf):
    """The acute analysis of all outcomes with weights of several covariates."""
    variants = [v for v in VARIANTS if (v.name, v.phase) == ("no_added_dose", "acute")]
    result = analysis.run_analysis(eligible(spark, sf), TERMS, [replace(variants[0], exclude_added_dose=False)], SAMPLE_STUDY_END)
    return rounded(result.select("outcome", "group", "n", "events", *RESULT_NUMBERS), *RESULT_NUMBERS)


@query
def subgroup_results(spark, sf):
    variants = [v for v in VARIANTS if v.name == "subgroup"]
    result = analysis.run_analysis(eligible(spark, sf), ["age", "sex", "score_cci"], variants, SAMPLE_STUDY_END)
    return rounded(result, *RESULT_NUMBERS)


@query
def analysis_grid(spark, sf):
    return rounded(analysis.run_analysis(eligible(spark, sf), TERMS, VARIANTS, SAMPLE_STUDY_END), *RESULT_NUMBERS)


# Files ---------------------------------------------------------------------------------------------


def new_path(spark, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files/{label}-{uuid.uuid4().hex}"


@query
def read_cohort(spark, sf):
    """The person table written as a file and read with the study start pushed into the scan."""
    path = new_path(spark, "persons")
    person_table(spark, sf).write.parquet(path)
    names = ["subject_id", "index_date", "sex", "birth_year", "hx_cv_major", "outcome_death_date", "segment"]
    return read_cohort_file(spark, path, "1998-03-01").select(*names)


@query
def stage_round_trip(spark, sf):
    """Two subgroups written one after the other, then read together."""
    path = new_path(spark, "stage")
    df = materialise(analysable(spark, sf).select("subject_id", "group", "age"), "round-trip")
    for name, condition in (("l65", "age < 65"), ("ge65", "age >= 65")):
        write_stage(df.where(condition).withColumn("subgroup", F.lit(name)), path, ["subgroup"])
    return read_stage(spark, path)


@query
def definitions_round_trip(spark, sf):
    path = new_path(spark, "definitions")
    sheet = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("Name"), (F.col("p_size") % 7).alias("Set"))
    sheet.write.option("header", True).csv(path)
    return read_definitions(spark, path, "PS")


@query
def tables_round_trip(spark, sf):
    path = new_path(spark, "tables")
    nation, region = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region"))
    write_tables(
        {"first": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
         "second": region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))}, path,
    )
    back = spark.read.option("header", True).csv(path)
    return back.select("table_name", F.col("id").cast("long").alias("id"), "name")


@query
def report_round_trip(spark, sf):
    path = new_path(spark, "report")
    write_report(R.event_counts(Z.at_risk(acute_long(analysable(spark, sf))), ["outcome", "group"]), path)
    schema = "outcome string, `group` string, n long, events long, fu long"
    return spark.read.schema(schema).option("header", True).csv(path)


@query
def propensity_terms(spark, sf):
    """Names of a sheet up to a set, in sheet order, numbered without a collect as the sheet is a whole table."""
    name, level = F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")), (F.col("p_size") % 7).cast("int")
    defs = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", name.alias("Name"), level.alias("Set"))
    kept = with_places(definition_filter(defs, 4), "p_partkey")
    return kept.select(F.col("place").cast("int").alias("place"), F.col("Name").alias("name"))


@query
def level_order(spark, sf):
    """Keys in the order of a report: by outcome, groups in level order with the baseline first."""
    keys = Z.at_risk(acute_long(analysable(spark, sf))).select("outcome", "group").distinct()
    placed = numbered(keys, K.level_order("group", S.DOSE_LEVELS, ["outcome"]), "row_no")
    return placed.withColumn("row_no", F.col("row_no").cast("int"))


@query
def ordered_report(spark, sf):
    """Counts written as an ordered report; the place of a row is where the files have it."""
    path = new_path(spark, "report")
    counts = R.event_counts(Z.at_risk(acute_long(analysable(spark, sf))), ["outcome", "group"])
    write_report(counts, path, order=K.level_order("group", S.DOSE_LEVELS, ["outcome"]))
    return read_report(spark, path, "outcome string, `group` string, n long, events long, fu long")


@query
def kept_stages(spark, sf):
    """A named stage that is written once and read by every later plan that is the same."""
    path = new_path(spark, "kept")
    counts = [kept_stage(analysable(spark, sf).select("subject_id", "group", "age"), path).groupBy("group").count() for _ in range(2)]
    return counts[0].join(counts[1].withColumnRenamed("count", "again"), "group")


@query
def ps_assess(spark, sf):
    """Balance before and after weighting, as the assessment of a fit gives it."""
    df = table_input(weighted(spark, sf, ["segment"], TABLE_VARIABLES))
    return rounded(tables.ps_assess(df, TABLE_VARIABLES)["balance"], "max_diff_un", "max_diff_adj")
