"""Any grid of variants in one pass: a subject fans out to its stages, variants and outcomes in the task
that reads it, and one shuffle reduces everything to survival cells."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tideline import schema as S
from tideline.functions import columns as C
from tideline.operators import censoring, cohort as K, rates, survival, weights
from tideline.plans.variants import VARIANTS, Stage, Variant, distinct_variants
from tideline.sources.stages import materialise

KEY = ["variant", "subgroup", "phase", "outcome"]


def added_dose_flags(cohort: DataFrame, key: str = "match") -> DataFrame:
    """Add ``added_acute`` and ``added_post``: 1 if the subject's matched set holds an analysable subject
    (still alive at day 28, for the second) with a dose in the first 28 days. NULL ids form one set.
    """
    doses = K.dose_in_window(K.analysable(cohort))
    sets = doses.groupBy(F.col(key).alias("set_key")).agg(
        F.max(F.lit(1)).alias("added_acute"), F.max(C.survives_to(S.ACUTE_DAYS)).alias("added_post")
    )
    joined = cohort.join(sets, F.col(key).eqNullSafe(F.col("set_key")), "left").drop("set_key")
    return joined.fillna(0, ["added_acute", "added_post"])


def _in_stage(stage: Stage) -> Column:
    conditions = [F.lit(True)]
    if stage.landmark:
        conditions.append(C.survives_to(stage.landmark) == 1)
    if stage.recent_dose is not None:
        since = C.days_since_last_dose(index=F.date_add("index_date", stage.landmark))
        conditions.append((F.col("group_brand") == S.BRAND_LEVELS[0]) | (since <= stage.recent_dose))
    if stage.test_types:
        conditions.append(F.col("test_type").isin(list(stage.test_types)))
    return reduce(and_, conditions)


def stage_rows(cohort: DataFrame, stages: list[Stage]) -> DataFrame:
    """Analysable subjects once per stage (and subgroup) they belong to.

    ``stage`` names the fit (stage and subgroup), ``index_date`` is moved to the landmark; everything else keeps its value at
    the original index.
    """
    rows = K.use_dose_group(K.analysable(cohort))
    fanned = K.explode_where(
        rows, "stage_no", {s.name: F.lit(i) for i, s in enumerate(stages)}, {s.name: _in_stage(s) for s in stages}
    )
    number = F.col("stage_no")

    def value(f) -> Column:
        return F.get(F.array(*[F.lit(f(s)) for s in stages]), number)

    # The subgroups are those of the original index, on which all their conditions are defined.
    own = F.array(*[F.when(c, F.lit(n)) for n, c in K.subgroup_conditions().items()])
    everyone = F.array(F.lit("all"))
    fanned = fanned.withColumn("subgroup", F.explode(F.when(value(lambda s: s.by_subgroup), own).otherwise(everyone)))
    return fanned.where(F.col("subgroup").isNotNull()).withColumns(
        {
            "stage_name": value(lambda s: s.name),
            "stage": F.concat_ws("|", value(lambda s: s.name), "subgroup"),
            "index_date": F.date_add("index_date", value(lambda s: s.landmark)),
        }
    )


def _in_variant(v: Variant, stages: list[Stage], study_end: str) -> Column:
    conditions = [F.col("stage_no") == stages.index(v.stage)]
    if v.exclude_added_dose:
        conditions.append(F.col("added_post" if v.stage.landmark else "added_acute") == 0)
    if v.index_by_study_end:
        conditions.append(F.col("index_date") <= F.lit(study_end).cast("date"))
    return reduce(and_, conditions)


def stages_of(variants: list[Variant]) -> list[Stage]:
    return list(dict.fromkeys(v.stage for v in variants))


def variant_rows(weighted: DataFrame, variants: list[Variant], study_end: str) -> DataFrame:
    """Weighted stage rows once per variant that uses the stage, one row per outcome, censored and at risk.

    Variants are numbers here (``variant_no``), which keeps the rows and the aggregation keys narrow. Only
    the outcomes a variant asks for, without a baseline history, become rows.
    """
    number = F.col("variant_no")
    stages, numbered = stages_of(variants), dict(enumerate(variants))
    fanned = K.explode_where(
        weighted, "variant_no", {i: F.lit(i) for i in numbered},
        {i: _in_variant(v, stages, study_end) for i, v in numbered.items()},
    )

    def numbers(chosen) -> Column:
        picked = [i for i, v in enumerate(variants) if chosen(v)]
        return number.isin(picked) if picked else F.lit(False)

    outcomes = [o for o in S.OUTCOMES if any(o in v.outcomes for v in variants)]
    keep = ["variant_no", "subgroup", "group", "index_date", "death_date", "weight"]
    long = censoring.unpivot_outcomes(
        fanned, outcomes, keep, competing="death", only=lambda o, hx: numbers(lambda v: o in v.outcomes) & (hx == 0)
    )
    days = F.get(F.array(*[F.lit(v.days).cast("int") for v in variants]), number)
    censored = censoring.censor(long, days, study_end, numbers(lambda v: v.prior_counts))
    return censoring.at_risk(censoring.competing_status(censored)).withColumn(
        "status", F.when(numbers(lambda v: v.competing), F.col("status_cr")).otherwise(F.col("status"))
    )


def name_variants(cells: DataFrame, variants: list[Variant]) -> DataFrame:
    """Replace ``variant_no`` by ``variant, phase, competing_model``."""
    number = F.col("variant_no")

    def value(f) -> Column:
        return F.get(F.array(*[F.lit(f(v)) for v in variants]), number)

    names = [value(lambda v: v.name).alias("variant"), value(lambda v: v.phase).alias("phase"),
             value(lambda v: v.competing).alias("competing_model")]
    return cells.select(*names, *[c for c in cells.columns if c != "variant_no"])


def _needed(variants: list[Variant], terms: list[str], columns: list[str]) -> list[str]:
    """Columns an analysis reads, so that the written cohort holds no others."""
    outcomes = {o for v in variants for o in v.outcomes} | {"death"}
    names = ["match", "infected", "test_type", "sex", "age", "severity", "score_cci_age", "group_brand", "group_dose",
             "dose_seq", "bnt", "sino", "index_date", "death_date", *S.ALL_DOSE_DATES]
    names += [f"outcome_{o}_date" for o in outcomes] + [f"hx_{o}" for o in outcomes if o in S.HX_OUTCOMES] + list(terms)
    return [c for c in columns if c in names]


def weighted_stages(cohort: DataFrame, terms: list[str], stages: list[Stage]) -> DataFrame:
    """Analysable subjects once per stage and subgroup, with the weights of that fit.

    ``write_stage(df, path, ["stage_name", "subgroup"])`` keeps them for later analyses. ``cohort`` is read
    by the fit and by whatever uses the result, so it should be a written table.
    """
    rows = stage_rows(cohort, stages)
    return weights.iptw_weights(rows, weights.fit_propensity(rows, terms, by="stage"))


def analysis_cells(
    cohort: DataFrame, terms: list[str], variants: list[Variant] = VARIANTS, study_end: str = S.STUDY_END
) -> DataFrame:
    """Weights for every stage, then the survival cells of every variant, subgroup and outcome.

    ``cohort`` holds the eligible subjects. It is written once, because the fits and the analysis both
    read it.
    """
    variants = list(variants)
    kept = cohort.select(*_needed(variants, terms, cohort.columns))
    if any(v.exclude_added_dose for v in variants):
        kept = added_dose_flags(kept)
    else:
        kept = kept.withColumns({"added_acute": F.lit(0), "added_post": F.lit(0)})
    kept = materialise(K.analysable(kept), "cohort")
    weighted = weighted_stages(kept, terms, stages_of(variants))
    long = censoring.check_time(variant_rows(weighted, variants, study_end))
    cells = survival.survival_cells(long, ["variant_no", "subgroup", "outcome"], weight="weight")
    return name_variants(cells, variants)


def result_table(
    cells: DataFrame, by: list[str], weighted: bool = True, competing: bool = False, level: float = 0.95,
    levels: list[str] = S.DOSE_LEVELS, floor_events: bool = False,
) -> DataFrame:
    """Rates with exact limits and hazard ratios per key and group, joined by key."""
    counts = rates.counts_from_cells(cells, [*by, "group"])
    # The cells of a weight-free table carry weight 1, so its rates are the crude ones.
    rate = rates.poisson_rate_ci(counts, level=level, floor_events=floor_events)
    fit = survival.hazard_ratios(survival.cox_ph(cells, by, levels, weighted, competing=competing), level)
    hr = fit.select(*by, "group", "log_hr", "se", "se_model", "hr", "hr_lo", "hr_hi", "converged")
    return rates.assemble(rate, hr, [*by, "group"])


def crude_ratios(cells: DataFrame, by: list[str], competing: bool = False, level: float = 0.95) -> DataFrame:
    """Hazard ratios without weights, from the counts in the same cells."""
    fit = survival.hazard_ratios(survival.cox_ph(cells, by, weighted=False, variance="model", competing=competing), level)
    names = ["log_hr", "se", "hr", "hr_lo", "hr_hi", "converged"]
    return fit.select(*by, "group", *[F.col(c).alias(f"crude_{c}") for c in names])


def _parts(cells: DataFrame, variants: list[Variant], make) -> DataFrame:
    """``make(cells, competing)`` for the variants with and without the competing model, stacked.

    An analysis that several variants share is made once; its rows are then given out under each name.
    """
    parts = [make(cells.where(F.col("competing_model") == c), c) for c in sorted({v.competing for v in variants})]
    names = F.array("variant")
    for v, own in distinct_variants(variants).items():
        if len(own) > 1:
            same = (F.col("variant") == v.name) & (F.col("phase") == v.phase)
            names = F.when(same, F.array(*map(F.lit, own))).otherwise(names)
    return reduce(DataFrame.unionByName, parts).withColumn("variant", F.explode(names))


def written_cells(
    cohort: DataFrame, terms: list[str], variants: list[Variant] = VARIANTS, study_end: str = S.STUDY_END
) -> DataFrame:
    """The cells of all different variants as a written table, for ``results_of`` and ``ph_of``."""
    return materialise(analysis_cells(cohort, terms, list(distinct_variants(variants)), study_end), "cells")


def results_of(cells: DataFrame, variants: list[Variant] = VARIANTS, level: float = 0.95) -> DataFrame:
    """The long result: counts, weighted rates with limits, weighted and crude hazard ratios per group."""
    def make(part: DataFrame, competing: bool) -> DataFrame:
        adjusted = result_table(part, KEY, competing=competing, level=level)
        return rates.assemble(adjusted, crude_ratios(part, KEY, competing, level), [*KEY, "group"])

    return _parts(cells, variants, make).select(*S.RESULT_COLUMNS)


def ph_of(cells: DataFrame, variants: list[Variant] = VARIANTS) -> DataFrame:
    """The proportional-hazards test of every weighted fit: a row per group and one for all."""
    return _parts(cells, variants, lambda part, competing: survival.ph_test(part, KEY, competing=competing))


def run_analysis(
    cohort: DataFrame, terms: list[str], variants: list[Variant] = VARIANTS, study_end: str = S.STUDY_END,
    level: float = 0.95,
) -> DataFrame:
    """``results_of`` the cells of all variants. ``n_missing`` counts subjects without a weight, which take no part."""
    return results_of(written_cells(cohort, terms, variants, study_end), variants, level)
