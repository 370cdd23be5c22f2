"""The analyses of the study as parameter sets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tideline import schema as S


@dataclass(frozen=True)
class Stage:
    """Subjects whose weights are fitted together."""

    name: str
    landmark: int = 0                  # days the index is moved; earlier deaths leave
    recent_dose: int | None = None     # longest time since the last dose, from the moved index
    test_types: tuple[str, ...] = ()
    by_subgroup: bool = False          # a fit of its own per subgroup


@dataclass(frozen=True)
class Variant:
    """An analysis of a weighted stage."""

    name: str
    phase: str
    stage: Stage
    outcomes: tuple[str, ...]
    days: int | None = None            # length of follow-up; None runs to the end of the study
    prior_counts: bool = True          # outcomes before the index are history
    exclude_added_dose: bool = False   # drop matched sets with a dose in the first 28 days
    index_by_study_end: bool = False   # drop subjects whose index is after the end of the study
    competing: bool = False            # Fine-Gray with death as competing event instead of Cox


ACUTE = Stage("acute")
POSTACUTE = Stage("postacute", landmark=S.ACUTE_DAYS)
LATE = Stage("postacute90d", landmark=S.LATE_DAYS)
ACUTE_PCR = Stage("acute_pcr", test_types=tuple(S.PCR_TEST_TYPES))
POSTACUTE_PCR = Stage("postacute_pcr", landmark=S.ACUTE_DAYS, test_types=tuple(S.PCR_TEST_TYPES))
ACUTE_180 = Stage("acute_180", recent_dose=S.RECENT_DOSE_DAYS)
POSTACUTE_180 = Stage("postacute_180", landmark=S.ACUTE_DAYS, recent_dose=S.RECENT_DOSE_DAYS)
ACUTE_SUB = Stage("acute_sub", by_subgroup=True)
POSTACUTE_SUB = Stage("postacute_sub", landmark=S.ACUTE_DAYS, by_subgroup=True)

# Outcome lists of the analyses.
MAIN = ("cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_mi", "cv_death", "death")
NO_MI = ("cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_death", "death")
WITH_ACS = ("cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_acs", "cv_death", "death")
SUBGROUP = ("cv_stroke", "cv_cad", "cv_hf", "cv_death")
COMPETING = ("cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_death")


def distinct_variants(variants: list[Variant]) -> dict[Variant, list[str]]:
    """Variants that differ in more than their name, each with all its names; the others are the same analysis."""
    names: dict[Variant, list[str]] = {}
    first: dict[Variant, Variant] = {}
    for v in variants:
        names.setdefault(first.setdefault(replace(v, name=""), v), []).append(v.name)
    return names


def _acute(name: str, stage: Stage, outcomes: tuple[str, ...], **more) -> Variant:
    return Variant(name, "acute", stage, outcomes, days=S.ACUTE_DAYS, prior_counts=False, **more)


def _post(name: str, stage: Stage, outcomes: tuple[str, ...], **more) -> Variant:
    return Variant(name, "postacute", stage, outcomes, **more)


VARIANTS = (
    _acute("main", ACUTE, ("cv_major",)),
    _post("main", POSTACUTE, MAIN, exclude_added_dose=True),
    _post("with_added_dose", POSTACUTE, MAIN),
    _post("days_28_89", POSTACUTE, NO_MI, days=S.INTERVAL_DAYS),
    Variant("day_90_on", "postacute90d", LATE, NO_MI, index_by_study_end=True),
    _acute("pcr", ACUTE_PCR, MAIN),
    _post("pcr", POSTACUTE_PCR, MAIN),
    _acute("recent_180", ACUTE_180, WITH_ACS),
    _post("recent_180", POSTACUTE_180, WITH_ACS),
    _acute("no_added_dose", ACUTE, MAIN, exclude_added_dose=True),
    _post("no_added_dose", POSTACUTE, MAIN, exclude_added_dose=True),
    _acute("subgroup", ACUTE_SUB, SUBGROUP),
    _post("subgroup", POSTACUTE_SUB, SUBGROUP),
    _acute("competing", ACUTE, COMPETING, competing=True),
    _post("competing", POSTACUTE, COMPETING, competing=True),
)
