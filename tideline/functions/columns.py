"""Column expressions of the cohort build. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from tideline import schema as S


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_at_index(index="index_date", birth_year="birth_year") -> Column:
    """Calendar year of the index date minus the birth year; birthdays are ignored."""
    return F.year(_col(index)) - _col(birth_year)


def comorbidity_score(weights=S.SCORE_WEIGHTS, hierarchy=S.SCORE_HIERARCHY, prefix="dx_") -> Column:
    """Weighted sum of 0/1 flags. A flag in ``hierarchy`` counts only where its severe form is 0.

    A NULL flag makes the whole score NULL.
    """
    terms = []
    for flag, points in weights.items():
        value = f"`{prefix}{flag}`"
        if flag in hierarchy:
            value = f"CAST({value} <> 0 AND NOT `{prefix}{hierarchy[flag]}` <> 0 AS INT)"
        terms.append(f"{value} * {points}")
    return F.expr(" + ".join(terms))


def age_adjusted_score(score="score_cci", age="age") -> Column:
    """Score plus one point per started decade above 49, at most four."""
    steps = F.ceil((_col(age) - 49) / F.lit(10)).cast("int")
    return _col(score) + F.greatest(F.least(steps, F.lit(4)), F.lit(0))


def window_flag(anchor="covid_date", dates=("icu_date", "vent_date"), days=7) -> Column:
    """1 if any of the dates lies in [anchor, anchor + days), else 0; NULL dates count as no."""
    hits = [(_col(d) >= _col(anchor)) & (_col(d) < F.date_add(_col(anchor), days)) for d in dates]
    return F.coalesce(F.when(reduce(or_, hits), 1), F.lit(0))


def dose_sequence(dates=S.DOSE_DATES, brands=S.BRANDS, index="index_date") -> Column:
    """First brand letters of the doses dated strictly before the index, in dose order.

    A skipped dose adds nothing. A dated dose without a brand makes the sequence NULL.
    """
    letters = [
        F.when(_col(d).isNotNull() & (_col(d) < _col(index)), F.substring(_col(b), 1, 1)).otherwise("")
        for d, b in zip(dates, brands)
    ]
    return F.concat(*letters)


def days_since_last_dose(sequence="dose_seq", dates=S.DOSE_DATES, index="index_date", last_dose="length") -> Column:
    """Days from the last dose to the index; NULL without a dose.

    ``last_dose="length"`` takes dose number ``len(sequence)``; ``"max"`` the latest dose date before
    the index, which differs when a dose was skipped.
    """
    if last_dose == "max":
        before = [F.when(_col(d) < _col(index), _col(d)) for d in dates]
        return F.date_diff(_col(index), F.greatest(*before))
    if last_dose != "length":
        raise ValueError(f"last_dose must be 'length' or 'max', not {last_dose!r}")
    return F.date_diff(_col(index), F.get(F.array(*dates), F.length(_col(sequence)) - 1))


def exposure_group(sequence="dose_seq", levels=S.BRAND_LEVELS) -> Column:
    """The sequence itself, ``levels[0]`` for an empty one, NULL outside the levels."""
    seq = _col(sequence)
    return F.when(seq == "", levels[0]).when(seq.isin(levels[1:]), seq)


def dose_group(sequence="dose_seq", mapping=S.DOSE_OF_SEQUENCE, baseline=S.DOSE_LEVELS[0]) -> Column:
    """Dose count level of a single-brand sequence; NULL for mixed brands and longer sequences."""
    seq = _col(sequence)
    groups: dict[str, list[str]] = {}
    for key, level in mapping.items():
        groups.setdefault(level, []).append(key)
    out = F.when(seq == "", baseline)
    for level, keys in groups.items():
        out = out.when(seq.isin(keys), level)
    return out


def brand_flag(letter: str, sequence="dose_seq", max_doses=3) -> Column:
    """1 if the sequence is 1..max_doses doses of one brand, else 0 (also for a NULL sequence)."""
    same = _col(sequence).isin([letter * k for k in range(1, max_doses + 1)])
    return F.coalesce(same, F.lit(False)).cast("int")


def survives_to(days: int, index="index_date", death="death_date") -> Column:
    """1 if not dead before index + days."""
    return (_col(death).isNull() | (_col(death) >= F.date_add(_col(index), days))).cast("int")


def any_date_between(dates, lo: Column, hi: Column) -> Column:
    """True if any of the dates lies in [lo, hi); NULL dates count as no."""
    return reduce(or_, [F.coalesce((_col(d) >= lo) & (_col(d) < hi), F.lit(False)) for d in dates])


def level_index(c, levels) -> Column:
    """0-based position in an ordered level list; NULL outside it."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c))
    return F.when(position > 0, (position - 1).cast("int"))


def as_level(c, levels) -> Column:
    """Cast to string and keep only the given levels; the first one is the baseline."""
    text = _col(c).cast("string")
    return F.when(text.isin([str(v) for v in levels]), text)
