"""Hazard models. Every model reads cells: one shuffle reduces all subjects to (key, group, day, status)."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tideline import schema as S
from tideline.functions import gamma, hazards


def survival_cells(df: DataFrame, by: list[str], weight: str | None = None, status: str = "status") -> DataFrame:
    """(by, group, time, status) -> n, w, w2: all that rates, Cox and Fine-Gray need of the subjects.

    Time must be whole days, which bounds the cells per key by days x statuses x groups. Subjects without a
    weight (a covariate of theirs is missing) take no part in n, w and w2; ``n_missing`` counts them.
    """
    if not isinstance(df.schema["time"].dataType, (T.IntegerType, T.ShortType, T.LongType)):
        raise TypeError("time must be whole days")
    w = F.col(weight) if weight else F.lit(1.0)
    none = F.lit(0.0)
    return df.groupBy(*by, "group", "time", F.col(status).alias("status")).agg(
        F.count(w).alias("n"), F.coalesce(F.sum(w), none).alias("w"), F.coalesce(F.sum(w * w), none).alias("w2"),
        F.count_if(w.isNull()).alias("n_missing"),
    )


def _at(status: int, value: str) -> Column:
    return F.sum(F.when(F.col("status") == status, F.col(value)).otherwise(0))


def risk_table(cells: DataFrame, by: list[str]) -> DataFrame:
    """Per key, group and day: events and what is still at risk (rows and weights)."""
    daily = cells.where("n > 0").groupBy(*by, "group", "time").agg(
        _at(1, "n").alias("n_event"), _at(1, "w").alias("w_event"), F.sum("n").alias("n_day"), F.sum("w").alias("w_day")
    )
    onwards = Window.partitionBy(*by, "group").orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        *by, "group", "time", "n_event", "w_event",
        F.sum("n_day").over(onwards).alias("n_risk"), F.sum("w_day").over(onwards).alias("w_risk"),
    )


def survival_curve(cells: DataFrame, by: list[str]) -> DataFrame:
    """Weighted product-limit curve per group at its event days, with log(-log S)."""
    risk = risk_table(cells, by).where(F.col("n_event") > 0)
    so_far = Window.partitionBy(*by, "group").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    left = 1 - F.col("w_event") / F.col("w_risk")
    gone = F.min(F.when(F.col("n_event") == F.col("n_risk"), 0).otherwise(1)).over(so_far) == 0
    product = F.exp(F.sum(F.when(F.col("n_event") < F.col("n_risk"), F.log(left)).otherwise(0.0)).over(so_far))
    surv = F.when(gone, 0.0).otherwise(product)
    return risk.withColumn("surv", surv).withColumn(
        "cloglog", F.when((F.col("surv") > 0) & (F.col("surv") < 1), F.log(-F.log("surv")))
    )


def risk_sets(
    cells: DataFrame,
    by: list[str],
    levels: list[str] = S.DOSE_LEVELS,
    weighted: bool = True,
    competing: bool = False,
    weight_censoring: bool = False,
) -> DataFrame:
    """Per key a row for each of its days and groups: who leaves that day and what is at risk. All fits read these rows.

    n_day, w_day leave; n_event, w_event of them with the event; the squared weights are kept by how follow-up ends.
    n_risk are the rows of all groups at risk, w_risk the weight of the group, fg_risk the same with what
    competing events leave behind: a subject with one on day s stays at risk with weight w G(t-) / G(s-), G being
    the survival of the censoring time (events before censorings on the same day). Summed over subjects this is
    a running sum over days, so no subject is expanded into rows. Without ``competing`` status 2 is a censoring and
    G is one; without ``weighted`` every row weighs one. Groups that are no level are left out.
    """
    cells = cells.where((F.col("n") > 0) & F.col("group").isin(levels))
    if not weighted:
        cells = cells.withColumns({"w": F.col("n").cast("double"), "w2": F.col("n").cast("double")})
    base = "w" if weight_censoring else "n"
    event, rival = F.col("status") == 1, (F.col("status") == 2) & F.lit(competing)

    def of_level(level: str) -> Column:
        mine = F.col("group") == level
        total = lambda value, which: F.sum(F.when(mine & which, F.col(value)).otherwise(0))
        every = F.lit(True)
        return F.struct(
            F.lit(level).alias("group"),
            total("n", every).alias("n_day"), total("w", every).alias("w_day"),
            total("n", event).alias("n_event"), total("w", event).alias("w_event"), total("w", rival).alias("w_competing"),
            total("w2", ~event & ~rival).alias("w2_censored"), total("w2", event).alias("w2_event"),
            total("w2", rival).alias("w2_competing"),
        )

    # Levels as columns of the day, so that days without rows of a group need no join.
    days = cells.groupBy(*by, "time").agg(
        F.sum(base).alias("all"), _at(0, base).alias("lost"), F.sum("n").alias("day_n"), _at(1, "n").alias("day_events"),
        F.array(*map(of_level, levels)).alias("groups"),
    )
    day = Window.partitionBy(*by).orderBy("time")
    earlier = day.rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.partitionBy(*by).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum("all").over(onwards) - (F.col("all") - F.col("lost"))
    days = days.withColumns({"left": left, "n_risk": F.sum("day_n").over(onwards)}).withColumn(
        "stay", F.when(F.col("left") > 0, 1 - F.col("lost") / F.col("left")).otherwise(1.0)
    )
    log_keep = F.sum(F.when(F.col("stay") > 0, F.log("stay")).otherwise(0.0)).over(earlier)
    survival = F.when(F.min("stay").over(earlier) <= 0, 0.0).otherwise(F.coalesce(F.exp(log_keep), F.lit(1.0)))
    rows = days.withColumn("g_before", survival if competing else F.lit(1.0)).select(
        *by, "time", "day_events", "n_risk", "g_before", F.inline("groups")
    )
    own = Window.partitionBy(*by, "group")
    at_risk = own.orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = own.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    left_behind = F.when(F.col("g_before") > 0, F.col("w_competing") / F.col("g_before")).otherwise(0.0)
    carried = F.coalesce(F.sum(left_behind).over(before), F.lit(0.0)) if competing else F.lit(0.0)
    return (
        rows.withColumns({"in_group": F.sum("n_day").over(own), "w_risk": F.sum("w_day").over(at_risk), "carried": carried})
        .where("in_group > 0")
        .withColumn("fg_risk", F.col("w_risk") + F.col("g_before") * F.col("carried"))
        .drop("in_group", "carried", "w_competing")
    )


def fine_gray_risk_table(
    cells: DataFrame, by: list[str], levels: list[str] = S.DOSE_LEVELS, weight_censoring: bool = False
) -> DataFrame:
    """Risk weights of the sub-distribution hazard at each event day and group."""
    rows = risk_sets(cells, by, levels, competing=True, weight_censoring=weight_censoring)
    return rows.where((F.col("day_events") > 0) & (F.col("fg_risk") > 0)).select(
        *by, "group", "time", "n_event", "w_event", "g_before", "w_risk", "fg_risk"
    )


def _per_key(risk: DataFrame, by: list[str], solve, schema: str) -> DataFrame:
    """Run ``solve`` on the risk sets of each key; a key holds at most days x groups rows, already in one partition."""
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in risk.select(*by).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve(pdf)
        for i, k in enumerate(by):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return risk.drop("day_events", "w_risk").groupBy(*by).applyInPandas(run, f"{key_schema}, {schema}")


COX_SCHEMA = (
    "`group` string, n long, events long, log_hr double, se double, se_model double, expected double, "
    "converged boolean"
)


def cox_ph(
    cells: DataFrame,
    by: list[str],
    levels: list[str] = S.DOSE_LEVELS,
    weighted: bool = False,
    variance: str | None = None,
    competing: bool = False,
    weight_censoring: bool = False,
) -> DataFrame:
    """Cox model of the exposure groups per key; one row per group present, the baseline's without estimates.

    ``variance`` is "model" or "design"; by default the crude fit uses the first, the weighted one the
    second (row-level sandwich). ``expected`` is the event weight the fit expects, in weight units; at the
    maximum it equals the observed one.
    """
    variance = variance or ("design" if weighted or competing else "model")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        f = hazards.fit(pdf, levels, robust=variance == "design")
        cov = f.robust_cov if variance == "design" else f.model_cov
        by_group = pdf.groupby("group")[["n_day", "n_event"]].sum()
        rows = []
        for i, g in enumerate(f.rs.groups):
            k = f.free.index(i) if i in f.free else None
            expected = float((f.rs.events - f.at.score)[:, i].sum() / f.rs.scale) if f.at is not None else None
            rows.append(
                (
                    g,
                    int(by_group.loc[g, "n_day"]),
                    int(by_group.loc[g, "n_event"]),
                    float(f.beta[i]) if i and not np.isnan(f.beta[i]) else None,
                    float(np.sqrt(cov[k, k])) if k is not None else None,
                    float(np.sqrt(f.model_cov[k, k])) if k is not None else None,
                    expected,
                    f.converged,
                )
            )
        names = ["group", "n", "events", "log_hr", "se", "se_model", "expected", "converged"]
        return pd.DataFrame(rows, columns=names)

    return _per_key(risk_sets(cells, by, levels, weighted, competing, weight_censoring), by, solve, COX_SCHEMA)


def fine_gray(
    cells: DataFrame,
    by: list[str],
    levels: list[str] = S.DOSE_LEVELS,
    weighted: bool = True,
    variance: str = "design",
    weight_censoring: bool = False,
) -> DataFrame:
    """Sub-distribution hazard model; the cells carry status 2 for the competing event."""
    return cox_ph(cells, by, levels, weighted, variance, competing=True, weight_censoring=weight_censoring)


def hazard_ratios(fit: DataFrame, level: float = 0.95) -> DataFrame:
    """Add ``hr, hr_lo, hr_hi``: exp of the coefficient and of its Wald limits."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    return fit.withColumns(
        {
            "hr": F.exp("log_hr"),
            "hr_lo": F.exp(F.col("log_hr") - z * F.col("se")),
            "hr_hi": F.exp(F.col("log_hr") + z * F.col("se")),
        }
    )


def add_reference_row(hr: DataFrame, by: list[str], level: str = S.DOSE_LEVELS[0]) -> DataFrame:
    """Put a baseline row without estimates to every key that lacks one."""
    rows = hr.where(F.col("group") != level)
    baseline = hr.select(*by).distinct().withColumn("group", F.lit(level))
    return baseline.unionByName(rows, allowMissingColumns=True)


def ph_test(
    cells: DataFrame, by: list[str], levels: list[str] = S.DOSE_LEVELS, weighted: bool = True, competing: bool = False
) -> DataFrame:
    """Score test of hazard ratios that change with 1 - S(t-): one row per group and one for all."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        f = hazards.fit(pdf, levels, robust=False)
        rows = hazards.ph_score_test(f) if f.free else []
        out = pd.DataFrame(rows, columns=["term", "chisq", "df"])
        p = np.full(len(out), np.nan)
        ok = out["chisq"].notna().to_numpy()
        if ok.any():
            p[ok] = gamma.chi2_tail(out["chisq"].to_numpy(float)[ok], out["df"].to_numpy(float)[ok])
        out["p"] = p
        return out

    return _per_key(risk_sets(cells, by, levels, weighted, competing), by, solve, "term string, chisq double, df int, p double")


def cox_score(cells: DataFrame, by: list[str], levels: list[str] = S.DOSE_LEVELS, weighted: bool = False) -> DataFrame:
    """Score vector and information matrix at no effect, one row per pair of non-baseline groups."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rs = hazards.risk_sets(pdf, levels)
        at = hazards.likelihood(rs, np.zeros(len(rs.groups)))
        score, info = at.score.sum(0), at.info.sum(0)
        rows = [
            (a, b, float(score[i]), float(info[i, j]))
            for i, a in enumerate(rs.groups) for j, b in enumerate(rs.groups)
            if a != levels[0] and b != levels[0]
        ]
        return pd.DataFrame(rows, columns=["group", "group2", "score", "info"])

    return _per_key(risk_sets(cells, by, levels, weighted), by, solve, "`group` string, group2 string, score double, info double")


def cox_curve(cells: DataFrame, by: list[str], levels: list[str] = S.DOSE_LEVELS, weighted: bool = True) -> DataFrame:
    """Model-based survival per group at the event days, with log(-log S)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        f = hazards.fit(pdf, levels, robust=False)
        if f.at is None:
            return pd.DataFrame(columns=["group", "time", "cum_hazard", "surv", "cloglog"])
        days = f.rs.deaths > 0
        cum = hazards.baseline_hazard(f)[days]
        parts = []
        for i, g in enumerate(f.rs.groups):
            if np.isnan(f.beta[i]):
                continue
            h = cum * np.exp(f.beta[i]) if np.isfinite(f.beta[i]) else cum * 0.0
            with np.errstate(divide="ignore"):
                log_h = np.where(h > 0, np.log(h), np.nan)
            parts.append(
                pd.DataFrame({"group": g, "time": f.rs.times[days], "cum_hazard": h, "surv": np.exp(-h), "cloglog": log_h})
            )
        return pd.concat(parts)

    return _per_key(risk_sets(cells, by, levels, weighted), by, solve, "`group` string, time int, cum_hazard double, surv double, cloglog double")
