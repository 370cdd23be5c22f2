"""Aggregated fits against brute force over the subjects."""

import numpy as np
import pandas as pd
import pytest

from tideline import schema as S
from tideline.functions import hazards
from tideline.operators import rates, survival as V

GROUPS = S.DOSE_LEVELS


def subjects(n=400, days=40, seed=3, competing=False, weighted=True):
    rng = np.random.default_rng(seed)
    g = rng.choice(4, n, p=[0.4, 0.3, 0.2, 0.1])
    t = np.minimum(np.ceil(rng.exponential(40 / (1 + 0.3 * g))), rng.integers(5, days, n)).astype(int)
    status = (rng.random(n) < 0.5).astype(int)
    if competing:
        status = np.where((status == 0) & (rng.random(n) < 0.4), 2, status)
    w = np.exp(rng.normal(0, 0.5, n)) if weighted else np.ones(n)
    return pd.DataFrame({"group": [GROUPS[i] for i in g], "g": g, "time": t, "status": status, "weight": w})


def risk_of(df, weighted=True, competing=False, weight_censoring=False):
    """Risk sets by their definition, subject by subject."""
    df = df.assign(w=df["weight"] if weighted else 1.0)
    rival = df["status"].eq(2) & competing
    keep = censoring_keep(df, df["w"] if weight_censoring else None) if competing else dict.fromkeys(range(df["time"].max() + 1), 1.0)
    rows = []
    for t in sorted(df["time"].unique()):
        for g in sorted(df["group"].unique()):
            mine, today = df["group"].eq(g), df["time"].eq(t)
            here, event = mine & today, df["status"].eq(1)
            w, sq = lambda m: df.loc[m, "w"].sum(), lambda m: (df.loc[m, "w"] ** 2).sum()
            gone = df[mine & rival & df["time"].lt(t)]
            still = w(mine & df["time"].ge(t))
            rows.append(
                (g, t, here.sum(), w(here), (here & event).sum(), w(here & event), sq(here & ~event & ~rival), sq(here & event),
                 sq(here & rival), df["time"].ge(t).sum(), keep[t], still,
                 still + sum(x * keep[t] / keep[s] for s, x in zip(gone["time"], gone["w"]) if keep[s] > 0))
            )
    names = "group time n_day w_day n_event w_event w2_censored w2_event w2_competing n_risk g_before w_risk fg_risk"
    return pd.DataFrame(rows, columns=names.split())


def fitted(df, weighted=True, competing=False):
    return hazards.fit(risk_of(df, weighted, competing), GROUPS)


def row_level(df, beta, w=None, keep=None):
    """Efron log likelihood over subjects; competing subjects stay at reduced weight if ``keep`` is given."""
    w = df["weight"].to_numpy() if w is None else w
    t, s, g = df["time"].to_numpy(), df["status"].to_numpy(), df["g"].to_numpy()
    r = np.exp(np.concatenate([[0], beta]))[g]
    total = 0.0
    for u in np.unique(t[s == 1]):
        factor = (t >= u).astype(float)
        if keep is not None:
            gone = (t < u) & (s == 2)
            factor[gone] = keep[u] / np.array([keep[x] for x in t[gone]])
        dead = (t == u) & (s == 1)
        d = dead.sum()
        a, b = (factor * w * r).sum(), (w * r)[dead].sum()
        total += (w * np.log(r))[dead].sum()
        total -= w[dead].sum() / d * sum(np.log(a - k / d * b) for k in range(d))
    return total


def gradient(f, x, h=1e-5):
    return np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(len(x))])


def censoring_keep(df, weights=None):
    t, s = df["time"].to_numpy(), df["status"].to_numpy()
    w = np.ones(len(df)) if weights is None else weights.to_numpy()
    out, value = {}, 1.0
    for u in range(0, t.max() + 1):
        out[u] = value
        left = w[(t > u) | ((t == u) & (s == 0))].sum()
        lost = w[(t == u) & (s == 0)].sum()
        if left:
            value *= 1 - lost / left
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_cox_optimum(weighted):
    df = subjects(weighted=weighted)
    f = fitted(df, weighted)
    assert f.converged
    assert np.abs(gradient(lambda b: row_level(df, b), f.beta[1:])).max() < 1e-5
    at = row_level(df, f.beta[1:])
    assert at * f.rs.scale == pytest.approx(f.at.loglik + _scale_term(df, f.rs.scale), rel=1e-10)


def _scale_term(df, scale):
    """Scaling all weights by c adds c * (events' weight) * log(c) to the log likelihood."""
    w = df["weight"].to_numpy() * scale
    return w[df["status"].to_numpy() == 1].sum() * np.log(scale)


def place(rs, row):
    """Where the influence of a subject stands: end of follow-up, day, group."""
    return row["status"], np.searchsorted(rs.times, row["time"]), rs.groups.index(row["group"])


@pytest.mark.parametrize("competing", [False, True])
def test_influences_are_derivatives_in_the_weights(competing):
    df = subjects(n=120, competing=competing)
    keep = censoring_keep(df) if competing else None
    f = fitted(df, competing=competing)
    beta, w = f.beta[1:], df["weight"].to_numpy()
    assert np.abs(gradient(lambda b: row_level(df, b, keep=keep), beta)).max() < 1e-5
    u = hazards.influence(f.rs, f.at)[..., 1:]
    for i in range(0, len(df), 7):
        up, down = w.copy(), w.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (gradient(lambda b: row_level(df, b, up, keep), beta) - gradient(lambda b: row_level(df, b, down, keep), beta)) / 2e-4
        row = df.iloc[i]
        assert u[place(f.rs, row)] == pytest.approx(slope, abs=2e-4)


def test_sandwich_is_row_level():
    df = subjects()
    f = fitted(df)
    every = hazards.influence(f.rs, f.at)[..., 1:]
    u = np.array([every[place(f.rs, row)] for _, row in df.iterrows()])
    z = (df["weight"].to_numpy() * f.rs.scale)[:, None] * u @ f.model_cov
    n = len(df)
    assert np.allclose(z.sum(0), 0, atol=1e-9)
    assert np.allclose(n / (n - 1) * z.T @ z, f.robust_cov, atol=1e-12)


def test_unit_weights_give_the_crude_fit():
    df = subjects(weighted=False)
    assert np.allclose(fitted(df, True).beta, fitted(df, False).beta, atol=1e-12)


def test_fine_gray_without_competing_events_is_cox():
    a, b = fitted(subjects(), competing=True), fitted(subjects())
    assert np.allclose(a.beta, b.beta, atol=1e-10) and np.allclose(a.robust_cov, b.robust_cov)


def test_fine_gray_with_common_end_keeps_competing_subjects():
    """Nobody is censored before the end, so Fine-Gray is Cox with competing subjects moved to the end."""
    df = subjects(competing=True)
    df["time"] = df["time"].where(df["status"] != 0, 50)
    moved = df.assign(time=df["time"].where(df["status"] != 2, 50), status=(df["status"] == 1).astype(int))
    a, b = fitted(df, competing=True), fitted(moved)
    assert np.allclose(a.beta, b.beta, atol=1e-10) and np.allclose(a.robust_cov, b.robust_cov, atol=1e-12)


def test_tie_sums_in_blocks(monkeypatch):
    a, b, d = np.array([10.0, 5.0, 7.0]), np.array([3.0, 0.5, 6.9]), np.array([4.0, 0.0, 9.0])
    whole = hazards.tie_sums(a, b, d)
    monkeypatch.setattr(hazards, "TIE_BLOCK", 3)
    for x, y in zip(vars(whole).values(), vars(hazards.tie_sums(a, b, d)).values()):
        assert np.allclose(x, y, rtol=1e-14)
    f = np.arange(9) / 9
    assert whole.q1[2] == pytest.approx((f / (7 - f * 6.9) ** 2).sum())


@pytest.mark.parametrize("d", [hazards.LONG_DAY + 1, 300_000])
@pytest.mark.parametrize("share", [1e-9, 1e-3, 0.4, 0.999, 1.0])
def test_days_with_many_events(share, d):
    """The constant-time sums against all terms, also where everyone at risk dies that day."""
    a, b = np.array([2.5e5]), np.array([2.5e5 * share])
    got = hazards.tie_sums(a, b, np.array([float(d)]))
    for name, values in hazards._terms(np.arange(d) / d, a[0], b[0]).items():
        assert getattr(got, name)[0] == pytest.approx(values.sum(), rel=2e-12), name


def test_groups_without_estimates():
    df = subjects(n=200)
    df.loc[df["group"] == "3d", "status"] = 0
    f = fitted(df)
    assert f.beta[3] == -np.inf and f.converged and len(f.free) == 2
    df.loc[df["group"] == "X", "status"] = 0
    assert np.isnan(fitted(df).beta).all()
    df["status"] = 0
    assert np.isnan(fitted(df).beta).all()


def test_monotone_likelihood_is_reported_as_infinite():
    """All of 1d die before anyone of X does."""
    rows = [("X", 10, 1, 3), ("X", 12, 0, 3), ("1d", 2, 1, 2), ("1d", 3, 1, 2)]
    rows = [row[:3] for row in rows for _ in range(row[3])]
    f = fitted(pd.DataFrame(rows, columns=["group", "time", "status"]).assign(weight=1.0), False)
    assert f.beta[1] == np.inf and f.free == []


def frame(spark, df, outcome="a"):
    columns = df.drop(columns="g").assign(outcome=outcome).astype({"time": "int32", "status": "int32"})
    return spark.createDataFrame(columns, "`group` string, time int, status int, weight double, outcome string")


def day_cells(spark, df):
    return V.survival_cells(frame(spark, df), ["outcome"], "weight")


def test_spark_fit_equals_numpy(spark):
    df = subjects()
    f = fitted(df)
    got = V.hazard_ratios(V.cox_ph(day_cells(spark, df), ["outcome"], weighted=True)).toPandas().set_index("group")
    assert got.loc["2d", "log_hr"] == pytest.approx(f.beta[2], abs=1e-9)
    assert got.loc["2d", "se"] == pytest.approx(np.sqrt(f.robust_cov[1, 1]), abs=1e-9)
    assert pd.isna(got.loc["X", "log_hr"]) and got.loc["X", "n"] == (df["group"] == "X").sum()
    observed = df[df["status"] == 1].groupby("group")["weight"].sum()
    assert np.allclose(got["expected"], observed.reindex(got.index))


def test_fine_gray_risk_table_against_expansion(spark):
    df = subjects(competing=True)
    keep = censoring_keep(df)
    table = V.fine_gray_risk_table(day_cells(spark, df), ["outcome"]).toPandas()
    assert len(table) > 50
    for row in table.itertuples():
        mine = df[df["group"] == row.group]
        still = mine[mine["time"] >= row.time]["weight"].sum()
        gone = mine[(mine["time"] < row.time) & (mine["status"] == 2)]
        later = (gone["weight"] * keep[row.time] / gone["time"].map(keep)).sum()
        assert row.fg_risk == pytest.approx(still + later, rel=1e-10)
        assert row.g_before == pytest.approx(keep[row.time], rel=1e-10)


@pytest.mark.parametrize("weighted, competing, weight_censoring", [(True, False, False), (False, True, False), (True, True, True)])
def test_risk_sets_against_the_subjects(spark, weighted, competing, weight_censoring):
    df = subjects(competing=True)
    df = df[df["group"] != "2d"]  # a level without rows has none in the table
    got = V.risk_sets(day_cells(spark, df), ["outcome"], GROUPS, weighted, competing, weight_censoring).toPandas()
    got = got.sort_values(["time", "group"]).reset_index(drop=True)
    want = risk_of(df, weighted, competing, weight_censoring)
    assert (got[["group", "time", "n_day", "n_event", "n_risk"]] == want[["group", "time", "n_day", "n_event", "n_risk"]]).all().all()
    numbers = ["w_day", "w_event", "w2_censored", "w2_event", "w2_competing", "g_before", "w_risk", "fg_risk"]
    assert np.allclose(got[numbers], want[numbers], rtol=1e-10, atol=1e-12)


def test_a_fit_needs_no_exchange_beyond_its_risk_sets(spark):
    """One exchange brings the days of the cells together, one the days of a key; windows and solver share the latter."""
    cells = day_cells(spark, subjects()).checkpoint()
    plan = V.cox_ph(cells, ["outcome"], weighted=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_curve_and_zero_survivors(spark):
    df = subjects(weighted=False)
    curve = V.survival_curve(day_cells(spark, df), ["outcome"]).toPandas()
    mine = df[df["group"] == "1d"]
    value = 1.0
    for u in sorted(mine[mine["status"] == 1]["time"].unique()):
        value *= 1 - ((mine["time"] == u) & (mine["status"] == 1)).sum() / (mine["time"] >= u).sum()
        got = curve[(curve["group"] == "1d") & (curve["time"] == u)]["surv"].iloc[0]
        assert got == pytest.approx(value, abs=1e-12)
    all_dead = pd.DataFrame({"group": ["X"] * 3, "g": 0, "time": [1, 2, 2], "status": 1, "weight": 1.0})
    last = V.survival_curve(day_cells(spark, all_dead), ["outcome"]).orderBy("time").collect()
    assert [r["surv"] for r in last] == pytest.approx([2 / 3, 0.0])


def test_cox_curve_follows_the_hazard_ratios(spark):
    curve = V.cox_curve(day_cells(spark, subjects()), ["outcome"]).toPandas().pivot(index="time", columns="group", values="cum_hazard")
    f = fitted(subjects())
    assert np.allclose(curve["2d"] / curve["X"], np.exp(f.beta[2]))
    assert (curve["X"].diff().dropna() > 0).all()


def test_ph_test_finds_a_reversal(spark):
    rng = np.random.default_rng(0)
    n = 3000
    g = rng.integers(0, 2, n)
    late = rng.random(n) < np.where(g == 1, 0.8, 0.2)
    t = np.where(late, rng.integers(20, 40, n), rng.integers(1, 20, n))
    crossing = pd.DataFrame({"group": np.where(g == 1, "1d", "X"), "g": g, "time": t, "status": 1, "weight": 1.0})
    steady = crossing.assign(time=rng.integers(1, 40, n))
    p = lambda d: V.ph_test(day_cells(spark, d), ["outcome"]).where("term = 'GLOBAL'").first()
    assert p(crossing)["p"] < 1e-10 and p(crossing)["df"] == 1
    assert p(steady)["p"] > 0.001


def test_ph_score_is_the_derivative_in_the_slope():
    """The score of a coefficient that changes with g(t), by differences of the row-level likelihood."""
    df = subjects(n=150, weighted=False)
    f = fitted(df, False)
    g = 1 - hazards.survival_before(f.rs)
    g = g - np.average(g, weights=f.rs.deaths)
    total = (g[:, None] * f.at.score).sum(0)

    def shifted(gamma):
        value = 0.0
        for day, slope in zip(f.rs.times, g):
            dead = df[(df["time"] == day) & (df["status"] == 1)]
            if len(dead) == 0:
                continue
            now = df[df["time"] >= day].assign(status=lambda d: ((d["time"] == day) & (d["status"] == 1)).astype(int), time=day)
            value += row_level(now, f.beta[1:] + gamma * slope)
        return value

    assert total[1:] == pytest.approx(gradient(shifted, np.zeros(3)), abs=1e-4)


def test_reference_row_and_empty_fit(spark):
    df = subjects()
    df["status"] = 0
    hr = V.add_reference_row(V.hazard_ratios(V.cox_ph(day_cells(spark, df), ["outcome"])), ["outcome"]).toPandas()
    assert sorted(hr["group"]) == sorted(GROUPS) and hr["hr"].isna().all()


def test_time_must_be_days(spark):
    df = spark.createDataFrame([("X", 1.5, 1, "a")], "group string, time double, status int, outcome string")
    with pytest.raises(TypeError):
        V.survival_cells(df, ["outcome"])


def test_counts_from_cells_equal_counts_from_subjects(spark):
    df = subjects()
    rows = frame(spark, df)
    a = rates.event_counts(rows, ["outcome", "group"]).toPandas().set_index("group")
    b = rates.weighted_event_rates(rows, ["outcome", "group"]).toPandas().set_index("group")
    c = rates.counts_from_cells(day_cells(spark, df), ["outcome", "group"]).toPandas().set_index("group").loc[a.index]
    assert (a[["n", "events", "fu"]] == c[["n", "events", "fu"]]).all().all()
    assert np.allclose(b.loc[a.index][["w_events", "pt", "rate"]], c[["w_events", "pt", "rate"]])
