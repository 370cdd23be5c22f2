"""Cox steps on the risk sets of one analysis, used inside one task per analysis.

The risk sets come from Spark (``operators.survival.risk_sets``): a row per day and group. With whole days and
few groups these are few rows per analysis, however many subjects there are, so one analysis always fits a
task. Ties follow Efron.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

TIE_BLOCK = 1 << 20
LONG_DAY = 1 << 12
TAIL = 1 << 10
#: What ends the follow-up of a subject, as it matters for its influence.
CENSORED, EVENT, COMPETING = range(3)


@dataclass
class RiskSets:
    """Per day and group; rows are days in order, columns the groups present."""

    groups: list[str]
    times: np.ndarray
    deaths: np.ndarray       # events per day, unweighted
    events: np.ndarray       # weighted events, day x group
    risk: np.ndarray         # weight at risk, day x group
    mean_weight: np.ndarray  # mean event weight per day
    keep: np.ndarray         # censoring survival just before the day; ones without competing events
    n_risk: np.ndarray       # rows at risk per day
    squares: np.ndarray      # sums of squared weights, end of follow-up x day x group
    n: int
    scale: float


def risk_sets(table: pd.DataFrame, levels: list[str]) -> RiskSets:
    """The rows of one analysis as arrays, with weights of mean 1: the estimates do not change, the information
    is on the scale of the rows."""
    present = set(table["group"])
    groups = [g for g in levels if g in present]
    days = {n: part.sort_values("time") for n, part in table.groupby("group")}
    wide = lambda name: np.column_stack([days[g][name].to_numpy(float) for g in groups])
    first = days[groups[0]]
    n = wide("n_day").sum()
    scale = n / wide("w_day").sum()
    events, deaths = wide("w_event") * scale, wide("n_event").sum(1)
    mean_weight = np.divide(events.sum(1), deaths, out=np.zeros(len(first)), where=deaths > 0)
    squares = np.stack([wide(name) for name in ("w2_censored", "w2_event", "w2_competing")]) * scale**2
    return RiskSets(
        groups, first["time"].to_numpy(), deaths, events, wide("fg_risk") * scale, mean_weight,
        first["g_before"].to_numpy(float), first["n_risk"].to_numpy(float), squares, int(n), scale,
    )


@dataclass
class TieSums:
    """Per event day, sums over l = 0..d-1 of powers of 1 / (a - l/d b)."""

    s0: np.ndarray
    s1: np.ndarray
    q0: np.ndarray
    q1: np.ndarray
    q2: np.ndarray
    log: np.ndarray


# Numerator and denominator powers: each sum runs over f^q / (a - f b)^p, f = l / d.
POWERS = {"s0": (0, 1), "s1": (1, 1), "q0": (0, 2), "q1": (1, 2), "q2": (2, 2)}
NODES, NODE_WEIGHTS = np.polynomial.legendre.leggauss(24)


def _terms(f: np.ndarray, a, b) -> dict[str, np.ndarray]:
    u = a - f * b
    s0 = 1 / u
    s1 = f * s0
    return {"s0": s0, "s1": s1, "q0": s0 * s0, "q1": s1 * s0, "q2": s1 * s1, "log": np.log(u)}


def tie_sums(a: np.ndarray, b: np.ndarray, deaths: np.ndarray) -> TieSums:
    """Efron's sums per day: term by term for days with few events, in constant time for the others."""
    d = deaths.astype(np.int64)
    out = {k: np.zeros(len(d)) for k in (*POWERS, "log")}
    few = np.flatnonzero((d > 0) & (d <= LONG_DAY))
    starts = np.concatenate([[0], np.cumsum(d[few])])
    for lo in range(0, int(starts[-1]), TIE_BLOCK):
        pos = np.arange(lo, min(lo + TIE_BLOCK, int(starts[-1])))
        t = np.searchsorted(starts, pos, side="right") - 1
        day = few[t]
        for name, values in _terms((pos - starts[t]) / d[day], a[day], b[day]).items():
            out[name] += np.bincount(day, weights=values, minlength=len(d))
    for day in np.flatnonzero(d > LONG_DAY):
        for name, value in _long_day(float(a[day]), float(b[day]), int(d[day])).items():
            out[name][day] = value
    return TieSums(**out)


def _long_day(a: float, b: float, d: int) -> dict[str, float]:
    """The sums of one day with many events, to rounding error.

    The terms can only become singular beyond the last one. The last TAIL terms are added up; the rest is
    an integral with the Euler-Maclaurin end corrections, whose next term is below 1e-13 that far from the
    end. The integral is taken over panels that halve towards the end.
    """
    head = d - TAIL
    end = head / d
    distances = 0.5 ** np.arange(0, 64)
    edges = np.append(1 - distances[distances > TAIL / d], end)
    lo, hi = edges[:-1], edges[1:]
    x = (lo + hi)[:, None] / 2 + (hi - lo)[:, None] / 2 * NODES
    w = (hi - lo)[:, None] / 2 * NODE_WEIGHTS
    inside = _terms(x, a, b)
    tail = _terms(np.arange(head, d) / d, a, b)
    ends = _terms(np.array([0.0, end]), a, b)
    out = {}
    for name, values in inside.items():
        slopes = []
        for f in (0.0, end):
            u = a - f * b
            if name == "log":
                slopes.append(-b / u)
            else:
                q, p = POWERS[name]
                slopes.append((q * f ** (q - 1) if q else 0.0) / u**p + p * b * f**q / u ** (p + 1))
        at_ends = ends[name]
        out[name] = (
            d * (w * values).sum() + (at_ends[0] - at_ends[1]) / 2 + (slopes[1] - slopes[0]) / (12 * d) + tail[name].sum()
        )
    return out


@dataclass
class Likelihood:
    loglik: float
    score: np.ndarray       # day x group
    info: np.ndarray        # day x group x group
    ratio: np.ndarray       # exp(beta) per group
    ties: TieSums


def likelihood(rs: RiskSets, beta: np.ndarray) -> Likelihood:
    """Log likelihood, score and information per day at ``beta`` (one entry per group; -inf drops one)."""
    r = np.exp(beta)
    ties = tie_sums(rs.risk @ r, rs.events @ r, rs.deaths)
    m = rs.mean_weight
    R, E = rs.risk * r, rs.events * r
    score = rs.events - m[:, None] * (R * ties.s0[:, None] - E * ties.s1[:, None])
    expected = m[:, None] * (R * ties.s0[:, None] - E * ties.s1[:, None])
    outer = lambda x, y: x[:, :, None] * y[:, None, :]
    second = (
        outer(R, R) * ties.q0[:, None, None]
        - (outer(R, E) + outer(E, R)) * ties.q1[:, None, None]
        + outer(E, E) * ties.q2[:, None, None]
    )
    info = np.zeros_like(second)
    idx = np.arange(len(r))
    info[:, idx, idx] = expected
    info -= m[:, None, None] * second
    used = np.isfinite(beta)
    loglik = float((rs.events[:, used] * beta[used]).sum() - (m * ties.log).sum())
    return Likelihood(loglik, score, info, r, ties)


@dataclass
class Fit:
    rs: RiskSets
    beta: np.ndarray          # log hazard ratio per group of rs.groups
    free: list[int]           # groups with an estimated coefficient
    model_cov: np.ndarray     # inverse information over the free groups
    robust_cov: np.ndarray | None
    at: Likelihood | None
    converged: bool


def fit(table: pd.DataFrame, levels: list[str], robust: bool = True, max_iter: int = 50) -> Fit:
    """Newton on the groups; the first level is the baseline.

    A group without events gets -inf, the limit of its coefficient; see _settle for other limits. Without
    events at all, or without events in the baseline, nothing can be estimated: all coefficients are NaN.
    """
    rs = risk_sets(table, levels)
    had = rs.events.sum(0) > 0
    beta = np.full(len(rs.groups), np.nan)
    empty = np.zeros((0, 0))
    if not had.any() or rs.groups[0] != levels[0] or not had[0]:
        return Fit(rs, beta, [], empty, None, None, False)
    free = [i for i in range(1, len(rs.groups)) if had[i]]
    beta = np.where(had, 0.0, -np.inf)
    at = likelihood(rs, beta)
    converged = not free
    step = np.zeros(len(free))
    for _ in range(max_iter if free else 0):
        score, info = at.score.sum(0)[free], at.info.sum(0)[np.ix_(free, free)]
        step = np.linalg.lstsq(info, score, rcond=1e-14)[0]
        size = 1.0
        while True:
            trial = beta.copy()
            trial[free] += size * step
            new = likelihood(rs, trial)
            if new.loglik >= at.loglik - 1e-10 * abs(at.loglik) or size < 1e-6:
                break
            size /= 2
        gain = new.loglik - at.loglik
        beta, at = trial, new
        converged = bool(np.abs(step).max() < 1e-11)
        if converged or (np.abs(step).max() > 0.1 and abs(gain) < 1e-11 * max(abs(at.loglik), 1.0)):
            break
    reported, free = _settle(beta, at, free, step)
    info = at.info.sum(0)[np.ix_(free, free)]
    model_cov = np.linalg.inv(info) if free else empty
    robust_cov = sandwich(rs, at, free, model_cov) if robust and free else None
    return Fit(rs, reported, free, model_cov, robust_cov, at, converged)


def _settle(beta: np.ndarray, at: Likelihood, free: list[int], step: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Coefficients to report, and those among them with a finite estimate.

    One that still drifts when the likelihood no longer grows is reported as infinite, one the likelihood
    does not depend on as NaN; the others are estimated in that limit.
    """
    reported, kept = beta.copy(), []
    if not free:
        return reported, kept
    values, vectors = np.linalg.eigh(at.info.sum(0)[np.ix_(free, free)])
    flat = vectors[:, values < 1e-10 * max(values.max(), 1.0)]
    for k, i in enumerate(free):
        if abs(step[k]) > 0.1:
            reported[i] = np.inf if step[k] > 0 else -np.inf
        elif flat.size and np.abs(flat[k]).max() > 1e-6:
            reported[i] = np.nan
        else:
            kept.append(i)
    return reported, kept


def influence(rs: RiskSets, at: Likelihood) -> np.ndarray:
    """Score residual of one row (per unit weight): end of follow-up x day x group of the row x group."""
    m, t = rs.mean_weight[:, None], at.ties
    R, E, r = rs.risk * at.ratio, rs.events * at.ratio, at.ratio
    G = len(r)
    share = np.divide(
        R * t.s0[:, None] - E * t.s1[:, None], rs.deaths[:, None], out=np.zeros_like(R), where=rs.deaths[:, None] > 0
    )
    out = np.zeros((3, len(rs.times), G, G))
    for g in range(G):
        unit = np.eye(G)[g]
        passed = m * (unit * t.s0[:, None] - (R * t.q0[:, None] - E * t.q1[:, None]))
        own = m * (unit * (t.s0 - t.s1)[:, None] - (R * (t.q0 - t.q1)[:, None] - E * (t.q1 - t.q2)[:, None]))
        through = passed.cumsum(0)
        kept = rs.keep[:, None] * passed
        later = kept[::-1].cumsum(0)[::-1] - kept
        tail = np.divide(later, rs.keep[:, None], out=np.zeros_like(later), where=rs.keep[:, None] > 0)
        out[CENSORED, :, g] = -r[g] * through
        out[EVENT, :, g] = unit - share - r[g] * (through - passed + own)
        out[COMPETING, :, g] = -r[g] * (through + tail)
    return out


def sandwich(rs: RiskSets, at: Likelihood, free: list[int], model_cov: np.ndarray) -> np.ndarray:
    """n/(n-1) times the sum of squared weighted influences; rows of one day, group and end have the same."""
    u = influence(rs, at)[..., free].reshape(-1, len(free))
    meat = (u * rs.squares.reshape(-1, 1)).T @ u
    factor = rs.n / (rs.n - 1) if rs.n > 1 else 1.0
    return factor * model_cov @ meat @ model_cov


def survival_before(rs: RiskSets) -> np.ndarray:
    """Unweighted product-limit estimate just before each day."""
    step = 1 - np.divide(rs.deaths, rs.n_risk, out=np.zeros(len(rs.times)), where=rs.n_risk > 0)
    return np.concatenate([[1.0], np.cumprod(step)[:-1]])


def ph_score_test(f: Fit) -> list[tuple[str, float, int]]:
    """(term, chi-square, df): score test of a slope on 1 - S(t-), per group and for all groups."""
    g = 1 - survival_before(f.rs)
    g = g - np.average(g, weights=f.rs.deaths)  # the test does not depend on the origin of g
    score = (g[:, None] * f.at.score).sum(0)[f.free]
    pick = np.ix_(range(len(g)), f.free, f.free)
    info = f.at.info[pick]
    i00, i01, i11 = info.sum(0), (g[:, None, None] * info).sum(0), (g[:, None, None] ** 2 * info).sum(0)
    out = []
    for k, i in enumerate(f.free):
        v = i11[k, k] - i01[k] @ np.linalg.solve(i00, i01[:, k])
        out.append((f.rs.groups[i], float(score[k] ** 2 / v) if v > 1e-12 else np.nan, 1))
    v = i11 - i01.T @ np.linalg.solve(i00, i01)
    full_rank = np.linalg.eigvalsh(v).min() > 1e-12
    out.append(("GLOBAL", float(score @ np.linalg.solve(v, score)) if full_rank else np.nan, len(f.free)))
    return out


def baseline_hazard(f: Fit) -> np.ndarray:
    """Cumulative hazard of the baseline group after each day."""
    return (f.rs.mean_weight * f.at.ties.s0).cumsum()
