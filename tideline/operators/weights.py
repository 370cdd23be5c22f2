"""Multinomial propensity scores and inverse-probability weights.

Subjects with equal covariates and exposure are one cell with a count, so the rows that the fit passes
over do not grow with the subjects unless the covariates are continuous. All fits of a run (phases,
sensitivity sets, subgroups) share each pass: a pass sums score and information per fit, the driver only
sees those sums. Where the information matrices would be large, as covariates have many levels, the fits are
matrix-free (``newton_cg``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline import schema as S
from tideline.operators.newton_cg import Layout, solve
from tideline.sources.definitions import definition_filter
from tideline.sources.stages import materialise

DENSE_ROWS = 100_000  # numbers of scores and information matrices that a pass brings to the driver at most
LISTED = 64  # levels that a row expression looks through; more are looked up by a join
BROADCAST_NUMBERS = 1_000_000  # coefficients that are sent to every executor at most
TOLERANCE = 1e-10
JUMP = 27.0


def ps_terms(defs: DataFrame, level: int = 4) -> list[str]:
    """Names of the covariates in the sets up to ``level``, in sheet order."""
    return [r[0] for r in definition_filter(defs, level).select("Name").collect()]  # names of columns


@dataclass(frozen=True)
class Term:
    """A covariate: categorical with levels (the first is the baseline), or numeric, centred and scaled."""

    name: str
    levels: tuple[str, ...] = ()
    mean: float = 0.0
    sd: float = 1.0

    @property
    def width(self) -> int:
        return len(self.levels) - 1 if self.levels else 1

    def columns(self) -> list[Column]:
        if self.levels:
            return [(F.col(self.name).cast("string") == v).cast("double") for v in self.levels[1:]]
        return [(F.col(self.name).cast("double") - self.mean) / self.sd]


@dataclass(frozen=True)
class PropensityModel:
    group: str
    levels: tuple[str, ...]
    terms: tuple[Term, ...]
    by: str | None
    coefs: dict            # fit key -> level x parameter array; -inf intercept for a level without subjects
    converged: dict
    loglik: dict
    tables: dict | None = None  # matrix-free fits: fit key -> row x level array, see newton_cg.Layout

    @property
    def width(self) -> int:
        return 1 + sum(t.width for t in self.terms)

    def design(self) -> list[Column]:
        return [F.lit(1.0)] + [c for t in self.terms for c in t.columns()]


def _is_categorical(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.BooleanType))


def _describe(cells: DataFrame, terms: list[str]) -> tuple[Term, ...]:
    categorical = [t for t in terms if _is_categorical(cells, t)]
    numeric = [t for t in terms if t not in categorical]
    count = F.col("n_cell")
    sizes = cells.agg(
        F.sum(count).alias("total"),
        *[F.sum(count * F.col(t)).cast("double").alias(f"s_{t}") for t in numeric],
    ).first()
    means = {t: (sizes[f"s_{t}"] or 0.0) / max(sizes["total"] or 0, 1) for t in numeric}
    detail = cells.agg(
        F.lit(1),
        *[F.sort_array(F.collect_set(F.col(t).cast("string"))).alias(f"l_{t}") for t in categorical],
        *[F.sum(count * (F.col(t) - means[t]) ** 2).alias(f"v_{t}") for t in numeric],
    ).first()
    out = []
    for t in terms:
        if t in categorical:
            out.append(Term(t, levels=tuple(detail[f"l_{t}"])))
        else:
            sd = float(np.sqrt((detail[f"v_{t}"] or 0.0) / max(sizes["total"] or 0, 1)))
            out.append(Term(t, mean=means[t], sd=sd if sd > 0 else 1.0))
    return tuple(out)


def _pass(cells: DataFrame, coefs: dict, width: int, n_levels: int) -> dict:
    """One pass over all cells: per fit, log likelihood, score and information at ``coefs``."""
    size = width * n_levels
    upper = np.triu_indices(size)
    length = 1 + size + len(upper[0])

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            keys = batch.column("fit").dictionary_encode()
            fits = keys.indices.to_numpy(zero_copy_only=False)
            x_all = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y_all = batch.column("y").to_numpy(zero_copy_only=False)
            n_all = batch.column("n_cell").to_numpy(zero_copy_only=False).astype(float)
            for i, key in enumerate(keys.dictionary.to_pylist()):
                rows = fits == i
                x, y, n = x_all[rows], y_all[rows], n_all[rows]
                b = coefs[key]
                eta = x[:, 1:] @ np.where(np.isfinite(b[:, 1:]), b[:, 1:], 0.0).T + b[:, 0]
                top = eta.max(1, keepdims=True)
                e = np.exp(eta - top)
                total = e.sum(1, keepdims=True)
                p = e / total
                loglik = (n * (eta[np.arange(len(y)), y] - top[:, 0] - np.log(total[:, 0]))).sum()
                hit = np.eye(n_levels)[y]
                score = ((hit - p) * n[:, None]).T @ x
                info = np.zeros((n_levels, width, n_levels, width))
                for k in range(n_levels):
                    for l in range(k, n_levels):
                        v = n * p[:, k] * ((k == l) - p[:, l])
                        block = (x * v[:, None]).T @ x
                        info[k, :, l, :] = block
                        info[l, :, k, :] = block.T
                part = np.concatenate([[loglik], score.ravel(), info.reshape(size, size)[upper]])
                sums[key] = sums[key] + part if key in sums else part
        for key, values in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"fit": [key] * length, "pos": np.arange(length, dtype=np.int32), "value": values}
            )

    parts = cells.mapInArrow(partial, "fit string, pos int, value double")
    rows = parts.groupBy("fit", "pos").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for key, mine in rows.groupby("fit"):
        v = np.zeros(length)
        v[mine["pos"].to_numpy()] = mine["value"].to_numpy()
        info = np.zeros((size, size))
        info[upper] = v[1 + size :]
        out[key] = (v[0], v[1 : 1 + size], info + np.triu(info, 1).T)
    return out


def fit_propensity(
    df: DataFrame,
    terms: list[str],
    group: str = "group",
    levels: list[str] = S.DOSE_LEVELS,
    by: str | None = None,
    max_iter: int = 100,
) -> PropensityModel:
    """Maximum-likelihood multinomial logit of ``group`` on ``terms``, one fit per value of ``by``.

    Newton steps with halving, all fits in the same passes. Rows with a NULL exposure or covariate do not
    enter. Levels without subjects in a fit get probability 0. A fit that has not converged after ``max_iter``
    steps (halvings not counted) raises; no weights come from it.
    """
    columns = list(dict.fromkeys([*terms, group]))
    fit_key = F.col(by).cast("string") if by else F.lit("all")
    complete = df.where(reduce(and_, [F.col(c).isNotNull() for c in columns]))
    complete = complete.where(F.col(group).isin(list(levels)))
    cells = materialise(
        complete.select(fit_key.alias("fit"), *columns).groupBy("fit", *columns).agg(F.count(F.lit(1)).alias("n_cell"))
        .sortWithinPartitions("fit"),  # so that late passes skip the row groups of finished fits
        "propensity",
    )
    described = _describe(cells, terms)
    model = PropensityModel(group, tuple(levels), described, by, {}, {}, {})
    width, n_levels = model.width, len(levels)
    y = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(group)) - 1
    fits = [r["fit"] for r in cells.select("fit").distinct().collect()]
    size = width * n_levels
    if len(fits) * (1 + size + size * (size + 1) // 2) > DENSE_ROWS:
        return _fit_wide(cells.withColumn("y", y.cast("int")), model, fits, max_iter)
    design = cells.select(
        "fit", y.cast("int").alias("y"), "n_cell", F.array(*model.design()).alias("x")
    )
    counts: dict[str, np.ndarray] = {}
    for r in cells.groupBy("fit", F.col(group).alias("level")).agg(F.sum("n_cell").alias("n")).collect():
        counts.setdefault(r["fit"], np.zeros(n_levels))[levels.index(r["level"])] = r["n"]

    coefs, free = {}, {}
    for key, n in counts.items():
        b = np.zeros((n_levels, width))
        b[n == 0, 0] = -np.inf
        reference = int(np.argmax(n > 0))
        b[n > 0, 0] = np.log(n[n > 0] / n[reference])
        coefs[key] = b
        free[key] = [k * width + j for k in range(n_levels) if n[k] > 0 and k != reference for j in range(width)]
    step = {key: np.zeros((n_levels, width)) for key in coefs}
    state: dict = {}
    converged = {key: not free[key] for key in coefs}
    halvings = dict.fromkeys(coefs, 0)
    loglik: dict[str, float] = {}
    jumped: set[str] = set()
    last: dict[str, np.ndarray] = {}
    steps = dict.fromkeys(coefs, 0)
    while active := [k for k in coefs if not converged[k]]:
        late = [k for k in active if steps[k] >= max_iter]
        if late:
            raise RuntimeError(f"propensity fits that did not converge in {max_iter} steps: {', '.join(late)}")
        trial = {k: coefs[k] + step[k] for k in active}
        sums = _pass(design.where(F.col("fit").isin(active)), trial, width, n_levels)
        for key in active:
            value, score, info = sums[key]
            if key in state and value < state[key] - 1e-12 * abs(state[key]) and halvings[key] < 30:
                step[key] = step[key] / 2
                halvings[key] += 1
                continue
            gained = value - state.get(key, -np.inf)
            coefs[key], state[key], halvings[key] = trial[key], value, 0
            steps[key] += 1
            loglik[key] = value
            i = free[key]
            delta = np.linalg.lstsq(info[np.ix_(i, i)], score[i], rcond=1e-12)[0]
            size = np.abs(delta).max()
            # Newton steps shrink fast unless a covariate separates the groups; then a coefficient drifts to
            # infinity by equal steps.
            drifts = (np.abs(delta) > 0.1) & (np.abs(delta) > 0.5 * np.abs(last.get(key, np.inf)))
            last[key] = delta
            tiny = 0 <= gained < 1e-9 * (abs(value) + 0.1)
            if size < TOLERANCE or (key in jumped and drifts.any() and tiny):
                converged[key] = True
            elif key not in jumped and drifts.any() and 0 <= gained < 1e-4 * (abs(value) + 0.1):
                # One long step gets there. The halving above takes it back if it is wrong.
                delta = np.where(drifts, JUMP, 1.0) * delta
                jumped.add(key)
            new = np.zeros(n_levels * width)
            new[i] = delta
            step[key] = new.reshape(n_levels, width)
            if converged[key] and size < TOLERANCE:
                coefs[key] = coefs[key] + step[key]
    return PropensityModel(group, tuple(levels), described, by, coefs, converged, loglik)


def _place(df: DataFrame, term: Term) -> tuple[DataFrame, Column]:
    """``df`` with what the lookup needs, and the place of the row's level among those of the term."""
    value = F.col(term.name).cast("string")
    if len(term.levels) <= LISTED:
        return df, F.array_position(F.lit(list(term.levels)), value).cast("int") - 1
    name = f"_place_{term.name}"
    table = df.sparkSession.createDataFrame(
        pa.table({"_level": pa.array(term.levels, pa.string()), name: pa.array(range(len(term.levels)), pa.int32())})
    )
    known = F.broadcast(table) if len(term.levels) <= BROADCAST_NUMBERS else table
    return df.join(known, value == F.col("_level")).drop("_level"), F.col(name)


def _wide_layout(model: PropensityModel) -> Layout:
    sizes = tuple(len(t.levels) for t in model.terms if t.levels) or (1,)
    return Layout(sizes, sum(not t.levels for t in model.terms), len(model.levels))


def _fit_wide(cells: DataFrame, model: PropensityModel, fits: list[str], max_iter: int) -> PropensityModel:
    """The fit without information matrices, for covariates of any number of levels."""
    layout, places, numbers = _wide_layout(model), [], []
    for t in model.terms:
        if t.levels:
            cells, place = _place(cells, t)
            places.append(place + layout.starts[len(places)])
        else:
            numbers += t.columns()
    none = F.array().cast("array<double>")
    design = cells.select(
        "fit", "y", "n_cell", F.array(*(places or [F.lit(0)])).alias("places"), (F.array(*numbers) if numbers else none).alias("numbers")
    )
    found = solve(materialise(design.sortWithinPartitions("fit"), "propensity"), layout, fits, max_iter)
    converged = {key: fit.done for key, fit in found.items()}
    values = {key: fit.value for key, fit in found.items()}
    return replace(model, converged=converged, loglik=values, tables={key: fit.theta for key, fit in found.items()})


def _wide_predictors(df: DataFrame, model: PropensityModel) -> tuple[DataFrame, list[Column]]:
    """As ``_linear_predictors``, with the coefficients of levels joined by fit and level."""
    layout, groups, fits = _wide_layout(model), range(len(model.levels)), list(model.tables)
    stacked = np.stack([model.tables[f] for f in fits]) if fits else np.zeros((0, layout.rows, len(groups)))
    categorical, numeric = [t for t in model.terms if t.levels], [t for t in model.terms if not t.levels]

    def joined_by(rows: DataFrame, condition: Column, **columns: pa.Array) -> DataFrame:
        table = pa.table(columns)
        sent = df.sparkSession.createDataFrame(table)
        small = table.num_rows * table.num_columns <= BROADCAST_NUMBERS  # the size is known here
        return rows.join(F.broadcast(sent) if small else sent, condition, "left").drop("_f", "_level")

    own_fit = F.col("_fit") == F.col("_f")
    rows = df.withColumn("_fit", F.col(model.by).cast("string") if model.by else F.lit("all"))
    # A level that the fit has not seen counts as the baseline; without categories the first row is the intercept.
    single = {f"_b{at}_{k}": pa.array(stacked[:, layout.starts[at], k]) for at in range(len(layout.sizes)) for k in groups}
    single |= {f"_n{j}_{k}": pa.array(stacked[:, layout.starts[-1] + j, k]) for j in range(len(numeric)) for k in groups}
    rows = joined_by(rows, own_fit, _f=pa.array(fits, pa.string()), **single)
    eta = [F.lit(0.0) if categorical else F.col(f"_b0_{k}") for k in groups]
    for at, t in enumerate(categorical):
        mine = stacked[:, layout.starts[at] : layout.starts[at + 1]].reshape(-1, len(groups))
        rows = joined_by(
            rows, own_fit & (F.col(t.name).cast("string") == F.col("_level")),
            _f=pa.array([f for f in fits for _ in t.levels], pa.string()), _level=pa.array(list(t.levels) * len(fits), pa.string()),
            **{f"_c{at}_{k}": pa.array(mine[:, k]) for k in groups},
        )
        unseen = F.when(F.col(t.name).isNotNull(), 1)
        eta = [eta[k] + F.coalesce(f"_c{at}_{k}", unseen * F.col(f"_b{at}_{k}")) for k in groups]
    for j, t in enumerate(numeric):
        eta = [eta[k] + F.col(f"_n{j}_{k}") * t.columns()[0] for k in groups]
    return rows, eta


def _linear_predictors(df: DataFrame, model: PropensityModel) -> tuple[DataFrame, list[Column]]:
    """``df`` with what the predictors need, and one predictor per level.

    A covariate's level is looked up among the coefficients by its place, so the expressions grow with the
    covariates, not with their levels. A level that the fit has not seen counts as the baseline.
    """
    if model.tables is not None:
        return _wide_predictors(df, model)
    n_levels, width = len(model.levels), model.width
    if model.by is None:
        joined, coefs = df, F.lit([float(v) for v in model.coefs["all"].ravel()])
    else:
        table = df.sparkSession.createDataFrame(
            [(key, [float(v) for v in b.ravel()]) for key, b in model.coefs.items()], "fit_key string, fit_coefs array<double>"
        )
        # The size is known here; a table beyond it is joined by key.
        small = len(model.coefs) * n_levels * width <= BROADCAST_NUMBERS
        joined = df.join(F.broadcast(table) if small else table, F.col(model.by).cast("string") == F.col("fit_key"), "left")
        coefs = F.col("fit_coefs")
    eta = [F.get(coefs, F.lit(k * width)) for k in range(n_levels)]
    offset = 1
    for t in model.terms:
        for k in range(n_levels):
            start = k * width + offset
            if t.levels:
                place = F.array_position(F.lit(list(t.levels)), F.col(t.name).cast("string")).cast("int")
                part = F.when(place <= 1, 0.0).otherwise(F.get(coefs, place + (start - 2)))
            else:
                part = F.get(coefs, F.lit(start)) * t.columns()[0]
            eta[k] = eta[k] + part
        offset += t.width
    return joined, eta


def propensity_scores(df: DataFrame, model: PropensityModel, prefix: str = "ps_") -> DataFrame:
    """Add the probability of each exposure level given the covariates."""
    joined, eta = _linear_predictors(df, model)
    with_eta = joined.withColumns({f"eta_{k}": e for k, e in enumerate(eta)})
    names = [f"eta_{k}" for k in range(len(eta))]
    top = F.greatest(*names)
    total = reduce(add, [F.exp(F.col(n) - top) for n in names])
    scores = {prefix + level: F.exp(F.col(n) - top) / total for n, level in zip(names, model.levels)}
    return with_eta.withColumns(scores).select(*df.columns, *scores)


def iptw_weights(df: DataFrame, model: PropensityModel, estimand: str = "ATE", name: str = "weight") -> DataFrame:
    """Add 1 / P(own level | covariates), neither stabilised nor trimmed; a row expression, no join by position."""
    if estimand != "ATE":
        raise ValueError("only the ATE is supported")
    joined, eta = _linear_predictors(df, model)
    with_eta = joined.withColumns({f"eta_{k}": e for k, e in enumerate(eta)})
    names = [f"eta_{k}" for k in range(len(eta))]
    own = F.lit(None).cast("double")
    for n, level in zip(names, model.levels):
        own = F.when(F.col(model.group) == level, F.col(n)).otherwise(own)
    weight = reduce(add, [F.exp(F.col(n) - F.col("eta_own")) for n in names])
    return (
        with_eta.withColumn("eta_own", own)
        .withColumn(name, weight)
        .select(*[c for c in df.columns if c != name], name)
    )
