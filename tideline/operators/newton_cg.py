"""Matrix-free Newton steps for multinomial logits with covariates of many levels.

Every level of a covariate has a coefficient per exposure group and there is no intercept, so the covariates
overlap in a constant only, which changes no probability. Executors add up scores, the small blocks of
the information on its diagonal, and products of the information with a vector, by (fit, level) that occurs; the
driver holds vectors as long as the coefficients and no matrix. A step is found by conjugate gradients.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ACCURACY = 1e-18  # of the squared Newton decrement, relative to the log likelihood
CG_ACCURACY = 1e-4
CG_STEPS = 300


@dataclass(frozen=True)
class Layout:
    """Where the coefficients of each covariate begin: levels of the categorical ones, then the numeric ones."""

    sizes: tuple[int, ...]
    numeric: int
    groups: int

    @property
    def starts(self) -> list[int]:
        return [0, *np.cumsum(self.sizes).tolist()]

    @property
    def rows(self) -> int:
        return self.starts[-1] + self.numeric


def _gather(values: np.ndarray, places: np.ndarray, numbers: np.ndarray, first: int) -> np.ndarray:
    """Linear predictors of cells for coefficients (or a direction)."""
    out = numbers @ values[first:] if numbers.shape[1] else np.zeros((len(places), values.shape[1]))
    for column in places.T:
        out = out + values[column]
    return out


def _scatter(cells: np.ndarray, places: np.ndarray, numbers: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the cells' values by coefficient row, for the rows that occur."""
    rows, inverse = np.unique(places.T.ravel(), return_inverse=True)
    sums = np.zeros((len(rows), cells.shape[1]))
    np.add.at(sums, inverse, np.tile(cells, (places.shape[1], 1)))
    if numbers.shape[1]:
        rows = np.concatenate([rows, first + np.arange(numbers.shape[1])])
        sums = np.vstack([sums, numbers.T @ cells])
    return rows, sums


def pass_over(design: DataFrame, layout: Layout, asked: dict[str, tuple[np.ndarray | None, np.ndarray | None]]) -> dict[str, tuple]:
    """One pass over the cells of the asked fits.

    Without coefficients: counts per row and group. With coefficients: log likelihood, scores, and the upper halves
    of the diagonal blocks. With a direction too: the product of the information with it. ``design`` has fit, y,
    n_cell, places (rows of the coefficients) and numbers. The rows that reach the driver are those of the
    coefficients that occur.
    """
    groups, first, count = layout.groups, layout.starts[-1], layout.numeric
    upper = np.triu_indices(groups)
    kinds = {(theta is None, way is None) for theta, way in asked.values()}
    assert len(kinds) == 1
    width = groups + len(upper[0]) if kinds == {(False, True)} else groups

    def partial(batches):
        for batch in batches:
            keys = batch.column("fit").dictionary_encode()
            fits = keys.indices.to_numpy(zero_copy_only=False)
            places_all = batch.column("places").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            numbers_all = batch.column("numbers").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, count)
            y_all = batch.column("y").to_numpy(zero_copy_only=False)
            n_all = batch.column("n_cell").to_numpy(zero_copy_only=False).astype(float)
            for i, key in enumerate(keys.dictionary.to_pylist()):
                mine = fits == i
                places, numbers, y, n = places_all[mine], numbers_all[mine], y_all[mine], n_all[mine]
                theta, way = asked[key]
                hit, value = np.eye(groups)[y], 0.0
                if theta is None:
                    cells, block = hit * n[:, None], None
                else:
                    eta = _gather(theta, places, numbers, first)
                    eta -= eta.max(1, keepdims=True)
                    e = np.exp(eta)
                    total = e.sum(1, keepdims=True)
                    p = e / total
                    if way is None:
                        value = float((n * (eta[np.arange(len(y)), y] - np.log(total[:, 0]))).sum())
                        cells, block = (hit - p) * n[:, None], (np.einsum("ij,jk->ijk", p, np.eye(groups)) - p[:, :, None] * p[:, None, :])
                    else:
                        u = _gather(way, places, numbers, first)
                        cells, block = n[:, None] * p * (u - (p * u).sum(1, keepdims=True)), None
                rows, sums = _scatter(cells, places, numbers, first)
                if block is not None:
                    flat = block[:, upper[0], upper[1]] * n[:, None]
                    _, blocks = _scatter(flat, places, numbers**2, first)
                    sums = np.hstack([sums, blocks])
                rows = np.append(rows, -1)
                sums = np.vstack([sums, [value] + [0.0] * (width - 1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(rows)), pa.array(rows, pa.int32()), *(pa.array(c) for c in sums.T)],
                    ["fit", "row", *(f"c{j}" for j in range(width))],
                )

    names = [f"c{j}" for j in range(width)]
    parts = design.where(F.col("fit").isin(list(asked))).mapInArrow(partial, "fit string, row int, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("fit", "row").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = {}
    for key, mine in found.groupby("fit"):
        rows, values = mine["row"].to_numpy(), mine[names].to_numpy()
        sums = np.zeros((layout.rows, width))
        sums[rows[rows >= 0]] = values[rows >= 0]
        out[key] = (float(values[rows < 0][0, 0]), sums[:, :groups], sums[:, groups:])
    return out


@dataclass
class Fit:
    """Coefficients of one fit on their way. -inf where a level holds no subject of a group."""

    theta: np.ndarray
    free: np.ndarray
    occurs: np.ndarray
    step: np.ndarray
    value: float = -np.inf
    taken: int = 0
    halvings: int = 0
    still: int = 0
    done: bool = False
    inverse: np.ndarray | None = None
    state: dict = field(default_factory=dict)

    @classmethod
    def start(cls, counts: np.ndarray, layout: Layout) -> Fit:
        """Begins with the coefficients that fit the covariate with most levels on its own."""
        starts, first = layout.starts, layout.starts[-1]
        sizes = counts[: starts[1]].sum(0)  # every subject has one level of the first covariate
        reference = int(np.argmax(sizes > 0))
        occurs = np.ones(layout.rows, bool)
        occurs[:first] = counts[:first].sum(1) > 0
        seen = np.ones_like(counts, bool)
        seen[:first] = counts[:first] > 0
        seen &= sizes > 0
        theta = np.where(seen | ~occurs[:, None], 0.0, -np.inf)
        theta[first:] = 0.0
        free = seen & occurs[:, None]
        free[:, reference] = False
        widest = int(np.argmax(layout.sizes))
        rows = slice(starts[widest], starts[widest + 1])
        with np.errstate(divide="ignore"):
            logs = np.log(counts[rows])
        base = np.where(np.isfinite(logs[:, [reference]]), logs[:, [reference]], 0.0)
        theta[rows] = np.where(free[rows], logs - base, theta[rows])
        return cls(theta, free, occurs, np.zeros_like(theta), done=not free.any())

    def take(self, value: float, score: np.ndarray, upper: np.ndarray) -> None:
        """Takes the last step if it helped (otherwise halves it) and begins the search for the next one."""
        if value < self.value - 1e-12 * abs(self.value) and self.halvings < 40:
            self.step, self.halvings, self.state = self.step / 2, self.halvings + 1, {}
            return
        gained = value - self.value
        self.theta, self.value, self.halvings = self.theta + self.step, value, 0
        self.taken += 1
        # A covariate combination that separates groups drifts on while the likelihood stands still.
        self.still = self.still + 1 if 0 <= gained < 1e-11 * (abs(value) + 0.1) else 0
        groups = score.shape[1]
        blocks = np.zeros((len(score), groups, groups))
        i, j = np.triu_indices(groups)
        blocks[:, i, j] = blocks[:, j, i] = upper
        blocks *= self.free[:, :, None] & self.free[:, None, :]
        self.inverse = np.linalg.pinv(blocks, rcond=1e-12, hermitian=True)
        r = np.where(self.free, score, 0.0)
        z = self.scaled(r)
        rz = float((r * z).sum())
        self.state = {"x": np.zeros_like(r), "r": r, "p": z, "rz": rz, "end": CG_ACCURACY**2 * rz, "steps": 0}
        self.done = rz <= ACCURACY * (abs(value) + 1) or self.still >= 3

    def scaled(self, r: np.ndarray) -> np.ndarray:
        return np.einsum("ijk,ik->ij", self.inverse, r)

    @property
    def searching(self) -> bool:
        s = self.state
        return bool(s) and not self.done and s["rz"] > s["end"] and s["steps"] < CG_STEPS

    def search(self, product: np.ndarray) -> None:
        """A conjugate gradient step, given the information times the direction."""
        s = self.state
        product = np.where(self.free, product, 0.0)
        curve = float((s["p"] * product).sum())
        s["steps"] += 1
        if curve <= 0:  # a direction that changes no probability
            s["rz"] = 0.0
            return
        a = s["rz"] / curve
        s["x"] = s["x"] + a * s["p"]
        s["r"] = s["r"] - a * product
        z = self.scaled(s["r"])
        rz = float((s["r"] * z).sum())
        s["p"] = z + (rz / s["rz"]) * s["p"]
        s["rz"] = rz


def solve(design: DataFrame, layout: Layout, fits: list[str], max_iter: int) -> dict[str, Fit]:
    """All fits in the same passes; fits that are done leave them."""
    counts = pass_over(design, layout, {key: (None, None) for key in fits})
    state = {key: Fit.start(found, layout) for key, (_, found, _) in counts.items()}
    while active := [key for key, fit in state.items() if not fit.done]:
        late = [key for key in active if state[key].taken > max_iter]
        if late:
            raise RuntimeError(f"propensity fits that did not converge in {max_iter} steps: {', '.join(sorted(late))}")
        for key, sums in pass_over(design, layout, {k: (state[k].theta + state[k].step, None) for k in active}).items():
            state[key].take(*sums)
        while searching := [key for key in active if state[key].searching]:
            asked = {k: (state[k].theta, state[k].state["p"]) for k in searching}
            for key, (_, product, _) in pass_over(design, layout, asked).items():
                state[key].search(product)
        for key in active:
            if state[key].state:
                state[key].step = state[key].state["x"]
    for fit in state.values():
        for start, end in zip(layout.starts, layout.starts[1:]):  # a level without subjects is like the first that has some
            known = fit.occurs[start:end]
            fit.theta[start:end][~known] = fit.theta[start + int(np.argmax(known))]
    return state
