import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline import schema as S
from tideline.operators import weights

LEVELS = ["X", "1d", "2d"]


def people(n=900, seed=1):
    rng = np.random.default_rng(seed)
    age = rng.integers(20, 90, n)
    area = rng.choice(["a", "b", "c"], n)
    eta = np.stack([np.zeros(n), -0.5 + 0.02 * (age - 50) + 0.6 * (area == "b"), -1 + 0.5 * (area == "c")], 1)
    u = rng.random(n)[:, None]
    p = np.exp(eta) / np.exp(eta).sum(1, keepdims=True)
    g = (u > p.cumsum(1)).sum(1)
    return pd.DataFrame({"id": range(n), "age": age, "area": area, "group": [LEVELS[i] for i in g], "half": rng.choice(["p", "q"], n)})


def reference_fit(df):
    """Plain Newton on rows."""
    x = np.column_stack([np.ones(len(df)), df["age"] - 50, df["area"] == "b", df["area"] == "c"]).astype(float)
    y = np.stack([df["group"] == g for g in LEVELS], 1).astype(float)
    b = np.zeros((2, 4))
    for _ in range(30):
        e = np.exp(np.column_stack([np.zeros(len(df)), x @ b.T]))
        p = e / e.sum(1, keepdims=True)
        score = ((y - p)[:, 1:].T @ x).ravel()
        info = np.block([[(x * (p[:, [i + 1]] * ((i == j) - p[:, [j + 1]]))).T @ x for j in range(2)] for i in range(2)])
        b = b + np.linalg.solve(info, score).reshape(2, 4)
    return (p * y).sum(1)


def test_fit_equals_row_level_newton(spark):
    df = people()
    sdf = spark.createDataFrame(df)
    model = weights.fit_propensity(sdf, ["age", "area"], levels=LEVELS)
    got = weights.iptw_weights(sdf, model).orderBy("id").toPandas()
    assert model.converged["all"]
    assert np.allclose(got["weight"], 1 / reference_fit(df), rtol=1e-10)
    scores = weights.propensity_scores(sdf, model).select([f"ps_{g}" for g in LEVELS]).toPandas()
    assert np.allclose(scores.sum(axis=1), 1)


def test_fits_by_key_equal_separate_fits(spark):
    df = people()
    sdf = spark.createDataFrame(df)
    both = weights.iptw_weights(sdf, weights.fit_propensity(sdf, ["age", "area"], levels=LEVELS, by="half")).toPandas()
    for half in ("p", "q"):
        mine = df[df["half"] == half]
        got = both[both["half"] == half].sort_values("id")
        assert np.allclose(got["weight"], 1 / reference_fit(mine), rtol=1e-10)


def test_saturated_weights_balance_exactly(spark):
    df = people()
    sdf = spark.createDataFrame(df)
    got = weights.iptw_weights(sdf, weights.fit_propensity(sdf, ["area"], levels=LEVELS)).toPandas()
    cell = got.groupby("area")["id"].transform("size") / got.groupby(["area", "group"])["id"].transform("size")
    assert np.allclose(got["weight"], cell, rtol=1e-11)
    sums = got.groupby("group")["weight"].sum()
    assert np.allclose(sums, len(df))
    share = got.groupby(["group", "area"])["weight"].sum().unstack().div(sums, axis=0)
    assert np.allclose(share.std(), 0, atol=1e-12)


def test_missing_level_constant_term_and_nulls(spark):
    df = people()
    df = df[df["group"] != "2d"].assign(same="k")
    sdf = spark.createDataFrame(df).withColumn("age", F.when(F.col("id") != 5, F.col("age")))
    model = weights.fit_propensity(sdf, ["age", "area", "same"], levels=LEVELS)
    got = weights.iptw_weights(sdf, model).toPandas().set_index("id")
    assert model.converged["all"] and np.isneginf(model.coefs["all"][2, 0])
    assert pd.isna(got.loc[5, "weight"]) if 5 in got.index else True
    rest = got.drop(index=5, errors="ignore")
    assert np.isfinite(rest["weight"]).all()
    # Score equation: expected size of each group equals its size.
    scores = weights.propensity_scores(sdf.where("id <> 5"), model).toPandas()
    assert scores["ps_1d"].sum() == pytest.approx((scores["group"] == "1d").sum(), abs=1e-8)
    assert (scores["ps_2d"] == 0).all()


def test_collinear_terms_do_not_change_the_weights(spark):
    df = people()
    sdf = spark.createDataFrame(df).withColumn("age2", F.col("age") * 2 + 1)
    one = weights.iptw_weights(sdf, weights.fit_propensity(sdf, ["age", "area"], levels=LEVELS)).orderBy("id").toPandas()
    two = weights.iptw_weights(sdf, weights.fit_propensity(sdf, ["age", "age2", "area"], levels=LEVELS)).orderBy("id").toPandas()
    assert np.allclose(one["weight"], two["weight"], rtol=1e-8)


def test_separated_groups_end(spark):
    rows = [(i, "X", "a") for i in range(5)] + [(i + 5, "1d", "b") for i in range(5)]
    sdf = spark.createDataFrame(rows, "id int, group string, area string")
    model = weights.fit_propensity(sdf, ["area"], levels=["X", "1d"])
    got = weights.iptw_weights(sdf, model).toPandas()
    assert model.converged["all"] and np.allclose(got["weight"], 1, atol=1e-6)


def test_three_thousand_levels(spark):
    """One covariate of 3,000 levels: probabilities are the shares of its levels, also where groups are missing."""
    rng = np.random.default_rng(5)
    n = 24_000
    df = pd.DataFrame({"id": range(n), "key": [f"k{i}" for i in rng.integers(0, 3000, n)], "group": rng.choice(LEVELS, n, p=[0.5, 0.3, 0.2])})
    sdf = spark.createDataFrame(df)
    model = weights.fit_propensity(sdf, ["key"], levels=LEVELS)
    assert model.tables is not None and len(model.terms[0].levels) == df["key"].nunique() > 2990
    got = weights.iptw_weights(sdf, model).toPandas()
    want = got.groupby("key")["id"].transform("size") / got.groupby(["key", "group"])["id"].transform("size")
    assert np.allclose(got["weight"], want, rtol=1e-9) and got.columns.tolist() == [*sdf.columns, "weight"]
    scores = weights.propensity_scores(sdf, model).toPandas()
    assert np.allclose(scores[[f"ps_{g}" for g in LEVELS]].sum(axis=1), 1)


@pytest.mark.parametrize("terms", [["age", "area"], ["area"], ["age"], ["area", "half", "age"], ["site", "area"], ["site", "age", "area"]])
def test_matrix_free_fits_equal_dense_ones(spark, monkeypatch, terms):
    df = people(1200)
    rng = np.random.default_rng(9)
    df["site"] = [f"s{i:02d}" for i in rng.integers(0, 25, len(df))]
    df["by"] = np.where(df["half"] == "p", "one", "two")
    sdf = spark.createDataFrame(df)
    for by in (None, "by"):
        dense = weights.iptw_weights(sdf, weights.fit_propensity(sdf, terms, levels=LEVELS, by=by)).orderBy("id").toPandas()
        with monkeypatch.context() as m:
            m.setattr(weights, "DENSE_ROWS", 0)
            m.setattr(weights, "LISTED", 4)
            model = weights.fit_propensity(sdf, terms, levels=LEVELS, by=by)
            free = weights.iptw_weights(sdf, model).orderBy("id").toPandas()
        assert model.tables is not None and all(model.converged.values())
        assert np.allclose(free["weight"], dense["weight"], rtol=1e-6)


def test_matrix_free_edge_rows(spark, monkeypatch):
    """NULLs, a group without subjects, a constant covariate, levels that only one fit or no fit has."""
    monkeypatch.setattr(weights, "DENSE_ROWS", 0)
    df = people()
    df = df[df["group"] != "2d"].assign(same="k")
    df["area"] = np.where((df["half"] == "p") & (df["area"] == "c"), "b", df["area"])
    sdf = spark.createDataFrame(df).withColumn("age", F.when(F.col("id") != 5, F.col("age")))
    model = weights.fit_propensity(sdf, ["age", "area", "same"], levels=LEVELS, by="half")
    got = weights.iptw_weights(sdf, model).toPandas()
    assert got["weight"].isna().sum() == (got["id"] == 5).sum()
    scores = weights.propensity_scores(sdf, model).toPandas().dropna(subset=["ps_1d"])
    for _, mine in scores.groupby("half"):
        assert mine["ps_1d"].sum() == pytest.approx((mine["group"] == "1d").sum(), abs=1e-6)
    assert (scores["ps_2d"] == 0).all()
    new = sdf.limit(1).withColumns({"area": F.lit("nowhere"), "half": F.lit("q"), "age": F.lit(40)})
    base = sdf.limit(1).withColumns({"area": F.lit("a"), "half": F.lit("q"), "age": F.lit(40)})
    one, two = (weights.propensity_scores(d, model).first()["ps_1d"] for d in (new, base))
    assert one == pytest.approx(two)


def test_passes_bring_few_rows_to_the_driver(spark, monkeypatch):
    """27 fits of a covariate with 1,000 levels: rows of coefficients, no matrices."""
    from tideline.operators import newton_cg

    brought = []
    inside = newton_cg.pass_over

    def counted(*asked):
        brought.append(inside(*asked))
        return brought[-1]

    monkeypatch.setattr(newton_cg, "pass_over", counted)
    sdf = spark.range(60_000).selectExpr(
        "CAST(id * 7919 % 27 AS STRING) AS fit_no", "CAST(hash(id) % 500 AS STRING) AS key", "element_at(array('X', '1d', '2d'), CAST(1 + pmod(hash(id, 3), 3) AS INT)) AS `group`"
    )
    model = weights.fit_propensity(sdf, ["key"], levels=LEVELS, by="fit_no")
    assert len(model.tables) == 27 and all(model.converged.values())
    assert all(sum(len(sums) for _, sums, _ in one.values()) < 100_000 for one in brought)


def test_terms(spark):
    defs = spark.createDataFrame([("a", 1), (None, 1), ("b", 5), ("c", 4)], S.PS_SCHEMA)
    assert weights.ps_terms(defs, 4) == ["a", "c"]


def test_a_fit_that_does_not_converge_raises(spark):
    with pytest.raises(RuntimeError, match="did not converge in 2 steps: p, q"):
        weights.fit_propensity(spark.createDataFrame(people()), ["age", "area"], levels=LEVELS, by="half", max_iter=2)


def test_rows_without_a_covariate_leave_the_cells(spark):
    from tideline.operators import survival

    df = people(300).assign(time=[1 + i % 40 for i in range(300)], status=[int(i % 3 == 0) for i in range(300)])
    df.loc[::5, "area"] = None
    sdf = spark.createDataFrame(df.astype({"time": "int32"})).withColumn("time", F.col("time").cast("int"))
    with_weight = weights.iptw_weights(sdf, weights.fit_propensity(sdf, ["area"], levels=LEVELS))
    cells = survival.survival_cells(with_weight, [], "weight")
    sums = cells.agg(F.sum("n"), F.sum("n_missing")).first()
    assert tuple(sums) == (240, 60)
    keyed = cells.withColumn("k", F.lit(1))
    got = {r["group"]: r["log_hr"] for r in survival.cox_ph(keyed, ["k"], LEVELS, weighted=True).collect()}
    few = survival.survival_cells(with_weight.where("weight IS NOT NULL"), [], "weight").withColumn("k", F.lit(1))
    want = {r["group"]: r["log_hr"] for r in survival.cox_ph(few, ["k"], LEVELS, weighted=True).collect()}
    assert got == pytest.approx(want) and all(v is not None for g, v in got.items() if g != "X")
