import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline import schema as S
from tideline.operators import quantiles, tables

LEVELS = ["X", "1d", "2d"]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(2)
    n = 300
    pdf = pd.DataFrame(
        {
            "group": rng.choice(LEVELS, n), "age": rng.normal(50, 10, n), "area": rng.choice(["a", "b", "c"], n),
            "sex": rng.choice(["F", "M"], n), "dx": rng.random(n) < 0.3, "const": 1.0, "weight": rng.uniform(0.5, 3, n),
        }
    )
    pdf.loc[0, "age"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("age", F.when(~F.isnan("age"), F.col("age"))).cache()


def one(table, variable, level=None, group="X"):
    rows = table[(table["variable"] == variable) & (table["group"] == group)]
    return rows[rows["level"] == level].iloc[0] if level else rows.iloc[0]


def test_unweighted_and_weighted_moments(df):
    pdf, sdf = df
    table = tables.baseline_table(sdf, ["age", "area", "dx"]).toPandas()
    mine = pdf[pdf["group"] == "X"]
    assert one(table, "n")["count"] == len(mine)
    assert one(table, "age")["mean"] == pytest.approx(mine["age"].mean()) and one(table, "age")["sd"] == pytest.approx(mine["age"].std())
    assert one(table, "dx")["pct"] == pytest.approx(100 * mine["dx"].mean())
    assert one(table, "area", "b")["count"] == (mine["area"] == "b").sum()
    weighted = tables.baseline_table(sdf, ["age", "area", "dx"], weight="weight").toPandas()
    known = mine[mine["age"].notna()]
    w, n = known["weight"], len(known)
    mean = np.average(known["age"], weights=w)
    assert one(weighted, "age")["mean"] == pytest.approx(mean)
    assert one(weighted, "age")["sd"] == pytest.approx(np.sqrt(np.average((known["age"] - mean) ** 2, weights=w) * n / (n - 1)))
    assert one(weighted, "area", "b")["pct"] == pytest.approx(100 * mine[mine["area"] == "b"]["weight"].sum() / mine["weight"].sum())


def mahalanobis(p, q):
    """The form with the covariance matrix of the shares, first level dropped."""
    d = (p - q)[1:]
    cov = lambda v: np.diag(v[1:]) - np.outer(v[1:], v[1:])
    return np.sqrt(d @ np.linalg.inv((cov(p) + cov(q)) / 2) @ d)


def test_smd_equals_the_matrix_form(df):
    pdf, sdf = df
    got = tables.smd(tables.baseline_table(sdf, ["age", "area", "sex", "dx", "const"]), LEVELS, pairwise=True).toPandas()
    got = got.set_index(["variable", "group1", "group2"])["smd"]
    for v in ("area", "sex"):
        share = pd.crosstab(pdf["group"], pdf[v], normalize="index")
        assert got[v, "X", "2d"] == pytest.approx(mahalanobis(share.loc["X"].to_numpy(), share.loc["2d"].to_numpy()))
    p, q = pdf[pdf["group"] == "X"]["dx"].mean(), pdf[pdf["group"] == "1d"]["dx"].mean()
    assert got["dx", "X", "1d"] == pytest.approx(abs(p - q) / np.sqrt((p * (1 - p) + q * (1 - q)) / 2))
    a, b = (pdf[pdf["group"] == g]["age"] for g in ("X", "1d"))
    assert got["age", "X", "1d"] == pytest.approx(abs(a.mean() - b.mean()) / np.sqrt((a.var() + b.var()) / 2))
    assert pd.isna(got["const", "X", "1d"])


def test_smd_with_levels_that_miss_a_group(spark):
    rows = [("X", "a")] * 3 + [("X", "b")] + [("1d", "b")] * 2 + [("1d", "c")] * 2 + [("2d", "z")] * 2
    sdf = spark.createDataFrame(rows, "group string, v string")
    got = {(r["group1"], r["group2"]): r["smd"] for r in tables.smd(tables.baseline_table(sdf, ["v"]), LEVELS, pairwise=True).collect()}
    assert got["X", "1d"] == pytest.approx(mahalanobis(np.array([0.75, 0.25, 0]), np.array([0, 0.5, 0.5])))
    assert got["X", "2d"] is None


def test_balance_uses_the_unweighted_sd(df):
    pdf, sdf = df
    got = tables.balance_table(sdf, ["age", "dx", "area"], levels=LEVELS, pairwise=True).toPandas()
    row = got[(got["variable"] == "age") & (got["group1"] == "X") & (got["group2"] == "1d")].iloc[0]
    a, b = (pdf[(pdf["group"] == g) & pdf["age"].notna()] for g in ("X", "1d"))
    pooled = np.sqrt((a["age"].var() + b["age"].var()) / 2)
    adjusted = abs(np.average(a["age"], weights=a["weight"]) - np.average(b["age"], weights=b["weight"])) / pooled
    assert row["diff_adj"] == pytest.approx(adjusted)
    assert row["diff_un"] == pytest.approx(abs(a["age"].mean() - b["age"].mean()) / pooled)
    largest = tables.balance_table(sdf, ["age"], levels=LEVELS).first()
    assert largest["max_diff_adj"] == pytest.approx(got[got["variable"] == "age"]["diff_adj"].max())


def test_weight_summary_and_distribution(df):
    pdf, sdf = df
    got = tables.weight_summary(sdf).toPandas().set_index("group").loc["X"]
    w = pdf[pdf["group"] == "X"]["weight"]
    assert got["ess"] == pytest.approx(w.sum() ** 2 / (w**2).sum()) and got["cv"] == pytest.approx(w.std() / w.mean())
    parts = tables.ps_assess(sdf, ["age", "area"], bins=5)
    assert set(parts) == {"weights", "balance", "distribution_age", "distribution_area"}
    shares = parts["distribution_age"].toPandas()
    assert set(shares["bin"]) <= {"1", "2", "3", "4", "5"}
    assert np.allclose(shares.groupby("group")[["share_un", "share_adj"]].sum(), 1)


def test_export_labels(df, spark):
    _, sdf = df
    variables = ["age", "area", "dx", "sex"]
    table = tables.baseline_table(sdf, variables)
    defs = spark.createDataFrame([("age", "Age, years"), ("area", "Area")], S.TABLE1_SCHEMA)
    rows = tables.baseline_export(table, defs, variables, LEVELS, tables.smd(table, LEVELS)).orderBy("row_order", "level").collect()
    names = [r["Name"] for r in rows]
    assert names == ["n", "Age, years (mean (SD))", "Area = a (%)", "Area = b (%)", "Area = c (%)", "dx (%)", "sex (%)"]
    assert [r["row_order"] for r in rows] == [1, 2, 3, 3, 3, 4, 5]
    assert rows[-1]["level"] == "M"
    every = tables.baseline_export(table, defs, variables, LEVELS, all_levels=True)
    assert {"sex = F (%)", "sex = M (%)"} <= {r["Name"] for r in every.collect()}


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_quantiles_by_ranges(spark, ranges):
    """Values of a key are dealt to several ranges; a third of all rows is one value, one key has most rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.exponential(1, 2000), np.full(1000, 0.75)])
    key = rng.choice(["a", "b", None, "c"], 3000, p=[0.8, 0.1, 0.099, 0.001])
    pdf = pd.DataFrame({"x": x, "y": rng.integers(0, 5, 3000).astype(float), "key": key})
    pdf.loc[pdf["key"] == "c", "y"] = np.nan
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(pdf)
        got = quantiles.numeric_summary(df, "x").first()
        keyed = quantiles.numeric_summaries(df, ["x", "y"], ["key"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert (got["q1"], got["median"], got["q3"]) == pytest.approx(tuple(np.quantile(x, [0.25, 0.5, 0.75])), rel=1e-14)
    assert got["n"] == 3000 and got["max"] == x.max() and got["mean"] == pytest.approx(x.mean())
    assert len(keyed) == 8
    for r in keyed:
        mine = pdf.loc[pdf["key"].isna() if r["key"] is None else pdf["key"] == r["key"], r["variable"]].dropna()
        assert r["n"] == len(mine)
        if len(mine):
            want = (mine.min(), *np.quantile(mine, [0.25, 0.5, 0.75]), mine.max(), mine.mean())
            assert (r["min"], r["q1"], r["median"], r["q3"], r["max"], r["mean"]) == pytest.approx(want, rel=1e-12)
        else:
            assert r["median"] is None and r["mean"] is None


def test_distributions_of_every_fit(df):
    _, sdf = df
    fits = sdf.withColumn("stage", F.when(F.col("sex") == "F", "a").otherwise("b")).withColumn("same", F.lit(3))
    names = ["age", "area", "same"]
    both = tables.ps_assess(fits, names, bins=7, by=["stage"])
    for stage in ("a", "b"):
        part = fits.where(F.col("stage") == stage)
        alone = tables.ps_assess(part, names, bins=7)
        for name in alone:
            want = alone[name].toPandas()
            keys = [c for c in want.columns if want[c].dtype == object]
            got = both[name].where(F.col("stage") == stage).drop("stage").toPandas().sort_values(keys).reset_index(drop=True)
            pd.testing.assert_frame_equal(got[want.columns], want.sort_values(keys).reset_index(drop=True))


def test_distributions_read_their_rows_twice_at_most(spark, df, tmp_path):
    df[1].withColumn("stage", F.lit("a")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = tables.balance_distributions(rows, ["age", "area", "sex"], by=["stage"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_quantiles_of_nothing(spark):
    got = quantiles.numeric_summary(spark.createDataFrame([(None,)], "x double"), "x").first()
    assert got["n"] == 0 and got["median"] is None


@pytest.mark.parametrize("n", [900, 20_000])
def test_summary_treats_nan_as_missing_at_every_size(spark, n):
    df = spark.range(n).select(F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("id") * 0.5).alias("x"))
    got = quantiles.numeric_summary(df.unionByName(spark.createDataFrame([(float("inf"),)], "x double")), "x").first()
    x = np.sort(np.append(np.delete(np.arange(n) * 0.5, 7), np.inf))
    assert (got["n"], got["min"], got["max"]) == (n, 0.0, np.inf)
    assert [got[k] for k in ("q1", "median", "q3")] == [np.quantile(x[:-1], 0.0) + v for v in _quartiles(x)]


def _quartiles(x):
    out = []
    for p in (0.25, 0.5, 0.75):
        h = (len(x) - 1) * p
        low, high = x[int(np.floor(h))], x[int(np.ceil(h))]
        out.append(low + (high - low) * (h - np.floor(h)))
    return out


def test_weighted_sd_keeps_its_digits(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"group": rng.choice(LEVELS, 400), "x": 1e9 + rng.normal(0, 12, 400), "w": rng.uniform(0.5, 3, 400)})
    table = tables.baseline_table(spark.createDataFrame(pdf), ["x"], weight="w").toPandas()
    mine = pdf[pdf["group"] == "X"]
    n, mean = len(mine), np.average(mine["x"], weights=mine["w"])
    want = np.sqrt(np.average((mine["x"] - mean) ** 2, weights=mine["w"]) * n / (n - 1))
    assert one(table, "x")["sd"] == pytest.approx(want, rel=1e-6)


def test_export_names_with_blanks_and_hyphens(spark):
    df = spark.createDataFrame([("X", 20.0, "a = b"), ("1d", 30.0, "c"), ("2d", 31.0, "a = b")], "`group` string, `body-mass index` double, area string")
    table = tables.baseline_table(df, ["body-mass index", "area"])
    defs = spark.createDataFrame([("body-mass index", "BMI, kg/m2")], S.TABLE1_SCHEMA)
    names = {r["Name"] for r in tables.baseline_export(table, defs, ["body-mass index", "area"], LEVELS, all_levels=True).collect()}
    assert names == {"n", "BMI, kg/m2 (mean (SD))", "area = a = b (%)", "area = c (%)"}


def test_balance_of_every_fit_in_one_pass(df):
    pdf, sdf = df
    fits = sdf.withColumn("stage", F.when(F.col("sex") == "F", "a").otherwise("b"))
    both = tables.balance_table(fits, ["age", "area", "dx"], levels=LEVELS, by=["stage"]).toPandas()
    smds = tables.smd(tables.baseline_table(fits, ["age", "area"], by=["stage", "group"]), LEVELS, by=["stage"]).toPandas()
    for stage in ("a", "b"):
        part = fits.where(F.col("stage") == stage)
        for got, want in (
            (both, tables.balance_table(part, ["age", "area", "dx"], levels=LEVELS).toPandas()),
            (smds, tables.smd(tables.baseline_table(part, ["age", "area"]), LEVELS).toPandas()),
        ):
            keys = [c for c in want.columns if want[c].dtype == object]
            mine = got[got["stage"] == stage].drop(columns="stage").sort_values(keys).reset_index(drop=True)
            pd.testing.assert_frame_equal(mine[want.columns], want.sort_values(keys).reset_index(drop=True))
