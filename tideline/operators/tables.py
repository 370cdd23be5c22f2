"""Baseline tables, balance and weight diagnostics."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tideline import schema as S
from tideline.sources.definitions import add_total_row
from tideline.sources.stages import materialise

TABLE_COLUMNS = ["variable", "level", "kind", "n", "mean", "sd", "count", "pct"]
ADJUST = 1e-9  # added before rounding for print, so that halves go one way whatever the order of sums


def _kinds(df: DataFrame, variables: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Numeric, flag (boolean) and categorical (text) variables, by column type."""
    types = {f.name: f.dataType for f in df.schema}
    flags = [v for v in variables if isinstance(types[v], T.BooleanType)]
    texts = [v for v in variables if isinstance(types[v], T.StringType)]
    return [v for v in variables if v not in flags + texts], flags, texts


def _summaries(df: DataFrame, variables: list[str], by: list[str], weights: dict[str, Column | None]) -> DataFrame:
    """Long summaries per group, for several weightings in the same passes.

    ``weights`` maps a column suffix to its weight, None for unweighted. Numeric variables and flags come
    from one aggregate per group, categories from one per group and level.
    """
    numeric, flags, texts = _kinds(df, variables)
    w_of = {s: F.lit(1.0) if w is None else w for s, w in weights.items()}
    centred = numeric and any(w is not None for w in weights.values())
    if centred:  # squares are taken from the group's mean, so that large values keep their digits
        means = df.groupBy(*by).agg(*[F.avg(F.col(v).cast("double")).alias(f"at_{v}") for v in numeric])
        keys = [F.col(f"_{i}").eqNullSafe(F.col(f"d.{b}")) for i, b in enumerate(by)]
        means = means.select(*[F.col(b).alias(f"_{i}") for i, b in enumerate(by)], *[f"at_{v}" for v in numeric])
        df = df.alias("d").join(means, reduce(and_, keys))
        df = df.drop(*[f"_{i}" for i in range(len(by))])
    aggregates = []
    for s, w in w_of.items():
        aggregates.append(F.sum(w).alias(f"w{s}"))
        for v in numeric:
            x = F.col(v).cast("double")
            aggregates += [
                F.sum(F.when(x.isNotNull(), w)).alias(f"w_{v}{s}"),
                F.sum(w * x).alias(f"wx_{v}{s}"),
                F.count(x).alias(f"n_{v}{s}"),
                (F.var_samp(x) if weights[s] is None else F.sum(w * (x - F.col(f"at_{v}")) ** 2)).alias(f"v_{v}{s}"),
                *([] if weights[s] is None else [F.sum(w * (x - F.col(f"at_{v}"))).alias(f"off_{v}{s}")]),
            ]
        for v in flags:
            aggregates += [
                F.sum(F.when(F.col(v).isNotNull(), w)).alias(f"w_{v}{s}"),
                F.sum(F.when(F.col(v), w).otherwise(0.0)).alias(f"wx_{v}{s}"),
            ]
    wide = df.groupBy(*by).agg(*aggregates)

    def entry(variable, level, kind, cells) -> Column:
        texts_ = [F.lit(variable), F.lit(level).cast("string"), F.lit(kind)]
        numbers = []
        for s in weights:
            found = cells(s)
            numbers += [found.get(n, F.lit(None)).cast("double").alias(n + s) for n in TABLE_COLUMNS[3:]]
        return F.struct(*[c.alias(name) for c, name in zip(texts_, TABLE_COLUMNS)], *numbers)

    def numeric_cells(v):
        def cells(s):
            total, n = F.col(f"w_{v}{s}"), F.col(f"n_{v}{s}")
            mean = F.try_divide(f"wx_{v}{s}", f"w_{v}{s}")
            variance = F.col(f"v_{v}{s}")
            if weights[s] is not None:
                off = F.try_divide(f"off_{v}{s}", f"w_{v}{s}")  # from the plain mean to the weighted one
                spread = F.greatest(F.try_divide(variance, total) - off * off, F.lit(0.0))
                variance = spread * F.try_divide(n, n - 1)
            return {"n": total, "mean": mean, "sd": F.sqrt(variance)}

        return cells

    def flag_cells(v):
        return lambda s: {
            "n": F.col(f"w_{v}{s}"), "count": F.col(f"wx_{v}{s}"),
            "pct": F.try_divide(F.col(f"wx_{v}{s}") * 100, F.col(f"w_{v}{s}")),
        }

    entries = [entry("n", None, "size", lambda s: {"n": F.col(f"w{s}"), "count": F.col(f"w{s}")})]
    entries += [entry(v, None, "numeric", numeric_cells(v)) for v in numeric]
    entries += [entry(v, "TRUE", "flag", flag_cells(v)) for v in flags]
    table = wide.select(*by, F.inline(F.array(*entries)))
    if not texts:
        return table
    exploded = df.select(
        *by, *[w.alias(f"w{s}") for s, w in w_of.items()],
        F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("level")) for v in texts])),
    ).where(F.col("level").isNotNull())
    counts = exploded.groupBy(*by, "variable", "level").agg(*[F.sum(f"w{s}").alias(f"count{s}") for s in weights])
    whole = Window.partitionBy(*by, "variable")
    categories = counts.withColumns({f"n{s}": F.sum(f"count{s}").over(whole) for s in weights}).withColumn("kind", F.lit("category"))
    for s in weights:
        categories = categories.withColumns(
            {
                f"mean{s}": F.lit(None).cast("double"), f"sd{s}": F.lit(None).cast("double"),
                f"pct{s}": F.try_divide(F.col(f"count{s}") * 100, F.col(f"n{s}")),
            }
        )
    return table.unionByName(categories)


def baseline_table(df: DataFrame, variables: list[str], by: list[str] = ["group"], weight: str | None = None) -> DataFrame:
    """Long baseline table per group, weighted if a weight column is given.

    One row per group for the size ``n``, for each numeric variable (mean, sd), each flag (its TRUE
    share) and each category level (count, pct). Missing values leave the denominators. The weighted sd
    carries n/(n-1) with the number of rows.
    """
    return _summaries(df, variables, by, {"": F.col(weight) if weight else None})


def phase_tables(
    df: DataFrame, variables: list[str], weight: str = "weight", baseline: str = S.DOSE_LEVELS[0]
) -> dict[str, DataFrame]:
    """The tables of a phase: all groups and exposed groups only, plain and weighted.

    One pass makes all four; tables are per group, so the exposed ones are a part of the others.
    """
    both = materialise(_summaries(df, variables, ["group"], {"": None, "_w": F.col(weight)}), "tables")
    keys = ["group", *TABLE_COLUMNS[:3]]
    plain = both.select(*keys, *TABLE_COLUMNS[3:])
    weighted = both.select(*keys, *[F.col(f"{c}_w").alias(c) for c in TABLE_COLUMNS[3:]])
    out = {}
    for name, table in (("weighted", weighted), ("plain", plain)):
        out[f"{name}_all"] = table
        out[f"{name}_exposed"] = table.where(F.col("group") != baseline)
    return out


def _pairs(table: DataFrame, levels: list[str], group: str, values: list[str], by: list[str] = []) -> DataFrame:
    """Table rows side by side for every pair of groups: ``<value>_1`` and ``<value>_2``."""
    pairs = F.array(
        *[F.struct(F.lit(a).alias("group1"), F.lit(b).alias("group2")) for a, b in combinations(levels, 2)]
    )
    rows = table.where("kind <> 'size'").select("*", F.inline(pairs))
    rows = rows.where(F.col(group).isin(F.col("group1"), F.col("group2")))
    sides = []
    for i in (1, 2):
        mine = F.col(group) == F.col(f"group{i}")
        sides += [F.max(F.when(mine, F.col(v))).alias(f"{v}_{i}") for v in values]
        sides.append(F.count(F.when(mine, 1)).alias(f"rows_{i}"))
    return rows.groupBy(*by, "variable", "level", "kind", "group1", "group2").agg(*sides)


def smd(
    table: DataFrame, levels: list[str] = S.DOSE_LEVELS, group: str = "group", pairwise: bool = False, by: list[str] = []
) -> DataFrame:
    """Standardised mean differences of a baseline table, averaged over all pairs of groups.

    Numeric: |m1 - m2| / sqrt((s1^2 + s2^2) / 2). Flags and categories: the Mahalanobis distance of the
    level shares, which for shares p and q is sqrt(Q / (1 - Q/4)) with Q = sum (p - q)^2 / ((p + q) / 2).
    A variable that does not vary, or whose groups share no level, gives NULL. ``by`` keeps tables apart (a
    table per fit, made with ``baseline_table(..., by=[*by, "group"])``).
    """
    sides = _pairs(table, levels, group, ["mean", "sd", "pct"], by)
    pooled = F.sqrt((F.col("sd_1") ** 2 + F.col("sd_2") ** 2) / 2)
    p, q = F.coalesce("pct_1", F.lit(0.0)) / 100, F.coalesce("pct_2", F.lit(0.0)) / 100

    def part(p: Column, q: Column) -> Column:
        return F.coalesce(F.try_divide((p - q) ** 2, (p + q) / 2), F.lit(0.0))

    distance = F.when(F.col("kind") == "flag", part(p, q) + part(1 - p, 1 - q)).when(F.col("kind") == "category", part(p, q))
    pairs = (
        sides.groupBy(*by, "variable", "group1", "group2")
        .agg(
            F.max(F.try_divide(F.abs(F.col("mean_1") - F.col("mean_2")), pooled)).alias("by_mean"),
            F.sum(distance).alias("q"), F.sum("rows_1").alias("rows_1"), F.sum("rows_2").alias("rows_2"),
        )
        .where("rows_1 > 0 AND rows_2 > 0")
        .select(
            *by, "variable", "group1", "group2",
            F.when(F.col("q").isNull(), F.col("by_mean"))
            .when(F.col("q") < 4, F.sqrt(F.try_divide(F.col("q"), 1 - F.col("q") / 4))).alias("smd"),
        )
    )
    return pairs if pairwise else pairs.groupBy(*by, "variable").agg(F.avg("smd").alias("smd"))


def weight_summary(df: DataFrame, weight: str = "weight", by: list[str] = ["group"]) -> DataFrame:
    """Range, coefficient of variation and effective sample size of the weights."""
    w = F.col(weight)
    return df.groupBy(*by).agg(
        F.count(w).alias("n"), F.min(w).alias("w_min"), F.max(w).alias("w_max"), F.avg(w).alias("w_mean"),
        F.try_divide(F.stddev_samp(w), F.avg(w)).alias("cv"),
        F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("ess"),
    )


def balance_table(
    df: DataFrame, variables: list[str], weight: str = "weight", levels: list[str] = S.DOSE_LEVELS, pairwise: bool = False,
    by: list[str] = [],
) -> DataFrame:
    """Covariate balance before and after weighting, the largest over pairs of groups.

    Numeric variables: standardised mean difference with the unweighted pooled sd on both sides. Flags and
    levels: difference in proportion. With ``by`` (the stage) the balance of every fit comes from the same passes.
    """
    both = _summaries(df, variables, [*by, "group"], {"": None, "_w": F.col(weight)})
    table = both.withColumns(
        {"un": F.coalesce(F.col("mean"), F.col("pct") / 100), "adj": F.coalesce(F.col("mean_w"), F.col("pct_w") / 100)}
    )
    pairs = _pairs(table, levels, "group", ["un", "adj", "sd"], by)
    pooled = F.sqrt((F.col("sd_1") ** 2 + F.col("sd_2") ** 2) / 2)

    def difference(v: str) -> Column:
        raw = F.abs(F.coalesce(F.col(f"{v}_1"), F.lit(0.0)) - F.coalesce(F.col(f"{v}_2"), F.lit(0.0)))
        return F.when(F.col("kind") == "numeric", F.try_divide(raw, pooled)).otherwise(raw)

    out = pairs.withColumns({"diff_un": difference("un"), "diff_adj": difference("adj")}).select(
        *by, "variable", "level", "kind", "group1", "group2", "diff_un", "diff_adj"
    )
    if pairwise:
        return out
    return out.groupBy(*by, "variable", "level", "kind").agg(
        F.max("diff_un").alias("max_diff_un"), F.max("diff_adj").alias("max_diff_adj")
    )


def balance_distributions(
    df: DataFrame, variables: list[str], weight: str = "weight", bins: int = 20, by: list[str] = []
) -> DataFrame:
    """Share of each group per bin (numeric variables) or level (other), unadjusted and weighted, of all variables.

    With ``by`` (the stage) every fit has its own bins, between its own smallest and largest value; a variable with
    one value has one bin. One pass finds the ends of all bins, one more counts all bins. Missing values leave the shares.
    """
    numeric = [v for v in variables if isinstance(df.schema[v].dataType, T.NumericType)]
    ends = df.groupBy(*by).agg(
        F.lit(1), *[f(F.col(v).cast("double")).alias(f"_{end}_{v}") for v in numeric for end, f in (("lo", F.min), ("hi", F.max))]
    )
    if by:
        ends = ends.withColumnsRenamed({b: f"_{b}" for b in by})
        rows = df.join(ends, reduce(and_, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]))
    elif numeric:
        found = ends.first()  # one row, two numbers a variable
        rows = df.withColumns({f"_{end}_{v}": F.lit(found[f"_{end}_{v}"]).cast("double") for v in numeric for end in ("lo", "hi")})
    else:
        rows = df

    def bin_of(v: str) -> Column:
        if v not in numeric:
            return F.col(v).cast("string")
        x, low, high = F.col(v).cast("double"), F.col(f"_lo_{v}"), F.col(f"_hi_{v}")
        several = F.least(F.width_bucket(x, low, high, F.lit(bins)), F.lit(bins)).cast("string")
        return F.when(x.isNotNull(), F.when(low == high, "1").otherwise(several))

    long = rows.select(
        *by, "group", F.col(weight).alias("w"),
        F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), bin_of(v).alias("bin")) for v in variables])),
    ).where(F.col("bin").isNotNull())
    counts = long.groupBy(*by, "variable", "group", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    whole = Window.partitionBy(*by, "variable", "group")
    return counts.select(
        *by, "variable", "group", "bin", "n", (F.col("n") / F.sum("n").over(whole)).alias("share_un"),
        (F.col("w") / F.sum("w").over(whole)).alias("share_adj"),
    )


def balance_distribution(df: DataFrame, variable: str, weight: str = "weight", bins: int = 20) -> DataFrame:
    """The distribution of one variable over all rows."""
    return balance_distributions(df, [variable], weight, bins).drop("variable")


def ps_assess(
    df: DataFrame, variables: list[str], weight: str = "weight", bins: int = 20, by: list[str] = []
) -> dict[str, DataFrame]:
    """Weight summary, balance table and the distribution of each variable, of every fit if ``by`` names its stage."""
    spread = balance_distributions(df, variables, weight, bins, by)
    out = {"weights": weight_summary(df, weight, [*by, "group"]), "balance": balance_table(df, variables, weight, by=by)}
    return out | {f"distribution_{v}": spread.where(F.col("variable") == v).drop("variable") for v in variables}


def label_rows(table: DataFrame, defs: DataFrame, key: str = "Name") -> DataFrame:
    """Left join the descriptions by name; an existing order column keeps the row order."""
    return table.join(defs.select(F.col("Name").alias(key), "Description"), key, "left")


def keep_order(df: DataFrame, variables: list[str], variable: str = "variable") -> DataFrame:
    """Add ``row_order``: the position of the row's variable in the requested list, sizes first."""
    names = F.array(*[F.lit(v) for v in ["n", *variables]])
    return df.withColumn("row_order", F.array_position(names, F.col(variable)).cast("int"))


def _fixed(c: Column, digits: int) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.round(c + ADJUST, digits)))


def baseline_export(
    table: DataFrame, defs: DataFrame, variables: list[str], levels: list[str] = S.DOSE_LEVELS,
    smds: DataFrame | None = None, all_levels: bool = False, count_digits: int = 0,
) -> DataFrame:
    """Print form of a baseline table: one row per label, one text column per group, and the SMD.

    Labels are ``name (mean (SD))``, ``name (%)`` or ``name = level (%)``, with the description in place of the
    name where the variable has one. Of a variable with two levels only the second is
    shown, without its name, unless ``all_levels`` is set. Weighted counts want ``count_digits=1``.
    """
    kind = F.col("kind")
    known = table.groupBy("variable").agg(F.count_distinct("level").alias("levels"), F.max("level").alias("last"))
    table = table.join(known, "variable")
    single = (kind == "flag") | ((kind == "category") & (F.col("levels") == 2) & F.lit(not all_levels))
    table = table.where(~(single & (F.col("levels") == 2)) | (F.col("level") == F.col("last")))
    suffix = (
        F.when(kind == "size", F.lit(""))
        .when(kind == "numeric", F.lit(" (mean (SD))"))
        .when(single, F.lit(" (%)"))
        .otherwise(F.concat(F.lit(" = "), "level", F.lit(" (%)")))
    )
    cell = (
        F.when(kind == "size", _fixed(F.col("count"), count_digits))
        .when(kind == "numeric", F.concat(_fixed(F.col("mean"), 2), F.lit(" ("), _fixed(F.col("sd"), 2), F.lit(")")))
        .otherwise(F.concat(_fixed(F.col("count"), count_digits), F.lit(" ("), _fixed(F.col("pct"), 1), F.lit(")")))
    )
    cells = table.select("variable", "level", "group", suffix.alias("suffix"), cell.alias("cell"))
    rows = cells.groupBy("variable", "level", "suffix").agg(
        *[F.max(F.when(F.col("group") == g, F.col("cell"))).alias(f"group_{g}") for g in levels]
    )
    labelled = label_rows(rows, add_total_row(defs), key="variable")
    if smds is not None:
        labelled = labelled.join(smds, "variable", "left").withColumn("smd", _fixed(F.col("smd"), 3))
    out = labelled.withColumn("Name", F.concat(F.coalesce("Description", "variable"), "suffix"))
    extra = ["smd"] if smds is not None else []
    return keep_order(out, variables).select("row_order", "level", "Name", *[f"group_{g}" for g in levels], *extra)
