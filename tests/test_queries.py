"""Every registered query against its SQL, and the shape of the plans that must not grow."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, connection
from tideline import schema as S
from tideline.plans import analysis, queries as Q
from tideline.plans.variants import VARIANTS
from tideline.sources.definitions import with_places
from tideline.sources.sample import SAMPLE_STUDY_END

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


#: Fits of several covariates have no maximum in the 53 subjects of the smallest tables, as a group has one subject.
MORE_SUBJECTS = ["analysis_multinomial", "propensity_multinomial"]


@pytest.mark.parametrize("name", MORE_SUBJECTS)
def test_fits_of_several_covariates_equal_sql(spark, sf_dir, name):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    assert compare(QUERIES[name](spark, larger), connection(larger), ORACLE[name], tolerance=2e-6) == ""


@pytest.mark.parametrize("name", sorted(set(ORACLE) - set(MORE_SUBJECTS)))
def test_equals_sql(spark, sf_dir, con, name):
    # Tolerance for the last digit: at this scale some fits diverge and both sides stop near the limit.
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name], tolerance=2e-6) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) | set(MORE_SUBJECTS)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_propensity_terms_are_of_the_whole_table(spark, sf_dir):
    parts = sorted(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size").collect())
    want = list(enumerate(name for key, name, size in parts if key % 10 and size % 7 <= 4))
    got = QUERIES["propensity_terms"](spark, sf_dir)
    assert sorted(map(tuple, got.select("place", "name").collect())) == want and len(want) > 60


def test_places_follow_the_key(spark):
    keys = [k * k - 50 for k in range(40)]
    df = spark.createDataFrame([(k, f"n{k}") for k in reversed(keys)], "id long, Name string").repartition(3)
    got = {r.id: r.place for r in with_places(df, "id").collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_oracle_has_no_orphans():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["outcome", "group", "n"] and df.count() > 0


def exchanges(df):
    """Exchanges of any kind but broadcasts, and the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange ", text)), text


def test_all_variants_are_one_scan_and_one_shuffle(spark, sf_dir):
    """The analysis of every variant, subgroup and outcome reads the written cohort once."""
    cells = analysis.analysis_cells(Q.eligible(spark, sf_dir), Q.TERMS, VARIANTS, SAMPLE_STUDY_END)
    n, text = exchanges(cells)
    assert n == 1 and text.count("FileScan") == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "subject_id" not in text  # only the columns that are read


def test_an_analysis_of_two_names_is_made_once():
    from tideline.plans.variants import distinct_variants

    names = distinct_variants(list(VARIANTS))
    assert sum(map(len, names.values())) == len(VARIANTS) and ["main", "no_added_dose"] in names.values()


def test_cohort_operators_do_not_shuffle(spark):
    df = spark.createDataFrame([], S.PERSON_SCHEMA)
    long = Q.acute_long(Q.K.use_dose_group(Q.K.analysable(Q.K.eligible(df))))
    assert exchanges(long)[0] == 0
    counts = Q.R.event_counts(Q.Z.at_risk(long), ["outcome", "group"])
    n, text = exchanges(counts)
    assert n == 1 and "partial_sum" in text


def test_result_columns_and_levels(spark, sf_dir):
    variants = [v for v in VARIANTS if v.name in ("main", "competing")]
    result = analysis.run_analysis(Q.eligible(spark, sf_dir), ["segment"], variants, SAMPLE_STUDY_END)
    assert result.columns == S.RESULT_COLUMNS
    rows = result.toPandas()
    assert set(rows["variant"]) == {"main", "competing"} and set(rows["phase"]) == {"acute", "postacute"}
    assert rows[rows["group"] == "X"]["hr"].isna().all()
    assert set(rows[(rows["variant"] == "main") & (rows["phase"] == "acute")]["outcome"]) == {"cv_major"}


def test_a_spread_hot_set_does_not_change_the_exclusion(spark, sf_dir):
    """A third of all subjects in one matched set, the set of NULL ids."""
    df = Q.analysable(spark, sf_dir).withColumn("match", F.when(F.col("subject_id") % 3 != 0, F.col("match")))
    flagged = analysis.added_dose_flags(df).select("subject_id", "match", "added_acute").toPandas()
    dosed = {r["match"] for r in Q.K.dose_in_window(df).select("match").collect()}
    want = [int((None if m != m else m) in dosed) for m in flagged["match"]]
    assert flagged["added_acute"].tolist() == want


def test_a_hot_set_is_split(spark):
    """A third of the rows without a set id: the adaptive join splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 300_000, 1, 8).selectExpr("id", "IF(id % 3 = 0, NULL, id % 5000) AS match")
        kept = Q.K.exclude_matched_sets(df, df.where("match % 10 = 1"))
        rows = kept.collect()
        assert "SortMergeJoin(skew=true)" in kept._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == df.where("match IS NULL OR match % 10 <> 1").count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_doses_are_ranked_before_the_shuffle(spark, sf_dir):
    from tideline.sources import sample

    text = exchanges(sample._doses(spark.read.parquet(f"{sf_dir}/orders.parquet")))[1]
    first, last = text.index("row_number(), 5, Final"), text.index("row_number(), 5, Partial")
    assert first < text.index("Exchange hashpartitioning") < last


def test_weighted_stages_round_trip(spark, sf_dir, tmp_path):
    """Saved weighted stages give the weights back per stage and subgroup."""
    from tideline.plans.variants import ACUTE, POSTACUTE_SUB
    from tideline.sources import materialise, read_stage, write_stage

    cohort = materialise(Q.eligible(spark, sf_dir), "eligible")
    weighted = analysis.weighted_stages(cohort, ["sex"], [ACUTE, POSTACUTE_SUB])
    write_stage(weighted, str(tmp_path / "stages"), ["stage_name", "subgroup"])
    back = read_stage(spark, str(tmp_path / "stages"), stage_name="acute")
    assert back.count() == Q.analysable(spark, sf_dir).count()
    # Each group that has both sexes is weighted up to everybody.
    sizes = back.groupBy("group").agg(F.sum("weight").alias("w"), F.countDistinct("sex").alias("sexes")).toPandas()
    sizes = sizes[sizes["sexes"] == 2]
    assert len(sizes) >= 2 and abs(sizes["w"] - back.count()).max() < 1e-6
    assert read_stage(spark, str(tmp_path / "stages"), subgroup="sex.male").where("sex <> 'M'").count() == 0


def test_queries_without_an_optional_library(monkeypatch):
    """A library that only the training-data operators need is not there: their queries are not either."""
    import sys

    for name in [n for n in sys.modules if n.startswith("tideline.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    known = entry.queries()
    assert "cox_weighted" in known and not any(n.startswith("op") and n[2].isdigit() for n in known) and set(entry.oracle_sql()) <= set(known)
