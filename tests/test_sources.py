import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline import schema as S
from tideline.operators import cohort as K
from tideline.sources import (
    add_total_row, definition_filter, kept_stage, materialise, read_cohort, read_definitions, read_report, read_set_stage,
    read_stage, run, write_report, write_set_stage, write_stage, write_tables,
)
from tideline.sources.ordered import numbered
from tideline.sources.sample import person_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_cohort_pushes_the_date_filter(spark, sf_dir, tmp_path):
    path = str(tmp_path / "persons")
    person_table(spark, sf_dir).drop("segment").write.parquet(path)
    df = read_cohort(spark, path, "1998-03-01")
    assert df.schema.names == S.PERSON_SCHEMA.names
    assert "GreaterThanOrEqual(index_date,1998-03-01)" in plan(df)
    few = plan(df.select("subject_id"))
    assert "ReadSchema: struct<subject_id:bigint,index_date:date>" in few
    assert df.count() == person_table(spark, sf_dir).where("index_date >= '1998-03-01'").count()


def test_stage_round_trip_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "stage")
    df = spark.createDataFrame([(1, "acute", "all"), (2, "postacute", "all")], "id int, phase string, subgroup string")
    write_stage(df, path, ["phase", "subgroup"])
    back = read_stage(spark, path, phase="acute")
    assert [r["id"] for r in back.collect()] == [1]
    assert "PartitionFilters: [isnotnull(phase" in plan(back)
    write_stage(df.where("id = 2").withColumn("id", F.lit(3)), path, ["phase", "subgroup"])
    assert sorted(r["id"] for r in read_stage(spark, path).collect()) == [1, 3]  # the other partition stays


def test_cohort_without_required_columns_is_refused(spark, sf_dir, tmp_path):
    df = person_table(spark, sf_dir)
    df.drop("hx_cv_major").write.parquet(str(tmp_path / "less"))
    with pytest.raises(ValueError, match="hx_cv_major"):
        read_cohort(spark, str(tmp_path / "less"))
    df.withColumn("sex", F.lit(1)).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="sex string"):
        read_cohort(spark, str(tmp_path / "other"))
    df.write.parquet(str(tmp_path / "more"))
    assert read_cohort(spark, str(tmp_path / "more"), "1998-03-01").columns == [*S.PERSON_SCHEMA.names, "segment"]


def test_every_file_of_a_cohort_is_checked(spark, sf_dir, tmp_path):
    """Spark takes the schema of one file; a file without a column would be read as NULL."""
    df, path = person_table(spark, sf_dir), str(tmp_path / "mixed")
    df.repartition(6).write.parquet(path)
    assert read_cohort(spark, path).columns == [*S.PERSON_SCHEMA.names, "segment"]
    df.drop("hx_cv_major").coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match=r"part-\S+ \(hx_cv_major int\)"):
        read_cohort(spark, path)
    assert read_cohort(spark, path, "1998-03-01", every_file=False).count() > 0
    df.withColumn("sex", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "types/kind=b"))
    df.coalesce(1).write.parquet(str(tmp_path / "types/kind=a"))
    with pytest.raises(ValueError, match="kind=b"):
        read_cohort(spark, str(tmp_path / "types"))
    df.write.partitionBy("sex").parquet(str(tmp_path / "folders"))
    assert read_cohort(spark, str(tmp_path / "folders"), "1998-03-01").count() == df.where("index_date >= '1998-03-01'").count()


def test_a_half_written_stage_is_not_read(spark, tmp_path):
    path = str(tmp_path / "stage")
    df = spark.range(0, 1000, 1, 8)
    write_stage(df, path)
    assert read_stage(spark, path).count() == 1000
    broken = df.withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        write_stage(broken, path)
    with pytest.raises(ValueError, match="to its end"):
        read_stage(spark, path)
    assert kept_stage(df, path).count() == 1000  # made anew
    parts = str(tmp_path / "parts")
    write_stage(df.withColumn("p", F.col("id") % 3), parts, ["p"])
    with pytest.raises(Exception, match="lost"):
        write_stage(broken.withColumn("p", F.col("id") % 3), parts, ["p"])
    with pytest.raises(ValueError, match="to its end"):
        read_stage(spark, parts, p=1)


def test_a_stage_is_reused_by_the_same_plan_only(spark, tmp_path):
    path, source = str(tmp_path / "kept"), str(tmp_path / "source")
    spark.range(10).write.parquet(source)

    def files(df):
        return sorted(kept_stage(df, path).inputFiles())

    first = files(spark.read.parquet(source).where("id > 3"))
    assert files(spark.read.parquet(source).where("id > 3")) == first
    other = files(spark.read.parquet(source).where("id > 4"))
    assert other != first and read_stage(spark, path).count() == 5
    spark.range(20).write.mode("overwrite").parquet(source)  # other files under the same name
    assert files(spark.read.parquet(source).where("id > 4")) != other and read_stage(spark, path).count() == 15
    local = [spark.createDataFrame([(x,)], "a int") for x in (1, 2)]
    assert files(local[0]) != files(local[1]) and read_stage(spark, path).first()["a"] == 2


def test_a_run_leaves_named_stages_only(spark, tmp_path):
    path = str(tmp_path / "named")
    with run(spark) as folder:
        df = materialise(spark.range(5), "one")
        assert folder in df.inputFiles()[0] and df.count() == 5
        kept_stage(materialise(df, "two").where("id > 1"), path)
    assert not os.path.exists(folder) and read_stage(spark, path).count() == 3
    assert folder not in materialise(spark.range(2), "after").inputFiles()[0]


def test_numbers_and_file_order(spark, tmp_path):
    rows = [(i * 37 % 1009, f"n{i % 5}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, name string").repartition(9)
    got = {(r.k, r.name): r.place for r in numbered(df, ["name", -F.col("k")]).collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows, key=lambda r: (r[1], -r[0])))}
    write_report(df, str(tmp_path / "report"), order=["name", "k"])
    back = read_report(spark, str(tmp_path / "report"), "k int, name string").collect()
    assert {(r.k, r.name): r.place for r in back} == {row: i for i, row in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_definitions(spark, tmp_path):
    path = str(tmp_path / "ps")
    spark.createDataFrame([("age", 1), (None, 1), ("bmi", 5)], S.PS_SCHEMA).write.option("header", True).csv(path)
    defs = read_definitions(spark, path, "PS")
    assert defs.schema == S.PS_SCHEMA
    assert [r["Name"] for r in definition_filter(defs, 4).collect()] == ["age"]
    table1 = spark.createDataFrame([("age", "Age")], S.TABLE1_SCHEMA)
    assert [tuple(r) for r in add_total_row(table1).collect()] == [("n", "n"), ("age", "Age")]


def test_tables_and_report(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    write_tables({"first": a, "second": b}, str(tmp_path / "tables"))
    back = spark.read.option("header", True).csv(str(tmp_path / "tables"))
    assert {r["table_name"]: r["count"] for r in back.groupBy("table_name").count().collect()} == {"first": 1, "second": 2}
    for format in ("csv", "json"):
        for df in (b, a):
            write_report(df, str(tmp_path / format), format)
        reader = spark.read.option("header", True)
        assert getattr(reader, format)(str(tmp_path / format)).count() == 1


def test_materialise_uses_the_shared_folder(spark):
    df = materialise(spark.createDataFrame([(1, date(2020, 1, 1))], "a int, b date"), "test")
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert df.dtypes == [("a", "int"), ("b", "date")]


def test_sample_counts(spark, sf_dir):
    """Counts known from running the same rules as SQL."""
    df = K.with_exposure(K.with_scores(person_table(spark, sf_dir)))
    assert [r["n"] for r in K.attrition(df, K.eligibility_steps()).orderBy("step_no").collect()] == [150, 147, 70, 68, 53]
    assert df.where("dose_seq IS NULL").count() == 4


@pytest.mark.parametrize("column", [f.name for f in S.PERSON_SCHEMA if f.name.startswith(("outcome", "dose"))][:3])
def test_sample_types(spark, sf_dir, column):
    assert dict(person_table(spark, sf_dir).dtypes)[column] == "date"


def sets_of(spark):
    """Sets of five, a third of all rows without an id, two extra columns and an empty set of doses in most."""
    df = spark.range(0, 3000, 1, 6).selectExpr("id", "IF(id % 3 = 0, NULL, id % 600) AS match", "id % 100 = 1 AS dosed")
    return df.withColumn("excluded_key_2", F.lit("x"))


def test_stored_sets_need_no_exchange(spark, tmp_path):
    """Work on whole sets of a bucketed stage moves no row: only the scalar of the rows without id has an exchange."""
    df, path = sets_of(spark), str(tmp_path / "sets")
    write_set_stage(df, path, buckets=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stage = read_set_stage(spark, path)
        kept, flagged = K.exclude_stored_sets(stage, F.col("dosed")), K.flag_stored_sets(stage, {"any_dose": F.col("dosed")})
        for plan_text in (plan(kept), plan(flagged)):
            assert "SortMergeJoin" in plan_text and "Exchange hashpartitioning" not in plan_text
            assert "SelectedBucketsCount: 8 out of 8" in plan_text
        want = K.exclude_matched_sets(df, df.where("dosed"))
        assert sorted(r["id"] for r in kept.collect()) == sorted(r["id"] for r in want.collect())
        dosed = {r["match"] for r in df.where("dosed").collect()}
        assert None in dosed and all(r["any_dose"] == (r["match"] in dosed) for r in flagged.collect())
        assert flagged.count() == 3000
        assert {r["match"] for r in K.exclude_stored_sets(stage, F.col("dosed") & F.col("match").isNotNull()).collect()} >= {None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_sets_of_another_session_and_empty_ones(spark, tmp_path):
    path = str(tmp_path / "sets")
    write_set_stage(sets_of(spark), path, buckets=4)
    other = spark.newSession()
    assert read_set_stage(other, path).rows.count() == 3000
    write_set_stage(sets_of(spark).where("false"), path, buckets=2)
    empty = read_set_stage(spark, path)
    assert K.exclude_stored_sets(empty, F.col("dosed")).count() == 0
    assert K.flag_stored_sets(empty, {"any_dose": F.col("dosed")}).columns[-1] == "any_dose"
    broken = sets_of(spark).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        write_set_stage(broken, path, buckets=2)
    with pytest.raises(ValueError, match="to its end"):
        read_set_stage(spark, path)
