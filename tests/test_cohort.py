"""Edge rows of the cohort build and the censoring rules, worked out by hand."""

from datetime import date, timedelta

import pytest

from tideline import schema as S
from tideline.functions import columns as C
from tideline.operators import censoring as Z, cohort as K
from tideline.sources.cohort import normalise_dates, snake_case, snake_name

INDEX = date(2022, 3, 1)


def day(n):
    return INDEX + timedelta(days=n)


def person(**values):
    row = {f.name: None for f in S.PERSON_SCHEMA}
    row |= {f"dx_{f}": 0 for f in S.DX_FLAGS} | {f"hx_{o}": 0 for o in S.HX_OUTCOMES}
    row |= {"subject_id": 1, "sex": "F", "birth_year": 1960, "index_date": INDEX, "covid_date": INDEX, "infected": 1}
    return row | values


def persons(spark, *rows):
    full = [person(**{"subject_id": i} | r) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[f.name] for f in S.PERSON_SCHEMA) for r in full], S.PERSON_SCHEMA)


def by_id(df, *cols):
    rows = df.select("subject_id", *cols).collect()
    return {r[0]: (r[1] if len(cols) == 1 else tuple(r[1:])) for r in rows}


def test_alive_at_index(spark):
    df = persons(spark, {"death_date": INDEX}, {"death_date": day(-1)}, {})
    assert set(by_id(K.alive_at_index(df), "index_date")) == {1, 3}


@pytest.mark.parametrize("age,points", [(18, 0), (49, 0), (50, 1), (59, 1), (60, 2), (79, 3), (80, 4), (99, 4)])
def test_age_steps(spark, age, points):
    df = persons(spark, {"birth_year": 2022 - age, "dx_mi": 1})
    row = K.with_scores(df).select("age", "score_cci", "score_cci_age").first()
    assert tuple(row) == (age, 1, 1 + points)


def test_score_hierarchy_and_null(spark):
    df = persons(
        spark,
        {"dx_dm_com0": 1},
        {"dx_dm_com0": 1, "dx_dm_com1": 1},
        {"dx_liver_mild": 1, "dx_liver_modsev": 1},
        {"dx_cancer": 1, "dx_cancer_mets": 1},
        {"dx_ra": None},
        {f"dx_{f}": 1 for f in S.DX_FLAGS},
    )
    # all flags: 9 single points + dm 2 + crf 2 + liver 3 + aids 6 + cancer 2 + mets 6
    assert by_id(K.with_scores(df), "score_cci") == {1: 1, 2: 2, 3: 3, 4: 8, 5: None, 6: 30}


def test_severity_window(spark):
    df = persons(spark, {"icu_date": INDEX}, {"vent_date": day(6)}, {"icu_date": day(7)}, {"icu_date": day(-1)}, {},
                 {"covid_date": None, "icu_date": INDEX})
    assert by_id(K.with_scores(df), "severity") == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}


def test_exposure(spark):
    d = [day(-300), day(-200), day(-100), day(-10)]
    b = {"dose1_date": d[0], "brand1": "BNT"}
    bb = b | {"dose2_date": d[1], "brand2": "BNT"}
    df = persons(
        spark,
        {},
        b,
        bb | {"dose3_date": d[2], "brand3": "BNT"},
        bb | {"dose3_date": d[2], "brand3": "Sino"},
        bb | {"dose3_date": d[2], "brand3": "BNT", "dose4_date": d[3], "brand4": "BNT"},
        {"dose1_date": d[0]},                               # dated dose without a brand
        b | {"dose2_date": INDEX, "brand2": "BNT"},         # dose on the index day does not count
        {"dose2_date": d[1], "brand2": "Sino"},             # first dose skipped
    )
    e = K.with_exposure(df)
    assert by_id(e, "dose_seq") == {1: "", 2: "B", 3: "BBB", 4: "BBS", 5: "BBBB", 6: None, 7: "B", 8: "S"}
    assert by_id(e, "group_dose") == {1: "X", 2: "1d", 3: "3d", 4: None, 5: None, 6: None, 7: "1d", 8: "1d"}
    assert by_id(e, "bnt", "sino")[3] == (1, 0) and by_id(e, "bnt", "sino")[6] == (0, 0)
    assert by_id(e, "days_since_dose") == {1: None, 2: 300, 3: 100, 4: 100, 5: 10, 6: None, 7: 300, 8: None}
    latest = e.withColumn("latest", C.days_since_last_dose(last_dose="max"))
    assert by_id(latest, "latest") == {1: None, 2: 300, 3: 100, 4: 100, 5: 10, 6: 300, 7: 300, 8: 200}
    assert set(by_id(K.analysable(e), "group_dose")) == {1, 2, 3, 7, 8}


def test_recent_dose_uses_the_current_index(spark):
    df = K.with_exposure(persons(spark, {}, {"dose1_date": day(-180), "brand1": "BNT"}, {"dose1_date": day(-152), "brand1": "BNT"},
                                 {"dose1_date": day(-181), "brand1": "BNT"}))
    assert set(by_id(K.recent_dose(df), "sex")) == {1, 2, 3}
    assert set(by_id(K.recent_dose(K.landmark(df)), "sex")) == {1, 3}


def test_landmark(spark):
    df = persons(spark, {"death_date": day(27)}, {"death_date": day(28)}, {})
    assert by_id(K.landmark(df, 28), "index_date") == {2: day(28), 3: day(28)}


def test_exclude_matched_sets_is_null_safe(spark):
    df = persons(spark, {"match": 1}, {"match": 1}, {"match": 2}, {"match": None})
    assert set(by_id(K.exclude_matched_sets(df, df.where("subject_id = 1")), "sex")) == {3, 4}
    assert set(by_id(K.exclude_matched_sets(df, df.where("subject_id = 4")), "sex")) == {1, 2, 3}


def test_dose_in_window(spark):
    df = persons(spark, {"dose5_date": INDEX}, {"dose1_date": day(27)}, {"dose1_date": day(28)}, {"dose1_date": day(-1)}, {})
    assert set(by_id(K.dose_in_window(df), "sex")) == {1, 2}
    doses = spark.createDataFrame([(1, INDEX), (1, INDEX), (2, day(27)), (3, day(28))], "subject_id long, dose_date date")
    assert set(by_id(K.dose_in_window_long(df, doses), "sex")) == {1, 2}


def test_subgroups(spark):
    df = K.use_dose_group(K.eligible(persons(spark, {"birth_year": 1957}, {"birth_year": 1958, "sex": "M"})))
    got = {(r[0], r[1]) for r in K.subgroups(df).select("subject_id", "subgroup").collect()}
    assert {s for i, s in got if i == 1} == {"age.ge65", "sex.female", "cci.l4", "sev0", "bnt", "sino"}
    assert {s for i, s in got if i == 2} == {"age.l65", "sex.male", "cci.l4", "sev0", "bnt", "sino"}


def test_attrition_counts_cumulatively(spark):
    df = K.with_exposure(K.with_scores(persons(spark, {"death_date": day(-1)}, {"hx_cv_major": 1}, {"hx_cv_major": None},
                                              {"birth_year": 2010}, {"infected": 0}, {})))
    assert [r["n"] for r in K.attrition(df, K.eligibility_steps()).orderBy("step_no").collect()] == [6, 5, 3, 2, 1]


def long(spark, *rows, index=INDEX):
    schema = "id int, index_date date, death_date date, outcome_date date, hx int, competing_date date"
    return spark.createDataFrame([(i, index, *r) for i, r in enumerate(rows, 1)], schema)


def censored(df):
    return {r["id"]: (r["time"], r["status"]) for r in df.collect()}


def test_censor_acute(spark):
    df = long(
        spark, (None, None, 0, None), (None, INDEX, 0, None), (None, day(27), 0, None), (None, day(28), 0, None),
        (day(5), day(5), 0, day(5)), (day(5), day(6), 0, day(5)), (INDEX, None, 0, INDEX),
    )
    assert censored(Z.censor_acute(df)) == {1: (28, 0), 2: (1, 1), 3: (28, 1), 4: (28, 0), 5: (6, 1), 6: (6, 0), 7: (1, 0)}


def test_competing_status_same_day_is_the_outcome(spark):
    df = long(spark, (day(5), day(5), 0, day(5)), (day(5), day(6), 0, day(5)), (None, None, 0, None), (day(40), None, 0, day(40)))
    out = Z.competing_status(Z.censor_acute(df))
    assert {r["id"]: r["status_cr"] for r in out.collect()} == {1: 1, 2: 2, 3: 0, 4: 0}


def test_censor_open_prior_outcome_is_history(spark):
    df = long(spark, (None, day(-1), 0, None), (None, day(-1), None, None), (None, None, None, None), (None, INDEX, 0, None),
              (None, day(100), 0, None))
    out = Z.censor_open(df, study_end=str(day(50)))
    rows = {r["id"]: (r["hx"], r["time"], r["status"]) for r in out.collect()}
    assert rows[1][0] == 1 and rows[2][0] == 1 and rows[3][0] is None
    assert rows[4] == (0, 1, 1) and rows[5] == (0, 51, 0)
    assert {r["id"] for r in Z.at_risk(out).collect()} == {4, 5}


def test_censor_interval(spark):
    df = long(spark, (None, day(61), 0, None), (None, day(62), 0, None))
    assert censored(Z.censor_interval(df, study_end=str(day(500)))) == {1: (62, 1), 2: (62, 0)}
    assert censored(Z.censor_interval(df, study_end=str(day(10)))) == {1: (11, 0), 2: (11, 0)}


def test_check_time_fails_on_negative_time(spark):
    df = Z.censor_acute(long(spark, (day(-3), None, 0, None)))
    with pytest.raises(Exception, match="negative follow-up time"):
        Z.check_time(df).collect()
    assert Z.time_check(df, ["hx"]).first()["n_bad"] == 1


def test_flags_as_boolean_and_names(spark):
    df = spark.createDataFrame([(1, 0, 5)], "dx_mi int, hx_mi int, infected int")
    assert dict(K.flags_as_boolean(df).dtypes) == {"dx_mi": "boolean", "hx_mi": "boolean", "infected": "int"}
    assert snake_name("dx.mi") == "dx_mi" and snake_name("outcome.cv.major.date") == "outcome_cv_major_date"
    assert snake_name("Date of vaccination.2nd") == "dose2_date" and snake_name("COVID.date") == "covid_date"
    assert snake_case(spark.createDataFrame([(1,)], ["dx.mi"])).columns == ["dx_mi"]


def test_normalise_dates(spark):
    df = spark.createDataFrame([("2022-03-01", INDEX), ("bad", None), (None, None)], "a string, b date")
    assert [r["a"] for r in normalise_dates(df, ["a", "b"]).collect()] == [INDEX, None, None]


def test_order_by_level(spark):
    df = spark.createDataFrame([("3d",), ("X",), ("1d",)], "group string")
    assert [r[0] for r in K.order_by_level(df, "group", S.DOSE_LEVELS).collect()] == ["X", "1d", "3d"]
