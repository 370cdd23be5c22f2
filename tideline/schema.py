"""Column names, level orders and the input schema of a person table."""

from pyspark.sql import types as T

# Comorbidity flags, in the order the score lists them.
DX_FLAGS = [
    "mi", "chf", "pvd", "cbd", "copd", "dementia", "paralysis", "dm_com0", "dm_com1", "crf",
    "liver_mild", "liver_modsev", "ulcers", "ra", "aids", "cancer", "cancer_mets",
]
# Points per flag. dm_com0 and liver_mild only count without their severe form.
SCORE_WEIGHTS = {
    "mi": 1, "chf": 1, "pvd": 1, "cbd": 1, "copd": 1, "dementia": 1, "paralysis": 1, "dm_com0": 1,
    "dm_com1": 2, "crf": 2, "liver_mild": 1, "liver_modsev": 3, "ulcers": 1, "ra": 1, "aids": 6,
    "cancer": 2, "cancer_mets": 6,
}
SCORE_HIERARCHY = {"dm_com0": "dm_com1", "liver_mild": "liver_modsev"}

# Outcomes, and those that have a history flag (death has none).
OUTCOMES = ["cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_mi", "cv_acs", "cv_death", "death"]
HX_OUTCOMES = ["cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_mi", "cv_acs"]

# Exposure levels; the first level is the comparison baseline.
BRAND_LEVELS = ["X", "B", "S", "BB", "SS", "BBB", "SSS"]
DOSE_LEVELS = ["X", "1d", "2d", "3d"]
DOSE_OF_SEQUENCE = {"B": "1d", "S": "1d", "BB": "2d", "SS": "2d", "BBB": "3d", "SSS": "3d"}

# Study dates, phase lengths in days, and the test types of the PCR source.
STUDY_START = "2021-02-23"
STUDY_END = "2023-01-23"
ACUTE_DAYS = 28
LATE_DAYS = 90
INTERVAL_DAYS = 62
RECENT_DOSE_DAYS = 180
MIN_AGE = 18
PCR_TEST_TYPES = ["HA_241", "HA_244", "HA_245", "PCR"]

DOSE_DATES = ["dose1_date", "dose2_date", "dose3_date", "dose4_date"]
ALL_DOSE_DATES = DOSE_DATES + ["dose5_date"]
BRANDS = ["brand1", "brand2", "brand3", "brand4"]

# Input column names of the source files that the general snake_case rule
# in sources.cohort.snake_name does not already map.
SOURCE_NAMES = {
    "dob_y": "birth_year",
    "COVID.test": "test_type",
    "death_date_ymd": "death_date",
    "icu.adm_date": "icu_date",
    "Date of vaccination.1st": "dose1_date",
    "Date of vaccination.2nd": "dose2_date",
    "Date of vaccination.3rd": "dose3_date",
    "Date of vaccination.4th": "dose4_date",
    "Date of vaccination.5th": "dose5_date",
    "Vaccine Brand.1st": "brand1",
    "Vaccine Brand.2nd": "brand2",
    "Vaccine Brand.3rd": "brand3",
    "Vaccine Brand.4th": "brand4",
}

PERSON_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.LongType(), False),
        T.StructField("match", T.LongType()),
        T.StructField("sex", T.StringType()),
        T.StructField("birth_year", T.IntegerType()),
        T.StructField("index_date", T.DateType(), False),
        T.StructField("covid_date", T.DateType()),
        T.StructField("infected", T.IntegerType()),
        T.StructField("test_type", T.StringType()),
        T.StructField("death_date", T.DateType()),
        T.StructField("icu_date", T.DateType()),
        T.StructField("vent_date", T.DateType()),
    ]
    + [T.StructField(c, T.DateType()) for c in ALL_DOSE_DATES]
    + [T.StructField(c, T.StringType()) for c in BRANDS]
    + [T.StructField(f"dx_{f}", T.IntegerType()) for f in DX_FLAGS]
    + [T.StructField(f"hx_{o}", T.IntegerType()) for o in HX_OUTCOMES]
    + [T.StructField(f"outcome_{o}_date", T.DateType()) for o in OUTCOMES]
)

TABLE1_SCHEMA = T.StructType(
    [T.StructField("Name", T.StringType()), T.StructField("Description", T.StringType())]
)
PS_SCHEMA = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Set", T.IntegerType())])

# The long result of an analysis run.
RESULT_COLUMNS = [
    "variant", "subgroup", "phase", "outcome", "group", "n", "events", "w_events", "pt", "rate",
    "rate_lo", "rate_hi", "log_hr", "se", "hr", "hr_lo", "hr_hi", "se_model", "converged", "n_missing", "crude_log_hr",
    "crude_se", "crude_hr", "crude_hr_lo", "crude_hr_hi", "crude_converged",
]
