"""DuckDB SQL for the registered queries, written from the definitions and independent of the package."""

from __future__ import annotations

DX = ["mi", "chf", "pvd", "cbd", "copd", "dementia", "paralysis", "dm_com0", "dm_com1", "crf", "liver_mild",
      "liver_modsev", "ulcers", "ra", "aids", "cancer", "cancer_mets"]
HX = {"cv_major": (29, 0), "cv_stroke": (31, 1), "cv_cad": (31, 2), "cv_hf": (31, 3), "cv_mi": (31, 4), "cv_acs": (31, 5)}
FIRST = {"cv_stroke": (7, 0), "cv_cad": (7, 1), "cv_hf": (11, 2), "cv_mi": (17, 4), "cv_acs": (19, 5), "icu": (23, 6),
         "vent": (23, 7)}
OUTCOMES = ["cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_mi", "cv_acs", "cv_death", "death"]
GROUPS = ["X", "1d", "2d", "3d"]
STUDY_END = "DATE '2001-10-01'"


def r6(x: str) -> str:
    return f"round(({x}) + 1e-9, 6)"


def _person() -> str:
    dx = ",\n".join(
        [f"max(CASE WHEN d < index_date AND pk % 101 = {k} THEN 1 ELSE 0 END) AS dx_{f}" for k, f in enumerate(DX)]
        + [f"max(CASE WHEN d < index_date AND pk % {m} = {r} THEN 1 ELSE 0 END) AS hx_{o}" for o, (m, r) in HX.items()]
        + [f"min(CASE WHEN d >= index_date AND pk % {m} = {r} THEN d END) AS first_{o}" for o, (m, r) in FIRST.items()]
        + ["min(CASE WHEN d >= index_date - 10 AND pk % 13 = 3 THEN d END) AS death_date"]
    )
    doses = ", ".join(
        [f"max(CASE WHEN k = {k} THEN d END) AS dose{k}_date" for k in range(1, 6)]
        + [f"max(CASE WHEN k = {k} THEN brand END) AS brand{k}" for k in range(1, 5)]
    )
    zero = ", ".join([f"coalesce(dx_{f}, 0) AS dx_{f}" for f in DX] + [f"coalesce(hx_{o}, 0) AS hx_{o}" for o in HX])
    outcomes = ", ".join(f"first_{o} AS outcome_{o}_date" for o in FIRST if o not in ("icu", "vent"))
    return f"""idx AS (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS index_date FROM orders
  WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey),
urgent AS (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL
         WHEN (o_custkey % 2 = 0) <> (o_orderkey % 20 = 0) THEN 'BNT' ELSE 'Sino' END AS brand,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k
  FROM orders WHERE o_orderpriority = '1-URGENT'),
doses AS (SELECT o_custkey, {doses} FROM urgent GROUP BY o_custkey),
items AS (
  SELECT o_custkey, CAST(l_shipdate AS DATE) AS d, l_partkey AS pk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
facts AS (SELECT idx.o_custkey, {dx} FROM idx JOIN items ON items.o_custkey = idx.o_custkey GROUP BY idx.o_custkey),
person AS MATERIALIZED (
  SELECT idx.o_custkey AS subject_id,
    CASE WHEN idx.o_custkey % 97 = 0 THEN NULL ELSE idx.o_custkey // 5 END AS "match",
    CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
    CAST(year(index_date) - (15 + idx.o_custkey % 75) AS INTEGER) AS birth_year,
    index_date, index_date AS covid_date,
    CASE WHEN idx.o_custkey % 10 = 9 THEN 0 ELSE 1 END AS infected,
    CASE WHEN idx.o_custkey % 3 = 0 THEN 'PCR' ELSE 'RAT' END AS test_type,
    death_date, first_icu AS icu_date, first_vent AS vent_date,
    dose1_date, dose2_date, dose3_date, dose4_date, dose5_date, brand1, brand2, brand3, brand4, {zero}, {outcomes},
    least(first_cv_stroke, first_cv_cad, first_cv_hf, first_cv_mi) AS outcome_cv_major_date,
    CASE WHEN idx.o_custkey % 2 = 0 THEN death_date END AS outcome_cv_death_date,
    death_date AS outcome_death_date, c_mktsegment AS segment
  FROM idx JOIN customer ON c_custkey = idx.o_custkey
  LEFT JOIN doses ON doses.o_custkey = idx.o_custkey LEFT JOIN facts ON facts.o_custkey = idx.o_custkey)"""


def _derived() -> str:
    plain = " + ".join(f"dx_{f}" for f in ["mi", "chf", "pvd", "cbd", "copd", "dementia", "paralysis", "ulcers", "ra"])
    score = (
        f"{plain} + CASE WHEN dx_dm_com0 = 1 AND dx_dm_com1 = 0 THEN 1 ELSE 0 END + 2 * dx_dm_com1 + 2 * dx_crf"
        " + CASE WHEN dx_liver_mild = 1 AND dx_liver_modsev = 0 THEN 1 ELSE 0 END + 3 * dx_liver_modsev"
        " + 6 * dx_aids + 2 * dx_cancer + 6 * dx_cancer_mets"
    )
    letters = " || ".join(
        f"CASE WHEN dose{k}_date IS NOT NULL AND dose{k}_date < index_date THEN substr(brand{k}, 1, 1) ELSE '' END"
        for k in range(1, 5)
    )
    before = ", ".join(f"CASE WHEN dose{k}_date < index_date THEN dose{k}_date END" for k in range(1, 5))
    last = " ".join(f"WHEN {k} THEN dose{k}_date" for k in range(1, 5))
    return f"""scored AS (
  SELECT *, year(index_date) - birth_year AS age, {score} AS score_cci,
    CASE WHEN (icu_date >= covid_date AND icu_date < covid_date + 7)
           OR (vent_date >= covid_date AND vent_date < covid_date + 7) THEN 1 ELSE 0 END AS severity,
    {letters} AS dose_seq, greatest({before}) AS latest_dose
  FROM person),
derived AS MATERIALIZED (
  SELECT *, score_cci + greatest(least(CAST(ceil((age - 49) / 10.0) AS INTEGER), 4), 0) AS score_cci_age,
    CASE length(dose_seq) {last} END AS last_dose,
    CASE WHEN dose_seq = '' THEN 'X' WHEN dose_seq IN ('B', 'S', 'BB', 'SS', 'BBB', 'SSS') THEN dose_seq END AS group_brand,
    CASE WHEN dose_seq = '' THEN 'X' WHEN dose_seq IN ('B', 'S') THEN '1d' WHEN dose_seq IN ('BB', 'SS') THEN '2d'
         WHEN dose_seq IN ('BBB', 'SSS') THEN '3d' END AS group_dose,
    CASE WHEN dose_seq IN ('B', 'BB', 'BBB') THEN 1 ELSE 0 END AS bnt,
    CASE WHEN dose_seq IN ('S', 'SS', 'SSS') THEN 1 ELSE 0 END AS sino
  FROM scored),
elig AS MATERIALIZED (
  SELECT * FROM derived WHERE (death_date IS NULL OR death_date >= index_date) AND hx_cv_major = 0 AND age >= 18),
ana AS MATERIALIZED (
  SELECT *, group_dose AS "group" FROM elig WHERE group_brand IS NOT NULL AND infected = 1),
post AS (SELECT * REPLACE (CAST(index_date + 28 AS DATE) AS index_date) FROM ana
  WHERE death_date IS NULL OR death_date >= index_date + 28),
late AS (SELECT * REPLACE (CAST(index_date + 90 AS DATE) AS index_date) FROM ana
  WHERE death_date IS NULL OR death_date >= index_date + 90)"""


BASE = f"WITH RECURSIVE {_person()},\n{_derived()}"


def r3(x: str) -> str:
    return f"round(({x}) + 1e-5, 3)"


def sql(body: str, *ctes: str) -> str:
    return ",\n".join([BASE, *ctes]) + "\n" + body


def unpivot(source: str, name: str, outcomes=OUTCOMES, extra: str = "") -> str:
    parts = [
        f"SELECT subject_id, \"group\", index_date, death_date{extra}, '{o}' AS outcome, "
        f"{'0' if o in ('cv_death', 'death') else f'hx_{o}'} AS hx0, outcome_{o}_date AS od, outcome_death_date AS cd FROM {source}"
        for o in outcomes
    ]
    return f"{name}_rows AS ({' UNION ALL '.join(parts)})"


def censored(source: str, name: str, bound: str, prior: bool, outcomes=OUTCOMES, extra: str = "") -> str:
    """CTEs ``<name>_rows`` and ``<name>``: at-risk rows with end_date, time, status, competing."""
    hx = "CASE WHEN hx0 <> 0 OR (od IS NOT NULL AND od < index_date) THEN 1 ELSE 0 END" if prior else "hx0"
    late = " AND {} >= index_date" if prior else ""
    happened = lambda c: f"CASE WHEN {c} IS NOT NULL AND least({c}, death_date, {bound}) = {c}{late.format(c)} THEN 1 ELSE 0 END"
    return (
        unpivot(source, name, outcomes, extra)
        + f""",
{name}_all AS (
  SELECT *, {hx} AS hx, CAST(least(od, death_date, {bound}) AS DATE) AS end_date,
    CAST(least(od, death_date, {bound}) AS DATE) - index_date + 1 AS "time",
    {happened('od')} AS status, {happened('cd')} AS competing
  FROM {name}_rows),
{name} AS MATERIALIZED (SELECT * FROM {name}_all WHERE hx = 0)"""
    )


ACUTE_BOUND = "CAST(index_date + 27 AS DATE)"
ACUTE = censored("ana", "acute", ACUTE_BOUND, False)
OPEN = censored("ana", "follow", STUDY_END, True)

# Weights with the segment as only covariate: cell size over the cell's group size.
SATURATED = """weighted AS MATERIALIZED (
  SELECT *, CAST(count(*) OVER (PARTITION BY segment) AS DOUBLE) / count(*) OVER (PARTITION BY segment, "group") AS weight
  FROM ana)"""
ACUTE_W = censored("weighted", "acute", ACUTE_BOUND, False, extra=", weight")
OPEN_W = censored("weighted", "follow", STUDY_END, True, extra=", weight")

CENSORED = 'subject_id, outcome, CAST(hx AS INTEGER) AS hx, end_date, CAST("time" AS INTEGER) AS "time", status'

ORACLE: dict[str, str] = {}

# Cohort build
ORACLE["cohort_eligible"] = sql('SELECT subject_id, "match", sex, index_date, death_date, age, group_brand, group_dose FROM ana')
ORACLE["index_from"] = sql("SELECT subject_id, index_date FROM person WHERE index_date >= DATE '1998-03-01'")
ORACLE["attrition"] = sql("""SELECT 0 AS step_no, 'all' AS step, count(*) AS n FROM derived
UNION ALL SELECT 1, 'alive_at_index', count(*) FROM derived WHERE death_date IS NULL OR death_date >= index_date
UNION ALL SELECT 2, 'no_prior', count(*) FROM derived WHERE (death_date IS NULL OR death_date >= index_date) AND hx_cv_major = 0
UNION ALL SELECT 3, 'adult', count(*) FROM elig
UNION ALL SELECT 4, 'analysable', count(*) FROM ana""")
ORACLE["normalised_dates"] = sql("SELECT subject_id, CASE WHEN subject_id % 11 <> 0 THEN outcome_death_date END AS outcome_death_date FROM person")
ORACLE["age_scores"] = sql("SELECT subject_id, age, score_cci, score_cci_age FROM derived")
ORACLE["severity_flag"] = sql("SELECT subject_id, severity FROM derived")
ORACLE["dose_sequence"] = sql("SELECT subject_id, dose_seq FROM derived")
ORACLE["days_since_dose"] = sql("""SELECT subject_id, CAST(index_date - last_dose AS INTEGER) AS days_since_dose,
  CAST(index_date - latest_dose AS INTEGER) AS days_since_latest FROM derived""")
ORACLE["exposure_groups"] = sql("""SELECT subject_id, group_brand,
  CAST(list_position(['X', 'B', 'S', 'BB', 'SS', 'BBB', 'SSS'], group_brand) - 1 AS INTEGER) AS group_no FROM derived""")
ORACLE["dose_groups"] = sql('SELECT subject_id, group_dose AS "group" FROM derived')
ORACLE["brand_flags"] = sql("SELECT subject_id, CAST(bnt AS VARCHAR) AS bnt, CAST(sino AS VARCHAR) AS sino FROM derived")
ORACLE["relevel_exposed"] = sql("""SELECT subject_id, 1 AS vaccinated, "group",
  CASE "group" WHEN '1d' THEN 0 WHEN '2d' THEN 1 ELSE 2 END AS group_no FROM ana WHERE "group" <> 'X'""")
for _days in (28, 90):
    ORACLE[f"landmark_{_days}"] = sql(f"""SELECT subject_id, CAST(index_date + {_days} AS DATE) AS index_date, age, group_dose
      FROM elig WHERE death_date IS NULL OR death_date >= index_date + {_days}""")
ORACLE["index_not_after"] = sql("""SELECT subject_id, CAST(index_date + 90 AS DATE) AS index_date FROM elig
  WHERE (death_date IS NULL OR death_date >= index_date + 90) AND index_date + 90 <= DATE '1998-06-30'""")
ORACLE["recent_dose_180"] = sql("""SELECT subject_id, 'acute' AS phase FROM elig
  WHERE group_brand = 'X' OR index_date - last_dose <= 180
UNION ALL SELECT subject_id, 'postacute' FROM elig
  WHERE (death_date IS NULL OR death_date >= index_date + 28)
    AND (group_brand = 'X' OR CAST(index_date + 28 AS DATE) - last_dose <= 180)""")
ORACLE["test_type"] = sql("SELECT subject_id, test_type FROM elig WHERE test_type IN ('HA_241', 'HA_244', 'HA_245', 'PCR')")
_ADDED = " OR ".join(f"(dose{k}_date >= index_date AND dose{k}_date < index_date + 28)" for k in range(1, 6))
_ADDED = f"coalesce({_ADDED}, false)"
ORACLE["dose_in_window"] = sql(f"""SELECT subject_id, 'acute' AS phase FROM elig WHERE {_ADDED}
UNION ALL SELECT subject_id, 'postacute' FROM elig
  WHERE (death_date IS NULL OR death_date >= index_date + 28) AND {_ADDED}""")
ORACLE["dose_in_window_rows"] = sql("""SELECT subject_id FROM elig WHERE EXISTS (SELECT 1 FROM urgent
  WHERE urgent.o_custkey = elig.subject_id AND urgent.d >= index_date AND urgent.d < index_date + 28)""")
ORACLE["exclude_matched_sets"] = sql(f"""SELECT subject_id, "match" FROM ana WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT "match" AS m FROM person WHERE {_ADDED}) e WHERE e.m IS NOT DISTINCT FROM ana."match")""")
ORACLE["exclude_stored_sets"] = sql(f"""SELECT subject_id, "match" FROM ana WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT "match" AS m FROM ana WHERE {_ADDED}) e WHERE e.m IS NOT DISTINCT FROM ana."match")""")
ORACLE["added_dose_flags_stored"] = sql(f"""SELECT subject_id, "match", CAST(max(a) OVER s AS INTEGER) AS added_acute,
  CAST(max(CASE WHEN death_date IS NULL OR death_date >= index_date + 28 THEN a ELSE 0 END) OVER s AS INTEGER) AS added_post
FROM (SELECT *, CASE WHEN {_ADDED} THEN 1 ELSE 0 END AS a FROM ana) WINDOW s AS (PARTITION BY "match")""")
SUBGROUPS = {
    "age.l65": "age < 65", "age.ge65": "age >= 65", "sex.male": "sex = 'M'", "sex.female": "sex = 'F'",
    "cci.l4": "score_cci_age < 4", "cci.ge4": "score_cci_age >= 4", "sev1": "severity = 1", "sev0": "severity = 0",
    "bnt": "\"group\" = 'X' OR bnt = 1", "sino": "\"group\" = 'X' OR sino = 1",
}
ORACLE["subgroup_membership"] = sql(
    " UNION ALL ".join(f"SELECT subject_id, '{n}' AS subgroup FROM ana WHERE {c}" for n, c in SUBGROUPS.items())
)
ORACLE["flags_as_boolean"] = sql("""SELECT subject_id, dx_mi = 1 AS dx_mi, dx_cancer_mets = 1 AS dx_cancer_mets,
  hx_cv_mi = 1 AS hx_cv_mi, infected FROM person""")
ORACLE["unpivot_outcomes"] = sql(
    "SELECT subject_id, 1 AS acute, outcome, hx0 AS hx, od AS outcome_date FROM u_rows",
    "e AS (SELECT *, group_dose AS \"group\" FROM elig)", unpivot("e", "u"),
)

# Censoring
ORACLE["censor_acute"] = sql(f"SELECT {CENSORED} FROM acute", ACUTE)
ORACLE["censor_open"] = sql(f"SELECT {CENSORED} FROM c", censored("post", "c", STUDY_END, True))
ORACLE["censor_interval"] = sql(
    f"SELECT {CENSORED} FROM c", censored("post", "c", f"CAST(index_date + 61 AS DATE), {STUDY_END}", True)
)
ORACLE["censor_landmark_90"] = sql(
    f"SELECT {CENSORED} FROM c", f"l90 AS (SELECT * FROM late WHERE index_date <= {STUDY_END})",
    censored("l90", "c", STUDY_END, True),
)
STATUS_CR = "CASE WHEN status = 1 THEN 1 WHEN competing = 1 THEN 2 ELSE 0 END"
ORACLE["competing_status"] = sql(
    f"SELECT subject_id, outcome, status, competing, {STATUS_CR} AS status_cr FROM c",
    censored("post", "c", STUDY_END, True, OUTCOMES[:-1]),
)

# Rates
ORACLE["event_counts"] = sql(f"""SELECT outcome, "group", count(*) AS n, CAST(sum(status) AS BIGINT) AS events,
  CAST(sum("time") AS BIGINT) AS fu, CAST(sum(sum(status)) OVER (PARTITION BY outcome) AS BIGINT) AS total_events,
  {r6('sum(status) / sum("time")')} AS rate FROM acute GROUP BY outcome, "group\"""", ACUTE)
ORACLE["weighted_event_rates"] = sql(f"""SELECT outcome, "group", {r3('sum(weight * status)')} AS w_events,
  {r3('sum(weight * "time")')} AS pt, {r6('sum(weight * status) / sum(weight * "time")')} AS rate
  FROM acute GROUP BY outcome, "group\"""", SATURATED, ACUTE_W)
ORACLE["time_check"] = sql(
    'SELECT outcome, count(*) AS n, count(*) FILTER (WHERE "time" < 0) AS n_bad FROM c_all GROUP BY outcome',
    'd AS (SELECT *, group_dose AS "group" FROM derived WHERE group_brand IS NOT NULL AND infected = 1)',
    censored("d", "c", ACUTE_BOUND, False),
)
ORACLE["rates"] = sql(f"""SELECT outcome, "group", count(*) AS n, CAST(sum(status) AS BIGINT) AS events,
  CAST(sum("time") AS BIGINT) AS fu, {r3('sum(status)')} AS w_events, {r3('sum("time")')} AS pt,
  {r6('sum(status) / sum("time")')} AS rate FROM follow GROUP BY outcome, "group\"""", OPEN)


def limits(name: str, source: str, events: str, pt: str) -> str:
    """CTEs that bisect for the exact Poisson limits of integer counts: P(X >= x) and P(X <= x) of 0.025."""
    tail = "list_sum([exp(-mid + k * ln(mid) - lgamma(k + 1)) FOR k IN range(0, CAST({n} AS BIGINT))])"
    return f"""{name}_x AS (SELECT DISTINCT CAST({events} AS BIGINT) AS x FROM {source}),
{name}_bis AS (
  SELECT x, 'lo' AS side, 0 AS i, 0.0::DOUBLE AS a, x + 1.0::DOUBLE AS b FROM {name}_x WHERE x > 0
  UNION ALL SELECT x, 'hi', 0, x::DOUBLE, (2 * x + 20)::DOUBLE FROM {name}_x
  UNION ALL
  SELECT x, side, i + 1, CASE WHEN up THEN mid ELSE a END, CASE WHEN up THEN b ELSE mid END FROM (
    SELECT *, CASE side WHEN 'lo' THEN 1 - {tail.format(n='x')} < 0.025 ELSE {tail.format(n='x + 1')} > 0.025 END AS up
    FROM (SELECT *, (a + b) / 2 AS mid FROM {name}_bis WHERE i < 60))),
{name}_lim AS (SELECT x, coalesce(max(a) FILTER (WHERE side = 'lo'), 0) AS lo, max(a) FILTER (WHERE side = 'hi') AS hi
  FROM {name}_bis WHERE i = 60 GROUP BY x)"""


_COUNTS = """counts AS MATERIALIZED (SELECT outcome, "group", count(*) AS n, CAST(sum(status) AS BIGINT) AS events,
  CAST(sum("time") AS BIGINT) AS fu FROM {} GROUP BY outcome, "group")"""
ORACLE["poisson_ci"] = sql(f"""SELECT outcome, "group", n, events, fu, {r6('events / fu')} AS rate,
  {r6('lo / fu')} AS rate_lo, {r6('hi / fu')} AS rate_hi FROM counts JOIN p_lim ON x = events""",
    ACUTE, _COUNTS.format("acute"), limits("p", "counts", "events", "fu"))


# Tables
NUMERIC, FLAGS, TEXTS = ["age", "score_cci"], ["dx_mi", "dx_cancer"], ["sex", "segment"]


def table_rows(source: str, w: str, numeric=NUMERIC, flags=FLAGS, texts=TEXTS) -> str:
    parts = [f"""SELECT "group", 'n' AS variable, NULL AS level, 'size' AS kind, sum({w}) AS n, NULL::DOUBLE AS mean,
      NULL::DOUBLE AS sd, sum({w}) AS count, NULL::DOUBLE AS pct FROM {source} GROUP BY "group\""""]
    for v in numeric:
        mean = f"sum({w} * {v}) / sum({w})"
        spread = f"sum({w} * {v} * {v}) / sum({w}) - ({mean}) * ({mean})"
        parts.append(f"""SELECT "group", '{v}', NULL, 'numeric', sum({w}), {mean},
          CASE WHEN count(*) > 1 THEN sqrt(greatest({spread}, 0) * count(*) / (count(*) - 1)) END, NULL, NULL
          FROM {source} GROUP BY "group\"""")
    for v in flags:
        parts.append(f"""SELECT "group", '{v}', 'TRUE', 'flag', sum({w}), NULL, NULL, sum({w} * {v}),
          100 * sum({w} * {v}) / sum({w}) FROM {source} GROUP BY "group\"""")
    for v in texts:
        parts.append(f"""SELECT "group", '{v}', {v}, 'category', sum(sum({w})) OVER (PARTITION BY "group"), NULL, NULL, sum({w}),
          100 * sum({w}) / sum(sum({w})) OVER (PARTITION BY "group") FROM {source} GROUP BY "group", {v}""")
    return " UNION ALL ".join(parts)


TABLE_OUT = f"""SELECT "group", variable, level, kind, {r3('n')} AS n, {r6('mean')} AS mean, {r6('sd')} AS sd,
  {r3('count')} AS count, {r6('pct')} AS pct FROM"""
ORACLE["baseline_table"] = sql(f"{TABLE_OUT} ({table_rows('ana', '1.0::DOUBLE')})")
ORACLE["baseline_table_weighted"] = sql(f"{TABLE_OUT} ({table_rows('weighted', 'weight')})", SATURATED)
ORACLE["stacked_tables"] = sql(
    f"""SELECT *, 'all' AS table_name FROM ({TABLE_OUT} ({table_rows('ana', '1.0::DOUBLE', ['age'], ['dx_mi'], [])}))
    UNION ALL SELECT *, 'exposed' FROM ({TABLE_OUT} ({table_rows("(SELECT * FROM ana WHERE \"group\" <> 'X')", '1.0::DOUBLE', ['age'], ['dx_mi'], [])}))"""
)

_PLAIN, _WEIGHTED = table_rows("weighted", "1.0::DOUBLE"), table_rows("weighted", "weight")
ORACLE["phase_tables"] = sql(
    " UNION ALL ".join(
        f"""SELECT *, '{name}_{part}' AS table_name FROM ({TABLE_OUT} ({rows})) WHERE {keep}"""
        for name, rows in (("plain", _PLAIN), ("weighted", _WEIGHTED))
        for part, keep in (("all", "true"), ("exposed", "\"group\" <> 'X'"))
    ),
    SATURATED,
)


def _pairs_cte() -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for i, a in enumerate(GROUPS) for b in GROUPS[i + 1 :])
    return f"pairs AS (SELECT * FROM (VALUES {pairs}) AS v(g1, g2))"


# For shares p, q of all levels of a variable (a flag has TRUE and FALSE), the Mahalanobis distance between
# two groups, written out through the 2x2 or k x k closed form.
SMD_CTES = [
    f"tab AS MATERIALIZED ({table_rows('ana', '1.0::DOUBLE')})",
    _pairs_cte(),
    """shares AS (SELECT "group", variable, level, pct / 100 AS p FROM tab WHERE kind IN ('flag', 'category')
      UNION ALL SELECT "group", variable, 'FALSE', 1 - pct / 100 FROM tab WHERE kind = 'flag')""",
    """sides AS (SELECT variable, level, g1, g2, sum(CASE WHEN "group" = g1 THEN p ELSE 0 END) AS p,
      sum(CASE WHEN "group" = g2 THEN p ELSE 0 END) AS q, count(*) FILTER (WHERE "group" = g1) AS c1,
      count(*) FILTER (WHERE "group" = g2) AS c2
      FROM shares JOIN pairs ON "group" IN (g1, g2) GROUP BY variable, level, g1, g2)""",
    """smds AS (
      SELECT variable, avg(s) AS smd FROM (
        SELECT a.variable, CASE WHEN a.sd * a.sd + b.sd * b.sd > 0
            THEN abs(a.mean - b.mean) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2) END AS s
        FROM tab a JOIN tab b ON a.variable = b.variable AND a.kind = 'numeric' AND b.kind = 'numeric'
        JOIN pairs ON a."group" = g1 AND b."group" = g2
        UNION ALL
        SELECT variable, CASE WHEN q4 < 4 THEN sqrt(q4 / (1 - q4 / 4)) END FROM (
          SELECT variable, sum(CASE WHEN p + q > 0 THEN (p - q) * (p - q) / ((p + q) / 2) ELSE 0 END) AS q4
          FROM sides GROUP BY variable, g1, g2 HAVING sum(c1) > 0 AND sum(c2) > 0))
      GROUP BY variable)""",
]
ORACLE["smd"] = sql(f"SELECT variable, {r6('smd')} AS smd FROM smds", *SMD_CTES)
_fixed = lambda x, digits: f"printf('%.{digits}f', round({x} + 1e-9, {digits}))"
_CELL = f"""CASE kind WHEN 'size' THEN {_fixed('count', 0)} WHEN 'numeric' THEN {_fixed('mean', 2)} || ' (' || {_fixed('sd', 2)} || ')'
  ELSE {_fixed('count', 0)} || ' (' || {_fixed('pct', 1)} || ')' END"""
_VARIABLES = ["n", "age", "score_cci", "sex", "segment", "dx_mi", "dx_cancer"]
ORACLE["baseline_export"] = sql(
    f"""SELECT CAST(list_position({_VARIABLES}, variable) AS INTEGER) AS row_order, level,
      coalesce(description, variable) || CASE kind WHEN 'size' THEN '' WHEN 'numeric' THEN ' (mean (SD))'
        WHEN 'flag' THEN ' (%)' ELSE CASE WHEN variable IN (SELECT variable FROM two) THEN ' (%)'
          ELSE ' = ' || level || ' (%)' END END AS "Name",
      {', '.join(f"max(CASE WHEN \"group\" = '{g}' THEN {_CELL} END) AS group_{g}" for g in GROUPS)},
      max({_fixed('smd', 3)}) AS smd
    FROM tab LEFT JOIN smds USING (variable) LEFT JOIN (VALUES ('n', 'n'), ('age', 'Age, years'), ('score_cci', 'Comorbidity score'),
      ('sex', 'Sex'), ('dx_mi', 'Infarction')) AS defs(variable, description) USING (variable)
    WHERE kind <> 'category' OR variable NOT IN (SELECT variable FROM two) OR level IN (SELECT last FROM two WHERE two.variable = tab.variable)
    GROUP BY variable, level, kind, description""",
    *SMD_CTES,
    """two AS (SELECT variable, max(level) AS last FROM tab WHERE kind = 'category' GROUP BY variable
      HAVING count(DISTINCT level) = 2)""",
)


def summary(source: str) -> str:
    return f"""SELECT "group", count(weight) AS n, {r6('min(weight)')} AS w_min, {r6('max(weight)')} AS w_max,
      {r6('avg(weight)')} AS w_mean, {r6('stddev_samp(weight) / avg(weight)')} AS cv,
      {r3('sum(weight) * sum(weight) / sum(weight * weight)')} AS ess FROM {source} GROUP BY "group\""""


ORACLE["weight_summary"] = sql(summary("weighted"), SATURATED)


def balance(out: str, by: str) -> str:
    return f"""SELECT {out} variable, level, kind, {r6('max(un)')} AS max_diff_un, {r6('max(adj)')} AS max_diff_adj FROM (
      SELECT g1, u.variable, u.level, u.kind, abs(u.mean - v.mean) / sqrt((u.sd * u.sd + v.sd * v.sd) / 2) AS un,
        abs(x.mean - y.mean) / sqrt((u.sd * u.sd + v.sd * v.sd) / 2) AS adj
      FROM pairs JOIN before u ON u."group" = g1 AND u.kind = 'numeric' JOIN before v ON v."group" = g2 AND v.variable = u.variable
      JOIN after x ON x."group" = g1 AND x.variable = u.variable JOIN after y ON y."group" = g2 AND y.variable = u.variable
      UNION ALL SELECT g1, variable, level, kind, NULL, NULL FROM before JOIN pairs ON "group" IN (g1, g2) WHERE kind = 'numeric'
      UNION ALL
      SELECT g1, variable, level, kind, abs(sum(CASE WHEN "group" = g1 THEN pu ELSE -pu END)),
        abs(sum(CASE WHEN "group" = g1 THEN pa ELSE -pa END))
      FROM (SELECT b."group", b.variable, b.level, b.kind, b.pct / 100 AS pu, a.pct / 100 AS pa FROM before b JOIN after a
            ON a."group" = b."group" AND a.variable = b.variable AND a.level = b.level WHERE b.kind IN ('flag', 'category'))
      JOIN pairs ON "group" IN (g1, g2) GROUP BY variable, level, kind, g1, g2)
    GROUP BY {by} variable, level, kind"""


ORACLE["balance_table"] = sql(
    balance("", ""), SATURATED, f"before AS MATERIALIZED ({table_rows('weighted', '1.0::DOUBLE')})",
    f"after AS MATERIALIZED ({table_rows('weighted', 'weight')})", _pairs_cte(),
)
ORACLE["balance_distribution"] = sql(
    f"""SELECT "group", bin, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY variable, "group")')} AS share_un,
      {r6('sum(weight) / sum(sum(weight)) OVER (PARTITION BY variable, "group")')} AS share_adj, variable
    FROM (SELECT 'age' AS variable, "group", weight, CAST(least(20, CAST(floor((age - lo) * 20.0 / (hi - lo)) AS BIGINT) + 1) AS VARCHAR) AS bin
      FROM weighted, (SELECT min(age) AS lo, max(age) AS hi FROM weighted)
      UNION ALL SELECT 'segment', "group", weight, segment FROM weighted)
    GROUP BY variable, "group", bin""",
    SATURATED,
)
ORACLE["numeric_summary"] = sql(f"""SELECT 'weight' AS variable, count(weight) AS n, {r6('min(weight)')} AS min,
  {r6('quantile_cont(weight, 0.25)')} AS q1, {r6('quantile_cont(weight, 0.5)')} AS median, {r6('avg(weight)')} AS mean,
  {r6('quantile_cont(weight, 0.75)')} AS q3, {r6('max(weight)')} AS max FROM weighted""", SATURATED)

# Weights
ORACLE["definition_terms"] = """SELECT p_partkey AS id, p_name AS "Name", CAST(p_size % 7 AS INTEGER) AS "Set"
FROM part WHERE p_partkey % 10 <> 0 AND p_name IS NOT NULL AND p_size % 7 <= 4"""
ORACLE["iptw_saturated"] = sql(f'SELECT subject_id, segment, "group", {r6("weight")} AS weight FROM weighted', SATURATED)
# At the maximum of the multinomial likelihood expected and observed sums agree for every covariate.
ORACLE["propensity_scores"] = sql(
    f"""SELECT covariate, {', '.join(f"round(sum(CASE WHEN \"group\" = '{g}' THEN x ELSE 0 END)::DOUBLE + 1e-7, 5) AS expected_{g}" for g in GROUPS)}
    FROM (SELECT "group", 'all' AS covariate, 1 AS x FROM ana UNION ALL SELECT "group", 'segment ' || segment, 1 FROM ana
      UNION ALL SELECT "group", 'sex ' || sex, 1 FROM ana UNION ALL SELECT "group", 'age', age FROM ana
      UNION ALL SELECT "group", 'score_cci', score_cci FROM ana) GROUP BY covariate"""
)

# Survival
CELLS = """cells AS MATERIALIZED (SELECT outcome, "group", "time" AS t, {status} AS status, count(*) AS n,
  sum({w}) AS w, sum({w} * {w}) AS w2 FROM follow {where} GROUP BY ALL)"""
CRUDE_CELLS = CELLS.format(status="status", w="1.0::DOUBLE", where="")
W_CELLS = CELLS.format(status="status", w="weight", where="")
FG_CELLS = CELLS.format(status=STATUS_CR, w="weight", where="WHERE outcome <> 'death'")
DAILY = """daily AS (SELECT outcome, "group", t, sum(CASE WHEN status = 1 THEN n ELSE 0 END) AS n_event,
  sum(CASE WHEN status = 1 THEN w ELSE 0 END) AS w_event, sum(n) AS n_day, sum(w) AS w_day FROM cells GROUP BY ALL),
risk AS MATERIALIZED (SELECT outcome, "group", t, CAST(n_event AS BIGINT) AS n_event, w_event,
  CAST(sum(n_day) OVER onwards AS BIGINT) AS n_risk, sum(w_day) OVER onwards AS w_risk FROM daily
  WINDOW onwards AS (PARTITION BY outcome, "group" ORDER BY t DESC))"""
ORACLE["cox_risk_table"] = sql(f"""SELECT outcome, "group", CAST(t AS INTEGER) AS "time", n_event, {r3('w_event')} AS w_event, n_risk,
  {r3('w_risk')} AS w_risk FROM risk""", SATURATED, OPEN_W, W_CELLS, DAILY)
ORACLE["km_curve"] = sql(
    f"""SELECT outcome, "group", CAST(t AS INTEGER) AS "time", n_event, {r3('w_event')} AS w_event, n_risk, {r3('w_risk')} AS w_risk,
      {r6('surv')} AS surv, CASE WHEN surv > 0 AND surv < 1 THEN {r6('ln(-ln(surv))')} END AS cloglog FROM km""",
    SATURATED, OPEN_W, W_CELLS, DAILY,
    """km AS (SELECT *, CASE WHEN max(CASE WHEN n_event = n_risk THEN 1 ELSE 0 END) OVER so_far = 1 THEN 0
      ELSE product(CASE WHEN n_event = n_risk THEN 1 ELSE 1 - w_event / w_risk END) OVER so_far END AS surv
      FROM risk WHERE n_event > 0 WINDOW so_far AS (PARTITION BY outcome, "group" ORDER BY t))""",
)

# The censoring survival just before each day, events before censorings.
KEEP = """totals AS (SELECT outcome, t, sum(n) AS n, sum(CASE WHEN status = 0 THEN n ELSE 0 END) AS c,
  sum(CASE WHEN status = 1 THEN n ELSE 0 END) AS d FROM cells GROUP BY ALL),
keep AS MATERIALIZED (SELECT outcome, t, d, coalesce(product(CASE WHEN lft > 0 THEN 1 - c / lft ELSE 1 END)
    OVER (PARTITION BY outcome ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g
  FROM (SELECT *, sum(n) OVER (PARTITION BY outcome ORDER BY t DESC) - (n - c) AS lft FROM totals))"""
NO_KEEP = """keep AS MATERIALIZED (SELECT outcome, t, sum(CASE WHEN status = 1 THEN n ELSE 0 END) AS d, 1.0::DOUBLE AS g
  FROM cells GROUP BY ALL)"""
# Risk weight by brute force: everyone still in, plus earlier competing events at their reduced weight.
GRID = """grid AS MATERIALIZED (
  SELECT k.outcome, k.t, k.g, k.d, gr."group",
    coalesce(sum(CASE WHEN c.t >= k.t THEN c.w END), 0) AS w_risk,
    coalesce(sum(CASE WHEN c.t >= k.t THEN c.w WHEN c.status = 2 THEN c.w * k.g / ck.g END), 0) AS fg_risk,
    coalesce(sum(CASE WHEN c.t = k.t AND c.status = 1 THEN c.w END), 0) AS w_event,
    coalesce(sum(CASE WHEN c.t = k.t AND c.status = 1 THEN c.n END), 0) AS n_event
  FROM keep k JOIN (SELECT unnest(['X', '1d', '2d', '3d']) AS "group") gr ON true
  LEFT JOIN cells c ON c.outcome = k.outcome AND c."group" = gr."group"
  LEFT JOIN keep ck ON ck.outcome = c.outcome AND ck.t = c.t
  WHERE k.d > 0 GROUP BY ALL)"""
ORACLE["fine_gray_risk_table"] = sql(
    f"""SELECT outcome, "group", CAST(t AS INTEGER) AS "time", CAST(n_event AS BIGINT) AS n_event, {r3('w_event')} AS w_event,
      {r6('g')} AS g_before, {r3('w_risk')} AS w_risk, {r3('fg_risk')} AS fg_risk FROM grid WHERE fg_risk > 0""",
    SATURATED, OPEN_W, FG_CELLS, KEEP, GRID,
)


# Cox and Fine-Gray by Newton steps in a recursive query, with the row-level sandwich.
# Group k of 0..3 has risk a_k (Efron's l-th reduction), exp(beta_k) r_k, share p_k = r_k a_k / sum.
TIES = """wide AS (SELECT outcome, t, g, d, {risk}, {event} FROM grid GROUP BY outcome, t, g, d),
ties AS MATERIALIZED (SELECT outcome, t, g, d, l / d AS f, (e0 + e1 + e2 + e3) / d AS m, {reduced}
  FROM (SELECT *, unnest(range(0, CAST(d AS BIGINT))) AS l FROM wide)),
had AS (SELECT outcome, {totals} FROM wide GROUP BY outcome)""".format(
    risk=", ".join(f"max(CASE WHEN \"group\" = '{g}' THEN fg_risk END) AS r{k}" for k, g in enumerate(GROUPS)),
    event=", ".join(f"max(CASE WHEN \"group\" = '{g}' THEN w_event END) AS e{k}" for k, g in enumerate(GROUPS)),
    reduced=", ".join(f"r{k} - l / d * e{k} AS a{k}" for k in range(4)),
    totals=", ".join(f"sum(e{k}) AS e{k}" for k in range(4)),
)


def _shares(b: str) -> str:
    """Ratio columns q1..q3 (0 without events), denominator and shares of one tie row at ``b``."""
    q = ", ".join(f"CASE WHEN h.e{k} > 0 THEN exp({b}.b{k}) ELSE 0 END AS q{k}" for k in (1, 2, 3))
    return f"""(SELECT *, q1 * a1 / den AS p1, q2 * a2 / den AS p2, q3 * a3 / den AS p3 FROM (
      SELECT *, a0 + q1 * a1 + q2 * a2 + q3 * a3 AS den FROM (
        SELECT {b}.*, x.t, x.g, x.d, x.f, x.m, x.a0, x.a1, x.a2, x.a3, h.e1, h.e2, h.e3, {q}
        FROM {b} JOIN ties x ON x.outcome = {b}.outcome JOIN had h ON h.outcome = {b}.outcome {{where}})))"""


def _inverse(s: str = "") -> str:
    """Entries of the inverse of the symmetric matrix i11..i33."""
    det = f"({s}i11 * ({s}i22 * {s}i33 - {s}i23 * {s}i23) - {s}i12 * ({s}i12 * {s}i33 - {s}i23 * {s}i13) + {s}i13 * ({s}i12 * {s}i23 - {s}i22 * {s}i13))"
    cof = {
        "v11": f"{s}i22 * {s}i33 - {s}i23 * {s}i23", "v12": f"{s}i13 * {s}i23 - {s}i12 * {s}i33",
        "v13": f"{s}i12 * {s}i23 - {s}i13 * {s}i22", "v22": f"{s}i11 * {s}i33 - {s}i13 * {s}i13",
        "v23": f"{s}i12 * {s}i13 - {s}i11 * {s}i23", "v33": f"{s}i11 * {s}i22 - {s}i12 * {s}i12",
    }
    return ", ".join(f"({c}) / {det} AS {n}" for n, c in cof.items())


_INFO = ", ".join(
    [f"CASE WHEN max(e{k}) > 0 THEN sum(m * (p{k} - p{k} * p{k})) ELSE 1 END AS i{k}{k}" for k in (1, 2, 3)]
    + [f"-sum(m * p{j} * p{k}) AS i{j}{k}" for j, k in ((1, 2), (1, 3), (2, 3))]
)
_SCORE = ", ".join(f"max(e{k}) - sum(m * p{k}) AS u{k}" for k in (1, 2, 3))
# Steps are limited to 1 per iteration, so that few events do not make them overshoot.
NEWTON = f"""newton AS (
  SELECT outcome, 0 AS i, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM had
  UNION ALL
  SELECT outcome, i + 1, b1 + greatest(-1, least(1, v11 * u1 + v12 * u2 + v13 * u3)),
    b2 + greatest(-1, least(1, v12 * u1 + v22 * u2 + v23 * u3)), b3 + greatest(-1, least(1, v13 * u1 + v23 * u2 + v33 * u3))
  FROM (SELECT *, {_inverse()} FROM (
    SELECT outcome, i, b1, b2, b3, {_SCORE}, {_INFO} FROM {_shares('newton').format(where='WHERE newton.i < 22')}
    GROUP BY outcome, i, b1, b2, b3))),
fitted AS MATERIALIZED (SELECT outcome, b1, b2, b3 FROM newton WHERE i = 22),
at_fit AS MATERIALIZED (SELECT * FROM {_shares('fitted').format(where='')}),
info AS MATERIALIZED (SELECT *, {_inverse()} FROM (SELECT outcome, max(b1) AS b1, max(b2) AS b2, max(b3) AS b3,
  max(e1) AS e1, max(e2) AS e2, max(e3) AS e3, {_INFO} FROM at_fit GROUP BY outcome))"""

# Per event day: hazard mass c0 and its share-weighted parts, also with Efron's reduction for those who die that day.
_DAYS = f"""days AS (SELECT outcome, t, max(g) AS g, sum(m / den) AS s, sum(m * (1 - f) / den) AS so,
  {', '.join(f'sum(m * p{k} / den) AS s{k}, sum(m * (1 - f) * p{k} / den) AS so{k}, sum(p{k} / d) AS share{k}' for k in (1, 2, 3))}
  FROM at_fit GROUP BY outcome, t)"""


def _influence(k: int) -> str:
    """Score residual for group k of a cell; z is its own risk ratio, own is 1 if the cell is of group k."""
    own = f"CASE WHEN \"group\" = '{GROUPS[k]}' THEN 1 ELSE 0 END"
    event = f"CASE WHEN status = 1 THEN ({own}) - share{k} ELSE 0 END"
    through = f"({own}) * s_all - s{k}_all"
    tail = f"CASE WHEN status = 2 THEN (({own}) * s_tail - s{k}_tail) / g0 ELSE 0 END"
    return f"{event} - z * ({through} + {tail})"


SANDWICH = f"""{_DAYS},
residual AS (
  SELECT c.outcome, c."group", c.t, c.status, max(c.n) AS n, max(c.w2) AS w2, max(k0.g) AS g0,
    CASE c."group" WHEN 'X' THEN 1 WHEN '1d' THEN max(CASE WHEN fi.e1 > 0 THEN exp(fi.b1) ELSE 0 END)
      WHEN '2d' THEN max(CASE WHEN fi.e2 > 0 THEN exp(fi.b2) ELSE 0 END) ELSE max(CASE WHEN fi.e3 > 0 THEN exp(fi.b3) ELSE 0 END) END AS z,
    coalesce(sum(CASE WHEN y.t < c.t OR (y.t = c.t AND c.status <> 1) THEN s WHEN y.t = c.t THEN so END), 0) AS s_all,
    coalesce(sum(CASE WHEN y.t > c.t THEN y.g * s END), 0) AS s_tail,
    {', '.join(f"coalesce(sum(CASE WHEN y.t < c.t OR (y.t = c.t AND c.status <> 1) THEN s{k} WHEN y.t = c.t THEN so{k} END), 0) AS s{k}_all, coalesce(sum(CASE WHEN y.t > c.t THEN y.g * s{k} END), 0) AS s{k}_tail, coalesce(max(CASE WHEN y.t = c.t THEN share{k} END), 0) AS share{k}" for k in (1, 2, 3))}
  FROM cells c JOIN info fi ON fi.outcome = c.outcome JOIN keep k0 ON k0.outcome = c.outcome AND k0.t = c.t
  LEFT JOIN days y ON y.outcome = c.outcome
  GROUP BY c.outcome, c."group", c.t, c.status),
influence AS (SELECT outcome, n, w2, {', '.join(f'{_influence(k)} AS z{k}' for k in (1, 2, 3))} FROM residual),
robust AS (SELECT f.outcome, {', '.join(
    f"sqrt(sum(n) / (sum(n) - 1) * sum(w2 * pow(" + ' + '.join(f"v{min(k, j)}{max(k, j)} * z{j}" for j in (1, 2, 3)) + f", 2))) AS se{k}" for k in (1, 2, 3))}
  FROM influence JOIN info f ON f.outcome = influence.outcome GROUP BY f.outcome)"""


def _hr_rows(se: str, source: str) -> str:
    z = "1.959963984540054"
    parts = [f"SELECT outcome, 'X' AS \"group\", NULL::DOUBLE AS b, NULL::DOUBLE AS se FROM info"]
    for k in (1, 2, 3):
        parts.append(f"""SELECT outcome, '{GROUPS[k]}', CASE WHEN had.e0 = 0 THEN NULL WHEN info.e{k} = 0 OR b{k} < -15 THEN -'inf'::DOUBLE
            WHEN b{k} > 15 THEN 'inf'::DOUBLE ELSE b{k} END,
          CASE WHEN had.e0 > 0 AND info.e{k} > 0 AND abs(b{k}) <= 15 THEN {se.format(k=k)} END FROM {source} JOIN had USING (outcome)
          WHERE (outcome, '{GROUPS[k]}') IN (SELECT (outcome, "group") FROM cells)""")
    return f"""hr AS (SELECT outcome, "group", b AS log_hr, se, exp(b) AS hr, exp(b - {z} * se) AS hr_lo,
      exp(b + {z} * se) AS hr_hi FROM ({' UNION ALL '.join(parts)}))"""


MODEL_SE = _hr_rows("sqrt(v{k}{k})", "info")
ROBUST_SE = _hr_rows("se{k}", "info JOIN robust USING (outcome)")
HR_OUT = ", ".join(f"{r6(c)} AS {c}" for c in ("log_hr", "se", "hr", "hr_lo", "hr_hi"))
CRUDE_FIT = [OPEN, CRUDE_CELLS, NO_KEEP, GRID, TIES, NEWTON]
WEIGHTED_FIT = [SATURATED, OPEN_W, W_CELLS, NO_KEEP, GRID, TIES, NEWTON]
FG_FIT = [SATURATED, OPEN_W, FG_CELLS, KEEP, GRID, TIES, NEWTON]
ORACLE["cox_crude"] = sql(f'SELECT outcome, "group", {HR_OUT} FROM hr', *CRUDE_FIT, MODEL_SE)
ORACLE["cox_weighted"] = sql(f'SELECT outcome, "group", {HR_OUT} FROM hr', *WEIGHTED_FIT, SANDWICH, ROBUST_SE)
ORACLE["fine_gray"] = sql(f'SELECT outcome, "group", {HR_OUT} FROM hr', *FG_FIT, SANDWICH, ROBUST_SE)
ORACLE["cox_score_test"] = sql(
    " UNION ALL ".join(
        f"""SELECT outcome, '{GROUPS[j]}' AS "group", '{GROUPS[k]}' AS group2, {r6(f'sum_e{j} - sum(m * p{j})')} AS score,
          {r6(f'sum(m * ({f"p{j}" if j == k else "0"} - p{j} * p{k}))')} AS info
          FROM null_fit WHERE EXISTS (SELECT 1 FROM cells c WHERE c.outcome = null_fit.outcome AND c."group" = '{GROUPS[j]}')
            AND EXISTS (SELECT 1 FROM cells c WHERE c.outcome = null_fit.outcome AND c."group" = '{GROUPS[k]}')
          GROUP BY outcome, sum_e{j}"""
        for j in (1, 2, 3) for k in (1, 2, 3)
    ),
    OPEN, CRUDE_CELLS, NO_KEEP, GRID, TIES,
    """null_fit AS MATERIALIZED (SELECT ties.outcome, m, a1 / (a0 + a1 + a2 + a3) AS p1, a2 / (a0 + a1 + a2 + a3) AS p2,
      a3 / (a0 + a1 + a2 + a3) AS p3, had.e1 AS sum_e1, had.e2 AS sum_e2, had.e3 AS sum_e3 FROM ties JOIN had ON had.outcome = ties.outcome)""",
)
ORACLE["result_table_crude"] = sql(
    f"""SELECT c.outcome, c."group", n, events, fu, {r3('events::DOUBLE')} AS w_events, {r3('fu::DOUBLE')} AS pt, {r6('events / fu')} AS rate,
      {r6('lo / fu')} AS rate_lo, {r6('hi / fu')} AS rate_hi, {HR_OUT}
    FROM counts c JOIN p_lim ON x = events LEFT JOIN hr ON hr.outcome = c.outcome AND hr."group" = c."group\"""",
    *CRUDE_FIT, MODEL_SE, _COUNTS.format("follow"), limits("p", "counts", "events", "fu"),
)

# Every variant: (variant, phase, stage source, filter, bound, prior, outcomes, weight partition)
MAIN = ["cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_mi", "cv_death", "death"]
NO_MI = [o for o in MAIN if o != "cv_mi"]
ACS = ["cv_major", "cv_stroke", "cv_cad", "cv_hf", "cv_acs", "cv_death", "death"]
SUB = ["cv_stroke", "cv_cad", "cv_hf", "cv_death"]
CR = NO_MI[:-1]


def _analysis() -> tuple[list[str], str]:
    recent = "(group_brand = 'X' OR index_date - last_dose <= 180)"
    bounds = {"acute": (ACUTE_BOUND, False), "postacute": (STUDY_END, True), "postacute90d": (STUDY_END, True)}
    stages = {
        "s_acute": "ana", "s_post": "post", "s_late": "late", "s_acute_pcr": "(SELECT * FROM ana WHERE test_type = 'PCR')",
        "s_post_pcr": "(SELECT * FROM post WHERE test_type = 'PCR')", "s_acute_180": f"(SELECT * FROM ana WHERE {recent})",
        "s_post_180": f"(SELECT * FROM post WHERE {recent})",
    }
    ctes = [
        f"""{n} AS MATERIALIZED (SELECT *, 'all' AS subgroup, CAST(count(*) OVER (PARTITION BY segment) AS DOUBLE)
          / count(*) OVER (PARTITION BY segment, "group") AS weight FROM {src} q)"""
        for n, src in stages.items()
    ]
    for n, src in (("s_acute_sub", "ana"), ("s_post_sub", "post")):
        member = " UNION ALL ".join(f"SELECT *, '{s}' AS subgroup FROM {src} WHERE {c}" for s, c in SUBGROUPS.items())
        ctes.append(f"""{n} AS MATERIALIZED (SELECT *, CAST(count(*) OVER (PARTITION BY subgroup, segment) AS DOUBLE)
          / count(*) OVER (PARTITION BY subgroup, segment, "group") AS weight FROM ({member}) q)""")
    back = _ADDED.replace("index_date + 28", "index_date").replace(">= index_date", ">= index_date - 28")
    no_dose = lambda src, cond: f"""(SELECT * FROM {src} a WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT DISTINCT "match" AS m FROM {src} WHERE {cond}) e WHERE e.m IS NOT DISTINCT FROM a."match"))"""
    variants = [
        ("main", "acute", "s_acute", ["cv_major"]),
        ("main", "postacute", no_dose("s_post", back), MAIN),
        ("with_added_dose", "postacute", "s_post", MAIN),
        ("days_28_89", "postacute", "s_post", NO_MI),
        ("day_90_on", "postacute90d", f"(SELECT * FROM s_late WHERE index_date <= {STUDY_END})", NO_MI),
        ("pcr", "acute", "s_acute_pcr", MAIN), ("pcr", "postacute", "s_post_pcr", MAIN),
        ("recent_180", "acute", "s_acute_180", ACS), ("recent_180", "postacute", "s_post_180", ACS),
        ("no_added_dose", "acute", no_dose("s_acute", _ADDED), MAIN),
        ("no_added_dose", "postacute", no_dose("s_post", back), MAIN),
        ("subgroup", "acute", "s_acute_sub", SUB), ("subgroup", "postacute", "s_post_sub", SUB),
        ("competing", "acute", "s_acute", CR), ("competing", "postacute", "s_post", CR),
    ]
    parts = []
    for i, (variant, phase, source, outcomes) in enumerate(variants):
        bound, prior = bounds[phase]
        if variant == "days_28_89":
            bound = f"CAST(index_date + 61 AS DATE), {STUDY_END}"
        ctes.append(f"v{i} AS (SELECT * FROM {source} q)")
        ctes.append(censored(f"v{i}", f"c{i}", bound, prior, outcomes, extra=", subgroup, weight"))
        model = STATUS_CR if variant == "competing" else "status"
        parts.append(f"""SELECT '{variant}' AS variant, '{phase}' AS phase, subgroup, outcome, "group", "time", status,
          {model} AS model_status, weight FROM c{i}""")
    return ctes, " UNION ALL ".join(parts)


_ctes, _rows = _analysis()
ORACLE["analysis_counts"] = sql(
    f"""SELECT variant, subgroup, phase, outcome, "group", count(*) AS n, CAST(sum(status) AS BIGINT) AS events,
      {r3('sum(weight * status)')} AS w_events, {r3('sum(weight * "time")')} AS pt
    FROM ({_rows}) GROUP BY ALL""",
    *_ctes,
)

# The full result of every variant: the same fits, keyed by variant, subgroup, phase and outcome together.
_KEYED = f"""keyed AS MATERIALIZED (SELECT concat_ws('|', variant, subgroup, phase, outcome) AS outcome, "group", "time", status,
  model_status, weight FROM ({_rows}))"""
_KEYED_CELLS = """cells AS MATERIALIZED (SELECT outcome, "group", "time" AS t, model_status AS status, count(*) AS n,
  sum(weight) AS w, sum(weight * weight) AS w2 FROM keyed GROUP BY ALL)"""
_KEYED_COUNTS = """counts AS MATERIALIZED (SELECT outcome, "group", count(*) AS n, CAST(sum(status) AS BIGINT) AS events,
  sum(weight * status) AS w_events, sum(weight * "time") AS pt FROM keyed GROUP BY outcome, "group")"""


def gamma_limits(name: str, source: str, events: str) -> str:
    """CTEs that bisect for the limits of weighted counts: P(x, lo) = 0.025 and P(x + 1, hi) = 0.975, P by its series."""
    series = "list_sum([exp(-mid + (a + k) * ln(mid) - lgamma(a + k + 1)) FOR k IN range(0, CAST(16 * sqrt(a + 1) + 80 AS BIGINT))])"
    return f"""{name}_bis AS (
  SELECT x, 'lo' AS side, x AS a, 0.025 AS goal, 0 AS i, 0.0::DOUBLE AS l, x + 1.0::DOUBLE AS h
  FROM (SELECT DISTINCT {events} AS x FROM {source}) WHERE x > 0
  UNION ALL SELECT x, 'hi', x + 1, 0.975, 0, x, x + 6 * sqrt(x + 1) + 20 FROM (SELECT DISTINCT {events} AS x FROM {source})
  UNION ALL
  SELECT x, side, a, goal, i + 1, CASE WHEN up THEN mid ELSE l END, CASE WHEN up THEN h ELSE mid END FROM (
    SELECT *, {series} < goal AS up FROM (SELECT *, (l + h) / 2 AS mid FROM {name}_bis WHERE i < 56))),
{name}_lim AS (SELECT x, coalesce(max(l) FILTER (WHERE side = 'lo'), 0) AS lo, max(l) FILTER (WHERE side = 'hi') AS hi
  FROM {name}_bis WHERE i = 56 GROUP BY x)"""


ORACLE["analysis_grid_saturated"] = sql(
    f"""SELECT split_part(c.outcome, '|', 1) AS variant, split_part(c.outcome, '|', 2) AS subgroup,
      split_part(c.outcome, '|', 3) AS phase, split_part(c.outcome, '|', 4) AS outcome, c."group", n, events,
      {r3('w_events')} AS w_events, {r3('pt')} AS pt, {r6('w_events / pt')} AS rate, {r6('lo / pt')} AS rate_lo,
      {r6('hi / pt')} AS rate_hi, {HR_OUT}, CAST(0 AS BIGINT) AS n_missing
    FROM counts c JOIN p_lim ON x = w_events LEFT JOIN hr ON hr.outcome = c.outcome AND hr."group" = c."group\"""",
    *_ctes, _KEYED, _KEYED_CELLS, _KEYED_COUNTS, gamma_limits("p", "counts", "w_events"), KEEP, GRID, TIES, NEWTON,
    SANDWICH, ROBUST_SE,
)

ORACLE["cox_curve"] = sql(
    " UNION ALL ".join(
        f"""SELECT outcome, '{g}' AS "group", CAST(t AS INTEGER) AS "time", {r6('cum * z')} AS cum_hazard, {r6('exp(-cum * z)')} AS surv,
          CASE WHEN cum * z > 0 THEN {r6('ln(cum * z)')} END AS cloglog
          FROM (SELECT days.outcome, t, sum(s) OVER (PARTITION BY days.outcome ORDER BY t) AS cum,
                  {'1' if k == 0 else f'CASE WHEN e{k} > 0 THEN exp(b{k}) ELSE 0 END'} AS z
                FROM days JOIN info ON info.outcome = days.outcome) c
          WHERE EXISTS (SELECT 1 FROM cells x WHERE x.outcome = c.outcome AND x."group" = '{g}')"""
        for k, g in enumerate(GROUPS)
    ),
    *WEIGHTED_FIT, _DAYS,
)


# Proportional hazards: score test of a slope on g(t) = 1 - S(t-), S being the unweighted survival of all.
def _sym(j: int, k: int) -> str:
    return f"{min(j, k)}{max(j, k)}"


_PAIRS3 = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
_MOMENTS = ", ".join(
    f"sum({g} * m * ({f'p{j}' if j == k else '0'} - p{j} * p{k})) AS {name}{j}{k}"
    for name, g in (("m", "gt"), ("n", "gt * gt")) for j, k in _PAIRS3
)
_V = ", ".join(
    f"n{j}{k} - (" + " + ".join(f"m{_sym(j, a)} * v{_sym(a, b)} * m{_sym(b, k)}" for a in (1, 2, 3) for b in (1, 2, 3)) + f") AS c{j}{k}"
    for j, k in _PAIRS3
)
PH = f"""km AS (SELECT outcome, t, d, sum(d_all) OVER (PARTITION BY outcome ORDER BY t DESC) AS n_risk FROM (
    SELECT outcome, t, sum(CASE WHEN status = 1 THEN n ELSE 0 END) AS d, sum(n) AS d_all FROM cells GROUP BY ALL)),
slope AS (SELECT outcome, t, 1 - coalesce(product(1 - d / n_risk) OVER (PARTITION BY outcome ORDER BY t
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS gt FROM km),
observed AS (SELECT w.outcome, {', '.join(f'sum(gt * w.e{k}) AS o{k}' for k in (1, 2, 3))}
  FROM wide w JOIN slope ON slope.outcome = w.outcome AND slope.t = w.t GROUP BY w.outcome),
moments AS (SELECT a.outcome, {', '.join(f'sum(gt * m * p{k}) AS x{k}' for k in (1, 2, 3))}, {_MOMENTS}
  FROM at_fit a JOIN slope ON slope.outcome = a.outcome AND slope.t = a.t GROUP BY a.outcome),
tests AS (SELECT outcome, scale, {', '.join(f'o{k} - x{k} AS u{k}' for k in (1, 2, 3))}, {', '.join(f'e{k} > 0 AS has{k}' for k in (1, 2, 3))}, {_V}
  FROM moments JOIN observed USING (outcome) JOIN info USING (outcome)
  JOIN (SELECT outcome, sum(n) / sum(w) AS scale FROM cells GROUP BY outcome) USING (outcome)),
inverted AS (SELECT *, {_inverse()} FROM (SELECT * EXCLUDE (c11, c22, c33), c11, c22, c33,
  {', '.join(f'CASE WHEN has{k} THEN c{k}{k} ELSE 1 END AS i{k}{k}' for k in (1, 2, 3))}, c12 AS i12, c13 AS i13, c23 AS i23 FROM tests)),
chi AS (
  {' UNION ALL '.join(f"SELECT outcome, '{GROUPS[k]}' AS term, scale * u{k} * u{k} / c{k}{k} AS chisq, 1 AS df FROM tests WHERE has{k}" for k in (1, 2, 3))}
  UNION ALL SELECT outcome, 'GLOBAL', scale * ({' + '.join(f'u{a} * v{_sym(a, b)} * u{b}' for a in (1, 2, 3) for b in (1, 2, 3))}),
    {' + '.join(f'CAST(has{k} AS INTEGER)' for k in (1, 2, 3))} FROM inverted)"""
ORACLE["ph_test"] = sql(
    f"""SELECT outcome, term, {r6('chisq')} AS chisq, CAST(df AS INTEGER) AS df, {r6(
        "1 - list_sum([exp(-chisq / 2 + (df / 2 + k) * ln(chisq / 2) - lgamma(df / 2 + k + 1)) FOR k IN range(0, 400)])")} AS p FROM chi""",
    *WEIGHTED_FIT, PH,
)

# The same analyses without weights, and their proportional-hazards tests, but for the competing model.
_NAMES = """split_part({c}outcome, '|', 1) AS variant, split_part({c}outcome, '|', 2) AS subgroup,
  split_part({c}outcome, '|', 3) AS phase, split_part({c}outcome, '|', 4) AS outcome"""
_PLAIN = """cells AS MATERIALIZED (SELECT outcome, "group", "time" AS t, status, count(*) AS n, {w} AS w, {w2} AS w2
  FROM keyed WHERE outcome NOT LIKE 'competing|%' GROUP BY ALL)"""
ORACLE["analysis_crude_saturated"] = sql(
    f"""SELECT {_NAMES.format(c='c.')}, c."group", {', '.join(f'{r6(c)} AS crude_{c}' for c in ('log_hr', 'se', 'hr', 'hr_lo', 'hr_hi'))}
    FROM (SELECT DISTINCT outcome, "group" FROM cells) c LEFT JOIN hr ON hr.outcome = c.outcome AND hr."group" = c."group\"""",
    *_ctes, _KEYED, _PLAIN.format(w="count(*)::DOUBLE", w2="count(*)::DOUBLE"), NO_KEEP, GRID, TIES, NEWTON, MODEL_SE,
)
ORACLE["analysis_ph_saturated"] = sql(
    f"""SELECT {_NAMES.format(c='')}, term, {r6('chisq')} AS chisq, CAST(df AS INTEGER) AS df, {r6(
        "1 - list_sum([exp(-chisq / 2 + (df / 2 + k) * ln(chisq / 2) - lgamma(df / 2 + k + 1)) FOR k IN range(0, 400)])")} AS p FROM chi
    WHERE outcome IN (SELECT outcome FROM had WHERE e0 > 0) AND df > 0
      AND outcome NOT IN (SELECT outcome FROM hr WHERE abs(log_hr) = 'inf'::DOUBLE)""",
    *_ctes, _KEYED, _PLAIN.format(w="sum(weight)", w2="sum(weight * weight)"), NO_KEEP, GRID, TIES, NEWTON, MODEL_SE, PH,
)

# Every fifth subject without the covariate.
ORACLE["analysis_missing_covariate"] = sql(
    f"""SELECT c.outcome, c."group", n, events, n_missing, {r3('w_events')} AS w_events, {r3('pt')} AS pt,
      {r6('w_events / nullif(pt, 0)')} AS rate, {r6('lo / nullif(pt, 0)')} AS rate_lo, {r6('hi / nullif(pt, 0)')} AS rate_hi, {HR_OUT}
    FROM counts c JOIN p_lim ON x = w_events LEFT JOIN hr ON hr.outcome = c.outcome AND hr."group" = c."group\"""",
    """partly AS MATERIALIZED (SELECT * EXCLUDE (segment), CASE WHEN subject_id % 5 <> 0 THEN segment END AS segment FROM ana)""",
    """partly_w AS MATERIALIZED (SELECT *, CASE WHEN segment IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY segment) AS DOUBLE)
      / count(*) OVER (PARTITION BY segment, "group") END AS weight FROM partly)""",
    censored("partly_w", "follow", ACUTE_BOUND, False, MAIN, extra=", weight"),
    CELLS.format(status="status", w="weight", where="WHERE weight IS NOT NULL"),
    """counts AS MATERIALIZED (SELECT outcome, "group", count(weight) AS n,
      CAST(sum(CASE WHEN weight IS NOT NULL THEN status ELSE 0 END) AS BIGINT) AS events, count(*) - count(weight) AS n_missing,
      coalesce(sum(weight * status), 0) AS w_events, coalesce(sum(weight * "time"), 0) AS pt FROM follow GROUP BY outcome, "group")""",
    gamma_limits("p", "counts", "w_events"), NO_KEEP, GRID, TIES, NEWTON, SANDWICH, ROBUST_SE,
)

# Files: what was written is what is read back.
ORACLE["read_cohort"] = sql("""SELECT subject_id, index_date, sex, birth_year, hx_cv_major, outcome_death_date, segment
FROM person WHERE index_date >= DATE '1998-03-01'""")
ORACLE["stage_round_trip"] = sql("""SELECT subject_id, "group", age, 'ge65' AS subgroup FROM ana WHERE age >= 65
UNION ALL SELECT subject_id, "group", age, 'l65' FROM ana WHERE age < 65""")
ORACLE["definitions_round_trip"] = """SELECT p_name AS "Name", CAST(p_size % 7 AS INTEGER) AS "Set" FROM part"""
ORACLE["tables_round_trip"] = """SELECT 'first' AS table_name, n_nationkey AS id, n_name AS name FROM nation
UNION ALL SELECT 'second', r_regionkey, r_name FROM region"""
ORACLE["report_round_trip"] = sql("""SELECT outcome, "group", count(*) AS n, CAST(sum(status) AS BIGINT) AS events,
CAST(sum("time") AS BIGINT) AS fu FROM acute GROUP BY outcome, "group\"""", ACUTE)
ORACLE["propensity_terms"] = """SELECT p_name AS name, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS place
FROM part WHERE p_partkey % 10 <> 0 AND p_size % 7 <= 4"""
ORACLE["level_order"] = sql("""SELECT outcome, "group", CAST(row_number() OVER (
  ORDER BY outcome, list_position(['X', '1d', '2d', '3d'], "group")) - 1 AS INTEGER) AS row_no
FROM (SELECT DISTINCT outcome, "group" FROM acute)""", ACUTE)
ORACLE["ps_assess"] = ORACLE["balance_table"]

# Every fit: the stages of the analyses, a group of a fit is named stage#group.
_FITS = {"s_acute": "acute", "s_post": "postacute", "s_late": "postacute90d", "s_acute_pcr": "acute_pcr",
         "s_post_pcr": "postacute_pcr", "s_acute_180": "acute_180", "s_post_180": "postacute_180",
         "s_acute_sub": "acute_sub", "s_post_sub": "postacute_sub"}
_COLUMNS = ", ".join([*NUMERIC, *FLAGS, *TEXTS])
_STAGES = [c for c in _ctes if c.split(" ")[0] in _FITS] + [
    "fits AS MATERIALIZED (" + " UNION ALL ".join(
        f"""SELECT '{name}|' || subgroup AS stage, "group" AS plain, '{name}|' || subgroup || '#' || "group" AS "group", weight, {_COLUMNS}
        FROM {source}""" for source, name in _FITS.items()) + ")"
]
ORACLE["balance_by_fit"] = sql(
    balance("split_part(g1, '#', 1) AS stage,", "split_part(g1, '#', 1),"), *_STAGES,
    f"before AS MATERIALIZED ({table_rows('fits', '1.0::DOUBLE')})", f"after AS MATERIALIZED ({table_rows('fits', 'weight')})",
    _pairs_cte().replace("pairs AS", "plain_pairs AS"),
    """pairs AS (SELECT stage || '#' || g1 AS g1, stage || '#' || g2 AS g2 FROM plain_pairs, (SELECT DISTINCT stage FROM fits))""",
)
_BIN = """CASE WHEN lo = hi THEN '1' ELSE
  CAST(least(20, CAST(floor((x - lo) * 20.0 / (hi - lo)) AS BIGINT) + 1) AS VARCHAR) END"""
ORACLE["distribution_by_fit"] = sql(
    f"""SELECT stage, variable, "group", bin, count(*) AS n,
      {r6('count(*) / sum(count(*)) OVER (PARTITION BY stage, variable, "group")')} AS share_un,
      {r6('sum(weight) / sum(sum(weight)) OVER (PARTITION BY stage, variable, "group")')} AS share_adj
    FROM (SELECT stage, variable, "group", weight, {_BIN} AS bin FROM (
        SELECT *, min(x) OVER (PARTITION BY stage, variable) AS lo, max(x) OVER (PARTITION BY stage, variable) AS hi FROM ("""
    + " UNION ALL ".join(f"SELECT stage, '{v}' AS variable, plain AS \"group\", weight, {v} AS x FROM fits" for v in NUMERIC)
    + ")) UNION ALL "
    + " UNION ALL ".join(f"SELECT stage, '{v}', plain, weight, {v} FROM fits" for v in TEXTS)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT stage, '{v}', plain, weight, CASE WHEN {v} = 1 THEN 'true' ELSE 'false' END FROM fits" for v in FLAGS)
    + """) GROUP BY stage, variable, "group", bin""",
    *_STAGES,
)
ORACLE["weights_by_fit"] = sql(f"""SELECT stage, 'weight' AS variable, count(weight) AS n, {r6('min(weight)')} AS min,
  {r6('quantile_cont(weight, 0.25)')} AS q1, {r6('quantile_cont(weight, 0.5)')} AS median, {r6('avg(weight)')} AS mean,
  {r6('quantile_cont(weight, 0.75)')} AS q3, {r6('max(weight)')} AS max FROM fits GROUP BY stage""", *_STAGES)
ORACLE["propensity_wide"] = sql(f"""SELECT subject_id, CAST("match" AS VARCHAR) AS household, "group",
  {r6('CAST(count(*) OVER (PARTITION BY "match") AS DOUBLE) / count(*) OVER (PARTITION BY "match", "group")')} AS weight
FROM ana WHERE "match" IS NOT NULL""")
ORACLE["ordered_report"] = sql("""SELECT outcome, "group", count(*) AS n, CAST(sum(status) AS BIGINT) AS events,
  CAST(sum("time") AS BIGINT) AS fu,
  row_number() OVER (ORDER BY outcome, list_position(['X', '1d', '2d', '3d'], "group")) - 1 AS place
FROM acute GROUP BY outcome, "group\"""", ACUTE)
ORACLE["kept_stages"] = sql('SELECT "group", count(*) AS "count", count(*) AS again FROM ana GROUP BY "group"')

# The multinomial fit with several covariates: ascent with a fixed bound of the information (twice the inverse Gram
# matrix, mixed over the groups), which needs no matrix of the fit itself. x is the row of the design.
_WIDTH, _STEPS = 8, 4000
_PLACES = f"range(1, {_WIDTH + 1})"
_ETA = ", ".join(f"exp(list_dot_product(x, b{k})) AS r{k}" for k in (1, 2, 3))
_UPHILL = ", ".join(
    "[" + ", ".join(f"sum(x[{i}] * (n{k} + n1 + n2 + n3 - n * (r{k} + r1 + r2 + r3) / (1 + r1 + r2 + r3)))" for i in range(1, _WIDTH + 1)) + f"] AS u{k}"
    for k in (1, 2, 3)
)
MULTINOMIAL = f"""design AS MATERIALIZED (SELECT *, [1.0::DOUBLE, (age - avg(age) OVER ()) / stddev_pop(age) OVER (),
    (score_cci - avg(score_cci) OVER ()) / stddev_pop(score_cci) OVER (), CASE WHEN sex = 'M' THEN 1 ELSE 0 END]
    || [CASE WHEN segment = s THEN 1.0::DOUBLE ELSE 0 END FOR s IN (SELECT list(DISTINCT segment ORDER BY segment)[2:] FROM ana)] AS x
  FROM ana),
patterns AS MATERIALIZED (SELECT x, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE \"group\" = '{GROUPS[k]}') AS n{k}" for k in (1, 2, 3))}
  FROM design GROUP BY x),
gram AS MATERIALIZED (SELECT list(row_i ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS row_i FROM (
    SELECT i, j, sum(n * x[i] * x[j]) AS v FROM patterns, range(1, {_WIDTH + 1}) a(i), range(1, {_WIDTH + 1}) b(j) GROUP BY i, j)
  GROUP BY i)),
inverted_gram AS (SELECT 1 AS k, m FROM gram UNION ALL
  SELECT k + 1, [[CASE WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN -m[i][k] / m[k][k]
    ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END FOR j IN {_PLACES}] FOR i IN {_PLACES}]
  FROM inverted_gram WHERE k <= {_WIDTH}),
bound AS MATERIALIZED (SELECT m FROM inverted_gram WHERE k = {_WIDTH + 1}),
ascent AS (SELECT 0 AS step, {', '.join(f'[0.0::DOUBLE FOR i IN {_PLACES}] AS b{k}' for k in (1, 2, 3))}
  UNION ALL
  SELECT step + 1, {', '.join(f'[b{k}[i] + 2 * list_dot_product(m[i], u{k}) FOR i IN {_PLACES}] AS b{k}' for k in (1, 2, 3))}
  FROM (SELECT step, any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, any_value(m) AS m, {_UPHILL}
    FROM (SELECT step, b1, b2, b3, m, x, n, n1, n2, n3, {_ETA} FROM ascent, patterns, bound WHERE step < {_STEPS}) GROUP BY step)),
multinomial AS MATERIALIZED (SELECT *, (1 + r1 + r2 + r3) / CASE "group" WHEN 'X' THEN 1 WHEN '1d' THEN r1 WHEN '2d' THEN r2 ELSE r3 END AS weight
  FROM (SELECT d.*, {_ETA} FROM design d, ascent WHERE step = {_STEPS}))"""
ORACLE["propensity_multinomial"] = sql(summary("multinomial"), MULTINOMIAL)
ORACLE["analysis_multinomial"] = sql(
    f"""SELECT c.outcome, c."group", n, events, {r3('w_events')} AS w_events, {r3('pt')} AS pt,
      {r6('w_events / pt')} AS rate, {r6('lo / pt')} AS rate_lo, {r6('hi / pt')} AS rate_hi, {HR_OUT}
    FROM counts c JOIN p_lim ON x = w_events LEFT JOIN hr ON hr.outcome = c.outcome AND hr."group" = c."group\"""",
    MULTINOMIAL, censored("multinomial", "follow", ACUTE_BOUND, False, MAIN, extra=", weight"),
    CELLS.format(status="status", w="weight", where=""),
    """counts AS MATERIALIZED (SELECT outcome, "group", count(*) AS n, CAST(sum(status) AS BIGINT) AS events,
      sum(weight * status) AS w_events, sum(weight * "time") AS pt FROM follow GROUP BY outcome, "group")""",
    gamma_limits("p", "counts", "w_events"), NO_KEEP, GRID, TIES, NEWTON, SANDWICH, ROBUST_SE,
)
