"""A person table built from the TPC-H-like test tables, with the columns of PERSON_SCHEMA.

Item rows are first reduced to one bit mask per customer and day, so a customer that holds a large
share of all orders shrinks to at most one row per day before anything is grouped by customer.
Expressions are SQL text: hundreds of them as Column calls would spend longer in the driver than the
small scale factors take to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline import schema as S

SAMPLE_STUDY_END = "2001-10-01"
INDEX_FROM = "1998-01-01"

# Fixed values: (modulus, remainder) of the part key that stands for each clinical code.
CODES = {f"dx_{flag}": (101, k) for k, flag in enumerate(S.DX_FLAGS)} | {
    "hx_cv_major": (29, 0),
    "hx_cv_stroke": (31, 1),
    "hx_cv_cad": (31, 2),
    "hx_cv_hf": (31, 3),
    "hx_cv_mi": (31, 4),
    "hx_cv_acs": (31, 5),
    "cv_stroke": (7, 0),
    "cv_cad": (7, 1),
    "cv_hf": (11, 2),
    "cv_mi": (17, 4),
    "cv_acs": (19, 5),
    "death": (13, 3),
    "icu": (23, 6),
    "vent": (23, 7),
}
BIT = {name: 1 << i for i, name in enumerate(CODES)}
FLAGS = [c for c in CODES if c[:3] in ("dx_", "hx_")]
FIRSTS = [c for c in CODES if c not in FLAGS and c != "death"]


def _code_days(items: DataFrame, orders: DataFrame) -> DataFrame:
    """(custkey, day, codes): the codes a customer has on a day, as bits."""
    lookups: dict[int, list[int]] = {}
    for name, (m, r) in CODES.items():
        lookups.setdefault(m, [0] * m)[r] = BIT[name]
    mask = " | ".join(
        f"get(array({', '.join(f'{b}L' for b in bits)}), CAST(l_partkey % {m} AS INT))" for m, bits in lookups.items()
    )
    coded = items.selectExpr("l_orderkey AS o_orderkey", "to_date(l_shipdate) AS day", f"{mask} AS codes").where("codes <> 0")
    owned = coded.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return _aggregate(owned, "o_custkey, day", ["bit_or(codes) AS codes"])


def _doses(orders: DataFrame) -> DataFrame:
    """The first five urgent orders per customer, as columns.

    The rank filter lets Spark cut each customer to five rows per input partition before the shuffle.
    """
    ranked = orders.where("o_orderpriority = '1-URGENT'").selectExpr(
        "o_custkey", "o_orderdate", "o_orderkey",
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dose_no",
    ).where("dose_no <= 5")
    doses = ranked.selectExpr(
        "o_custkey", "dose_no", "to_date(o_orderdate) AS day",
        "CASE WHEN o_orderkey % 53 <> 0 THEN IF((o_custkey % 2 = 0) <> (o_orderkey % 20 = 0), 'BNT', 'Sino') END AS brand",
    )
    picks = [f"max(IF(dose_no = {k}, day, NULL)) AS dose{k}_date" for k in range(1, 6)]
    picks += [f"max(IF(dose_no = {k}, brand, NULL)) AS brand{k}" for k in range(1, 5)]
    return _aggregate(doses, "o_custkey", picks)


def _aggregate(df: DataFrame, key: str, aggregates: list[str]) -> DataFrame:
    return df.sparkSession.sql(f"SELECT {key}, {', '.join(aggregates)} FROM {{rows}} GROUP BY {key}", rows=df)


def person_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_shipdate")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS o_custkey", "c_nationkey", "c_mktsegment"
    )
    recent = orders.where(f"o_orderdate >= TIMESTAMP_NTZ '{INDEX_FROM} 00:00:00'")
    index = _aggregate(recent, "o_custkey", ["to_date(min(o_orderdate)) AS index_date"])

    facts = [f"max(IF(day < index_date AND codes & {BIT[c]}L <> 0, 1, 0)) AS {c}" for c in FLAGS]
    facts += [f"min(IF(day >= index_date AND codes & {BIT[c]}L <> 0, day, NULL)) AS first_{c}" for c in FIRSTS]
    facts.append(f"min(IF(day >= index_date - 10 AND codes & {BIT['death']}L <> 0, day, NULL)) AS death_date")
    history = _aggregate(index.join(_code_days(items, orders), "o_custkey"), "o_custkey", facts)

    joined = index.join(customers, "o_custkey").join(_doses(orders), "o_custkey", "left").join(history, "o_custkey", "left")
    return joined.selectExpr(
        "o_custkey AS subject_id",
        "CASE WHEN o_custkey % 97 <> 0 THEN o_custkey DIV 5 END AS match",
        "IF(c_nationkey % 2 = 0, 'M', 'F') AS sex",
        "CAST(year(index_date) - (15 + o_custkey % 75) AS INT) AS birth_year",
        "index_date",
        "index_date AS covid_date",
        "IF(o_custkey % 10 = 9, 0, 1) AS infected",
        "IF(o_custkey % 3 = 0, 'PCR', 'RAT') AS test_type",
        "death_date",
        "first_icu AS icu_date",
        "first_vent AS vent_date",
        *S.ALL_DOSE_DATES,
        *S.BRANDS,
        *[f"coalesce({c}, 0) AS {c}" for c in FLAGS],
        "least(first_cv_stroke, first_cv_cad, first_cv_hf, first_cv_mi) AS outcome_cv_major_date",
        *[f"first_{o} AS outcome_{o}_date" for o in FIRSTS if o.startswith("cv_")],
        "IF(o_custkey % 2 = 0, death_date, NULL) AS outcome_cv_death_date",
        "death_date AS outcome_death_date",
        "c_mktsegment AS segment",
    )
