"""Reading a matched person table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tideline import schema as S
from tideline.operators.cohort import index_from


def _lacking(found: T.StructType, schema: T.StructType) -> list[str]:
    kinds = {f.name: f.dataType for f in found}
    return [f"{f.name} {f.dataType.simpleString()}" for f in schema if kinds.get(f.name) != f.dataType]


def files_lacking(df: DataFrame, schema: T.StructType) -> DataFrame:
    """file, lacking: the Parquet files behind ``df`` without all columns of ``schema`` in their types, and which.

    Tasks read the footers, a share of the files each. Columns that the folder names give need not be in a file.
    """
    files = df.inputFiles()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column("file").to_pylist():
                system, path = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", file))
                folders = {part.split("=")[0] for part in unquote(path).split("/")[:-1] if "=" in part}
                inside = from_arrow_schema(pq.read_schema(path, filesystem=system))
                lacking = _lacking(inside, T.StructType([f for f in schema if f.name not in folders]))
                if lacking:
                    rows.append((file, ", ".join(lacking)))
            yield pa.RecordBatch.from_pylist(
                [{"file": f, "lacking": c} for f, c in rows], pa.schema([("file", pa.string()), ("lacking", pa.string())])
            )

    spark = df.sparkSession
    named = spark.createDataFrame(pa.table({"file": pa.array(files, pa.string())}))
    tasks = max(1, min(len(files) // 50 + 1, 4 * spark.sparkContext.defaultParallelism))
    return named.repartition(tasks).mapInArrow(check, "file string, lacking string")


def read_cohort(
    spark: SparkSession,
    path: str,
    min_index_date: str = S.STUDY_START,
    schema: T.StructType = S.PERSON_SCHEMA,
    every_file: bool = True,
) -> DataFrame:
    """Person rows with an index date from ``min_index_date`` on; the filter reaches the Parquet scan.

    Every file must have every column of ``schema`` in its type; further columns (covariates) are kept after them.
    Spark itself takes the schema of one file and reads columns that another lacks as NULL, so a job reads
    all footers first; ``every_file=False`` leaves it out, for storage that only Spark's own readers can open.
    """
    found = spark.read.parquet(path)
    wrong = _lacking(found.schema, schema)
    if wrong:
        raise ValueError(f"{path} lacks these columns, or has them in another type: {', '.join(wrong)}")
    if every_file:
        bad = files_lacking(found, schema).limit(5).collect()
        if bad:
            raise ValueError("files without all columns in their types: " + "; ".join(f"{r['file']} ({r['lacking']})" for r in bad))
    more = [c for c in found.columns if c not in schema.names]
    return index_from(found.select(*schema.names, *more), min_index_date)


def snake_name(name: str) -> str:
    """``dx.mi`` -> ``dx_mi``, ``outcome.cv.major.date`` -> ``outcome_cv_major_date``."""
    return S.SOURCE_NAMES.get(name) or re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def snake_case(df: DataFrame) -> DataFrame:
    """Rename dotted or spaced source columns, which would need backticks in every expression."""
    return df.toDF(*[snake_name(c) for c in df.columns])


def normalise_dates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast date columns that arrive as text, timestamps or dates; unreadable text becomes NULL."""
    types = dict(df.dtypes)
    casts = {}
    for c in cols:
        if types[c] == "string":
            casts[c] = F.col(c).try_cast("date")
        elif types[c] != "date":
            casts[c] = F.to_date(c)
    return df.withColumns(casts) if casts else df
